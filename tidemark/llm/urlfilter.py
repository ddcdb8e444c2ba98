"""URL filters: host-suffix and path-prefix expressions of each URL meet the rules on short hash prefixes.

A rule is a host, a path and a verdict. It fits the URLs of its host and of all hosts below it whose path starts with
its own. The expressions of a URL are the pairs of a host suffix and a path prefix that a rule could have: one for each
shape (number of labels, length of the path) that occurs among the rules.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import spread_lookup, stage

#: Hex digits of the hash prefix that expressions and rules are joined on.
PREFIX = 8
#: Rows of the rule table ``RULES`` (fixed by the query's contract).
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """(host, path, verdict) of a list of rules."""
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased) and path (from there up to ``?``, ``#`` or the
    end) of a URL. Null, or no ``://``: both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def _labels(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def _digest(host: Column, path: Column) -> Column:
    """SHA-256 of an expression. No host holds the slash between the two."""
    return F.sha2(F.concat(host, F.lit("/"), path), 256)


def filter_urls(urls: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``urls`` with host, path, rule (the rule's host and path, null if none fits) and verdict (the rule's, else ``default``).

    The longest rule wins: of the rules that fit a URL, the one with most code points of host and path together, among equals the one with the
    longer host. Rules that repeat with different verdicts block if one of them does (verdicts are compared as text, ``block`` first).
    Rules with a null or empty host, a null path, a null verdict or a host that no URL can have (capitals, ``/?#``) fit nothing.

    URLs are first brought down to their sites (host and as much of the path as the longest rule has), so a host that holds a third of
    all rows is looked up once. The expressions of all sites are made distinct before they meet the rules on ``PREFIX`` hex digits
    of their SHA-256; the whole digest confirms. Joins back to expressions, sites and rows send keys that hold a large share to all tasks and
    shuffle the rest (``spread_lookup``). Null URLs, texts without ``://`` and empty ones have an empty host and path and get the
    default; long ones are cut by nothing but the rules' longest path. Repeated rows are each answered. An empty table gives an empty
    table. Columns named host, path, rule or verdict are replaced, others kept."""
    known = rules.where("host is not null and path is not null and verdict is not null and host <> '' and not host rlike '[A-Z/?#]'")
    known = known.groupBy("host", "path").agg(F.max_by("verdict", F.struct(F.col("verdict") == "block", "verdict")).alias("verdict"))
    known = known.select("host", "path", "verdict", _digest(F.col("host"), F.col("path")).alias("digest"))
    known = stage(known.withColumn("prefix", F.substring("digest", 1, PREFIX)), "rules")
    shapes = known.groupBy(_labels(F.col("host")).alias("labels"), F.length("path").alias("size")).agg(F.lit(1).alias("one"))
    # one row; a host has at most 127 labels and the shapes are those of the rules
    shape = shapes.agg(F.collect_set(F.struct("labels", "size")).alias("shapes"), F.coalesce(F.max("size"), F.lit(0)).alias("reach")).first()
    kept = [c for c in urls.columns if c not in ("host", "path", "rule", "verdict")]
    host, path = host_and_path(F.col(url).cast("string"))
    rows = urls.select(*kept, host.alias("host"), path.alias("path"))
    rows = rows.withColumn("site_path", F.substring("path", 1, shape["reach"]) if shape["reach"] else F.lit(""))
    sites = rows.groupBy("host", "site_path").agg(F.count(F.lit(1)).alias("n"))

    listed = F.array(*[F.struct(F.lit(s["labels"]).alias("labels"), F.lit(s["size"]).alias("size")) for s in shape["shapes"]]) if shape["shapes"] else F.array().cast("array<struct<labels:int,size:int>>")
    fitting = F.filter(listed, lambda s: (s["labels"] <= _labels(F.col("host"))) & (s["size"] <= F.length("site_path")))
    made = F.transform(fitting, lambda s: _digest(F.call_function("substring_index", F.col("host"), F.lit("."), -s["labels"]), F.substring(F.col("site_path"), F.lit(1), s["size"])))
    sites = stage(sites.where("host <> ''").select("host", "site_path", F.array_distinct(made).alias("made")), "sites")
    asked = sites.select("host", "site_path", F.explode("made").alias("digest"))
    distinct = asked.select("digest").distinct().withColumn("prefix", F.substring("digest", 1, PREFIX))
    met = distinct.join(known.withColumnRenamed("digest", "full"), "prefix").where(F.col("digest") == F.col("full"))
    found = stage(met.select("digest", F.struct((F.length("host") + F.length("path")).alias("size"), F.length("host").alias("host_size"), F.concat(F.col("host"), F.col("path")).alias("rule"), "verdict").alias("best")), "found")
    fits = spread_lookup(asked, found, ["digest"], inner=True)
    decided = stage(fits.groupBy("host", "site_path").agg(F.max("best").alias("best")).select("host", "site_path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict")), "decided")
    out = spread_lookup(rows, decided, ["host", "site_path"])
    return out.select(*kept, "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
