"""Scans, schema resolution and sinks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "labels": "doc_id long, quality int, toxic int",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "embeddings": "vec_id long, embedding array<float>, label int",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Parquet scan under the declared schema (no inference job)."""
    reader = spark.read.schema(SCHEMAS[name]) if name in SCHEMAS else spark.read
    return reader.parquet(f"{folder}/{name}.parquet")


def resolve_columns(df: DataFrame, wanted: dict[str, Sequence[str]], optional: Sequence[str] = ()) -> DataFrame:
    """Project ``wanted``: target name -> candidate source names, first present wins.

    A missing optional column becomes NULL, a missing required one raises.
    """
    have = {c.lower(): c for c in df.columns}
    cols = []
    for target, names in wanted.items():
        hit = next((have[n.lower()] for n in names if n.lower() in have), None)
        if hit is None and target not in optional:
            raise KeyError(f"none of {list(names)} found for column {target!r}")
        cols.append((F.col(hit) if hit else F.lit(None)).alias(target))
    return df.select(*cols)


def check_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Raise when a declared column is absent or has another type."""
    have = {f.name: f.dataType for f in df.schema.fields}
    wrong = [
        f"{f.name}: want {f.dataType.simpleString()}, have {have[f.name].simpleString() if f.name in have else 'none'}"
        for f in schema.fields
        if have.get(f.name) != f.dataType
    ]
    if wrong:
        raise ValueError("schema mismatch: " + "; ".join(wrong))
    return df.select(*[f.name for f in schema.fields])


def nan_to_null(df: DataFrame) -> DataFrame:
    """Only NULL means missing downstream."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(*[F.nanvl(c, F.lit(None)).alias(c) if c in floats else F.col(c) for c in df.columns])


def read_deflator(spark: SparkSession, path: str, base_year: int) -> DataFrame:
    """Annual ``year,deflator`` or quarterly ``observation_date,GDPDEF`` CSV, base year = 1."""
    raw = spark.read.csv(path, header=True)
    cols = {c.lower(): c for c in raw.columns}
    if "year" in cols and "deflator" in cols:
        obs = raw.select(F.col(cols["year"]).cast("long").alias("year"), F.col(cols["deflator"]).cast("double").alias("level"))
    elif "observation_date" in cols and "gdpdef" in cols:
        obs = raw.select(
            F.year(F.to_date(cols["observation_date"])).cast("long").alias("year"),
            F.col(cols["gdpdef"]).cast("double").alias("level"),
        )
    else:
        raise ValueError("expected columns year,deflator or observation_date,GDPDEF")
    out = rebase(obs, base_year)
    if out.where(F.col("year") == base_year).isEmpty():
        raise ValueError(f"base year {base_year} is not in the deflator file")
    return out


def rebase(obs: DataFrame, base_year: int) -> DataFrame:
    """Average ``level`` by year and divide by the base year's average."""
    annual = obs.groupBy("year").agg(F.avg("level").alias("level"))
    base = annual.where(F.col("year") == base_year).select(F.col("level").alias("base_level"))
    return annual.join(F.broadcast(base), F.lit(True)).select(
        "year", (F.col("level") / F.col("base_level")).alias("deflator")
    )


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_report_csv(df: DataFrame, path: str) -> None:
    """Report tables (tens of rows) as one CSV with a header."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def append_ledger(df: DataFrame, path: str) -> None:
    df.withColumn("logged_at", F.current_timestamp()).write.mode("append").parquet(path)


def use_checkpoint_dir(spark: SparkSession) -> None:
    """Point checkpoints at the shared folder named in spark.checkpoint.dir.

    A temporary folder is used only in local mode with nothing configured (tests).
    """
    if spark.sparkContext.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
        folder = tempfile.mkdtemp(prefix="tidemark-")
    spark.sparkContext.setCheckpointDir(folder)


def staged(df: DataFrame) -> DataFrame:
    """Write a stage's table to the checkpoint folder and read it back, so the many fits
    that follow scan columns instead of repeating the joins; it survives lost executors."""
    spark = df.sparkSession
    use_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/fitted-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fitted(df: DataFrame) -> DataFrame:
    """The same for a small fitted table (bounds, fill values, edges): scanned, not refitted."""
    return staged(df)
