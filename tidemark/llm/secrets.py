"""Secret scan with DataFrame functions only: fixed patterns and sliding-window entropy.

Places count code points, ends are exclusive. Kinds, in the order used for ties: assign, access, hex (patterns), then
entropy_hex, entropy_base64 and entropy_one_case (windows of high Shannon entropy in candidate strings).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed patterns.
ASSIGN = r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd])|(?:[Pp][Aa][Ss][Ss][Ww][Dd])|(?:[Ss][Ee][Cc][Rr][Ee][Tt])|(?:[Tt][Oo][Kk][Ee][Nn])|(?:[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
LEAST_VALUE = 8
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64", "entropy_one_case")

#: Candidate strings: whole runs of these characters, of one window's length at least.
WINDOW = 20
CANDIDATE = rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{WINDOW},}}+"
#: Least entropy (bits per character) of a window of hex digits, of one with letters of both cases, and of one of digits and letters of one case without
#: other signs; least digits of the last.
HEX_BITS, BASE64_BITS, ONE_CASE_BITS, ONE_CASE_DIGITS = 3.0, 3.9, 3.6, 3
#: Candidates that match one of these as a whole are harmless: UUIDs, runs of one repeated sign.
ALLOW = (
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
    r"(.)\1*",
)
#: Pieces of letters and digits in a candidate that hold one of these are harmless: their characters count as ``=``, what stands beside them does not.
ALLOW_WORDS = r"EXAMPLE|example|PLACEHOLDER|placeholder|0123456789abcdef|0123456789ABCDEF|abcdefghijklmnop|ABCDEFGHIJKLMNOP"
PIECE = "[A-Za-z0-9]+"
#: Entropy is kept in whole units of 2^-20 bits, so that steps in and out of a window cancel exactly.
UNIT = 1 << 20
_WEIGHT = [0] + [round(c * math.log2(c) * UNIT) for c in range(1, WINDOW + 1)]


def most_weight(bits: float) -> int:
    """Greatest sum of c*log2(c) over a window's character counts, in units, at an entropy of ``bits`` or more."""
    return math.floor((math.log2(WINDOW) - bits) * WINDOW * UNIT)


def _let(value: Column, body) -> Column:
    """``body`` of ``value`` worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _places(text: Column, pattern: str) -> Column:
    """array<struct<s,e>> of all matches, leftmost first: what lies between matches gives their places."""
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps, lengths = F.transform(between, F.length), F.transform(found, F.length)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int>>").alias("out"))

    def step(acc: Column, gap_and_length: Column) -> Column:
        s = acc["at"] + gap_and_length["g"]
        e = s + gap_and_length["n"]
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e")))).alias("out"))

    steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(lengths)), lengths, lambda g, n: F.struct(g.alias("g"), n.alias("n")))
    return F.aggregate(steps, zero, step)["out"]


def _spans(places: Column, kind: int) -> Column:
    return F.transform(places, lambda p: F.struct(p["s"].alias("s"), F.lit(kind).alias("k"), p["e"].alias("e")))


def _none() -> Column:
    return F.array().cast("array<struct<s:int,k:int,e:int>>")


def _assigned(text: Column) -> Column:
    values = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    both = F.zip_with(_places(text, ASSIGN), values, lambda p, v: F.struct(p["s"].alias("s"), F.lit(0).alias("k"), p["e"].alias("e"), F.length(v).alias("n")))
    return F.transform(F.filter(both, lambda x: x["n"] >= LEAST_VALUE), lambda x: F.struct(x["s"], x["k"], x["e"]))


def windows(candidate: Column, start: Column) -> Column:
    """array<struct<s,k,e>>: spans covered by a candidate's windows of high entropy, for each class of characters.

    One pass over the characters: the counts of a window and the sum of c*log2(c) change by the character that comes in and the
    one that goes out. A window of hex digits needs a digit and a letter; any other needs a digit and letters of both cases, or
    ``ONE_CASE_DIGITS`` digits, letters of one case and no other sign. Windows of a kind that overlap or touch are one span."""
    code = F.transform(F.split(candidate, ""), F.ascii)
    weight = F.array(*[F.lit(w).cast("long") for w in _WEIGHT])
    digit = lambda c: c.between(48, 57)
    upper = lambda c: c.between(65, 90)
    lower = lambda c: c.between(97, 122)
    letter_hex = lambda c: c.between(65, 70) | c.between(97, 102)
    tests = {"other": lambda c: ~(digit(c) | letter_hex(c)), "digits": digit, "uppers": upper, "lowers": lower}
    bit = lambda test: test.cast("int")
    span = lambda s, k, e: F.struct((start + s).alias("s"), F.lit(k).alias("k"), (start + e).alias("e"))

    def scan(codes: Column, weights: Column) -> Column:
        zero = F.struct(
            F.transform(F.sequence(F.lit(0), F.lit(127)), lambda _: F.lit(0)).alias("counts"), F.lit(0).cast("long").alias("sum"),
            *[F.lit(0).alias(n) for n in tests], *[F.lit(-1).alias(n) for n in ("s3", "e3", "s4", "e4", "s5", "e5")], _none().alias("out"),
        )

        def step(acc: Column, i: Column) -> Column:
            new, old = codes[i], F.when(i >= WINDOW, F.get(codes, i - WINDOW)).otherwise(F.lit(-1))
            came = F.get(acc["counts"], new)
            went = F.when(old >= 0, F.get(acc["counts"], old)).otherwise(0)
            total = F.when(new == old, acc["sum"]).otherwise(
                acc["sum"] + F.get(weights, came + 1) - F.get(weights, came) + F.when(went > 0, F.get(weights, went - 1) - F.get(weights, went)).otherwise(0)
            )
            counts = F.transform(acc["counts"], lambda c, at: c + bit(at == new) - bit(at == old))
            first = F.struct(counts.alias("counts"), total.alias("sum"), *[(acc[n] + bit(t(new)) - bit((old >= 0) & t(old))).alias(n) for n, t in tests.items()])

            def settle(x: Column) -> Column:
                whole, mixed = i >= WINDOW - 1, x["digits"] > 0
                is_hex = x["other"] == 0
                hot3 = whole & is_hex & mixed & (x["digits"] < WINDOW) & (x["sum"] <= most_weight(HEX_BITS))
                hot4 = whole & ~is_hex & mixed & (x["uppers"] > 0) & (x["lowers"] > 0) & (x["sum"] <= most_weight(BASE64_BITS))
                one_case = (x["uppers"] == 0) != (x["lowers"] == 0)
                hot5 = whole & ~is_hex & one_case & (x["digits"] >= ONE_CASE_DIGITS) & (x["digits"] + x["uppers"] + x["lowers"] == WINDOW) & (x["sum"] <= most_weight(ONE_CASE_BITS))
                a, e = i - (WINDOW - 1), i + 1
                fields, closed = [], [acc["out"]]
                for k, hot, s0, e0 in ((k, hot, acc[f"s{k}"], acc[f"e{k}"]) for k, hot in ((3, hot3), (4, hot4), (5, hot5))):
                    fresh = hot & ((s0 < 0) | (a > e0))
                    fields += [F.when(fresh, a).otherwise(s0).alias(f"s{k}"), F.when(hot, e).otherwise(e0).alias(f"e{k}")]
                    closed.append(F.when(fresh & (s0 >= 0), F.array(span(s0, k, e0))).otherwise(_none()))
                return F.struct(x["counts"], x["sum"], *[x[n] for n in tests], *fields, F.concat(*closed).alias("out"))

            return _let(first, settle)

        def finish(acc: Column) -> Column:
            return F.concat(acc["out"], *[F.when(acc[f"s{k}"] >= 0, F.array(span(acc[f"s{k}"], k, acc[f"e{k}"]))).otherwise(_none()) for k in (3, 4, 5)])

        return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), zero, step, finish)

    return _let(code, lambda codes: _let(weight, lambda weights: scan(codes, weights)))


def _harmless_out(candidate: Column) -> Column:
    """The candidate with ``=`` for every character of a piece that holds an allowed word; its length stays."""
    between, found = F.split(candidate, PIECE, -1), F.regexp_extract_all(candidate, F.lit(PIECE), F.lit(0))
    written = F.transform(found, lambda x: F.when(F.rlike(x, F.lit(ALLOW_WORDS)), F.repeat(F.lit("="), F.length(x))).otherwise(x))
    rebuilt = F.array_join(F.zip_with(between, written, lambda g, x: F.concat(g, F.coalesce(x, F.lit("")))), "")
    return F.when(F.rlike(candidate, F.lit(ALLOW_WORDS)), rebuilt).otherwise(candidate)


def _entropy(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))
    both = F.zip_with(found, _places(text, CANDIDATE), lambda c, p: F.struct(c.alias("c"), p["s"].alias("s")))
    allowed = lambda c: F.rlike(c, F.lit(r"\A(?:" + "|".join(ALLOW) + r")\z"))
    suspect = F.filter(both, lambda x: ~allowed(x["c"]) & F.rlike(x["c"], F.lit("[0-9]")))
    return F.flatten(F.transform(suspect, lambda x: windows(_harmless_out(x["c"]), x["s"])))


def _written(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, base (array of s, k, e) and spans (the same with entropy spans), both ordered by start, then kind.

    A null text is empty. Every match is found in whole texts; a text that no pattern can match is passed over by one test per
    pattern. Repeated keys give a row each, null keys stay null, other columns are ignored. An empty table gives an empty table."""
    x = F.coalesce(F.col(text), F.lit(""))
    only = lambda pattern, value: F.when(F.rlike(F.col("_x"), F.lit(pattern)), value).otherwise(_none())
    t = F.col("_x")
    found = docs.select(F.col(key).alias("_key"), x.alias("_x"))
    base = F.array_sort(F.concat(only(ASSIGN, _assigned(t)), only(ACCESS, _spans(_places(t, ACCESS), 1)), only(HEX, _spans(_places(t, HEX), 2))))
    return (
        found.select("_key", base.alias("base"), only(CANDIDATE, _entropy(t)).alias("more"))
        .select(F.col("_key").alias(key), "base", F.array_sort(F.concat("base", "more")).alias("spans"))
    )


def report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, n_assign, n_access, n_hex, base_sha256 and spans of every row: see ``scan``."""
    found = scan(docs, key, text)
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return found.select(key, *map(count, range(3)), F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"))
