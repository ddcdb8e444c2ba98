"""Point-in-time joins: as-of lookups, interval histories and forward event windows.

As-of lookups are a merge of both sides into one row per (entity, instant) followed by
a last-seen window over a short time cell, with one carried value per cell. Lookups in
histories whose intervals do not overlap are as-of lookups too. Overlapping histories are cut into segments that
instants meet by equality; the candidates are reduced with a partial aggregate.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPEN_END = "2099-12-31"


def time_cell(df: DataFrame, col: str) -> Column:
    """Day number for dates, minute number for timestamps (monotone in time)."""
    days = F.datediff(F.to_date(col), F.lit("1970-01-01").cast("date"))
    if isinstance(df.schema[col].dataType, T.DateType):
        return days.cast("long")
    return (days.cast("long") * 1440 + F.hour(col) * 60 + F.minute(col)).cast("long")


def _met(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the rows, brought together by its keys. The planner does not see how many segments an interval is cut
    into, or how much a hash table takes, and would collect such a side on the driver to send all of it to every task."""
    return df.hint("merge")


def nearest_event(
    anchors: DataFrame,
    events: DataFrame,
    by: Sequence[str],
    at: str,
    when: str,
    payload: Sequence[str] = (),
    forward: bool = True,
    keep: str = "min",
    known: str | None = None,
) -> DataFrame:
    """First event at or after (or last at or before) each distinct anchor.

    Returns (by, at, when, payload); NULL where there is none. Ties at one instant
    keep the smallest (``keep="max"``: largest) payload. ``known`` names a payload column:
    the struct column ``_known`` is the nearest event in which it is not NULL.
    """
    by = list(by)
    body = F.struct(F.col(when).alias("t"), *[F.col(c).alias(c) for c in payload])
    hit_type = events.select(body.alias("h")).schema["h"].dataType
    side_a = anchors.where(F.col(at).isNotNull()).select(
        *by, F.col(at).alias("_t"), F.lit(None).cast(hit_type).alias("_hit"), F.lit(1).alias("_is_anchor")
    )
    side_e = events.where(F.col(when).isNotNull()).select(
        *by, F.col(when).alias("_t"), body.alias("_hit"), F.lit(0).alias("_is_anchor")
    )
    hits = {"": F.col("_hit")} | ({"_known": F.when(F.col(f"_hit.{known}").isNotNull(), F.col("_hit"))} if known else {})
    best = F.min if keep == "min" else F.max
    merged = side_a.unionByName(side_e).groupBy(*by, "_t").agg(
        *[best(h).alias(f"_hit{n}") for n, h in hits.items()], F.max("_is_anchor").alias("_is_anchor")
    )
    merged = merged.withColumn("_slot", time_cell(merged, "_t"))
    order = F.col("_t").desc() if forward else F.col("_t").asc()
    inside = Window.partitionBy(*by, "_slot").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    end = F.min if forward else F.max
    per_cell = merged.groupBy(*by, "_slot").agg(*[end(f"_hit{n}").alias(f"_cell{n}") for n in hits])
    order = F.col("_slot").desc() if forward else F.col("_slot").asc()
    across = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    carried = per_cell.select(*by, "_slot", *[F.last(f"_cell{n}", ignorenulls=True).over(across).alias(f"_carry{n}") for n in hits])
    near = merged.withColumns({f"_near{n}": F.last(f"_hit{n}", ignorenulls=True).over(inside) for n in hits})
    found = near.where("_is_anchor = 1").join(_met(carried), [*by, "_slot"])
    found = found.withColumns({f"_best{n}": F.coalesce(f"_near{n}", f"_carry{n}") for n in hits})
    return found.select(
        *by, F.col("_t").alias(at), F.col("_best.t").alias(when), *[F.col(f"_best.{c}").alias(c) for c in payload],
        *([F.col("_best_known").alias("_known")] if known else []),
    )


def forward_label(
    rows: DataFrame,
    events: DataFrame,
    by: Sequence[str],
    anchor: str,
    when: str,
    reach: str,
    code: str | None = None,
    label: str = "label",
) -> DataFrame:
    """Label rows whose closed window [anchor, anchor + reach] holds an event.

    ``reach`` is an interval literal such as ``"365 DAYS"``. Adds the label, the
    first event time and (with ``code``) the first code that is not NULL in the window
    (which may belong to a later event); NULL outside the window.
    """
    payload = [code] if code else []
    nxt = nearest_event(rows, events, by, anchor, when, payload, known=code)
    last = window_end(f"_r.{anchor}", reach, rows.schema[anchor].dataType)
    inside = F.col(f"_e.{when}") <= last
    cond = F.col(f"_r.{anchor}") == F.col(f"_e.{anchor}")
    for c in by:
        cond = cond & (F.col(f"_r.{c}") == F.col(f"_e.{c}"))
    joined = rows.alias("_r").join(_met(nxt.alias("_e")), cond, "left")
    return joined.select(
        "_r.*",
        F.coalesce(inside, F.lit(False)).cast("int").alias(label),
        F.when(inside, F.col(f"_e.{when}")).alias(when),
        *[F.when(F.col("_e._known.t") <= last, F.col(f"_e._known.{c}")).alias(c) for c in payload],
    )


def window_end(anchor: str, reach: str, dtype: T.DataType) -> Column:
    end = F.expr(f"{anchor} + INTERVAL {reach}")
    return end.cast("date") if isinstance(dtype, T.DateType) else end


def unique_forward_label(
    rows: DataFrame,
    events: DataFrame,
    by: Sequence[str],
    anchor: str,
    when: str,
    reach: str,
    row_key: Sequence[str],
    label: str = "label",
    code: str | None = None,
) -> DataFrame:
    """Each event labels only the latest row whose window reaches it.

    Adds the first assigned event's time, the label and (with ``code``) the first code that is not NULL
    among the assigned events; events at one instant give their smallest code."""
    row_key = list(row_key)
    prev = nearest_event(
        events, rows.select(*by, *row_key, anchor), by, when, anchor, row_key, forward=False, keep="max"
    )
    reached = prev.where(F.col(when) <= window_end(anchor, reach, rows.schema[anchor].dataType))
    took = [F.min(when).alias(when)]
    if code:
        codes = events.where(F.col(when).isNotNull()).groupBy(*by, when).agg(F.min(code).alias(code))
        reached = reached.join(_met(codes), [*by, when])
        took.append(F.min(F.when(F.col(code).isNotNull(), F.struct(when, code)))[code].alias(code))
    first = reached.groupBy(*by, anchor, *row_key).agg(*took)
    joined = rows.join(_met(first), [*by, anchor, *row_key], "left")
    return joined.withColumn(label, F.col(when).isNotNull().cast("int"))


def close_open_ends(df: DataFrame, end: str) -> DataFrame:
    return df.withColumn(end, F.coalesce(F.col(end).cast("date"), F.lit(OPEN_END).cast("date")))


def valid_at(
    rows: DataFrame,
    history: DataFrame,
    by: Sequence[str],
    at: str,
    start: str,
    end: str,
    how: str = "left",
    disjoint: bool = False,
) -> DataFrame:
    """Rows joined to every history interval (closed bounds) holding ``at``.

    ``disjoint`` says that an entity's intervals do not overlap: then the last one to start is the only candidate, found by an as-of
    lookup without pairs. Otherwise intervals are cut into segments of powers of 2^``RADIX_BITS`` and an instant asks for the segment that it lies in on each
    level: they meet by equality, once for each interval that holds the instant and never else. The span of the rows
    limits the cut of open-ended intervals. Equal (by, at) are looked up once.
    """
    by = list(by)
    if disjoint:
        rest = [c for c in history.columns if c not in (*by, start)]
        known = history.where(F.col(start) <= F.col(end)).select(*by, F.col(start).alias("_start"), *[F.col(c).alias(f"_h_{c}") for c in rest])
        last = nearest_event(rows, known, by, at, "_start", [f"_h_{c}" for c in rest], forward=False, keep="max")
        hit = last.where(F.col("_start").isNotNull() & (F.col(at) <= F.col(f"_h_{end}")))
        if how in ("left_semi", "left_anti"):
            return rows.join(_met(hit.select(*by, at)), [*by, at], how).select(*rows.columns)
        hit = hit.select(*[F.col(c).alias(f"_k_{c}") for c in (*by, at)], *[F.col("_start" if c == start else f"_h_{c}").alias(f"_v_{c}") for c in (start, *rest)])
        cond = F.lit(True)
        for c in (*by, at):
            cond = cond & (F.col(c) == F.col(f"_k_{c}"))
        joined = rows.join(_met(hit), cond, how)
        return joined.select(*rows.columns, *[F.col(f"_v_{c}").alias(c) for c in history.columns if c not in rows.columns])
    points = rows.select(*by, at).where(F.col(at).isNotNull()).distinct()
    ticks = _ticks([rows.schema[at].dataType, history.schema[start].dataType, history.schema[end].dataType])
    low, high = points.agg(F.min(ticks(F.col(at))), F.max(ticks(F.col(at)))).first()
    low, span = (0, 0) if low is None else (low, high - low)
    levels = max(1, -(-span.bit_length() // RADIX_BITS))
    place = ticks(F.col(at)) - F.lit(low)
    dealt = points.withColumn("_s", F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.shiftright(place, RADIX_BITS * k).alias("at")) for k in range(levels)])))
    first, last = F.greatest(ticks(F.col(start)) - F.lit(low), F.lit(0).cast("long")), F.least(ticks(F.col(end)) - F.lit(low), F.lit(span).cast("long"))
    cut = history.where((F.col(start) <= F.col(end)) & (first <= last)).withColumn("_s", F.explode(_segments(first, last, levels)))
    cut = cut.select("_s", *[F.col(c).alias(f"_h_{c}") for c in history.columns])
    own = dealt.select("_s", *by, at)
    pairs = own.join(_met(cut), (own["_s"] == cut["_s"]) & _same(own, cut, by), "inner" if how not in ("left_semi", "left_anti") else "left_semi").drop("_s")
    pairs = pairs.select(*[F.col(c).alias(f"_k_{c}") for c in (*by, at)], *[c for c in pairs.columns if c.startswith("_h_")])
    if how in ("left_semi", "left_anti"):
        pairs = pairs.distinct()
    cond = F.lit(True)
    for c in (*by, at):
        cond = cond & (rows[c] == pairs[f"_k_{c}"])
    joined = rows.join(_met(pairs), cond, how)
    if how in ("left_semi", "left_anti"):
        return joined.select(*rows.columns)
    return joined.select(*rows.columns, *[F.col(f"_h_{c}").alias(c) for c in history.columns if c not in rows.columns])


#: Bits by which the segments of one level are longer than those below.
RADIX_BITS = 3


def _ticks(kinds: Sequence[T.DataType]) -> Callable[[Column], Column]:
    """Days if all are dates, else microseconds (of the clock for times without a zone, which no change of summer time disturbs)."""
    if all(isinstance(k, T.DateType) for k in kinds):
        return lambda c: F.unix_date(c).cast("long")
    if not any(isinstance(k, T.TimestampNTZType) for k in kinds):
        return lambda c: F.unix_micros(c.cast("timestamp"))

    def clock(c: Column) -> Column:
        c = c.cast("timestamp_ntz")
        minutes = (F.unix_date(c.cast("date")).cast("long") * 24 + F.hour(c)) * 60 + F.minute(c)
        return minutes * 60_000_000 + (F.date_part(F.lit("SECOND"), c) * 1_000_000).cast("long")

    return clock


def _same(left: DataFrame, right: DataFrame, by: Sequence[str]) -> Column:
    out = F.lit(True)
    for c in by:
        out = out & (left[c] == right[f"_h_{c}"])
    return out


def _segments(first: Column, last: Column, levels: int) -> Column:
    """The segments (level, at) that make up the whole numbers from ``first`` to ``last``: a segment of level k is 2^(RADIX_BITS k) numbers
    long and begins at a multiple of that. Every number lies in one of them; there are fewer than 2^(RADIX_BITS + 1) on each level."""
    none = F.array().cast("array<struct<level:int,at:bigint>>")
    width = 1 << RADIX_BITS

    def run(level: Column, a: Column, b: Column) -> Column:
        return F.when(b > a, F.transform(F.sequence(a, b - 1), lambda i: F.struct(level.alias("level"), i.alias("at")))).otherwise(none)

    def step(held: Column, level: Column) -> Column:
        a, b = held["a"], held["b"]
        up, down = F.shiftright(a + F.lit(width - 1), RADIX_BITS), F.shiftright(b, RADIX_BITS)
        top = (up >= down) | (level == levels - 1)
        own = F.when(top, run(level, a, b)).otherwise(F.concat(run(level, a, up * width), run(level, down * width, b)))
        zero = F.lit(0).cast("long")
        return F.struct(F.when(top, zero).otherwise(up).alias("a"), F.when(top, zero).otherwise(down).alias("b"), F.concat(held["out"], own).alias("out"))

    start = F.struct(first.cast("long").alias("a"), (last + 1).cast("long").alias("b"), none.alias("out"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(levels - 1)), start, step, lambda held: held["out"])


def best_valid(
    rows: DataFrame,
    history: DataFrame,
    by: Sequence[str],
    at: str,
    start: str,
    end: str,
    row_key: Sequence[str],
    order: Sequence[Column],
    take: Sequence[str],
    how: str = "left",
    disjoint: bool = False,
) -> DataFrame:
    """One valid history row per row: the smallest by ``order`` (ascending columns). ``disjoint`` as in ``valid_at``.

    The choice is a min over a struct, so candidates combine before the shuffle.
    """
    slim = rows.select(*dict.fromkeys([*row_key, *by, at]))
    pairs = valid_at(slim, history, by, at, start, end, "inner", disjoint)
    ranked = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], *[F.col(c).alias(c) for c in take])
    best = pairs.groupBy(*row_key).agg(F.min(ranked).alias("_b")).select(
        *row_key, *[F.col(f"_b.{c}").alias(c) for c in take]
    )
    return rows.join(_met(best), list(row_key), how)
