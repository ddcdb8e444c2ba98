"""Exact metric range join of vectors by cosine: pivots, boundary replication, independent cells."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cells, spanning, stage
from tidemark.llm.components import components

#: Pivots for each vector length; vectors of one role that a task compares at once.
PIVOTS, CHUNK = 12, 4096
#: Slack for rounding in the distances that decide replication; the cosine itself is compared without slack.
SLACK = 1e-9


def usable(vector: str) -> F.Column:
    """The vector is there, has components, none null or non-finite, and is not zero."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return F.coalesce(F.forall(F.col(vector), finite) & F.exists(F.col(vector), lambda x: x != 0), F.lit(False))


def unit(v: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; scaled by their largest component first, so that squares neither overflow nor vanish."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _classes(vectors: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """A row for each (label, vector): copies meet as one class. v is the vector in double precision."""
    return (
        vectors.where(F.col(label).isNotNull() & usable(vector))
        .groupBy(F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"))
        .agg(F.min(key).alias("first"), F.count(F.lit(1)).alias("copies"))
        .withColumn("node", F.monotonically_increasing_id())
    )


def _pivots(classes: DataFrame, pivots: int) -> dict[int, np.ndarray]:
    """Pivots by vector length: the first by hash, a bounded choice that no result depends on."""
    lengths = [r[0] for r in classes.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(16).collect()]
    out = {}
    for n in lengths:
        rows = classes.where(F.size("v") == n).orderBy(F.xxhash64("v"), "node").limit(pivots).select("v").collect()
        out[n] = unit(np.array([r[0] for r in rows], float))
    return out


def _dealt(classes: DataFrame, pivots: int, radius: float) -> DataFrame:
    """(label, n, pivot, home, node, copies, v): each class at its nearest pivot (home), and copied to every pivot whose cell
    may hold a vector within ``radius``: if x is at home with p, and y with q, then d(y,p) <= d(x,p) + r <= d(x,q) + r <= d(y,q) + 2r."""
    sent = classes.sparkSession.sparkContext.broadcast(_pivots(classes, pivots))
    labels = classes.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(a, 2048) for a in range(0, whole.num_rows, 2048)):
                v = batch.column("v")
                n = v.value_lengths().to_numpy(zero_copy_only=False)
                for length in np.unique(n).tolist():
                    rows = np.flatnonzero(n == length)
                    own = batch.take(pa.array(rows))
                    p = sent.value.get(length)
                    if p is None:  # a rare length: one cell, cut by size like any other
                        at, to, home = np.arange(len(rows)), np.zeros(len(rows), int), np.ones(len(rows), bool)
                    else:
                        u = unit(np.array(own.column("v").flatten().to_numpy(zero_copy_only=False), float).reshape(-1, length))
                        d = np.sqrt(np.maximum(0, 2 - 2 * u @ p.T))
                        nearest = d.argmin(axis=1)
                        at, to = np.nonzero(d <= d.min(axis=1, keepdims=True) + 2 * radius + SLACK)
                        home = to == nearest[at]
                    take = own.take(pa.array(at))
                    columns = [take.column("label"), pa.array(np.full(len(at), length), pa.int32()), pa.array(to, pa.int32()), pa.array(home), *(take.column(c) for c in ("node", "copies", "v"))]
                    yield pa.RecordBatch.from_arrays(columns, names=["label", "n", "pivot", "home", "node", "copies", "v"])

    return classes.select("label", "node", "copies", "v").mapInArrow(run, f"label {labels}, n int, pivot int, home boolean, node long, copies long, v array<double>")


def links(classes: DataFrame, least: float, pivots: int = PIVOTS, chunk: int = CHUNK) -> DataFrame:
    """(node, other, links) from every cell: for each home class the vectors linked to it there (other null), and edges that connect
    what the cell's links connect (links null), at most one for each class in it. A cell with more than ``chunk`` classes
    of a role is cut into pieces, and every pair of pieces is a task of its own."""
    radius = float(np.sqrt(max(0.0, 2 - 2 * least)))
    rows = _dealt(classes, pivots, radius)
    cell = ["label", "n", "pivot"]
    sizes = rows.groupBy(cell).agg(F.ceil(F.sum(F.col("home").cast("int")) / chunk).cast("int").alias("homes"), F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("parts")).where("homes > 0")
    mine = F.pmod(F.xxhash64("node"), F.lit(1 << 30))
    dealt = rows.join(sizes, cell)
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    held = ["node", "copies", "v"]
    as_home = dealt.where("home").select(*cell, (mine % F.col("homes")).cast("int").alias("i"), F.explode(every("parts")).alias("j"), "home", *held)
    as_other = dealt.select(*cell, F.explode(every("homes")).alias("i"), (mine % F.col("parts")).cast("int").alias("j"), F.lit(False).alias("home"), *held)
    keys = [*cell, "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, n, *_), t in cells(batches, keys):
            home, node, copies = t["home"].to_numpy(), t["node"].to_numpy(), t["copies"].to_numpy()
            if not home.any() or home.all():
                continue
            v = unit(np.concatenate([np.asarray(c.flatten(), float) for c in t["v"].chunks]).reshape(-1, int(n)))
            nodes, where = np.unique(node, return_inverse=True)
            a, b = v[home], v[~home]
            wa, wb, weight = where[home], where[~home], copies[~home]
            step = max(1, (1 << 22) // len(b))
            found = np.zeros(len(a), np.int64)
            near: list[tuple[np.ndarray, np.ndarray]] = []

            def linked():
                for at in range(0, len(a), step):
                    close = a[at : at + step] @ b.T >= least
                    close |= wa[at : at + step, None] == wb[None, :]
                    found[at : at + step] = close @ weight
                    i, j = np.nonzero(close)
                    i, j = wa[at + i], wb[j]
                    yield i[i != j], j[i != j]

            first = linked()
            label = np.arange(len(nodes))
            if len(a) <= step:  # one block: keep its links, else look again
                near = list(first)
                label = spanning(len(nodes), lambda: iter(near))
            else:
                label = spanning(len(nodes), linked)
            moved = np.flatnonzero(label != np.arange(len(nodes)))
            m = len(moved)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([node[home], nodes[moved]])), pa.array([None] * len(a) + nodes[label[moved]].tolist(), pa.int64()), pa.array(found.tolist() + [None] * m, pa.int64())],
                names=["node", "other", "links"],
            )

    met = as_home.union(as_other).repartition(*keys).sortWithinPartitions(*keys)
    return met.mapInArrow(run, "node long, other long, links long")


def range_join(vectors: DataFrame, least: float = 0.93, pivots: int = PIVOTS, chunk: int = CHUNK, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """``key``, n_links, component_id and kept of every row: vectors of equal labels are linked at a cosine of ``least`` or more.

    Equal vectors meet as one class, so copies are counted and not paired. Vectors of different lengths are never linked.
    A null label, or a vector that is null, empty, zero or holds a null or non-finite component, links with nothing: its
    component is its own key. Rows that repeat a key are vectors of their own. A null key counts as a partner and never names
    a component unless all its keys are null. Other columns are ignored. An empty table gives an empty table."""
    if not 0 < least <= 1:
        raise ValueError("the least cosine must be over 0 and at most 1")
    classes = stage(_classes(vectors, key, vector, label), "classes")
    found = stage(links(classes, least, pivots, chunk), "links")
    counts = found.where("other is null").groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    rooted = classes.join(counts, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("first").alias("component")), "root").select(F.col("label").alias("_l"), F.col("v").alias("_v"), "links", "component")
    rows = vectors.select(F.col(key).alias("id"), F.col(label).alias("l"), F.when(F.col(label).isNotNull() & usable(vector), F.col(vector).cast("array<double>")).alias("v"))
    out = rows.join(named, (F.col("l") == F.col("_l")) & (F.col("v") == F.col("_v")), "left")
    component = F.when(F.col("_v").isNull(), F.col("id")).otherwise(F.col("component"))
    return out.select(
        F.col("id").alias(key), F.coalesce(F.col("links") - 1, F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept")
    )
