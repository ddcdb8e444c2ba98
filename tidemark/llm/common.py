"""Shared pieces: staging in the cluster's folder, batch slicing, cells, filesystem access."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Callable, Iterator
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.tables import use_checkpoint_dir


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the one that spark.checkpoint.dir names; every executor reaches it."""
    use_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


#: Folders of the staged tables that are still held.
_FOLDERS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _FOLDERS[out] = path
    return out


def discard(*staged: DataFrame) -> None:
    """Delete the folders of staged tables. All that is made of them has to be staged itself."""
    for df in staged:
        context, path = df.sparkSession.sparkContext, _FOLDERS.pop(df)
        at = context._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


#: Vectors that are added in one task of a tree.
FAN = 16


def vector_row(v: np.ndarray) -> pa.RecordBatch:
    """A task's vector for ``tree_sum``, under the number of its partition."""
    from pyspark import TaskContext

    return pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([v.tobytes()], pa.binary())], names=["node", "v"])


def tree_sum(parts: DataFrame, kind: type, finish: Callable[[np.ndarray], np.ndarray] = lambda v: v) -> np.ndarray | None:
    """The sum of dense vectors of one length: ``parts`` (node long, v binary) holds a ``vector_row`` at most for each of its partitions. ``FAN`` of them are added in
    a task, then ``FAN`` of those sums, until one is left; what ``finish`` makes of it in its task reaches the driver (the caller bounds its length). None without
    vectors."""
    nodes = max(2, parts.rdd.getNumPartitions())
    tree = parts
    while nodes > 1:
        nodes = -(-nodes // FAN)

        def add(batches: Iterator[pa.RecordBatch], last: bool = nodes == 1) -> Iterator[pa.RecordBatch]:
            held: dict[int, np.ndarray] = {}
            for batch in batches:
                for node, v in zip(batch.column("node").to_pylist(), batch.column("v")):
                    v = np.frombuffer(v.as_buffer(), kind)
                    held[node // FAN] = held[node // FAN] + v if node // FAN in held else v
            for node, v in held.items():
                v = finish(v) if last else v
                yield pa.RecordBatch.from_arrays([pa.array([node], pa.int64()), pa.array([v.tobytes()], pa.binary()), pa.array([v.dtype.str])], names=["node", "v", "kind"])

        tree = tree.repartition(nodes, F.expr(f"node div {FAN}")).mapInArrow(add, "node long, v binary, kind string")
    summed = stage(tree, "sum")
    rows = summed.collect()  # one vector
    discard(summed)
    return np.frombuffer(rows[0]["v"], rows[0]["kind"]) if rows else None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder. Workers on this machine find the package wherever it was imported from; a cluster gets it with --py-files."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, *paths]))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: str) -> Column:
    """crc32 of the key as text, modulo 5; fold 0 is held out. A null key is held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5, F.lit(0))


def hash01(*columns: str) -> Column:
    """A number in [0, 1) that depends on the values only."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 52)) / F.lit(float(1 << 52))


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that a slice holds about ``limit`` bytes of ``column``, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(lengths, dtype=np.int64) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def cells(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Consecutive rows with equal ``keys`` from a partition that is sorted by them."""
    held: list[pa.RecordBatch] = []
    current: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        changed = np.zeros(batch.num_rows, bool)
        for c in columns:
            changed[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(changed).tolist(), batch.num_rows]
        for a, b in zip(starts, starts[1:]):
            key = tuple(c[a] for c in columns)
            if current is not None and key != current:
                yield current, pa.Table.from_batches(held)
                held = []
            current = key
            held.append(batch.slice(a, b - a))
    if held:
        yield current, pa.Table.from_batches(held)


def spanning(n: int, links: Callable[[], Iterator[tuple[np.ndarray, np.ndarray]]]) -> np.ndarray:
    """Smallest reachable position of each of ``n`` positions; ``links()`` yields arrays of linked positions
    and is read again until nothing changes, so links are never held together."""
    label = np.arange(n)
    while True:
        before = label.copy()
        for a, b in links():
            low = np.minimum(label[a], label[b])
            np.minimum.at(label, a, low)
            np.minimum.at(label, b, low)
            np.minimum.at(label, label[a], low)
            np.minimum.at(label, label[b], low)
        while True:
            jumped = label[label]
            if np.array_equal(jumped, label):
                break
            label = jumped
        if np.array_equal(before, label):
            return label


def filesystem(uri: str):
    """The Arrow filesystem and path of a URI as Hadoop writes it."""
    from pyarrow import fs

    uri = re.sub(r"^file:/+", "/", uri)
    return fs.FileSystem.from_uri(f"file://{uri}" if uri.startswith("/") else uri)


def spread_lookup(rows: DataFrame, answers: DataFrame, keys: list[str], share: int = 256, inner: bool = False) -> DataFrame:
    """``rows`` with the columns of ``answers`` (unique by ``keys``, which are never null in it); rows without an answer get nulls, or go if ``inner``.

    Keys held by more than a ``share``-th of all rows are counted first; they are fewer than ``share``, so their answers go to all tasks
    and only the other rows are shuffled (or none, if Spark finds the answers small). ``rows`` is read twice more: stage it
    if it is costly."""
    counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = rows.agg(F.count(F.lit(1)).alias("_total"))
    hot = counted.join(F.broadcast(total), F.col("_n") * share > F.col("_total")).select(*keys)  # one row against all keys
    hot = stage(hot.join(answers, keys, "left_semi"), "hot")  # fewer than ``share`` keys
    hot_answers = F.broadcast(answers.join(F.broadcast(hot), keys, "left_semi"))
    kind = "inner" if inner else "left"
    often = rows.join(hot_answers, keys, "inner")
    seldom = rows.join(F.broadcast(hot), keys, "left_anti").join(answers, keys, kind)
    names = [*rows.columns, *[c for c in answers.columns if c not in keys]]
    return often.select(names).unionByName(seldom.select(names))
