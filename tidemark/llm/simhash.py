"""SimHash near-duplicates by anchor-point covering."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cells, slices, spanning, stage
from tidemark.llm.components import components

#: Fixed values of the binary Golay code: length 23, generator polynomial, covering radius.
LENGTH, GENERATOR, RADIUS = 23, 0b101011100011, 3
#: Disjoint runs of bits that tile a 64-bit fingerprint: (first bit, bits).
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Most rows of one role that a task compares at once; a larger cell is dealt to several tasks.
CHUNK = 16384


def fingerprint(text: str | None, width: int = 4) -> int:
    """64-bit SimHash of the word shingles of a whole text; 0 without words. Bit i is set if it is set in over
    half of the shingles' XXH64 (seed 42), repeats included. Fewer words than ``width`` are one shingle."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    k, joined = min(width, len(words)), b" ".join(words)
    length = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(length + 1) - 1
    starts, ends = (ends - length)[: len(words) - k + 1], ends[k - 1 :]

    def parts() -> Iterator[np.ndarray]:
        for at in range(0, len(starts), 1 << 15):
            shingles = map(joined.__getitem__, map(slice, starts[at : at + (1 << 15)].tolist(), ends[at : at + (1 << 15)].tolist()))
            yield np.fromiter(map(xxh64_intdigest, shingles, repeat(42)), np.uint64)

    return majority(parts())


def majority(parts: Iterable[np.ndarray]) -> int:
    """The bits that are set in over half of all hashes of ``parts``; 0 without any."""
    ones, n = np.zeros(64, np.int64), 0
    for h in parts:
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
        n += len(h)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``fp`` (the fingerprint's bits as a signed long) of every row; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            fp = np.fromiter((fingerprint(x, width) for x in part.column(text).to_pylist()), np.uint64, part.num_rows)
            yield pa.RecordBatch.from_arrays([part.column(key), pa.array(fp.view(np.int64))], names=[key, "fp"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, fp long")


@lru_cache
def _code(radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of all words; leader (pattern to the nearest codeword) by syndrome; patterns of up to
    ``radius`` flipped bits ordered by syndrome, and where each syndrome's begin."""
    syndrome = np.arange(1 << LENGTH, dtype=np.int32)
    for bit in range(LENGTH - 1, 10, -1):
        syndrome = np.where(syndrome >> bit & 1, syndrome ^ (GENERATOR << bit - 11), syndrome)
    patterns = np.array([sum(1 << i for i in c) for w in range(radius + 1) for c in combinations(range(LENGTH), w)], np.int32)
    of = syndrome[patterns]
    leader = np.zeros(2048, np.int32)
    leader[of[::-1]] = patterns[::-1]  # the lightest comes last
    order = np.argsort(of, kind="stable")
    return syndrome.astype(np.int16), leader, patterns[order], np.searchsorted(of[order], np.arange(2049))


def anchors(fp: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each segment: (position of the fingerprint, cell, is home). The home is the nearest codeword, at
    most RADIUS away; the other cells are all codewords within RADIUS plus the segment's share of ``distance``."""
    share = distance // len(SEGMENTS)
    syndromes, leader, patterns, begin = _code(RADIUS + share)
    for k, (first, bits) in enumerate(SEGMENTS):
        word = (fp >> np.uint64(first) & np.uint64((1 << bits) - 1)).astype(np.int32)
        s = syndromes[word].astype(np.int64)
        count = begin[s + 1] - begin[s]
        row = np.repeat(np.arange(len(fp)), count)
        at = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begin[s], count)
        yield row, (word[row] ^ patterns[at]) | k << LENGTH, patterns[at] == leader[s][row]


def _covered(fps: DataFrame, distance: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 20_000):
                fp = batch.column("fp").slice(at, 20_000).to_numpy(zero_copy_only=False)
                for row, cell, home in anchors(fp.view(np.uint64), distance):
                    yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(fp[row]), pa.array(home)], names=["cell", "fp", "home"])

    return fps.select("fp").mapInArrow(run, "cell int, fp long, home boolean")


def compare(home: np.ndarray, others: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what the links (``distance`` or fewer differing bits) between ``home`` and ``others``
    connect: at most one for each fingerprint, never the pairs."""
    both, where = np.unique(np.concatenate([home, others]), return_inverse=True)
    a, b = np.unique(where[: len(home)]), np.unique(where[len(home) :])
    step = max(1, (1 << 22) // max(1, len(b)))

    def links():
        for at in range(0, len(a), step):
            i, j = np.nonzero(np.bitwise_count(both[a[at : at + step], None] ^ both[b]) <= distance)
            i, j = a[at + i], b[j]
            yield i[i != j], j[i != j]

    label = spanning(len(both), links)
    moved = np.flatnonzero(label != np.arange(len(both)))
    return both[moved], both[label[moved]]


def edges(fps: DataFrame, distance: int = 4, chunk: int = CHUNK) -> DataFrame:
    """Edges (a, b) between distinct fingerprints whose components are those of all links.

    If two fingerprints differ in ``distance`` bits at most, some segment differs in a third of that at most;
    there the home anchor of one lies within RADIUS plus that share of the other, so the home's cell holds both.
    A cell with more than ``chunk`` rows of a role is cut into pieces and every pair of pieces is compared in a
    task of its own. There are at most 3 * 4096 cells, so the table of their sizes is broadcast."""
    rows = _covered(fps, distance)
    sizes = rows.groupBy("cell").agg(
        F.ceil(F.sum(F.col("home").cast("int")) / chunk).cast("int").alias("homes"), F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("parts")
    ).where("homes > 0")
    mine = F.pmod(F.xxhash64("fp"), F.lit(1 << 30))
    dealt = rows.join(F.broadcast(sizes), "cell")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    as_home = dealt.where("home").select("cell", (mine % F.col("homes")).cast("int").alias("i"), F.explode(every("parts")).alias("j"), "fp", "home")
    as_other = dealt.select("cell", F.explode(every("homes")).alias("i"), (mine % F.col("parts")).cast("int").alias("j"), "fp", F.lit(False).alias("home"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in cells(batches, ["cell", "i", "j"]):
            home, fp = t["home"].to_numpy(), t["fp"].to_numpy().view(np.uint64)
            if home.any() and (fp != fp[0]).any():
                a, b = compare(fp[home], fp[~home], distance)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    met = as_home.union(as_other).repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j")
    return met.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, distance: int = 4, width: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``fingerprint`` (16 hex digits) and ``component_id`` (smallest key reachable by links) of every row.

    Rows are linked if their fingerprints differ in ``distance`` bits at most. Copies share a fingerprint and
    meet as one class. Null and empty texts have fingerprint 0 and are linked like any other. Repeated keys
    each get a row; null keys take part in links and never name a component unless all its keys are null (then
    the id is null). Other columns are ignored. An empty table gives an empty table."""
    if distance < 0 or distance >= 3 * len(SEGMENTS):
        raise ValueError("distance must be between 0 and 8")
    fps = stage(fingerprints(docs, width, key, text), "simhash")
    classes = fps.groupBy("fp").agg(F.min(key).alias("first"))
    roots = components(edges(classes, distance)).select(F.col("node").alias("fp"), "root")
    rooted = classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("fp", "component_id")
    return fps.join(named, "fp").select(key, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
