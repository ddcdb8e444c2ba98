"""Bounded-space online best-fit packing of token pieces into sequences."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cells, slices, stage
from tidemark.llm.tokens import encoded, vocabulary

#: Tokens of a sequence, sequences that a packer holds open, pieces that one packer gets (about).
CAPACITY, OPEN, PIECES = 4096, 4096, 1 << 21


class BestFit:
    """Online best-fit with at most ``open_bins`` open bins. Bit f of an integer is set while some open bin has f
    places free; the lowest set bit from a piece's length up is its best fit. With all bins in use and no fit,
    the fullest bin closes first. A bin without space closes at once."""

    def __init__(self, capacity: int = CAPACITY, open_bins: int = OPEN):
        self.capacity, self.limit = capacity, open_bins
        self.bits, self.open, self.made = 0, 0, 0
        self.by_space: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _take(self, space: int) -> int:
        bins = self.by_space[space]
        b = bins.pop()
        if not bins:
            self.bits &= ~(1 << space)
        self.open -= 1
        return b

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset in it) for a piece of ``length`` tokens, 1 to the capacity."""
        if not 0 < length <= self.capacity:
            raise ValueError(f"a piece of {length} does not fit {self.capacity}")
        fits = self.bits >> length
        if fits:
            space = length + (fits & -fits).bit_length() - 1
            b = self._take(space)
        else:
            if self.open == self.limit:
                self._take((self.bits & -self.bits).bit_length() - 1)
            b, space, self.made = self.made, self.capacity, self.made + 1
        left = space - length
        if left:
            self.by_space[left].append(b)
            self.bits |= 1 << left
            self.open += 1
        return b, self.capacity - space


def pieces(docs: DataFrame, file: str | None = None, end: int = 1, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: ``key``, row (a number of the document's row), piece, start, length, ids_crc32 and, if
    asked for, the ids. A document's ids end in ``end``; only those of more than ``capacity`` are cut."""
    file = file or vocabulary("word_bpe_49k.json")
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text, 4 << 20):
            out: list[tuple] = []
            for k, row, ids in zip(part.column(key).to_pylist(), part.column("row").to_pylist(), encoded(part.column(text), file, end)):
                for n, at in enumerate(range(0, len(ids), capacity)):
                    p = ids[at : at + capacity]
                    out.append((k, row, n, at, len(p), zlib.crc32(p.astype("<u4").tobytes()), *([p.astype(np.int32)] if with_ids else [])))
            columns = list(zip(*out))
            types = [part.schema.field(key).type, pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            names = [key, "row", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    schema = f"`{key}` {kind}, row long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(key, text).withColumn("row", F.monotonically_increasing_id()).mapInArrow(run, schema)


def assign(parts: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN, per_packer: int = PIECES) -> DataFrame:
    """``parts`` (a staged table of pieces) with sequence_id and offset.

    A piece of full capacity is a sequence by itself. The others are dealt by hash to one packer for every
    ``per_packer`` pieces, which takes them as they come in hash order: only lengths are shuffled, a packer's memory is its
    open bins, and each packer leaves at most ``open_bins`` sequences short."""
    n = parts.where(F.col("length") < capacity).count()
    packers = max(1, -(-n // per_packer))
    names = parts.columns
    mixed = parts.withColumn("mix", F.xxhash64("row", "piece")).withColumn("packer", F.pmod("mix", F.lit(packers)).cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit, of = None, None
        for batch in batches:
            bins = np.zeros(batch.num_rows, np.int64)
            offsets = np.zeros(batch.num_rows, np.int64)
            for i, (packer, length) in enumerate(zip(batch.column("packer").to_pylist(), batch.column("length").to_pylist())):
                if packer != of:
                    fit, of = BestFit(capacity, open_bins), packer
                b, offsets[i] = fit.place(length)
                bins[i] = b * packers + packer
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(2 * bins), pa.array(offsets)], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema) + ", sequence_id long, offset long"
    short = mixed.where(F.col("length") < capacity).repartition(packers, "packer").sortWithinPartitions("packer", "mix").mapInArrow(run, schema)
    full = parts.where(F.col("length") == capacity).withColumn("sequence_id", 2 * F.monotonically_increasing_id() + 1).withColumn("offset", F.lit(0).cast("long"))
    return short.unionByName(full)


def pack(docs: DataFrame, file: str | None = None, end: int = 1, capacity: int = CAPACITY, open_bins: int = OPEN, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, piece, start, length, ids_crc32, sequence_id and offset of every piece of every document.

    A null or empty text is a piece of the end id alone. Repeated keys are documents of their own; a null key
    stays null. Other columns are ignored. An empty table gives no pieces."""
    parts = stage(pieces(docs, file, end, capacity, key, text), "pieces")
    return assign(parts, capacity, open_bins).select(key, "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def sequences(docs: DataFrame, file: str | None = None, end: int = 1, capacity: int = CAPACITY, open_bins: int = OPEN, key: str = "doc_id", text: str = "text") -> DataFrame:
    """sequence_id and ids (array<int>): the packed sequences themselves, each of ``capacity`` ids at most."""
    parts = stage(pieces(docs, file, end, capacity, key, text, with_ids=True), "pieces")
    placed = assign(parts, capacity, open_bins)
    within = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(F.flatten(F.transform(within, lambda x: x["ids"])).alias("ids"))
