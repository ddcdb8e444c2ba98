"""Token-id shards with a minimal perfect hash index from document keys to offsets.

A shard is three files. ``.ids`` is nothing but the documents' ids in ascending key order, little-endian unsigned
numbers of 2 bytes (4 for a vocabulary of over 65,536 ids). ``.rows`` has the number of ids of each row (64 bits).
``.mph`` starts with five little-endian unsigned 64-bit numbers (fixed mark, keys n, buckets b, ids in the
shard, bytes of an id), then b signed 32-bit displacements, then for each of n slots a 32-bit fingerprint of the
key, the first id's place in the shard (64 bits) and the number of ids (64 bits), each as one array, then the
keys in ascending order with their slots (64 and 32 bits).
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import filesystem, shared_folder, slices, stage
from tidemark.llm.tokens import encoded, encoder, vocabulary

MARK = 0x3158444E49524B54
#: Stands for a null key in a shard.
NULL_KEY = -(1 << 63)
_M1, _M2, _MASK = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, (1 << 64) - 1


def _mix(x: int) -> int:
    x = (x ^ x >> 30) * _M1 & _MASK
    x = (x ^ x >> 27) * _M2 & _MASK
    return x ^ x >> 31


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(_M1)
    x = (x ^ x >> np.uint64(27)) * np.uint64(_M2)
    return x ^ x >> np.uint64(31)


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: a key's bucket holds a displacement under which the bucket's
    keys fall on free slots, or the slot itself (as -slot-1) for a bucket of one. Looking up takes two reads; the
    stored fingerprint tells keys that were never put in."""

    def __init__(self, displacement: np.ndarray, fingerprint: np.ndarray):
        self.displacement, self.fingerprint = displacement, fingerprint

    @classmethod
    def build(cls, keys: np.ndarray) -> tuple[PerfectHash, np.ndarray]:
        """The hash and the slot of each key."""
        n = len(keys)
        h = _mixed(keys.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        buckets = max(1, -(-n // 2))
        bucket = (h % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        begin = np.searchsorted(bucket[order], np.arange(buckets + 1))
        size = np.diff(begin)
        displacement, slot, taken = np.zeros(buckets, np.int32), np.zeros(n, np.int64), bytearray(n)
        hashes = h.tolist()
        for b in np.argsort(-size, kind="stable").tolist():
            if size[b] < 2:
                break
            mine = order[begin[b] : begin[b + 1]].tolist()
            d = 0
            while True:
                d += 1
                at = [_mix(hashes[k] ^ d * _M2 & _MASK) % n for k in mine]
                if len(set(at)) == len(at) and not any(taken[x] for x in at):
                    break
                if d == (1 << 31) - 1:
                    raise ValueError("keys repeat")
            displacement[b] = d
            for k, x in zip(mine, at):
                slot[k], taken[x] = x, 1
        free = np.flatnonzero(np.frombuffer(taken, np.uint8) == 0)
        for x, b in zip(free.tolist(), np.flatnonzero(size == 1).tolist()):
            slot[order[begin[b]]] = x
            displacement[b] = -x - 1
        fingerprint = np.zeros(n, np.uint32)
        fingerprint[slot] = (h >> np.uint64(32)).astype(np.uint32)
        return cls(displacement, fingerprint), slot

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """Slots of the keys, -1 for keys whose fingerprint isn't stored at their slot."""
        n = len(self.fingerprint)
        if not n:
            return np.full(len(keys), -1, np.int64)
        h = _mixed(np.asarray(keys, np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        d = self.displacement[(h % np.uint64(len(self.displacement))).astype(np.int64)].astype(np.int64)
        moved = (_mixed(h ^ d.view(np.uint64) * np.uint64(_M2)) % np.uint64(n)).astype(np.int64)
        slot = np.where(d < 0, -d - 1, np.where(d > 0, moved, 0))
        return np.where(self.fingerprint[slot] == (h >> np.uint64(32)).astype(np.uint32), slot, -1)


def _packed(keys: np.ndarray, starts: np.ndarray, counts: np.ndarray, total: int, width: int) -> bytes:
    """The index file of a shard whose keys are distinct."""
    mph, slot = PerfectHash.build(keys)
    place, length = np.zeros(len(keys), "<u8"), np.zeros(len(keys), "<u8")
    place[slot], length[slot] = starts, counts
    head = np.array([MARK, len(keys), len(mph.displacement), total, width], "<u8")
    return b"".join(x.tobytes() for x in (head, mph.displacement.astype("<i4"), mph.fingerprint.astype("<u4"), place, length, keys.astype("<i8"), slot.astype("<u4")))


class Shard:
    """A shard opened for keyed access."""

    def __init__(self, path: str):
        fs, at = filesystem(path)
        with fs.open_input_stream(f"{at}.mph") as f:
            raw = f.read()
        mark, n, b, self.total, self.width = (int(x) for x in np.frombuffer(raw, "<u8", 5))
        if mark != MARK:
            raise ValueError(f"{path} is not an index")
        at_byte = 40

        def column(kind: str, count: int) -> np.ndarray:
            nonlocal at_byte
            out = np.frombuffer(raw, kind, count, at_byte)
            at_byte += out.nbytes
            return out

        displacement, fingerprint = column("<i4", b), column("<u4", n)
        self.mph = PerfectHash(displacement, fingerprint)
        self.place, self.length, self.keys, self.slots = column("<u8", n), column("<u8", n), column("<i8", n), column("<u4", n)
        self.ids = fs.open_input_file(f"{at}.ids")

    def get(self, key: int) -> np.ndarray | None:
        """Ids of a key, read from its place in the payload; None for a key that isn't there."""
        slot = int(self.mph.lookup(np.array([key], np.int64))[0])
        if slot < 0:
            return None
        return self.read(int(self.place[slot]), int(self.length[slot]))

    def read(self, start: int, length: int) -> np.ndarray:
        self.ids.seek(self.width * start)
        return np.frombuffer(self.ids.read(self.width * length), f"<u{self.width}")


def write(docs: DataFrame, folder: str, file: str | None = None, end: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode every text and write shards in ascending key order; a staged table of (shard, path, ids).

    Texts are range-partitioned by key, so a shard is a task. A lost task leaves files that no row names and is
    written anew under other names. Keys are integers; null keys come first. Rows that repeat a key follow each other
    in the order of their texts; rows that repeat a key at a shard's end stay in that shard."""
    file = file or vocabulary("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        width = 2 if max(encoder(file).tokenizer.get_vocab_size(), end + 1) <= 1 << 16 else 4

        shard, path = TaskContext.get().partitionId(), None
        keys, counts, held, out = [], [], 0, None
        for part in slices(batches, text, 4 << 20):
            if out is None:
                path = f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex}"
                fs, at = filesystem(path)
                fs.create_dir(at.rpartition("/")[0], recursive=True)
                out = fs.open_output_stream(f"{at}.ids")
            keys.append(part.column(key).cast(pa.int64()).fill_null(NULL_KEY).to_numpy(zero_copy_only=False))
            for ids in encoded(part.column(text), file, end):
                counts.append(len(ids))
                out.write(ids.astype(f"<u{width}").tobytes())
        if out is None:
            return
        out.close()
        k, n = np.concatenate(keys), np.array(counts, np.int64)
        starts = np.cumsum(n) - n
        # rows that repeat a key: the index leads to the first and covers all of them
        first = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
        with fs.open_output_stream(f"{at}.mph") as f:
            f.write(_packed(k[first], starts[first], np.add.reduceat(n, first), int(n.sum()), width))
        with fs.open_output_stream(f"{at}.rows") as f:  # ids of each row, to tell repeated keys apart
            f.write(n.astype("<u8").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([path]), pa.array([int(n.sum())], pa.int64())], names=["shard", "path", "ids"])

    ordered = docs.select(key, text).repartitionByRange(key).sortWithinPartitions(key, text)
    return stage(ordered.mapInArrow(run, "shard int, path string, ids long"), "shards")


def read(spark: SparkSession, shards: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key``, start, n_tokens and ids_crc32 of every document, from the files alone: each shard's keys are looked
    up in its index, and their ids are read from the payload. ``shards`` has a row per shard, so its starts are
    summed up on the driver."""
    rows = sorted(shards.collect(), key=lambda r: r["shard"])
    bases = np.cumsum([0, *(r["ids"] for r in rows)]).tolist()
    listed = spark.createDataFrame([(r["path"], b) for r, b in zip(rows, bases)], "path string, base long").repartition(max(1, len(rows)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
                shard = Shard(path)
                fs, at = filesystem(path)
                with fs.open_input_stream(f"{at}.rows") as f:
                    n = np.frombuffer(f.read(), "<u8").astype(np.int64)
                row_starts = np.cumsum(n) - n
                for lo in range(0, len(shard.keys), 8192):
                    keys = shard.keys[lo : lo + 8192]
                    slot = shard.mph.lookup(keys)
                    if (slot < 0).any():
                        raise ValueError(f"{path}: a key is not in its index")
                    out: list[tuple] = []
                    for k, start, length in zip(keys.tolist(), shard.place[slot].tolist(), shard.length[slot].tolist()):
                        ids = shard.read(start, length).astype("<u4")
                        row, done = int(np.searchsorted(row_starts, start)), 0
                        while done < length:
                            c = int(n[row])
                            out.append((None if k == NULL_KEY else k, base + start + done, c, zlib.crc32(ids[done : done + c].tobytes())))
                            row, done = row + 1, done + c
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=[key, "start", "n_tokens", "ids_crc32"])

    return listed.mapInArrow(run, f"`{key}` long, start long, n_tokens long, ids_crc32 long")


def lookup(spark: SparkSession, shards: DataFrame, keys: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key`` and ids (array<int>) of the wanted keys, null ids for keys that no shard holds. Keys meet their shard by a
    join on the shards' key ranges, which are as many as the shards."""
    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                k = Shard(path).keys
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([int(k[0])]), pa.array([int(k[-1])])], names=["path", "least", "most"])

    ranges = sorted(shards.select("path").mapInArrow(ends, "path string, least long, most long").collect(), key=lambda r: r["least"])
    least = np.array([r["least"] for r in ranges], np.int64)
    paths = [r["path"] for r in ranges]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict[str, Shard] = {}
        for batch in batches:
            for part in (batch.slice(a, 1024) for a in range(0, batch.num_rows, 1024)):
                found = []
                for k in part.column("k").to_pylist():
                    at = int(np.searchsorted(least, k, "right")) - 1 if k is not None else -1
                    if at >= 0 and paths[at] not in opened:
                        opened = {paths[at]: Shard(paths[at])}
                    ids = opened[paths[at]].get(k) if at >= 0 else None
                    found.append(None if ids is None else ids.astype(np.int32))
                yield pa.RecordBatch.from_arrays([part.column("k"), pa.array(found, pa.list_(pa.int32()))], names=[key, "ids"])

    wanted = keys.select(F.col(key).cast("long").alias("k"))
    return wanted.repartitionByRange("k").sortWithinPartitions("k").mapInArrow(run, f"`{key}` long, ids array<int>")


def token_index(docs: DataFrame, file: str | None = None, end: int = 2, folder: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the shards and return what the files say of each document: ``key``, start, n_tokens, ids_crc32.

    A null or empty text has the end id alone. Repeated keys give a row each. Null keys come first, with a null
    key. Other columns are ignored. An empty table writes no shard and gives an empty table."""
    spark = docs.sparkSession
    return read(spark, write(docs, folder or shared_folder(spark, "ids"), file, end, key, text), key)
