"""Reversible line dedup: exact reference tables with sharded cuckoo filters in front of them.

The state of a corpus is three tables in a folder: ``refs`` (a row for each key and document that holds it),
``counts`` (for each key its number of documents and the largest document) and ``filters`` (for each
shard of the key space a cuckoo filter of the keys that enough documents hold). Inserting documents adds
references, deleting documents takes them away; counts and filters follow, so a deletion undoes an insertion.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cells, slices, stage

#: Bytes stripped at both ends of a line (fixed).
BLANK = b" \t\n\x0b\x0c\r"
#: Least shards of the key space, keys of a shard (about), bytes of all filters up to which they are sent to every task (beyond, lines are
#: brought to their shard's filter), tasks that a shard's lines are dealt to then.
SHARDS, SHARD_KEYS, BROADCAST_BYTES, SALTS = 64, 1 << 16, 64 << 20, 8


class CuckooFilter:
    """Approximate membership of 64-bit keys with deletion: 16-bit fingerprints in buckets of four, each key at
    one of two buckets. A key that was added is always found."""

    SLOTS, KICKS = 4, 500

    def __init__(self, buckets: int):
        self.table = np.zeros((1 << max(1, (buckets - 1).bit_length()), self.SLOTS), np.uint16)

    @classmethod
    def of(cls, keys: np.ndarray) -> CuckooFilter:
        """A filter of the keys, of twice the buckets whenever they don't fit. Free places are filled for all keys together; those that find
        none are added one by one."""
        buckets = max(2, int(len(keys) / (0.84 * cls.SLOTS)))
        while True:
            f = cls(buckets)
            if all(f.add(k) for k in f._fill(keys).tolist()):
                return f
            buckets = 2 * len(f.table)

    def _fill(self, keys: np.ndarray) -> np.ndarray:
        """Put keys at their first, then at their second bucket as long as it has room; the keys that are left."""
        for second in (False, True):
            mark, a, b = self._all_places(keys)
            at = b if second else a
            order = np.argsort(at, kind="stable")
            at, mark, keys = at[order], mark[order], keys[order]
            slot = np.arange(len(at)) - np.searchsorted(at, at) + (self.table != 0).sum(axis=1)[at]
            room = slot < self.SLOTS
            self.table[at[room], slot[room]] = mark[room]
            keys = keys[~room]
        return keys

    def _all_places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        k = keys.view(np.uint64)
        mark = ((k >> np.uint64(48)) % np.uint64(65535) + np.uint64(1)).astype(np.int64)
        a = (k & np.uint64(len(self.table) - 1)).astype(np.int64)
        return mark, a, a ^ (mark * 0x5BD1E995 >> 3 & len(self.table) - 1)

    def _places(self, key: int) -> tuple[int, int, int]:
        key &= (1 << 64) - 1
        mark = (key >> 48) % 65535 + 1
        a = (key & 0xFFFFFFFF) & len(self.table) - 1
        return mark, a, self._other(a, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return bucket ^ (mark * 0x5BD1E995 >> 3 & len(self.table) - 1)

    def add(self, key: int) -> bool:
        mark, a, b = self._places(key)
        for at in (a, b):
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = mark
                return True
        at = a
        for kick in range(self.KICKS):
            slot = kick % self.SLOTS
            mark, self.table[at, slot] = int(self.table[at, slot]), mark
            at = self._other(at, mark)
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = mark
                return True
        return False

    def remove(self, key: int) -> bool:
        mark, a, b = self._places(key)
        for at in (a, b):
            found = np.flatnonzero(self.table[at] == mark)
            if len(found):
                self.table[at, found[0]] = 0
                return True
        return False

    def __contains__(self, key: int) -> bool:
        mark, a, b = self._places(key)
        return bool((self.table[a] == mark).any() or (self.table[b] == mark).any())

    def contains(self, keys: np.ndarray) -> np.ndarray:
        mark, a, b = self._all_places(keys)
        return ((self.table[a] == mark[:, None]) | (self.table[b] == mark[:, None])).any(axis=1)

    @classmethod
    def read(cls, data: bytes) -> CuckooFilter:
        f = cls(2)
        f.table = np.frombuffer(data, np.uint16).reshape(-1, cls.SLOTS)
        return f


def line_keys(data: bytes, least: int) -> tuple[list[bytes], list[bytes | None]]:
    """The lines of a text and, for each, the 128-bit hash of its key (stripped, A-Z lower-cased) or None for a
    key of fewer than ``least`` code points."""
    from xxhash import xxh3_128_digest

    lines = data.split(b"\n")
    out: list[bytes | None] = []
    for line in lines:
        if len(line) >= least:
            key = line.strip(BLANK).lower()
            if len(key) >= least and (key.isascii() or len(key.decode("utf-8", "surrogatepass")) >= least):
                out.append(xxh3_128_digest(key))
                continue
        out.append(None)
    return lines, out


def _halves(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)


def _texts(part: pa.RecordBatch, text: str) -> list[bytes]:
    return [x or b"" for x in part.column(text).cast(pa.binary()).to_pylist()]


def references(docs: DataFrame, least: int = 40, key: str = "doc_id", text: str = "text", sieve=None) -> DataFrame:
    """(k1, k2, key): the line keys that each document holds, once per row. ``sieve`` maps hashes to a mask of those to keep."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            digests: list[bytes] = []
            owner: list[int] = []
            for row, data in enumerate(_texts(part, text)):
                mine = set(line_keys(data, least)[1])
                mine.discard(None)
                digests += mine
                owner += [row] * len(mine)
            if digests:
                k, rows = _halves(digests), np.array(owner)
                if sieve is not None:
                    kept = sieve(k)
                    k, rows = k[kept], rows[kept]
                yield pa.RecordBatch.from_arrays([pa.array(k[:, 0].copy()), pa.array(k[:, 1].copy()), part.column(key).take(pa.array(rows))], names=["k1", "k2", key])

    return docs.select(key, text).where(F.col(key).isNotNull()).mapInArrow(run, f"k1 long, k2 long, `{key}` {kind}")


def _count(refs: DataFrame, key: str) -> DataFrame:
    return refs.groupBy("k1", "k2", key).agg(F.lit(1).alias("one")).groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n_docs"), F.max(key).alias("keeper"))


def _filters(counts: DataFrame, copies: int, shards: int) -> DataFrame:
    """(shard, filter) over the keys that ``copies`` documents or more hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (shard,), t in cells(batches, ["shard"]):
            f = CuckooFilter.of(np.sort(t["k1"].to_numpy()))
            yield pa.RecordBatch.from_arrays([pa.array([int(shard)], pa.int32()), pa.array([f.table.tobytes()], pa.binary())], names=["shard", "filter"])

    held = counts.where(F.col("n_docs") >= copies).select(F.pmod("k2", F.lit(shards)).cast("int").alias("shard"), "k1")
    return held.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, "shard int, filter binary")


class LineIndex:
    """References, counts and filters of a corpus. ``insert`` and ``delete`` return a new index and leave this one as it is."""

    def __init__(self, refs: DataFrame, counts: DataFrame, filters: DataFrame, copies: int = 5, least: int = 40, shards: int = SHARDS, key: str = "doc_id", text: str = "text"):
        self.refs, self.counts, self.filters = refs, counts, filters
        self.copies, self.least, self.shards, self.key, self.text = copies, least, shards, key, text

    @classmethod
    def build(cls, docs: DataFrame, copies: int = 5, least: int = 40, shards: int | None = None, key: str = "doc_id", text: str = "text") -> LineIndex:
        """The index of a corpus. Rows with a null key hold no references. Without ``shards`` there are as many as hold ``SHARD_KEYS`` keys each, ``SHARDS`` at least."""
        refs = stage(references(docs, least, key, text), "refs")
        counts = stage(_count(refs, key), "counts")
        if shards is None:
            shards = max(SHARDS, -(-counts.where(F.col("n_docs") >= copies).count() // SHARD_KEYS))
        return cls(refs, counts, stage(_filters(counts, copies, shards), "filters"), copies, least, shards, key, text)

    def _changed(self, refs: DataFrame, moved: DataFrame) -> LineIndex:
        """With ``refs``; only keys in ``moved`` are counted anew, and only shards where a key has gained or lost its place are filtered anew."""
        touched = stage(moved.select("k1", "k2").distinct(), "touched")
        anew = _count(refs.join(touched, ["k1", "k2"], "left_semi"), self.key)
        counts = stage(self.counts.join(touched, ["k1", "k2"], "left_anti").unionByName(anew), "counts")
        mark = lambda c: c.where(F.col("n_docs") >= self.copies).join(touched, ["k1", "k2"], "left_semi").select("k1", F.pmod("k2", F.lit(self.shards)).cast("int").alias("shard"))
        was, now = mark(self.counts), mark(counts)
        steps = now.exceptAll(was).withColumn("add", F.lit(True)).unionByName(was.exceptAll(now).withColumn("add", F.lit(False)))
        filters = stage(self._stepped(steps), "filters")
        lost = filters.where("filter is null").select(F.col("shard").alias("lost"))
        if not lost.isEmpty():  # at most as many rows as shards
            anew = _filters(counts.join(F.broadcast(lost), F.pmod("k2", F.lit(self.shards)) == F.col("lost"), "left_semi"), self.copies, self.shards)
            filters = stage(filters.where("filter is not null").unionByName(anew), "filters")
        return LineIndex(refs, counts, filters, self.copies, self.least, self.shards, self.key, self.text)

    def _stepped(self, steps: DataFrame) -> DataFrame:
        """Filters with the keys of ``steps`` (shard, k1, add) put in or taken out; null for one that is full."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for (shard,), t in cells(batches, ["shard"]):
                rows = t.to_pylist()
                old = next((r["filter"] for r in rows if r["filter"] is not None), None)
                f = CuckooFilter(2)
                if old is not None:
                    f.table = CuckooFilter.read(old).table.copy()
                fits = True
                for r in rows:
                    if r["add"] is False:
                        f.remove(r["k1"])
                for r in rows:
                    if r["add"]:
                        fits = fits and f.add(r["k1"])
                yield pa.RecordBatch.from_arrays([pa.array([int(shard)], pa.int32()), pa.array([f.table.tobytes() if fits else None], pa.binary())], names=["shard", "filter"])

        both = self.filters.select("shard", F.lit(None).cast("long").alias("k1"), F.lit(None).cast("boolean").alias("add"), "filter")
        both = both.unionByName(steps.select("shard", "k1", "add", F.lit(None).cast("binary").alias("filter")))
        return both.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, "shard int, filter binary")

    def insert(self, docs: DataFrame) -> LineIndex:
        """The index with more documents. Documents that it holds already change nothing."""
        new = stage(references(docs, self.least, self.key, self.text), "refs").distinct()
        return self._changed(stage(self.refs.unionByName(new).distinct(), "refs"), new)

    def delete(self, keys: DataFrame) -> LineIndex:
        """The index without the documents named in the key column of ``keys``; unknown ones change nothing."""
        gone = keys.select(self.key).where(F.col(self.key).isNotNull()).distinct()
        return self._changed(stage(self.refs.join(gone, self.key, "left_anti").select(self.refs.columns), "refs"), self.refs.join(gone, self.key, "left_semi"))

    def sieve(self, limit: int = BROADCAST_BYTES):
        """A mask of the hashes that the filters may hold; None if the filters are over ``limit`` bytes together."""
        if self.filters.agg(F.coalesce(F.sum(F.octet_length("filter")), F.lit(0))).first()[0] > limit:
            return None
        held = self.filters.sparkSession.sparkContext.broadcast({r["shard"]: r["filter"] for r in self.filters.collect()})
        shards = self.shards

        def mask(k: np.ndarray) -> np.ndarray:
            found, shard = np.zeros(len(k), bool), k[:, 1] % shards
            for s in np.unique(shard).tolist():
                if s in held.value:
                    mine = np.flatnonzero(shard == s)
                    found[mine] = CuckooFilter.read(held.value[s]).contains(np.ascontiguousarray(k[mine, 0]))
            return found

        return mask

    def _met(self, asked: DataFrame) -> DataFrame:
        """The rows (k1, k2, _doc) whose key their shard's filter may hold: filters go to ``SALTS`` tasks for each shard, and so do the rows."""
        kind = asked.schema["_doc"].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, f = None, None
            for batch in batches:
                shard, salt = batch.column("shard").to_numpy(), batch.column("salt").to_numpy()
                cuts = [0, *(np.flatnonzero((np.diff(shard) != 0) | (np.diff(salt) != 0)) + 1).tolist(), batch.num_rows]
                for a, b in zip(cuts, cuts[1:]):
                    if a == b:
                        continue
                    part, at = batch.slice(a, b - a), (int(shard[a]), int(salt[a]))
                    if at != now:
                        now, f = at, None
                    if part.column("filter")[0].is_valid:  # a filter comes before its rows
                        f, part = CuckooFilter.read(part.column("filter")[0].as_py()), part.slice(1)
                    if f is not None and part.num_rows:
                        kept = f.contains(part.column("k1").to_numpy())
                        yield part.select(["k1", "k2", "_doc"]).filter(pa.array(kept))

        none = lambda t: F.lit(None).cast(t)
        head = self.filters.select("shard", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])).alias("salt"), "filter", none("long").alias("k1"), none("long").alias("k2"), none(kind).alias("_doc"))
        body = asked.select(F.pmod("k2", F.lit(self.shards)).cast("int").alias("shard"), F.pmod(F.xxhash64("_doc"), F.lit(SALTS)).cast("int").alias("salt"), none("binary").alias("filter"), "k1", "k2", "_doc")
        both = head.unionByName(body).repartition("shard", "salt").sortWithinPartitions("shard", "salt", F.col("filter").isNull())
        return both.mapInArrow(run, f"k1 long, k2 long, _doc {kind}")

    def doomed(self, docs: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
        """(key, gone): for each document the hashes of the line keys that it loses. The filters let through few lines; the exact counts decide. Filters of
        up to ``limit`` bytes together are sent to all tasks, else the lines are brought to them."""
        sieve = self.sieve(limit)
        asked = references(docs, self.least, self.key, self.text, sieve).withColumnRenamed(self.key, "_doc")
        if sieve is None:
            asked = self._met(asked)
        hot = self.counts.where(F.col("n_docs") >= self.copies)
        lost = asked.join(hot, ["k1", "k2"]).where(F.col("_doc") < F.col("keeper")).select("_doc", F.struct("k1", "k2").alias("k")).distinct()
        return lost.groupBy("_doc").agg(F.collect_list("k").alias("gone"))

    def apply(self, docs: DataFrame) -> DataFrame:
        """``docs`` with its text rid of repeated lines, and n_lines and n_dropped.

        Lines whose key is held by ``copies`` documents or more stay only in the largest of them. A null or empty text
        is one empty line. Rows with a null key lose nothing. Rows that repeat a key are one document and lose lines
        alike. Other columns are kept (columns named n_lines or n_dropped are replaced)."""
        key, text, least = self.key, self.text, self.least
        others = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
        base = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)])
        k, t = f"c{others.index(key)}", f"c{others.index(text)}"
        names = base.columns
        met = base.join(self.doomed(docs), F.col(k) == F.col("_doc"), "left").drop("_doc")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, t):
                texts, n_lines, n_dropped = [], [], []
                for data, gone in zip(_texts(part, t), part.column("gone").to_pylist()):
                    if not gone:
                        texts.append(data)
                        n_lines.append(data.count(b"\n") + 1)
                        n_dropped.append(0)
                        continue
                    lost = {np.array([g["k1"], g["k2"]], "<i8").tobytes() for g in gone}
                    lines, keys = line_keys(data, least)
                    kept = [x for x, d in zip(lines, keys) if d not in lost]
                    texts.append(b"\n".join(kept))
                    n_lines.append(len(lines))
                    n_dropped.append(len(lines) - len(kept))
                columns = [pa.array(texts, pa.binary()).cast(pa.string()) if c == t else part.column(c) for c in names]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=[*names, "n_lines", "n_dropped"])

        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in base.schema) + ", n_lines long, n_dropped long"
        return met.mapInArrow(run, schema).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(others)], "n_lines", "n_dropped")


def dedup_lines(docs: DataFrame, copies: int = 5, least: int = 40, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` indexed and rid of its repeated lines: see LineIndex.apply. An empty table gives an empty table."""
    return LineIndex.build(docs, copies, least, key=key, text=text).apply(docs)


def kept_digest(text: str = "text"):
    """Lower-case hex SHA-256 of a text's UTF-8 bytes."""
    return F.sha2(F.col(text), 256)
