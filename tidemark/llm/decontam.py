"""Benchmark decontamination: n-gram seeds that edits within the threshold cannot all break, then Smith-Waterman alignment of words."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import slices, stage

_WORD = re.compile(r"\w+")
#: log2 of the bits of the seed bitmap that every task holds, whatever the benchmark's size.
BITS = 25
#: Scores of the alignment: an equal word, another word, a skipped word.
MATCH, MISMATCH, GAP = 2, -1, -1
#: Places of score, equal words and start in one 64-bit number.
_S, _M = 42, 21
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class _Words(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        from xxhash import xxh64_intdigest

        if len(self) > 150_000:
            self.clear()
        h = self[word] = xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 7)
        return h


_WORDS = _Words()


def words(text: str | None) -> np.ndarray:
    """Hashes of a text's lower-cased words."""
    found = _WORD.findall((text or "").lower())
    return np.fromiter(map(_WORDS.__getitem__, found), np.uint64, len(found))


def grams(w: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of ``n`` words."""
    if not 0 < n <= len(w):
        return np.zeros(0, np.uint64)
    h = np.zeros(len(w) - n + 1, np.uint64)
    for i in range(n):
        h = (h ^ w[i : len(w) - n + 1 + i]) * _K1
        h ^= h >> np.uint64(29)
    return h


def _bits(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return (h >> np.uint64(64 - bits)).astype(np.int64), (h * _K2 >> np.uint64(64 - bits)).astype(np.int64)


def seed_length(size: int, least: float = 0.8, n: int = 5) -> int:
    """Words of a run that stays in any copy of an item of ``size`` words after as many edits (other, left out or put in words) as
    leave a share of ``least``; ``n`` at most, and at most all its words."""
    edits = size - math.ceil(least * size - 1e-9)
    return max(1, min(n, -(-(size - edits) // (edits + 1)))) if size else 0


def seeds(benchmark: DataFrame, least: float = 0.8, n: int = 5, item: str = "item_id", text: str = "text") -> DataFrame:
    """(gram, item): all runs of ``seed_length`` words of each item, however many items hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            found = [np.unique(grams(w, seed_length(len(w), least, n))) for w in map(words, part.column(text).to_pylist())]
            rows = np.repeat(np.arange(part.num_rows), [len(x) for x in found])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), part.column(item).take(pa.array(rows))], names=["gram", "item"])

    kind = benchmark.schema[item].dataType.simpleString()
    return benchmark.select(item, text).where(F.col(item).isNotNull()).mapInArrow(run, f"gram long, item {kind}").distinct()


def _bitmap(seeded: DataFrame, bits: int):
    """The seeds' bits, gathered as at most 2^(bits - 6) words of 64 bits, whatever the number of seeds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.concatenate(_bits(batch.column("gram").to_numpy(zero_copy_only=False).view(np.uint64), bits))
            yield pa.RecordBatch.from_arrays([pa.array((at >> 6).astype(np.int32)), pa.array((np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64))], names=["at", "word"])

    rows = seeded.select("gram").mapInArrow(run, "at int, word long").groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()
    out = np.zeros(1 << bits - 6, np.int64)
    out[rows["at"].to_numpy()] = rows["word"].to_numpy()
    return seeded.sparkSession.sparkContext.broadcast(out.view(np.uint64))


def passages(docs: DataFrame, seeded: DataFrame, margin: int, sizes: tuple[int, ...] = (5,), bits: int = BITS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, row, at, words, grams): the stretches of each whole text around n-grams that may be seeds, with ``margin`` words on
    either side. ``sizes`` are the lengths of seeds. at is the first word's place; stretches that overlap are one."""
    sent = _bitmap(seeded, bits)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = sent.value
        for part in slices(batches, text):
            keys, rows, ats, stretch, held = [], [], [], [], []
            for k, row, x in zip(part.column(key).to_pylist(), part.column("row").to_pylist(), part.column(text).to_pylist()):
                w = words(x)
                hits, seen = [], []
                for n in sizes:
                    g = grams(w, n)
                    p, q = _bits(g, bits)
                    hit = np.flatnonzero(bitmap[p >> 6] >> (p & 63).astype(np.uint64) & bitmap[q >> 6] >> (q & 63).astype(np.uint64) & np.uint64(1))
                    hits.append(hit)
                    seen.append(g[hit])
                hit, g = np.concatenate(hits), np.concatenate(seen)
                if not len(hit):
                    continue
                order = np.argsort(hit, kind="stable")
                hit, g = hit[order], g[order]
                for own in np.split(np.arange(len(hit)), np.flatnonzero(np.diff(hit) > 2 * margin) + 1):
                    a = max(0, int(hit[own[0]]) - margin)
                    keys.append(k)
                    rows.append(row)
                    ats.append(a)
                    stretch.append(w[a : int(hit[own[-1]]) + margin].view(np.int64))
                    held.append(np.unique(g[own]).view(np.int64))
            if keys:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, part.schema.field(key).type), pa.array(rows, pa.int64()), pa.array(ats, pa.int64()), pa.array(stretch, pa.list_(pa.int64())), pa.array(held, pa.list_(pa.int64()))],
                    names=[key, "row", "at", "words", "grams"],
                )

    return docs.select(key, text).withColumn("row", F.monotonically_increasing_id()).mapInArrow(run, f"`{key}` {kind}, row long, at long, words array<long>, grams array<long>")


def align(pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Best local alignment of each (passage, item): columns score, equal words, first and last word in the passage (from 0, the last
    excluded). All pairs advance together, a row of the table at a time; of equal scores the one with more equal words, then the
    later start, then the earlier end counts."""
    n, p, q = len(pairs), max(len(a) for a, _ in pairs), max(len(b) for _, b in pairs)
    names = np.unique(np.concatenate([x for pair in pairs for x in pair]))
    text, item = np.full((n, p), -1, np.int64), np.full((n, q), -2, np.int64)
    for i, (a, b) in enumerate(pairs):
        text[i, : len(a)], item[i, : len(b)] = np.searchsorted(names, a), np.searchsorted(names, b)
    equal, other, gap = (MATCH << _S) + (1 << _M), MISMATCH << _S, -GAP << _S
    fresh = np.arange(1, p + 2, dtype=np.int64)  # an alignment that begins here: score 0, its start
    slope = np.arange(p + 1, dtype=np.int64) * gap
    h = np.broadcast_to(fresh, (n, p + 1)).copy()
    best, end = h[:, 0].copy(), np.zeros(n, np.int64)
    for j in range(q):
        step = np.where(text == item[:, j : j + 1], equal, other)
        new = np.maximum(h - gap, fresh)
        new[:, 1:] = np.maximum(new[:, 1:], h[:, :-1] + step)
        h = np.maximum(np.maximum.accumulate(new + slope, axis=1) - slope, fresh)
        top = h.argmax(axis=1)
        value = h[np.arange(n), top]
        more = value >> _M > best >> _M
        best, end = np.where(more, value, best), np.where(more, top, end)
    return np.stack([best >> _S, best >> _M & (1 << _M) - 1, (best & (1 << _M) - 1) - 1, end], axis=1)


def leaks(docs: DataFrame, benchmark: DataFrame, least: float = 0.8, n: int = 5, bits: int = BITS, key: str = "doc_id", text: str = "text", item: str = "item_id") -> DataFrame:
    """``key``, ``item``, similarity (share of the item's words that the best local alignment finds again, in order), score,
    first_word and last_word (in the text, the last excluded): the best passage of a document for each item with a similarity of
    ``least`` or more.

    Words are runs of letters, digits and underscores, lower-cased; all words of all texts are looked at. Null and empty texts hold
    nothing, and so do items without a word. A copy with as many edits as ``least`` leaves (for 0.8: floor(0.2 L) words changed, left out or put in) keeps a
    run of ``seed_length`` words and is always looked at; words put in beyond that number do not lower the similarity, but a copy in
    which they leave no such run is not found. Pairs are aligned if the passage holds enough of the item's words. Null keys stay null,
    repeated keys are one document, rows with a null item are left out. Other columns are ignored. Empty tables give an empty table."""

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            w = [words(x) for x in part.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(item), pa.array([x.view(np.int64) for x in w], pa.list_(pa.int64()))], names=["item", "item_words"])

    kind = benchmark.schema[item].dataType.simpleString()
    items = stage(benchmark.select(item, text).where(F.col(item).isNotNull()).mapInArrow(lengths, f"item {kind}, item_words array<long>"), "items")
    seeded = stage(seeds(benchmark, least, n, item, text), "seeds")
    held = F.size("item_words")
    margin, lengths_held = items.agg(F.coalesce(F.max(held), F.lit(0)), F.collect_set(F.when(held > 0, held))).first()
    sizes = sorted({seed_length(size, least, n) for size in lengths_held}) or [n]
    found = stage(passages(docs, seeded, 3 * margin, tuple(sizes), bits, key, text), "passages")
    hits = found.select("row", "at", F.explode("grams").alias("gram")).join(seeded, "gram").select("row", "at", "item").distinct()
    pairs = hits.join(found.select("row", "at", F.col(key).alias("_key"), "words"), ["row", "at"]).join(items, "item")
    key_kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(a, 64) for a in range(0, whole.num_rows, 64)):
                # long passages go alone, so the padded table stays small
                size = batch.column("words").value_lengths().to_numpy(zero_copy_only=False)
                order = np.argsort(size, kind="stable")
                cut = np.flatnonzero(np.diff(np.cumsum(size[order]) // (1 << 15))) + 1
                for rows in np.split(order, cut):
                    part = batch.take(pa.array(rows))
                    table = [(np.array(a, np.int64), np.array(b, np.int64)) for a, b in zip(part.column("words").to_pylist(), part.column("item_words").to_pylist())]
                    enough = np.array([np.isin(b, a).sum() >= least * len(b) for a, b in table])
                    if not enough.any():
                        continue
                    part, table = part.filter(pa.array(enough)), [pair for pair, e in zip(table, enough) if e]
                    got = align(table)
                    share = got[:, 1] / np.array([max(1, len(b)) for _, b in table])
                    at = part.column("at").to_numpy(zero_copy_only=False)
                    kept = share >= least
                    columns = [part.column("_key"), part.column("item"), pa.array(share), pa.array(got[:, 0]), pa.array(at + got[:, 2]), pa.array(at + got[:, 3])]
                    yield pa.RecordBatch.from_arrays([c.filter(pa.array(kept)) for c in columns], names=[key, item, "similarity", "score", "first_word", "last_word"])

    scored = pairs.select("_key", "item", "at", "words", "item_words").mapInArrow(run, f"`{key}` {key_kind}, `{item}` {kind}, similarity double, score long, first_word long, last_word long")
    best = F.max_by(F.struct("similarity", "score", "first_word", "last_word"), F.struct("similarity", "score", -F.col("first_word"))).alias("b")
    return scored.groupBy(key, item).agg(best).select(key, item, "b.*")


def clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", **how) -> DataFrame:
    """The rows of ``docs`` in which ``leaks`` finds nothing; rows with a null key stay."""
    bad = leaks(docs, benchmark, key=key, **how).select(F.col(key).alias("_bad")).where("_bad is not null").distinct()
    return docs.join(bad, docs[key] == bad["_bad"], "left_anti")
