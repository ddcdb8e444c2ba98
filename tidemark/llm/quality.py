"""Quality classifier: averaged hashed word and character n-gram vectors under a softmax, learned together."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import fold, hash01, slices

#: Hashed places for words and character n-grams, for pairs of words, and the one for a word that follows itself.
WORDS, PAIRS = 40_000, 25_535
REPEAT, PLACES = WORDS + PAIRS, WORDS + PAIRS + 1
#: Character n-grams; numbers in a vector; rows to fit on (bound, for each class); passes; first step.
SHORTEST, LONGEST, WIDTH, SAMPLE, PASSES, STEP = 2, 4, 12, 1500, 8, 1.0
#: A document is good from this score on (fixed).
GOOD = 0.3
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _place(h: np.ndarray, n: int) -> np.ndarray:
    return ((h ^ h >> np.uint64(29)) * _K2 >> np.uint64(32)).astype(np.int64) % n


class Batch:
    """The words of a batch of texts, each distinct one looked at once.

    ``at`` numbers the words of all texts in a row, ``ends`` are the texts' bounds in it. A word's places are its own and those of
    its character n-grams, with marks for its ends; case counts."""

    def __init__(self, texts: pa.Array):
        trimmed = pc.utf8_trim_whitespace(pc.fill_null(texts.cast(pa.string()), ""))
        lists = pc.utf8_split_whitespace(trimmed)
        told = lists.flatten().dictionary_encode()
        empty = pc.equal(trimmed, "").to_numpy(zero_copy_only=False)
        bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        kept = np.ones(len(told), bool)
        kept[bounds[:-1][empty]] = False  # a text without words has one empty piece
        self.at = told.indices.to_numpy()[kept].astype(np.int64)
        self.ends = np.concatenate([[0], np.cumsum(np.diff(bounds) - empty)])
        length = pc.utf8_length(told.dictionary).to_numpy(zero_copy_only=False).astype(np.int64) + 2
        self.begin = np.cumsum(length) - length
        joined = "\x02" + "\x03\x02".join(told.dictionary.to_pylist()) + "\x03" if len(length) else ""
        self.points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        self.left = np.repeat(self.begin + length, length) - np.arange(len(self.points))  # characters to the word's end
        power = np.ones(int(length.max()) if len(length) else 1, np.uint64)
        power[1:] = np.multiply.accumulate(np.full(len(power) - 1, _K1))
        place = np.arange(len(self.points)) - np.repeat(self.begin, length)
        self.hash = np.add.reduceat(self.points * power[place], self.begin) if len(length) else np.zeros(0, np.uint64)
        self.size = 1 + sum(np.maximum(0, length - n + 1) for n in range(SHORTEST, LONGEST + 1))

    def grams(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each n the n-grams' places and first characters."""
        h = self.points * _K1
        for n in range(2, LONGEST + 1):
            h = (h[:-1] ^ self.points[n - 1 :]) * _K1
            first = np.flatnonzero(self.left[: len(h)] >= n)
            if n >= SHORTEST and len(first):
                yield _place(h[first] + np.uint64(n), WORDS), first

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of the pairs of neighbouring words of a text, and each text's bounds among them; a word that follows itself
        has a place of its own."""
        h = self.hash[self.at]
        both = np.ones(max(0, len(h) - 1), bool)
        inner = self.ends[1:-1]
        both[inner[(inner > 0) & (inner < len(h))] - 1] = False
        a, b = h[:-1][both], h[1:][both]
        n = np.maximum(0, np.diff(self.ends) - 1)
        return np.where(a == b, REPEAT, WORDS + _place(a * _K1 ^ b, PAIRS)), np.concatenate([[0], np.cumsum(n)])

    def means(self, vectors: np.ndarray) -> np.ndarray:
        """Mean vector of each text over all places of its words and pairs; zero without words."""
        out = np.zeros((len(self.ends) - 1, vectors.shape[1]))
        if len(self.at):
            word = vectors[_place(self.hash, WORDS)].astype(np.float64)
            for place, first in self.grams():
                owner = np.searchsorted(self.begin, first, "right") - 1
                starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
                word[owner[starts]] += np.add.reduceat(vectors[place], starts)
            two, bounds = self.pairs()
            some = np.flatnonzero(np.diff(self.ends))
            out[some] = np.add.reduceat(word[self.at], self.ends[some])
            more = np.flatnonzero(np.diff(bounds))
            if len(more):
                out[more] += np.add.reduceat(vectors[two], bounds[more])
            count = np.add.reduceat(self.size[self.at], self.ends[some])
            out[some] /= (count + np.diff(bounds)[some])[:, None]
        return out

    def counts(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of each text the places and how often each occurs."""
        found = [(_place(self.hash, WORDS), np.arange(len(self.hash)))] + [(p, np.searchsorted(self.begin, first, "right") - 1) for p, first in self.grams()]
        place, owner = (np.concatenate(x) for x in zip(*found))
        place = place[np.argsort(owner, kind="stable")]
        begin = np.cumsum(self.size) - self.size
        two, bounds = self.pairs()
        for i, (a, b) in enumerate(zip(self.ends, self.ends[1:])):
            word, n = np.unique(self.at[a:b], return_counts=True)
            size = self.size[word]
            at = np.repeat(begin[word] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
            total = np.bincount(place[at], np.repeat(n, size), PLACES) + np.bincount(two[bounds[i] : bounds[i + 1]], minlength=PLACES)
            used = np.flatnonzero(total)
            yield used, total[used]


@dataclass
class Model:
    vectors: np.ndarray  # places x width
    out: np.ndarray  # width x 2
    bias: np.ndarray  # 2

    def score(self, means: np.ndarray) -> np.ndarray:
        """Probability of class 1 from documents' mean vectors."""
        f = means @ self.out + self.bias
        return 1 / (1 + np.exp(np.clip(f[:, 0] - f[:, 1], -60, 60)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], seed: int = 7) -> Model:
    """Stochastic gradient descent over documents, a falling step. Without rows of both classes the score is their share (a half without any)."""
    rng = np.random.default_rng(seed)
    model = Model(rng.uniform(-1 / WIDTH, 1 / WIDTH, (PLACES, WIDTH)).astype(np.float32), np.zeros((WIDTH, 2), np.float32), np.zeros(2, np.float32))
    if len(set(labels)) < 2:
        model.bias[labels[0] if labels else 0] = 20.0 if labels else 0.0
        return model
    done, total = 0, PASSES * len(rows)
    for _ in range(PASSES):
        for i in rng.permutation(len(rows)).tolist():
            at, n = rows[i]
            step = STEP * (1 - done / total)
            done += 1
            share = (n / max(1.0, n.sum())).astype(np.float32)
            mean = share @ model.vectors[at]
            f = mean @ model.out + model.bias
            p = np.exp(f - f.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = model.out @ p
            model.out -= step * np.outer(mean, p)
            model.bias -= 0.1 * step * p
            model.vectors[at] -= step * np.outer(share, back)
    return model


def learn(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE, key: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """Fit on at most ``rows`` labelled documents of each class from folds 1 to 4, the first by hash. Keys are chosen first; texts are
    read for the chosen alone and reach the driver as counts of at most PLACES places. Of several labels of a key the greatest counts;
    labels other than 0 and 1 are left out."""
    known = labels.where((fold(key) != 0) & F.col(label).isin(0, 1)).groupBy(F.col(key).alias("k")).agg(F.max(label).cast("int").alias("y"))
    here = docs.select(F.col(key).alias("k")).where("k is not null").distinct()
    known = known.join(here, "k", "left_semi")
    one = lambda y: known.where(F.col("y") == y).orderBy(hash01("k"), "k").limit(rows)
    chosen = one(0).unionByName(one(1))
    taken = docs.select(F.col(key).alias("k"), F.col(text).alias("x")).join(F.broadcast(chosen), "k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "x", 1 << 20):
            got = [*Batch(part.column("x")).counts()]
            blobs = [[a.astype(np.uint16).tobytes() for a, _ in got], [n.astype(np.uint32).tobytes() for _, n in got]]
            yield pa.RecordBatch.from_arrays([part.column("k"), part.column("y"), *(pa.array(b, pa.binary()) for b in blobs)], names=["k", "y", "at", "n"])

    kind = docs.schema[key].dataType.simpleString()
    got = taken.select("k", "y", "x").mapInArrow(run, f"k {kind}, y int, at binary, n binary").orderBy(F.xxhash64("k"), "at", "n").limit(2 * rows).toArrow()
    held = lambda c, t: [np.frombuffer(v.as_buffer(), t) for v in got[c]]
    return fit([*zip(held("at", np.uint16), (n.astype(np.float32) for n in held("n", np.uint32)))], got["y"].to_pylist())


def _scores(docs: DataFrame, model: Model, text: str, name: str = "_score") -> DataFrame:
    """All columns of ``docs`` and the score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for part in slices(batches, text, 1 << 20):
            means = Batch(part.column(text)).means(m.vectors)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(m.score(means).astype(float))], names=[*names, name])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", `{name}` double"
    return docs.mapInArrow(run, schema)


def scored(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """``key``, held_out, score and predicted (1 from a score of 0.3) of every row.

    Only the text decides. Null and empty texts have the mean vector zero, so the score of the bias. Null keys are held out. Repeated rows are
    answered one by one. Other columns are ignored. An empty table gives an empty table."""
    model = learn(docs, labels, rows, key, text, label)
    out = _scores(docs.select(key, (fold(key) == 0).alias("held_out"), text), model, text)
    return out.select(key, "held_out", F.col("_score").alias("score"), (F.col("_score") >= GOOD).cast("int").alias("predicted"))


def good(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """The rows of ``docs`` with a score of 0.3 or more, all their columns but one named _score, which is dropped."""
    out = _scores(docs.drop("_score"), learn(docs, labels, rows, key, text, label), text)
    return out.where(F.col("_score") >= GOOD).drop("_score")
