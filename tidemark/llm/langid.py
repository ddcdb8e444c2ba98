"""Language identification by a string kernel: presence of blended n-grams, Nyström landmarks, ridge regression."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import fold, hash01, slices

_LETTER = re.compile(r"[^\W\d_]")
#: Longest n-gram; log2 of the hashed n-gram space; rows to fit on (bound, over all languages); landmarks; ridge.
LONGEST, BITS, SAMPLE, LANDMARKS, RIDGE = 4, 15, 2000, 128, 1e-3
UNKNOWN = "und"


def mark_grams(row: np.ndarray, text: str, longest: int = LONGEST) -> None:
    """Set 1 in ``row`` at the hash of every n-gram of 1 to ``longest`` characters of the whole lower-cased text."""
    shift = np.uint64(64 - (len(row) - 1).bit_length())
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    for at in range(0, len(points), 1 << 18):
        c = points[at : at + (1 << 18) + longest - 1].astype(np.uint64)
        h = np.zeros(len(c), np.uint64)
        for n in range(1, longest + 1):
            if len(c) < n:
                break
            h = (h[: len(c) - n + 1] + c[n - 1 :] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            row[(h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93) >> shift] = 1


@dataclass
class Model:
    """Languages, the landmarks' presence (grams x landmarks, scaled to length 1) and weights (landmarks x languages) with a bias."""

    languages: list[str]
    landmarks: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def kernel(self, presence: np.ndarray) -> np.ndarray:
        """Normalised kernel of texts (rows of 0 and 1) and landmarks: one matrix product for the batch."""
        size = np.sqrt(np.maximum(1, presence.sum(axis=1, keepdims=True)))
        return presence @ self.landmarks / size

    def decide(self, presence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Position of the best language and its share of the softmax over all languages' regressions."""
        f = self.kernel(presence) @ self.weights + self.bias
        e = np.exp(4 * (f - f.max(axis=1, keepdims=True)))
        return f.argmax(axis=1), e.max(axis=1) / e.sum(axis=1)


def fit(presence: list[np.ndarray], languages: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model | None:
    """One-versus-rest kernel ridge regression on the Nyström features of packed presence rows; None without rows."""
    if not languages:
        return None
    names = sorted(set(languages))
    y = np.where(np.array(languages)[:, None] == np.array(names), 1.0, -1.0)
    row = lambda x: np.unpackbits(x).astype(np.float32)
    chosen = np.unique(np.linspace(0, len(presence) - 1, min(landmarks, len(presence))).astype(int))
    marks = np.stack([row(presence[i]) for i in chosen], axis=1)
    marks /= np.sqrt(np.maximum(1, marks.sum(axis=0)))
    model = Model(names, marks, np.zeros((len(chosen), len(names)), np.float32), np.zeros(len(names), np.float32))
    k = np.concatenate([model.kernel(np.stack([row(x) for x in presence[a : a + 64]])) for a in range(0, len(presence), 64)]).astype(float)
    value, vector = np.linalg.eigh(k[chosen])
    kept = value > 1e-6 * value[-1]
    root = vector[:, kept] / np.sqrt(value[kept])
    features = k @ root
    mean, level = features.mean(axis=0), y.mean(axis=0)
    centred = features - mean
    w = np.linalg.solve(centred.T @ centred + ridge * len(y) * np.eye(centred.shape[1]), centred.T @ (y - level))
    model.weights = (root @ w).astype(np.float32)
    model.bias = (level - mean @ w).astype(np.float32)
    return model


def learn(docs: DataFrame, rows: int = SAMPLE, bits: int = BITS, key: str = "doc_id", text: str = "text", label: str = "lang") -> Model | None:
    """Fit on at most ``rows`` labelled rows of folds 1 to 4: the first by hash, languages in equal shares as far as they have rows.

    Keys and labels are chosen first; texts are read for the chosen alone and reach the driver as bits."""
    known = docs.select(F.col(key).alias("k"), F.col(label).alias("l"), F.col(text).alias("x")).where((fold("k") != 0) & F.col("l").isNotNull() & F.col("x").isNotNull())
    shares = known.groupBy("l").agg(F.count(F.lit(1)).alias("n"))
    chosen = known.select("k", "l").join(shares, "l").orderBy(hash01("k") * F.col("n"), "k").limit(rows).select("k").distinct()
    taken = known.join(F.broadcast(chosen), "k", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "x"):
            packed = []
            for x in part.column("x").to_pylist():
                row = np.zeros(1 << bits, np.uint8)
                mark_grams(row, x)
                packed.append(np.packbits(row).tobytes())
            yield pa.RecordBatch.from_arrays([part.column("k"), part.column("l"), pa.array(packed, pa.binary())], names=["k", "l", "bits"])

    kind = docs.schema[key].dataType.simpleString()
    got = taken.select("k", "l", "x").mapInArrow(run, f"k {kind}, l string, bits binary").orderBy(F.xxhash64("k"), "l", "bits").limit(rows).collect()
    return fit([np.frombuffer(r["bits"], np.uint8) for r in got], [r["l"] for r in got])


def identify(docs: DataFrame, model: Model | None, bits: int = BITS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, held_out, lang_pred and score of every row. Only the text decides: null texts and texts without a letter are
    ``und`` with score 0, and so is everything if nothing could be learned."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for whole in slices(batches, text, 4 << 20):
            for part in (whole.slice(a, 256) for a in range(0, whole.num_rows, 256)):
                texts = part.column(text).to_pylist()
                told = [i for i, x in enumerate(texts) if x and m is not None and _LETTER.search(x)]
                lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
                if told:
                    presence = np.zeros((len(told), 1 << bits), np.float32)
                    for row, i in zip(presence, told):
                        mark_grams(row, texts[i])
                    best, share = m.decide(presence)
                    score[told] = share
                    for i, b in zip(told, best.tolist()):
                        lang[i] = m.languages[b]
                yield pa.RecordBatch.from_arrays([part.column(key), part.column("held_out"), pa.array(lang), pa.array(score)], names=[key, "held_out", "lang_pred", "score"])

    return docs.select(key, (fold(key) == 0).alias("held_out"), text).mapInArrow(run, f"`{key}` {kind}, held_out boolean, lang_pred string, score double")


def language(docs: DataFrame, rows: int = SAMPLE, key: str = "doc_id", text: str = "text", label: str = "lang") -> DataFrame:
    """Learn from the labelled rows and identify all rows.

    Null keys are held out, null labels are not learned from, null texts are ``und``. Repeated rows are learned from and answered
    one by one. Other columns are ignored. An empty table gives an empty table."""
    return identify(docs, learn(docs, rows, key=key, text=text, label=label), key=key, text=text)
