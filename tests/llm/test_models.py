"""Language and quality models: held-out accuracy, folds and odd input."""

import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import langid, quality

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string"


def held(d):
    return zlib.crc32(str(d).encode()) % 5 == 0


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("score", F.lit("clash")).withColumn("k", F.lit(1)).withColumn("bits", F.lit(2))
    truth = {r.doc_id: r.lang for r in docs.collect()}
    got = langid.language(docs).collect()
    assert len(got) == len(truth) and all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 for r in got)
    test = [r for r in got if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in test) / len(test) > 0.97


def test_language_of_odd_rows(spark):
    base = [(i, "the cat and the dog went home " + str(i), "en") if i % 2 else (i, "der hund und die katze gehen nach hause " + str(i), "de") for i in range(60)]
    odd = [(100, None, "en"), (101, "", "en"), (102, "123 ... !", "de"), (103, "der hund", None), (None, "the dog and the cat", "en"), (104, "the " * 100000, None), (104, "the dog", None)]
    got = {}
    for r in langid.language(spark.createDataFrame(base + odd, DOCS)).collect():
        got.setdefault(r.doc_id, []).append((r.lang_pred, r.held_out, 0 <= r.score <= 1))
    for k in (100, 101, 102):
        assert got[k][0][0] == "und"
    assert got[103][0][0] == "de" and got[None][0][:2] == ("en", True) and [x[0] for x in got[104]] == ["en", "en"]
    none = spark.createDataFrame([(1, "text", None)], DOCS)
    assert [(r.lang_pred, r.score) for r in langid.language(none).collect()] == [("und", 0.0)]
    assert langid.language(none.limit(0)).count() == 0


def test_language_does_not_look_at_held_out_labels(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    other = docs.withColumn("lang", F.when((F.crc32(F.col("doc_id").cast("string")) % 5 == 0), F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.lit("s"))
    rows = lambda d: sorted(map(tuple, langid.language(d).collect()))
    assert rows(docs) == rows(other)


def test_quality_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet").withColumn("y", F.lit(1)), spark.read.parquet(f"{sf}/labels.parquet")
    truth = {r.doc_id: r.quality for r in labels.collect()}
    got = quality.scored(docs, labels).collect()
    assert len(got) == docs.count() and all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    test = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    good = [p for p, y in test if y == 1]
    bad = [p for p, y in test if y == 0]
    assert sum(good) / len(good) > 0.95 and 1 - sum(bad) / len(bad) > 0.8, (sum(good) / len(good), 1 - sum(bad) / len(bad))


def test_quality_of_odd_rows(spark):
    rows = [(i, "a fine clean sentence about things" if i % 2 else "BUY!! NOW$$$ BUY!! NOW$$$", None) for i in range(80)] + [(200, None, None), (201, "", None), (None, "a fine sentence", None), (202, "fine clean " * 60000, None), (1, "a fine clean sentence", None)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([*((i, i % 2) for i in range(80)), (3, None), (None, 1), (5, 0), (7, 9)], "doc_id long, quality int")
    got = quality.scored(docs, labels).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and by[202].predicted == 1 and by[None].held_out and by[200].score == by[201].score
    assert by[0].predicted == 0 and by[11].predicted == 1
    kept = quality.good(docs.withColumn("_score", F.lit(1)), labels)
    assert kept.columns == ["doc_id", "text", "lang"] and kept.count() == sum(r.predicted for r in got)
    assert [r.score for r in quality.scored(docs.limit(2), labels.limit(0)).collect()] == pytest.approx([0.5, 0.5])
    assert quality.scored(docs.limit(0), labels).count() == 0


def test_batches_of_texts_give_each_text_its_own_places():
    """Means over places equal those of the counted places, and do not depend on the other texts of a batch."""
    import numpy as np
    import pyarrow as pa

    vectors = np.random.default_rng(0).normal(size=(quality.PLACES, quality.WIDTH)).astype(np.float32)
    for texts in ([None, "", "a b b a", "  x  ", "word " * 5 + "é\x02", None], ["", None], ["one"], []):
        batch = quality.Batch(pa.array(texts, pa.string()))
        means = batch.means(vectors)
        for i, (at, n) in enumerate(batch.counts()):
            assert np.allclose(means[i], (n[:, None] * vectors[at]).sum(axis=0) / max(1, n.sum()), atol=1e-4)
            assert np.allclose(quality.Batch(pa.array([texts[i]], pa.string())).means(vectors)[0], means[i], atol=1e-6)
            words = (texts[i] or "").split()
            chars = sum(max(0, len(w) + 2 - k + 1) for w in words for k in range(quality.SHORTEST, quality.LONGEST + 1))
            assert n.sum() == len(words) + chars + max(0, len(words) - 1)
            assert n[at == quality.REPEAT].sum() == sum(a == b for a, b in zip(words, words[1:]))
