"""Near copies against the Jaccard similarity of all pairs."""

import random

import corpus_pipeline
import pytest
from test_text_operators import component_brute
from pyspark.sql import functions as F

from tidemark.llm import nearcopies

DOCS = "doc_id long, text string"


def set_brute(text, width=5):
    w = (text or "").encode().lower().split()
    k = min(width, len(w))
    return {b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def jaccard_brute(rows):
    sets = [set_brute(t) for _, t in rows]

    class Bits(int):
        """Stands for a row where ``component_brute`` wants a fingerprint."""

        def __xor__(self, other):
            return Bits(not (sets[self] == sets[other] or 5 * len(sets[self] & sets[other]) >= 4 * len(sets[self] | sets[other])))

        def bit_count(self):
            return int(self)

    return component_brute([d for d, _ in rows], [Bits(i) for i in range(len(rows))], 0)


def copies():
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(3000)]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    rows, common = [], some(60)
    for base in range(60):
        w = some(rng.choice((4, 12, 50, 200)))
        if base % 3 == 0:
            w[1:1] = common
        for _ in range(rng.randrange(1, 7)):
            x = list(w)
            for _ in range(rng.randrange(0, max(2, len(x) // 40))):
                x[rng.randrange(len(x))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(x)))
    chain = some(200)
    for i in range(30):  # each is a near copy of its neighbours alone
        chain[i * 6 : i * 6 + 2] = some(2)
        rows.append((len(rows), " ".join(chain)))
    rng.shuffle(rows)
    return [*rows, (None, rows[0][1]), (900, None), (901, ""), (902, " \t"), (903, "one"), (903, "ONE"), (904, "word " * 3000)]


@pytest.mark.parametrize("chunk", [3, nearcopies.CHUNK])
def test_near_copies_match_brute_force(spark, chunk):
    rows = copies()
    docs = spark.createDataFrame(rows, DOCS).withColumn("n", F.lit(1)).withColumn("key", F.lit("clash")).withColumn("component_id", F.lit(0)).repartition(5)
    want = sorted(zip([d for d, _ in rows], jaccard_brute(rows)), key=str)
    assert sorted(map(tuple, nearcopies.near_copies(docs, chunk=chunk).collect()), key=str) == want
    assert 60 < len({c for _, c in want}) < len(rows) - 50


def test_stage_keeps_one_of_each_group_of_near_copies(spark):
    """Also those whose fingerprints differ in more bits than the op10 query links."""
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows += [(5000 + d, t) for d, t in copies() if d is not None]
    docs = spark.createDataFrame(rows, DOCS).withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    want = {d for (d, _), c in zip(rows, jaccard_brute(rows)) if d == c}
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, sf).collect()} == want


def test_near_copies_of_nothing(spark):
    assert nearcopies.near_copies(spark.createDataFrame([], DOCS)).count() == 0


def test_simhash_names_candidates_and_the_sets_decide(spark, monkeypatch):
    """The stage goes through op10's fingerprints and anchors; a link of theirs that the sets do not confirm is none."""
    from tidemark.llm import simhash

    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(400)]
    texts = [" ".join(words), " ".join([*words[:399], "other"]), " ".join(words[200:]), "", None, "a b", " ".join(words * 2)]
    df = spark.createDataFrame([*enumerate(texts)], DOCS)
    fps = {r.doc_id: r.fp for r in simhash.fingerprints(df, 5).collect()}
    made = nearcopies._sets(df, 5, nearcopies.Fraction("0.8"), nearcopies.frequencies(df), "doc_id", "text")
    assert {r.key: r.fp for r in made.collect()} == fps and (fps[0] ^ fps[1]).bit_count() <= 4
    seen = []
    monkeypatch.setattr(nearcopies, "edges", lambda f, distance: seen.append(distance) or simhash.edges(f, distance))
    want = jaccard_brute([*enumerate(texts)])
    assert [r.component_id for r in nearcopies.near_copies(df).orderBy("doc_id").collect()] == want and seen == [4]
    wrong = lambda f, distance: f.crossJoin(f.agg(F.min("fp").alias("b"))).select(F.col("fp").alias("a"), "b")
    monkeypatch.setattr(nearcopies, "edges", wrong)
    assert [r.component_id for r in nearcopies.near_copies(df).orderBy("doc_id").collect()] == want


def test_a_piece_of_a_cell_that_holds_two_fingerprints_is_compared(spark):
    """where a cell is cut, its home and the other row of a piece can be different fingerprints; such a piece was passed over."""
    from tidemark.llm import simhash

    rng = random.Random(9)
    pairs = [(a, a ^ sum(1 << i for i in rng.sample(range(64), 4))) for a in (rng.getrandbits(64) for _ in range(40))]
    signed = lambda x: x - (x >> 63 << 64)
    df = spark.createDataFrame([(signed(x),) for p in pairs for x in p], "fp long")
    found = {frozenset((r.a, r.b)) for r in simhash.edges(df, 4, chunk=1).collect()}
    assert {frozenset(map(signed, p)) for p in pairs} <= found
