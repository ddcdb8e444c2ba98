"""The pipeline's stages, each judged on its own input."""

from collections import Counter

import __spark_entry__ as entry
import corpus_pipeline
from test_near_copies import jaccard_brute
from tidemark.llm import decontam, linededup, quality

SF = "/root/testdata/sf0.01"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_all_queries_and_the_pipeline_are_registered():
    names = [q for q in entry.queries() if q.startswith("op")]
    assert sorted(int(q[2:].split("_")[0]) for q in names) == list(range(1, 14)) and "pipeline" in entry.queries()
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_pipeline_matches_a_plain_one(spark):
    """The whole run on a small table against plain Python: every line, pair of shingle sets and (document, item) pair is looked at."""
    import numpy as np
    import pyarrow as pa
    from test_binary_operators import check_packing
    from test_text_operators import line_brute
    from tokenizers import Tokenizer

    from tidemark.llm import tokens

    sf = "/root/testdata/sf0.001"
    docs, labels, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    model = quality.learn(docs, labels)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rows = [(d, t) for d, t in rows if model.score(quality.Batch(pa.array([t], pa.string())).means(model.vectors))[0] >= quality.GOOD]
    rows = [(d, t) for d, _, _, t in line_brute(rows)]
    rows = [r for r, c in zip(rows, jaccard_brute(rows)) if r[0] == c]
    items = [w for w in (decontam.words(r.text) for r in bench.collect()) if len(w)]

    def leaked(text):
        w = decontam.words(text)
        return len(w) > 0 and any(decontam.align([(w.view(np.int64), i.view(np.int64))])[0, 1] >= 0.8 * len(i) for i in items)

    rows = [(d, t) for d, t in rows if not leaked(t)]
    plain = Tokenizer.from_file(tokens.vocabulary("word_bpe_49k.json"))
    want = {d: [plain.encode(t, add_special_tokens=False).ids + [1]] for d, t in rows}
    got = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in got} == set(want) and 0 < len(want) < docs.count()
    check_packing(got, want, 4096)


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, bench = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    ids = lambda d: {r.doc_id for r in d.select("doc_id").collect()}
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert out.columns == COLUMNS and out.schema == docs.schema
        if name == "quality":
            assert ids(out) == {r.doc_id for r in quality.scored(docs, labels).collect() if r.predicted}
            assert 0 < out.count() < docs.count()
        elif name == "line_dedup":
            assert ids(out) == ids(docs)
            want = {r.doc_id: r.text for r in linededup.dedup_lines(docs).collect()}
            assert {r.doc_id: r.text for r in out.collect()} == want
            assert all(r.n_chars == len(r.text) for r in out.collect())
            held = Counter(k for r in out.collect() for k in set(r.text.split("\n")) if len(k.strip()) >= 40)
            assert max(held.values()) < 5
        elif name == "near_dedup":
            rows = [(r.doc_id, r.text) for r in docs.collect()]
            want = {d for (d, _), c in zip(rows, jaccard_brute(rows)) if d == c}
            assert ids(out) == want and len(want) == out.count() < len(rows)
        elif name == "decontamination":
            leaked = {r.doc_id for r in decontam.leaks(docs, bench).collect()}
            assert ids(out) == ids(docs) - leaked
        else:
            assert ids(out) == ids(docs)
        docs = out
