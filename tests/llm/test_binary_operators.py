"""Archives, token index, packing and the metric join against plain Python."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import metricjoin, packing, tokenindex, tokens, warc

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"
ODD = ["", " ", "\n", "a", " a", "a ", "two  spaces", "line\n\nline", "tab\tand\r\nreturn", "end\n", "\nstart", "don't we'll 'S", "é ü x", "\x00nul", "<|endoftext|> x <|endoftext|>", "a <|startoftext|>b", "é x́", "İSTANBUL ΣΑΣ Σ", "\U0001f600 \U0001f468‍\U0001f469", "x" * 5000, "\x1c a \x85 b", " \n x \n y", "123 456,78"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_whole_encoding(spark, name):
    file = tokens.vocabulary(name)
    plain = Tokenizer.from_file(file)
    texts = ODD + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + ["word " * 3000 + "\n".join(ODD)]
    encode = tokens.Encoder(file)
    for x in texts * 2:
        assert encode(x).tolist() == plain.encode(x, add_special_tokens=False).ids, repr(x[:80])
    encode.reset()
    assert encode(texts[-1]).tolist() == plain.encode(texts[-1], add_special_tokens=False).ids


# --- archives


def test_archives_round_trip(spark):
    big = "<p>" + "same page text " * 20 + "é</p>"
    rows = [(5, "http://a/", big), (3, "http://b/\n", big), (9, None, big), (9, None, big), (None, "u", big), (1, "u", None), (2, "u", ""), (4, "u", "short"), (6, "u", "short"), (7, "u", "x" * 99), (8, "u", "x" * 99), (10, "u", "x" * 100), (11, "u", "x" * 100), (11, "u", "other " * 90000), (None, None, "n" * 300), (None, None, "n" * 300), (12, "u", "a\r\n\r\nWARC/1.1\r\n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).withColumn("size", F.lit(1)).repartition(3)
    got = warc.archive(pages).collect()
    first = defaultdict(list)
    for p, _, h in rows:
        if len((h or "").encode()) >= 100 and p is not None:
            first[h].append(p)
    want = []
    for p, u, h in rows:
        h = h or ""
        least = min(first[h]) if h in first else None
        revisit = least is not None and (p is None or p > least)
        want.append((p, u.replace("\n", "%0A") if u else u, len(h.encode()), hashlib.sha256(h.encode()).hexdigest(), "revisit" if revisit else "response", least if revisit else None))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_archive_files_follow_the_format(spark, tmp_path):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    files = warc.write(pages, f"file://{tmp_path}", file_bytes=200_000).collect()
    assert sum(r.records for r in files) == pages.count()
    import zstandard

    trained = 0
    for r in files:
        raw = open(r.path.removeprefix("file://"), "rb").read()
        if int.from_bytes(raw[:4], "little") == warc.DICTIONARY_FRAME:
            trained += 1
            n = int.from_bytes(raw[4:8], "little")
            frame = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw[8 : 8 + n])).decompressobj()
            assert frame.decompress(raw[8 + n :]).startswith(b"WARC/1.1\r\nWARC-Type: ")
    assert trained
    held = {r.page_id: r.payload for r in warc.read(spark, spark.createDataFrame(files), payloads=True).collect()}
    assert {k: bytes(v).decode() for k, v in held.items()} == {r.page_id: r.html for r in pages.collect()}


def test_archives_of_nothing(spark):
    assert warc.archive(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# --- token index


def test_perfect_hash_is_minimal_and_knows_strangers():
    for n in (1, 2, 3, 7, 50, 4000):
        keys = np.random.default_rng(n).choice(np.arange(-(10**6), 10**6), n, replace=False)
        mph, slot = tokenindex.PerfectHash.build(keys)
        assert sorted(slot.tolist()) == list(range(n)) and (mph.lookup(keys) == slot).all()
    strangers = np.arange(10**7, 10**7 + 20000)
    assert (mph.lookup(strangers) >= 0).mean() < 0.001
    assert (tokenindex.PerfectHash.build(np.zeros(0, np.int64))[0].lookup(strangers[:3]) == -1).all()


def test_token_index_round_trip(spark):
    rows = [(r.doc_id * 7 - 300, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + [(None, "no key"), (None, None), (5000, None), (5001, ""), (5002, "twice"), (5002, "twice"), (5002, "a third"), (-9000, "word " * 40000)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("start", F.lit("clash")).withColumn("k", F.lit(1)).repartition(5)
    plain = Tokenizer.from_file(tokens.vocabulary("byte_bpe_50k.json"))
    ids = {i: plain.encode(t or "", add_special_tokens=False).ids + [2] for i, (_, t) in enumerate(rows)}
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, rows[i][1] is not None, rows[i][1] or ""))
    want, at = [], 0
    for i in order:
        want.append((rows[i][0], at, len(ids[i]), zlib.crc32(np.array(ids[i], "<u4").tobytes())))
        at += len(ids[i])
    got = sorted(map(tuple, tokenindex.token_index(docs).collect()), key=lambda r: r[1])
    assert got == want


def test_token_index_gives_access_by_key(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    shards = tokenindex.write(docs, f"file://{tmp_path}")
    plain = Tokenizer.from_file(tokens.vocabulary("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    wanted = [*list(texts)[::9], 10**9, -4, None]
    got = tokenindex.lookup(spark, shards, spark.createDataFrame([(k,) for k in wanted], "doc_id long")).collect()
    assert len(got) == len(wanted)
    for r in got:
        assert r.ids == (plain.encode(texts[r.doc_id], add_special_tokens=False).ids + [2] if r.doc_id in texts else None)
    assert tokenindex.token_index(docs.limit(0)).count() == 0


# --- packing


def check_packing(rows, docs_ids, capacity):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append((r.start, r.piece, r.length, r.ids_crc32))
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for members in by_sequence.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    for d, all_ids in docs_ids.items():
        want = []
        for ids in all_ids:
            want += [(a, a // capacity, len(ids[a : a + capacity]), zlib.crc32(np.array(ids[a : a + capacity], "<u4").tobytes())) for a in range(0, len(ids), capacity)]
        assert sorted(by_doc[d]) == sorted(want)
    return len(by_sequence)


def test_packing_keeps_all_ids_in_few_sequences(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + [(900, None), (901, ""), (None, "no key"), (902, "word " * 12287), (903, "word " * 4095), (903, "word " * 4096), (903, "x")]
    docs = spark.createDataFrame(rows, DOCS).withColumn("row", F.lit("clash")).withColumn("length", F.lit(1)).repartition(4)
    plain = Tokenizer.from_file(tokens.vocabulary("word_bpe_49k.json"))
    ids = defaultdict(list)
    for d, t in rows:
        ids[d].append(plain.encode(t or "", add_special_tokens=False).ids + [1])
    total = sum(len(x) for v in ids.values() for x in v)
    n = check_packing(packing.pack(docs).collect(), ids, 4096)
    assert n <= -(-total // 4096) * 1.03 + 1
    few = check_packing(packing.pack(docs, capacity=512, open_bins=2).collect(), ids, 512)
    assert few <= -(-total // 512) * 1.6
    placed = {r.sequence_id: r.ids for r in packing.sequences(docs).collect()}
    assert len(placed) == n and sum(map(len, placed.values())) == total
    assert packing.pack(docs.limit(0)).count() == 0


def test_best_fit_takes_the_tightest_bin_and_closes_the_fullest():
    fit = packing.BestFit(10, 2)
    assert fit.place(6) == (0, 0) and fit.place(7) == (1, 0)
    assert fit.place(3) == (1, 7)  # the tightest; now full and closed
    assert fit.place(5) == (2, 0)
    assert fit.place(8) == (3, 0)  # bin 0, the fuller of the two open ones, has closed
    assert fit.place(4) == (2, 5) and fit.place(4) == (4, 0)
    for bad in (0, 11):
        with pytest.raises(ValueError):
            fit.place(bad)


# --- metric join


def join_brute(rows, least):
    ok = lambda v: v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)
    n = len(rows)
    links, root = [0] * n, list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            (_, a, la), (_, b, lb) = rows[i], rows[j]
            if la is not None and la == lb and ok(a) and ok(b) and len(a) == len(b):
                a, b = np.array(a, float), np.array(b, float)
                a, b = a / np.abs(a).max(), b / np.abs(b).max()
                if a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= least:
                    links[i] += 1
                    links[j] += 1
                    root[find(i)] = find(j)
    groups = defaultdict(list)
    for i, (k, _, _) in enumerate(rows):
        groups[find(i)].append(k)
    component = [min((k for k in groups[find(i)] if k is not None), default=None) for i in range(n)]
    return sorted([(k, links[i], component[i], k is not None and k == component[i]) for i, (k, _, _) in enumerate(rows)], key=str)


def vectors(seed=0, dim=8):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(160):
        c = np.random.default_rng(i % 12).normal(size=dim)
        rows.append((i, (c + rng.normal(size=dim) * 0.25).astype(np.float32).tolist(), i % 2 if i % 11 else None))
    nan, inf = float("nan"), float("inf")
    rows += [(500 + i, rows[3][1], 1) for i in range(6)] + [(600, None, 1), (601, [], 1), (602, [0.0] * dim, 1), (603, [nan] + [1.0] * (dim - 1), 1), (604, [inf] + [1.0] * (dim - 1), 1)]
    rows += [(605, [1.0, 2.0], 1), (606, [2.0, 4.0], 1), (607, [1.0, -2.0], 1), (608, [None] + [1.0] * (dim - 1), 1), (3, rows[3][1], 1), (3, rows[40][1], 0), (None, rows[3][1], 1), (None, [9.0, 0.0, 0.0], 1), (609, [1e30, 2e30], 1)]
    return rows


@pytest.mark.parametrize(("least", "pivots", "chunk"), [(0.93, 12, 4096), (0.93, 3, 7), (0.7, 5, 16), (0.999, 1, 4096)])
def test_metric_join_matches_brute_force(spark, least, pivots, chunk):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("v", F.lit("clash")).withColumn("node", F.lit(1)).repartition(5)
    assert sorted(map(tuple, metricjoin.range_join(df, least, pivots, chunk).collect()), key=str) == join_brute(rows, least)


def test_far_vectors_are_not_replicated():
    """Two tight groups with a pivot in each: no vector lies within reach of the other group's cell."""
    a, b = np.eye(8)[0], np.eye(8)[1]
    v = metricjoin.unit(np.concatenate([a + np.random.default_rng(1).normal(size=(20, 8)) * 0.01, b + np.random.default_rng(2).normal(size=(20, 8)) * 0.01]))
    p = metricjoin.unit(np.stack([a, b]))
    d = np.sqrt(np.maximum(0, 2 - 2 * v @ p.T))
    r = np.sqrt(2 - 2 * 0.93)
    assert (d <= d.min(axis=1, keepdims=True) + 2 * r).sum() == len(v)


def test_metric_join_of_nothing(spark):
    assert metricjoin.range_join(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_that_forgets_equals_whole_encoding(spark, monkeypatch, name):
    monkeypatch.setattr(tokens, "REMEMBER", 150)
    file = tokens.vocabulary(name)
    plain, encode = Tokenizer.from_file(file), tokens.Encoder(file)
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()] + ODD
    for x in texts * 2:
        assert encode(x).tolist() == plain.encode(x, add_special_tokens=False).ids, repr(x[:80])


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_words_are_encoded_once_whatever_marks_follow(name):
    rng, plain = random.Random(3), Tokenizer.from_file(tokens.vocabulary(name))
    encode = tokens.Encoder(tokens.vocabulary(name))
    assert encode.parted and encode.lowers == (name == "word_bpe_49k.json")
    signs = ["a", "B", "Te", "\u00c9", "\u0130", "\u212a", "\u0331", "H\u0331", "\u03a3", "\u0436", "\u4e2d", "7", "'s", "'", "'LL", ",", ".", "!)", "<|", "_", "-", "\u00d7", "=\u0338", " ", "\n"]
    texts = ["".join(rng.choices(signs, k=rng.randint(1, 12))) for _ in range(3000)]
    for text, got in zip(texts, encode.all(pa.array(texts))):
        assert got.tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)
    encode, asked = tokens.Encoder(tokens.vocabulary(name)), []
    learn = encode.ids_of
    encode.ids_of = lambda pieces: (asked.extend(pieces), learn(pieces))[1]
    list(encode.all(pa.array(["a harbour, a harbour. a harbour!", "the harbour; harbour"])))
    assert [x.strip() for x in asked].count("harbour") == 1 and not [x for x in asked if "harbour" in x and x.strip() != "harbour"]
