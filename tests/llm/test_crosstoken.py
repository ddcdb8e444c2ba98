"""Two tokenizers' alignments against whole encodings and a loop over all token pairs."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from sentencepiece import SentencePieceProcessor
from test_binary_operators import ODD
from tokenizers import Tokenizer

from tidemark.llm import crosstoken, queries, tokens

A_FILE, B_FILE = tokens.vocabulary("byte_bpe_50k.json"), tokens.vocabulary("piece_bpe_32k.model")
TEXTS = [None, *ODD, "  lead", "\nlead", "tail ", "</s> <s> <unk> <0x41> x", "a▁b ▁ ▁▁", "don't\n's 'll", "word " * 4000, "é́ ﬁ ① 　", "x" * 3000 + " y", "﻿bom", "same line\nsame line", "a" + " " * 50 + "b"]


def brute(texts):
    """Per text: ids of A and B, groups and links as positions; None without tokens."""
    a, b = Tokenizer.from_file(A_FILE), SentencePieceProcessor(model_file=B_FILE)
    a.encode_special_tokens = True
    printable = {c: c for c in [*range(33, 127), *range(161, 173), *range(174, 256)]}
    spare = iter(range(256, 1000))
    char = {chr(printable.get(c) or next(spare)): c for c in range(256)}
    entry = {i: bytes(char[c] for c in e) for e, i in a.get_vocab(with_added_tokens=False).items()}
    out = []
    for x in texts:
        ia = a.encode(" " + x, add_special_tokens=False).ids if x else []
        ib = b.encode(x) if x else []
        ba = [entry[i] for i in ia]
        bb = []
        for i in ib:
            p = b.id_to_piece(i)
            bb.append(bytes([int(p[1:-1], 16)]) if p.startswith("<0x") and len(p) == 6 else p.replace("▁", " ").encode())
        if not x or b"".join(ba) != (" " + x).encode() or b"".join(bb) != (" " + x).encode():
            out.append(None)
            continue
        ends = lambda y: [sum(map(len, y[: i + 1])) for i in range(len(y))] if len(y) < 400 else np.cumsum([*map(len, y)]).tolist()
        ea, eb = ends(ba), ends(bb)
        at = {}
        for j, e in enumerate(eb):
            at.setdefault(e, []).append(j)
        links = [(ia[i], ib[j]) for i, e in enumerate(ea) for j in at.get(e, [])]
        cuts = sorted(set(ea) & set(eb))
        groups, low = [], 0
        place_a, place_b = {e: i for i, e in enumerate(ea)}, {e: j for j, e in enumerate(eb)}
        ga = gb = 0
        for low in cuts:
            groups.append(",".join(map(str, ia[ga : place_a[low] + 1])) + "|" + ",".join(map(str, ib[gb : place_b[low] + 1])))
            ga, gb = place_a[low] + 1, place_b[low] + 1
        out.append((ia, ib, ";".join(groups), len(groups), links))
    return out


def rows_brute(keys, texts):
    found = brute(texts)
    counts = Counter(x for f in found if f for x in f[4])
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(most.get(b, 0), n)
    rows = []
    for k, f in zip(keys, found):
        if f is None:
            rows.append((k, 0, 0, 0, 0, 0, 0, ""))
            continue
        ia, ib, line, n, links = f
        rows.append((k, len(ia), len(ib), n, len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(line.encode()).hexdigest()))
    return rows


def test_odd_texts_match_brute_force(spark):
    rows = [(i if i != 3 else None, x) for i, x in enumerate(TEXTS)] + [(1, "same words here"), (1, "same words here")]
    df = spark.createDataFrame([(i, x, 7) for i, x in rows], "doc_id long, text string, n_a int").repartition(5)
    got = crosstoken.alignments(df, A_FILE, B_FILE)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(rows_brute(*zip(*rows)), key=str)


def test_query_matches_brute_force(spark):
    at = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{at}/documents.parquet").collect()]
    got = [tuple(r) for r in queries.op12_cross_tokens(spark, at).collect()]
    assert sorted(got) == sorted(rows_brute(*zip(*rows)))


def test_groups_are_a_real_output_and_tables_may_be_empty(spark):
    df = spark.createDataFrame([(1, "hello new world")], "doc_id long, text string")
    assert crosstoken.alignments(df, with_groups=True).first().groups == brute(["hello new world"])[0][2]
    assert crosstoken.alignments(df.where("doc_id > 1")).count() == 0
    assert [tuple(r) for r in crosstoken.alignments(df.selectExpr("doc_id", "'' as text")).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_pieces_equal_whole_texts(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBER", 300)
    aligned, rng = crosstoken.Aligner(A_FILE, B_FILE), random.Random(5)
    for _ in range(40):
        texts = ["".join(rng.choice(("a", "the", " ", " of", "\n", ".", "é", "12", "'s", "日", "\U0001f600", "Zx")) for _ in range(rng.randrange(1, 60))) for _ in range(20)]
        texts = [x for x in texts if x]
        offsets, number, places, wholes = aligned.pieces(pa.array(texts))
        whole = aligned.whole(texts)
        starts = {f: np.append(0, np.cumsum(whole[f][1])) for f in whole}
        for i in range(len(texts)):
            if i not in wholes:
                for f in ("written", "links"):
                    got = aligned.memory.runs(f, places[number[offsets[i] : offsets[i + 1]]])[0]
                    assert got.tolist() == whole[f][0][starts[f][i] : starts[f][i + 1]].tolist(), (texts[i], f)


def test_perfect_hash_and_bounds():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 50_000):
        keys = rng.choice(1 << 48, n, replace=False).astype(np.int64)
        made = crosstoken.PairHash.build(keys)
        assert sorted(made.lookup(keys).tolist()) == list(range(n))
        strange = keys[:100] + (1 << 50)
        assert (made.lookup(strange) == -1).all()
    with pytest.raises(ValueError):
        crosstoken.PairHash.build(np.array([5, 5]))
    a, b = [b"ab", b"b", b"c"], [b"b", b"xb", b"ab", b"b"]
    ends = sum(x.endswith(y) or y.endswith(x) for x in a for y in b)
    assert crosstoken.pair_bound(a, b) == ends


def test_vocabularies_without_a_fit_bound_are_refused(spark):
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    with pytest.raises(ValueError, match="more than 10"):
        crosstoken.pair_counts(df, A_FILE, B_FILE, most_pairs=10)
