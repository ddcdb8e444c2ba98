"""Conversation repair against a plain recursion over all edits."""

import hashlib
import random
import zlib
from functools import lru_cache

import pytest

from tidemark.llm import convrepair, queries

BLANK = " \t\n\x0b\x0c\r"
ROWS = "conv_id long, turn long, role string, text string"


def repair_brute(rows):
    """Least (cost, audit) and the repaired turns of rows (initial, drop, cut): states are the initials so far, reduced to the last one."""
    n = len(rows)
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}

    @lru_cache(None)
    def best(i, last, added):
        found = []
        if i == n and last in ("", "a"):
            found.append((0, ""))
        if added < 3:
            for x in "ua":
                if x in follow[last]:
                    cost, audit = best(i, x, added + 1)
                    found.append((cost + 5, "I" + audit))
        if i < n:
            initial, drop, cut = rows[i]
            cost, audit = best(i + 1, last, 0)
            found.append((cost + 2, "D" + audit))
            if not drop:
                for letter, x, c in [("K", initial, 0), ("R", "u", 1), ("R", "a", 1)]:
                    if x and x in follow[last]:
                        cost, audit = best(i + 1, x, 0)
                        found.append((cost + c + 5 * cut, letter + audit))
        return min(found, default=(1 << 40, "~"))

    import sys

    sys.setrecursionlimit(100_000)
    return best(0, "", 0)


def damage_brute(rows):
    blank = lambda x: " " if x is None else x
    out = {}
    for conv, turn, role, text in rows:
        held = out.setdefault(conv, [])
        role, text = blank(role), blank(text)
        case = zlib.crc32(f"{blank(conv)}:{blank(turn)}".encode()) % 20
        if case == 0:
            continue
        if case == 1:
            text = ""
        if case == 2:
            text = "".join(c for c in text if c not in ".!?")
        if case == 4:
            role = "user"
        held += [(turn, role, text)] * (2 if case == 3 else 1)
    return out


def report_brute(conversations):
    out = []
    for conv, held in conversations.items():
        held = sorted(held, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        faults, kinds, seen = [], [], set()
        for _, role, text in held:
            kept = text.strip(BLANK)
            fault = "blank" if not kept else "duplicate" if (role, text) in seen else "truncated" if kept[-1] not in ".!?" else None
            seen.add((role, text))
            faults.append(fault)
            kinds.append((role[:1] if role[:1] in ("s", "u", "a") else "", fault in ("blank", "duplicate"), fault == "truncated"))
        cost, audit = repair_brute(tuple(kinds))
        done, at, last = [], 0, ""
        for letter in audit:
            turn = "assistant" if last == "u" else "user"
            if letter == "I":
                done.append((turn, ""))
            else:
                _, role, text = held[at]
                at += 1
                if letter == "D":
                    continue
                done.append((role if letter == "K" else turn, text))
            last = done[-1][0][0]
        turns = [t for t, *_ in held if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(held, held[1:]))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in done).encode()).hexdigest()
        out.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest))
    return out


def conversations(seed, n, longest):
    rng = random.Random(seed)
    texts = ["Fine.", "No", "why?", " ", "", None, "line\nline!", "ends here. \t\n", "é.", "...", "x" * 500, "a\x00.", "　"]
    rows = []
    for conv in range(n):
        for i in range(rng.randrange(1, longest)):
            role = rng.choices(["user", "assistant", "system", "tool", None, "", "ul", "USER"], [8, 8, 1, 1, 0.5, 0.3, 0.3, 0.3])[0]
            turn = rng.choice((i, i, i, i, rng.randrange(40), None))
            rows.append((conv if conv else None, turn, role, rng.choice(texts) if rng.random() < 0.6 else f"text {rng.random()}."))
    rng.shuffle(rows)
    return rows


def test_search_equals_recursion():
    rng = random.Random(2)
    for _ in range(600):
        kinds = bytes(rng.randrange(convrepair.END) for _ in range(rng.randrange(0, 14)))
        rows = tuple(("", True, False) if k == 0 else (convrepair.KINDS[k][0], False, convrepair.KINDS[k][1]) for k in kinds)
        assert convrepair.search(kinds) == repair_brute(rows), kinds
        cut = rng.randrange(len(kinds) + 1)
        parts = [convrepair.search(kinds[:cut], 0, (m,)) and convrepair.search(kinds[cut:], m, (t,)) and (convrepair.search(kinds[:cut], 0, (m,)), convrepair.search(kinds[cut:], m, (t,))) for m in range(4) for t in (0, 3)]
        assert min((a[0] + b[0], a[1] + b[1]) for a, b in filter(None, parts)) == convrepair.search(kinds)


@pytest.mark.parametrize("segment", [convrepair.SEGMENT, 7])
def test_repair_matches_brute_force(spark, segment):
    rows = conversations(segment, 60, 45) + [(1000, None, "user", None), (1001, 5, "assistant", "Only."), (1002, -(1 << 63), "user", "a."), (1002, (1 << 63) - 1, "assistant", "b.")]
    rows += [(1003, 1, "user", "same")] * 30 + [(1004, i, "user" if i % 2 == 0 else "assistant", "Same.") for i in range(40)] + [(1005, None, "user", "t.")] * 3
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], ROWS + ", gaps int, audit string").repartition(4)
    damaged = convrepair.damage(df)
    got = convrepair.repair(damaged, gone="gone", segment=segment)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    want = [(c, (g + (1 << 63)) % (1 << 64) - (1 << 63), *rest) for c, g, *rest in report_brute(damage_brute(rows))]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    if segment > 100:
        lines = {}
        for r in convrepair.repaired(damaged, got, gone="gone").collect():
            lines.setdefault(r.conv_id, []).append((r.place, f"{r.role}:{r.text}"))
        digest = lambda x: hashlib.sha256("\n".join(t for _, t in sorted(x)).encode()).hexdigest()
        assert all(digest(lines.get(w[0], [])) == w[-1] for w in want)


def test_query_matches_brute_force(spark):
    at = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{at}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = [tuple(r) for r in queries.op13_conversation_repair(spark, at).collect()]
    assert sorted(got) == sorted(report_brute(damage_brute(rows)))


def test_empty_tables_and_gone_rows(spark):
    none = spark.createDataFrame([], ROWS)
    assert convrepair.repair(none).count() == 0
    gone = spark.createDataFrame([(4, 1, "user", "x", True), (4, 2, "user", "x", True)], ROWS + ", gone boolean")
    assert [tuple(r) for r in convrepair.repair(gone, gone="gone").collect()] == [(4, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert [tuple(r) for r in convrepair.repair(gone, gone="gone", segment=1).collect()] == [(4, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_a_long_conversation_is_searched_whole():
    kinds = bytes([3, 5] * 5000)  # user, assistant without fault
    assert convrepair.search(kinds) == (0, "K" * 10_000)
    cost, audit = convrepair.search(bytes([3, 5, 0, 4] * 1000))
    assert len(audit) >= 4000 and cost == sum({"D": 2, "I": 5, "K": 0, "R": 1}[x] for x in audit) + 5 * sum(x != "D" for x in [*filter(lambda y: y != "I", audit)][3::4])
