"""Block resampling, paired tests and multiple-comparison control.

A resample copies neither rows nor lists of draws: each block has one row of bytes, its multiplicity in every
rep, which is brought once to each cell of scores that holds the block. All reps are then rolled up together,
as matrices, along the scores. Draws are a hash of (seed, rep, slot), so they do not depend on partitioning or
retries. Everything after ``resample`` works on (scheme, rep, model) rows, bounded by reps x models.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from hashlib import md5
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.expr import draw_hash, unit_hash
from tidemark.functions.normal import two_sided_p
from tidemark.operators import metrics as M
from tidemark.operators.ranks import cell, dense_index, percentiles
from tidemark.sources.tables import fitted, staged

Z975 = 1.959963984540054
#: Rows of compressed scores that a cell holds (about), and bytes of a task's table of multiplicities.
CELL_ROWS, TILE = 4096, 32 << 20
#: Scores of all models and values of a crossed design's second block up to which rows are added up over blocks first.
FEW_SCORES, FEW_BLOCKS = 4096, 64


def multiplicities(df: DataFrame, block: str, reps: int, seed: int | str) -> DataFrame:
    """(rep, block, w): how often each block is drawn, blocks drawn with replacement."""
    idx = dense_index(df, block, size="_e")
    reps_col = F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))
    slots = idx.select("idx", "_e", reps_col.alias("rep"))
    pick = slots.select("rep", (draw_hash(seed, "rep", "idx") % F.col("_e")).alias("idx"))
    idx = idx.drop("_e")
    return pick.groupBy("rep", "idx").agg(F.count("*").alias("w")).join(idx, "idx").select("rep", block, "w")


_MD5_ADD = np.array([int(abs(math.sin(i + 1)) * 2**32) for i in range(64)], np.uint32)
_MD5_TURN = np.repeat([[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]], 4, axis=0).reshape(4, 4, 4).reshape(64).astype(np.uint32)
_MD5_WORD = [*range(16), *((5 * i + 1) % 16 for i in range(16)), *((3 * i + 5) % 16 for i in range(16)), *(7 * i % 16 for i in range(16))]


def md5_starts(heads: Sequence[bytes], tails: Sequence[bytes]) -> np.ndarray:
    """The first 8 bytes of the MD5 of every head followed by every tail, as big-endian numbers, heads x tails: all of one
    length are digested together, in a third of the time that calls one by one take."""
    out = np.zeros((len(heads), len(tails)), np.uint64)
    by = lambda names, n: np.array([i for i, x in enumerate(names) if len(x) == n], np.int64)
    letters = lambda names, at, n: np.frombuffer(b"".join(names[i] for i in at), np.uint8).reshape(len(at), n)
    for a in sorted({len(x) for x in heads}):
        for b in sorted({len(x) for x in tails}):
            head, tail = by(heads, a), by(tails, b)
            if a + b > 55:  # more than one block
                for i in head.tolist():
                    out[i, tail] = [int.from_bytes(md5(heads[i] + tails[j]).digest()[:8], "big") for j in tail.tolist()]
                continue
            step = max(1, 4096 // len(tail))
            ends = letters(tails, tail, b)
            for at in range(0, len(head), step):
                part = head[at : at + step]
                block = np.zeros((len(part), len(tail), 64), np.uint8)
                block[:, :, :a], block[:, :, a : a + b], block[:, :, a + b] = letters(heads, part, a)[:, None], ends, 0x80
                words = np.ascontiguousarray(block.reshape(-1, 64).view("<u4")[:, : (a + b) // 4 + 1].T)
                out[np.ix_(part, tail)] = _md5_block([*words, *[None] * (14 - len(words)), np.uint32(8 * (a + b)), None]).reshape(len(part), -1)
    return out


def _md5_block(words: Sequence) -> np.ndarray:
    """First half of the MD5 of messages of one block each: 16 words (None: zero), arrays over messages."""
    start = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    a, b, c, d = (np.full(len(words[0]), x) for x in start)
    f, t = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        if i < 32:
            x, y, z = (b, c, d) if i < 16 else (d, b, c)
            np.bitwise_xor(y, z, out=f)
            np.bitwise_and(f, x, out=f)
            np.bitwise_xor(f, z, out=f)
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            np.bitwise_not(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        f += a
        f += _MD5_ADD[i]
        if words[_MD5_WORD[i]] is not None:
            f += words[_MD5_WORD[i]]
        np.left_shift(f, _MD5_TURN[i], out=t)
        np.right_shift(f, np.uint32(32) - _MD5_TURN[i], out=f)
        f |= t
        f += b
        a, b, c, d, f = d, f, b, c, a
    return np.stack([a + start[0], b + start[1]], axis=1).astype("<u4").view(">u8").ravel().astype(np.uint64)


def multiplicity_matrix(df: DataFrame, block: str, reps: int, seed: int | str) -> DataFrame:
    """(block, w): how often each block is drawn in every rep, a byte for each. The draws are those of ``multiplicities``.

    Tasks draw for their slots and hand on 4 bytes a pick, by ranges of blocks; picks are counted in a table of blocks x reps for each
    range, whose size ``TILE`` bounds."""
    idx = staged(dense_index(df, block, size="_e"))
    size = idx.agg(F.max("_e")).first()[0] or 0
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    span = max(1, min(TILE // reps, -(-size // (4 * parts))))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ahead = [f"{seed}|{rep}|".encode() for rep in range(reps)]
        for batch in batches:
            slots = batch.column("id").to_pylist()
            for at in range(0, len(slots), 512):
                names = [b"%d" % i for i in slots[at : at + 512]]
                pick = (md5_starts(ahead, names) >> np.uint64(4)).astype(np.int64).T.ravel() % size  # 15 hex digits
                place = pick % span * reps + np.tile(np.arange(reps), len(names))
                tile = pick // span
                order = np.argsort(tile, kind="stable")
                cuts = np.flatnonzero(np.diff(tile[order])) + 1
                runs = np.split(place[order].astype(np.uint32), cuts)
                yield pa.RecordBatch.from_arrays([pa.array(tile[order][np.append(0, cuts)]), pa.array([x.tobytes() for x in runs], pa.binary())], names=["tile", "places"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles: dict[int, np.ndarray] = {}
        waiting: dict[int, list[np.ndarray]] = {}

        def counted(t: int) -> None:
            if t not in tiles:
                tiles[t] = np.zeros(min(span, size - t * span) * reps, np.uint16)
            place, n = np.unique(np.concatenate(waiting.pop(t)), return_counts=True)
            tiles[t][place] += n.astype(np.uint16)

        for batch in batches:
            for t, places in zip(batch.column("tile").to_pylist(), batch.column("places").to_pylist()):
                held = waiting.setdefault(t, [])
                held.append(np.frombuffer(places, np.uint32))
                if len(held) >= 64:
                    counted(t)
        for t in [*waiting]:
            counted(t)
        for t, held in tiles.items():
            if held.max() > 255:
                raise OverflowError("a block was drawn more than 255 times in a rep")
            held = held.astype(np.uint8).reshape(-1, reps)
            for at in range(0, len(held), 1024):
                part = held[at : at + 1024]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(part)) + t * span), pa.array([x.tobytes() for x in part], pa.binary())], names=["idx", "w"])

    slots = spark.range(0, size, 1, max(1, min(4 * parts, -(-size // 256))))
    picks = slots.mapInArrow(draw, "tile long, places binary").repartition(parts, "tile")
    return picks.mapInArrow(count, "idx long, w binary").join(idx.drop("_e"), "idx").select(block, "w")


def _matrix(column: pa.Array, kind: type = np.uint8) -> np.ndarray:
    """Binary values of one length as rows."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _binary(x: np.ndarray) -> pa.Array:
    return pa.array([x.tobytes()], pa.binary())


def weighted_sums(rows: DataFrame, keys: Sequence[str], values: Sequence[str], block: str, matrix: DataFrame, cross: tuple[str, dict[int, np.ndarray]] | None = None) -> DataFrame:
    """For each key the sums of ``values`` under every rep's multiplicities of ``block``: columns of little-endian doubles. ``cross`` names a second block of few
    values with its multiplicities, which multiply those of the first.

    Each block's multiplicities meet its rows once (both sorted by block); tasks add up what they read, so one row for each key and task is
    shuffled: keys must be few (features, heavily tied scores)."""
    kinds = [rows.schema[k].dataType for k in keys]
    arrow = [{"double": pa.float64(), "bigint": pa.int64(), "int": pa.int32()}.get(k.simpleString(), pa.string()) for k in kinds]
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    more = [cross[0]] if cross else []
    sent = rows.sparkSession.sparkContext.broadcast(cross[1]) if cross else None  # the caller bounds it
    head = matrix.select(block, "w", *[none(rows, c) for c in (*keys, *more, *values)])
    both = head.unionByName(rows.select(block, F.lit(None).cast("binary").alias("w"), *keys, *more, *values))
    both = both.repartition(block).sortWithinPartitions(block, F.col("w").isNull())

    def emitted(held: dict) -> Iterator[pa.RecordBatch]:
        for k, sums in held.items():
            yield pa.RecordBatch.from_arrays([*(pa.array([x], t) for x, t in zip(k, arrow)), *map(_binary, sums)], names=[*keys, *values])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        last = None  # the last block of the batch before and its multiplicities
        for whole in batches:
            for part in (whole.slice(a, 2048) for a in range(0, whole.num_rows, 2048)):
                is_head = part.column("w").is_valid().to_numpy(zero_copy_only=False)
                w = _matrix(part.column("w").filter(pa.array(is_head))) if is_head.any() else None
                w = w if last is None else last[1][None] if w is None else np.vstack([last[1][None], w])
                if w is None:
                    continue  # blocks that were never drawn
                at = np.cumsum(is_head) - (last is None)
                name = part.column(block).to_numpy(zero_copy_only=False)
                of = np.concatenate([name[:0] if last is None else np.array([last[0]], name.dtype), name[is_head]])
                body = np.flatnonzero(~is_head & (at >= 0))
                body = body[of[at[body]] == name[body]]
                if len(body):
                    own = part.take(pa.array(body))
                    code, names = _codes([own.column(k) for k in (*keys, *more)])
                    mine = [held.setdefault(k[: len(keys)], np.zeros((len(values), w.shape[1]))) for k in names]
                    for v, name in enumerate(values):
                        x = own.column(name).to_numpy(zero_copy_only=False).astype(float)
                        some = np.flatnonzero(x)
                        some = some[np.argsort(code[some], kind="stable")]
                        if not len(some):
                            continue
                        first = np.flatnonzero(np.append(True, np.diff(code[some]) != 0))
                        sums = np.add.reduceat(x[some, None] * w[at[body[some]]], first)
                        for k, row in zip(code[some[first]].tolist(), sums):
                            if cross:
                                times = sent.value.get(names[k][-1])
                                if times is None:
                                    continue  # never drawn
                                row *= times
                            mine[k][v] += row
                last = of[-1], w[-1]
        yield from emitted(held)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for row in batch.to_pylist():
                k, sums = tuple(row[x] for x in keys), np.stack([np.frombuffer(row[x]) for x in values])
                held[k] = held[k] + sums if k in held else sums
        yield from emitted(held)

    schema = ", ".join(f"{k} {t.simpleString()}" for k, t in zip(keys, kinds)) + "".join(f", {v} binary" for v in values)
    return both.mapInArrow(partial, schema).repartition(*keys).mapInArrow(merge, schema)


def _codes(columns: Sequence[pa.Array]) -> tuple[np.ndarray, list[tuple]]:
    """The number of each row's key among the distinct ones, and those."""
    found: dict[tuple, int] = {}
    code = [found.setdefault(k, len(found)) for k in zip(*(c.to_pylist() for c in columns))]
    return np.array(code, np.int64), [*found]


class _Roll:
    """Average precision (times positives) and wins (but for those over all negatives) of one cell, fed with rows of falling score."""

    def __init__(self, tp: np.ndarray, m: np.ndarray):
        self.tp, self.m = tp.copy(), m.copy()
        self.start = tp, m
        self.ap, self.wins = np.zeros_like(tp), np.zeros_like(tp)
        self.score, self.p, self.n = None, None, None

    def add(self, score: np.ndarray, p: np.ndarray, n: np.ndarray) -> None:
        first = np.flatnonzero(np.append(True, score[1:] != score[:-1]))
        p, n, score = np.add.reduceat(p, first), np.add.reduceat(n, first), score[first]
        if self.score == score[0]:  # the last rows ended within a tie
            p[0] += self.p
            n[0] += self.n
        elif self.score is not None:
            p, n = np.vstack([self.p, p]), np.vstack([self.n, n])
        self.score, self.p, self.n = score[-1], p[-1], n[-1]
        self._roll(p[:-1], n[:-1])

    def _roll(self, p: np.ndarray, n: np.ndarray) -> None:
        if len(p):
            tp, m = self.tp + np.cumsum(p, axis=0), self.m + np.cumsum(n, axis=0)
            self.ap += (p * tp / np.maximum(m, 1)).sum(axis=0)
            self.wins += (p * ((n - p) / 2 - (m - tp))).sum(axis=0)
            self.tp, self.m = tp[-1], m[-1]

    def close(self, model: str) -> pa.RecordBatch:
        if self.score is not None:
            self._roll(self.p[None], self.n[None])
        own = (self.tp - self.start[0], self.m - self.start[1])
        return pa.RecordBatch.from_arrays([pa.array([model]), *map(_binary, (self.ap, self.wins, *own))], names=["model", "ap", "wins", "pos", "total"])


class _Cells:
    """Reads a partition sorted by cell, with the cell's multiplicities (kind 0) first, then for each model what lies above (kind 1) and its
    rows (kind 2) by falling score. ``spans`` yields ("above", model, cell, tp, m) and ("rows", model, cell, score, p, n) with arrays of rows x reps."""

    def __init__(self, blocks: int):
        self.blocks, self.cell = blocks, None

    def _open(self, cell: int) -> None:
        self.cell = cell
        self.parts: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(self.blocks)]
        self.tables = None

    def _tables(self) -> list[tuple[np.ndarray, np.ndarray]]:
        if self.tables is None:
            self.tables = []
            for parts in self.parts:
                keys = np.concatenate([k for k, _ in parts]) if parts else np.zeros(0, np.int64)
                order = np.argsort(keys)
                self.tables.append((keys[order], np.concatenate([w for _, w in parts])[order] if parts else np.zeros((0, 0), np.uint8)))
        return self.tables

    def spans(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for whole in batches:
            if not whole.num_rows:
                continue
            cell, kind = whole.column("cell").to_numpy(), whole.column("kind").to_numpy()
            names = whole.column("model").fill_null("").dictionary_encode()
            model = names.indices.to_numpy()
            cuts = np.flatnonzero((np.diff(cell) != 0) | (np.diff(kind) != 0) | (np.diff(model) != 0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), whole.num_rows]):
                part, name = whole.slice(a, b - a), names.dictionary[int(model[a])].as_py()
                if self.cell != cell[a]:
                    self._open(int(cell[a]))
                if kind[a] == 0:
                    which = part.column("which").to_numpy()
                    for i in np.unique(which).tolist():
                        own = part.filter(pa.array(which == i))
                        self.parts[i].append((own.column("b0").to_numpy(), _matrix(own.column("w"))))
                elif kind[a] == 1:
                    yield "above", name, self.cell, np.frombuffer(part.column("pv")[0].as_py()), np.frombuffer(part.column("nv")[0].as_py())
                else:
                    for at in range(0, part.num_rows, 256):
                        yield from self._rows(name, part.slice(at, 256))

    def _rows(self, name: str, part: pa.RecordBatch) -> Iterator[tuple]:
        score = part.column("score").to_numpy(zero_copy_only=False)
        summed = part.column("pv").is_valid().to_numpy(zero_copy_only=False)
        if summed.any():  # a score whose rows were added up before
            for i in np.flatnonzero(summed).tolist():
                if i:
                    yield from self._rows(name, part.slice(0, i))
                row = part.slice(i, 1)
                yield "rows", name, self.cell, score[i : i + 1], _matrix(row.column("pv"), np.float64), _matrix(row.column("nv"), np.float64)
                yield from self._rows(name, part.slice(i + 1)) if i + 1 < part.num_rows else ()
                return
        w, known = None, np.ones(len(score), bool)
        for i, (keys, table) in enumerate(self._tables()):
            b = part.column(f"b{i}").to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.minimum(np.searchsorted(keys, b), max(0, len(keys) - 1))
            found = keys[at] == b if len(keys) else np.zeros(len(b), bool)
            known &= found  # blocks that were never drawn have no multiplicities
            if not found.any():
                return
            own = table[at].astype(np.float64)
            w = own if w is None else w * own
        p, n = (part.column(c).to_numpy(zero_copy_only=False)[:, None] * w for c in ("p", "n"))
        if known.any():
            yield "rows", name, self.cell, score[known], p[known], n[known]


def resample(
    scored: DataFrame, blocks: Sequence[str], reps: int, seed: int | str = 42, scheme: str = "entity"
) -> DataFrame:
    """Average precision and AUC per (rep, model). Two blocks multiply their
    multiplicities (crossed design). Draws without positives give NULL and drop out.

    The compressed rows are cut into cells by score, of about ``CELL_ROWS`` rows. A block's multiplicities (a byte a rep) are brought to each cell that
    holds rows of it, once for all rows and models; no row carries them. Cell totals (arrays over reps) give every cell what lies above
    it; then each cell is rolled up by itself, streaming over its scores. A score of one model that more than ``CELL_ROWS`` rows tie in is
    added up over blocks before, as all scores are if there are ``FEW_SCORES`` at most: each block's multiplicities then meet its rows once. A crossed
    design adds up before if its second block has ``FEW_BLOCKS`` values at most."""
    g = scored.groupBy("model", *blocks, F.col("score").cast("double").alias("score")).agg(F.sum("y").cast("double").alias("p"), F.count("*").cast("double").alias("n"))
    g = staged(g.select("model", "score", "p", "n", *[F.col(b).cast("long").alias(f"b{i}") for i, b in enumerate(blocks)]))
    bits = min(24, max(2, math.ceil(math.log2(max(1, g.count()) / CELL_ROWS))))
    g = g.withColumn("cell", -cell("score", bits))
    matrices = [staged(multiplicity_matrix(g, f"b{i}", reps, f"{seed}{b if i else ''}")) for i, b in enumerate(blocks)]
    none = lambda kind, c: F.lit(None).cast(kind).alias(c)
    own = {"cell": "long", "kind": "int", "which": "int", "model": "string", "score": "double", "p": "double", "n": "double", "b0": "long", "b1": "long", "w": "binary", "pv": "binary", "nv": "binary"}
    shaped = lambda df, **has: df.select([has[c].cast(k).alias(c) if c in has else none(k, c) for c, k in own.items()])
    col = F.col
    tied, cross = None, None
    if len(blocks) == 2 and matrices[1].count() <= FEW_BLOCKS:
        cross = "b1", {r["b1"]: np.frombuffer(r["w"], np.uint8).astype(np.float64) for r in matrices[1].collect()}
    if len(blocks) == 1 or cross:
        tied = staged(g.groupBy("model", "score").agg(F.count("*").alias("k")))
        if tied.count() > FEW_SCORES:
            tied = tied.where(F.col("k") > CELL_ROWS)
        tied = tied.select("model", "score")
        if tied.isEmpty():
            tied = None
    rows = g if tied is None else g.join(tied, ["model", "score"], "left_anti")
    rows_in = shaped(rows, cell=col("cell"), kind=F.lit(2), model=col("model"), score=col("score"), p=col("p"), n=col("n"), **{f"b{i}": col(f"b{i}") for i in range(len(blocks))})
    if tied is not None:
        summed = weighted_sums(g.join(tied, ["model", "score"], "left_semi").select("model", "score", "p", "n", *(f"b{i}" for i in range(len(blocks)))), ["model", "score"], ["p", "n"], "b0", matrices[0], cross)
        summed = staged(summed.withColumn("cell", -cell("score", bits)))
        rows_in = rows_in.unionByName(shaped(summed, cell=col("cell"), kind=F.lit(2), model=col("model"), score=col("score"), pv=col("p"), nv=col("n")))
    for i, m in enumerate(matrices if tied is None or not rows.isEmpty() else []):
        met = rows.select("cell", f"b{i}").distinct().join(m, f"b{i}")
        rows_in = rows_in.unionByName(shaped(met, cell=col("cell"), kind=F.lit(0), which=F.lit(i), b0=col(f"b{i}"), w=col("w")))
    rows_in = staged(rows_in)
    n_blocks = len(blocks)

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, None
        made = lambda: pa.RecordBatch.from_arrays([pa.array([at[0]]), pa.array([at[1]], pa.int64()), *map(_binary, held)], names=["model", "cell", "pv", "nv"])
        for _, model, c, _, p, n in _Cells(n_blocks).spans(batches):
            sums = [p.sum(axis=0), n.sum(axis=0)]
            if at == (model, c):
                held = [x + y for x, y in zip(held, sums)]
            else:
                if at is not None:
                    yield made()
                at, held = (model, c), sums
        if at is not None:
            yield made()

    def above(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, tp, m = None, 0.0, 0.0
        for batch in batches:
            for row in batch.to_pylist():
                p, n = np.frombuffer(row["pv"]), np.frombuffer(row["nv"])
                if row["model"] != model:
                    model, tp, m = row["model"], np.zeros_like(p), np.zeros_like(n)
                yield pa.RecordBatch.from_arrays([pa.array([model]), pa.array([row["cell"]], pa.int64()), _binary(tp), _binary(m)], names=["model", "cell", "pv", "nv"])
                tp, m = tp + p, m + n

    def roll(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, model = None, None
        for what, *span in _Cells(n_blocks).spans(batches):
            if what == "above":
                if now is not None:
                    yield now.close(model)
                model, now = span[0], _Roll(span[2], span[3])
            else:
                now.add(*span[2:])
        if now is not None:
            yield now.close(model)

    in_order = lambda df: df.repartition("cell").sortWithinPartitions("cell", F.col("kind") > 0, "model", "kind", F.col("score").desc())
    per_cell = in_order(rows_in).mapInArrow(totals, "model string, cell long, pv binary, nv binary")
    heads = per_cell.repartition("model").sortWithinPartitions("model", "cell").mapInArrow(above, "model string, cell long, pv binary, nv binary")
    heads_in = shaped(heads, cell=col("cell"), kind=F.lit(1), model=col("model"), pv=col("pv"), nv=col("nv"))
    cells = in_order(rows_in.unionByName(heads_in)).mapInArrow(roll, "model string, ap binary, wins binary, pos binary, total binary")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models: dict[str, np.ndarray] = {}
        for batch in batches:
            for row in batch.to_pylist():
                sums = np.stack([np.frombuffer(row[c]) for c in ("ap", "wins", "pos", "total")])
                models[row["model"]] = models[row["model"]] + sums if row["model"] in models else sums
        for model, (ap, wins, pos, total) in models.items():
            drawn, neg = np.flatnonzero(pos > 0), total - pos
            auc = np.where(neg[drawn] > 0, (wins + neg * pos)[drawn] / np.maximum(pos * neg, 1)[drawn], np.nan)
            yield pa.RecordBatch.from_arrays([pa.array(drawn, pa.int64()), pa.array([model] * len(drawn), pa.string()), pa.array(ap[drawn] / pos[drawn], pa.float64()), pa.array(auc, pa.float64(), from_pandas=True)], names=["rep", "model", "ap", "auc"])

    out = cells.repartition("model").mapInArrow(finish, "rep long, model string, ap double, auc double")
    return fitted(out).withColumn("scheme", F.lit(scheme))


def observed(scored: DataFrame) -> DataFrame:
    c = M.curve(M.compress(scored, ["model"]), ["model"])
    return c.groupBy("model").agg(M.average_precision().alias("ap"), M.roc_auc().alias("auc"))


def metric_intervals(scored: DataFrame, block: str, reps: int, seed: int | str = 42, alpha: float = 0.05) -> DataFrame:
    """The ranking metrics of each model with their percentile intervals over block resamples."""
    draws = resample(scored, [block], reps, seed)
    edge = lambda v: F.percentile(v, F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))
    ci = draws.groupBy("model").agg(F.count("*").alias("n_reps"), edge("ap").alias("_ap"), edge("auc").alias("_auc"))
    return observed(scored).join(ci, "model").select(
        "model", "n_reps",
        *[x.alias(f"{name}{part}") for name, c in (("pr_auc", "ap"), ("roc_auc", "auc")) for part, x in (("", F.col(c)), ("_lower", F.col(f"_{c}")[0]), ("_upper", F.col(f"_{c}")[1]))],
    )


def percentile_ci(draws: DataFrame, keys: Sequence[str], value: str, alpha: float = 0.05) -> DataFrame:
    """Percentile interval over reps (a bounded group)."""
    cut = F.percentile(value, F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))
    return draws.groupBy(*keys).agg(F.count(value).alias("n_reps"), cut[0].alias("lower"), cut[1].alias("upper"))


def pair_diffs(draws: DataFrame, value: str, pairs: Sequence[tuple[str, str]], keys: Sequence[str]) -> DataFrame:
    """Long table of model differences per pair: (keys, a, b, diff)."""
    names = sorted({m for p in pairs for m in p})
    wide = draws.groupBy(*keys).agg(*[F.max(F.when(F.col("model") == m, F.col(value))).alias(f"_{m}") for m in names])
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), (F.col(f"_{a}") - F.col(f"_{b}")).alias("diff")) for a, b in pairs]
    return wide.select(*keys, F.explode(F.array(*cells)).alias("x")).select(*keys, "x.*").where(F.col("diff").isNotNull())


def all_pairs(models: Sequence[str]) -> list[tuple[str, str]]:
    return list(combinations(models, 2))


def paired_test(draws: DataFrame, obs: DataFrame, value: str, pairs: Sequence[tuple[str, str]], alpha: float = 0.05) -> DataFrame:
    """Percentile interval, null-recentred and equal-tailed p-values, SE and normal p."""
    boot = pair_diffs(draws, value, pairs, ["rep"])
    truth = pair_diffs(obs.withColumn("_k", F.lit(0)), value, pairs, ["_k"]).select("a", "b", F.col("diff").alias("delta"))
    centred = boot.withColumn("_mean", F.avg("diff").over(Window.partitionBy("a", "b")))  # reps rows per pair
    j = centred.join(F.broadcast(truth), ["a", "b"])
    cut = F.percentile("diff", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))
    far = F.abs(F.col("diff") - F.col("_mean")) >= F.abs("delta")
    opposite = F.when(F.col("delta") >= 0, F.col("diff") <= 0).otherwise(F.col("diff") >= 0)
    out = j.groupBy("a", "b").agg(
        F.max("delta").alias("delta"), F.count("*").alias("n_reps"), cut[0].alias("lower"), cut[1].alias("upper"),
        F.stddev_samp("diff").alias("se"), ((F.count_if(far) + 1) / (F.count("*") + 1)).alias("p_recentred"),
        F.least(F.lit(1.0), 2.0 * F.avg(opposite.cast("int"))).alias("p_percentile"),
    )
    return out.withColumn("p_normal", two_sided_p(F.col("delta") / F.nullif("se", F.lit(0.0))))


def twoway(draws: DataFrame, keys: Sequence[str], value: str, entity="entity", period="period", row="row") -> DataFrame:
    """Two-way variance max(V_entity + V_period - V_row, 0) and its components."""
    v = lambda s: F.var_samp(F.when(F.col("scheme") == s, F.col(value)))
    out = draws.groupBy(*keys).agg(v(entity).alias("v_entity"), v(period).alias("v_period"), v(row).alias("v_row"))
    total = F.greatest(F.col("v_entity") + F.col("v_period") - F.col("v_row"), F.lit(0.0))
    return out.withColumn("se_twoway", F.sqrt(total))


def normal_interval(df: DataFrame, estimate: str, se: str) -> DataFrame:
    return df.withColumns({
        "lower": F.col(estimate) - Z975 * F.col(se), "upper": F.col(estimate) + Z975 * F.col(se),
        "p_value": F.when(F.col(se) > 0, two_sided_p(F.col(estimate) / F.col(se))).otherwise(0.0),
    })


def delong(wide: DataFrame, models: Sequence[str]) -> DataFrame:
    """DeLong test for every model pair from placement values.

    Rows collapse to distinct score pairs; placements come from each model's curve. With fewer than two
    rows of a class there is no variance: z is 0 and p is 1.
    """
    cells = F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("score")) for m in models])
    long = wide.select("y", F.explode(cells).alias("x")).select("y", "x.*")
    c = M.curve(M.compress(long, ["model"]), ["model"])
    neg_here = F.col("n") - F.col("p")
    place = c.select(
        "model", "score",
        ((F.col("neg") - (F.col("m") - F.col("tp")) + neg_here / 2.0) / F.nullif("neg", F.lit(0))).alias("v10"),
        ((F.col("tp") - F.col("p") / 2.0) / F.nullif("pos", F.lit(0))).alias("v01"),
    )
    pairs = F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).alias("sa"), F.col(b).alias("sb")) for a, b in all_pairs(models)
    ])
    joint = wide.select("y", F.explode(pairs).alias("x")).select("y", "x.*").groupBy("a", "b", "sa", "sb").agg(
        F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("q")
    )
    one = place.select(F.col("model").alias("a"), F.col("score").alias("sa"), F.col("v10").alias("a10"), F.col("v01").alias("a01"))
    two = place.select(F.col("model").alias("b"), F.col("score").alias("sb"), F.col("v10").alias("b10"), F.col("v01").alias("b01"))
    j = joint.join(one, ["a", "sa"]).join(two, ["b", "sb"])

    def cov(w, x, y):
        n, x, y, w = F.nullif(F.sum(w).cast("double"), F.lit(0.0)), F.col(x), F.col(y), F.col(w)
        return (F.sum(w * x * y) - F.sum(w * x) * F.sum(w * y) / n) / F.nullif(n - 1, F.lit(0.0))

    def var_delta(w, x, y):
        return (cov(w, x, x) + cov(w, y, y) - 2 * cov(w, x, y)) / F.nullif(F.sum(w).cast("double"), F.lit(0.0))

    mean = lambda x: F.sum(F.col("p") * F.col(x)) / F.nullif(F.sum("p"), F.lit(0))
    out = j.groupBy("a", "b").agg(
        mean("a10").alias("auc_a"), mean("b10").alias("auc_b"), (var_delta("p", "a10", "b10") + var_delta("q", "a01", "b01")).alias("_var")
    )
    delta, var = F.col("auc_a") - F.col("auc_b"), F.col("_var")
    z = F.when(var > 1e-18, delta / F.sqrt(F.greatest(var, F.lit(1e-18)))).otherwise(0.0)
    out = out.withColumn("delta", delta).withColumn("z", z)
    return out.withColumn("p_value", F.when(F.col("_var") > 1e-18, two_sided_p(F.col("z"))).otherwise(1.0)).drop("_var")


def holm(df: DataFrame, p: str, keys: Sequence[str] = (), tie: Sequence[str] = (), name: str = "p_holm") -> DataFrame:
    """Holm step-down over the hypotheses of a report (unrounded p-values)."""
    w = Window.partitionBy(*keys).orderBy(F.col(p), *tie)
    m = F.count("*").over(Window.partitionBy(*keys))
    step = df.withColumn("_raw", (m - F.row_number().over(w) + 1) * F.col(p))
    return step.withColumn(name, F.least(F.lit(1.0), F.max("_raw").over(w.rowsBetween(Window.unboundedPreceding, 0)))).drop("_raw")


def romano_wolf(boot: DataFrame, truth: DataFrame, hypothesis: Sequence[str]) -> DataFrame:
    """Ordered step-down on the studentised maximum.

    boot: (rep, hypothesis..., diff); truth: (hypothesis..., delta). Windows run over
    the hypotheses of one report within a rep.
    """
    h = list(hypothesis)
    j = boot.withColumn("se", F.stddev_samp("diff").over(Window.partitionBy(*h))).join(F.broadcast(truth), h)
    scale = F.when(F.col("se") > 0, F.col("se"))
    j = j.withColumns({"t_stat": F.abs("delta") / scale, "_c": F.abs(F.col("diff") - F.col("delta")) / scale})
    tail = Window.partitionBy("rep").orderBy(F.col("t_stat").asc_nulls_first(), *[F.col(c).desc() for c in h])
    top = j.withColumn("_max", F.max("_c").over(tail.rowsBetween(Window.unboundedPreceding, 0)))
    one = top.groupBy(*h).agg(
        F.max("delta").alias("delta"), F.max("se").alias("se"), F.max("t_stat").alias("t_stat"),
        F.avg((F.col("_max") >= F.col("t_stat")).cast("int")).alias("_p"),
    )
    down = Window.orderBy(F.col("t_stat").desc_nulls_last(), *h).rowsBetween(Window.unboundedPreceding, 0)
    return one.withColumn("p_adjusted", F.max("_p").over(down)).drop("_p")  # one row per hypothesis


def max_statistic(draws: DataFrame, obs: DataFrame, value: str, baseline: str) -> DataFrame:
    """One-sided test that the best challenger beats the baseline."""
    def gaps(df, keys):
        base = F.max(F.when(F.col("model") == baseline, F.col(value))).over(Window.partitionBy(*keys))  # models of one rep
        gap = F.col(value) - F.col("_base")
        return df.withColumn("_base", base).where(F.col("model") != baseline).withColumn("gap", gap)

    o = gaps(obs.withColumn("_k", F.lit(0)), ["_k"]).agg(F.max("gap").alias("observed"), F.max_by("model", "gap").alias("best_model"))
    g = gaps(draws, ["rep"])
    centred = g.withColumn("_mean", F.avg("gap").over(Window.partitionBy("model")))  # reps rows per model
    top = centred.groupBy("rep").agg(F.max(F.col("gap") - F.col("_mean")).alias("_top"))
    j = top.join(F.broadcast(o), F.lit(True))
    return j.groupBy("observed", "best_model").agg(F.avg((F.col("_top") >= F.col("observed")).cast("int")).alias("p_value"))


def model_set(draws: DataFrame, value: str, alpha: float = 0.05) -> DataFrame:
    """Range-based elimination: at most models-1 rounds, each one aggregation over the
    (rep, model) draws; only round summaries reach the driver."""
    spark = draws.sparkSession
    d = draws.select("rep", "model", F.col(value).alias("v")).persist()
    means = {r["model"]: r["m"] for r in d.groupBy("model").agg(F.avg("v").alias("m")).collect()}
    alive, gone, running = sorted(means), {}, 0.0
    while len(alive) > 1:
        sub = d.where(F.col("model").isin(alive))
        centre = sub.groupBy("model").agg(F.avg("v").alias("m"))
        spread = sub.join(F.broadcast(centre), "model").groupBy("rep").agg(
            (F.max(F.col("v") - F.col("m")) - F.min(F.col("v") - F.col("m"))).alias("s")
        )
        seen = max(means[m] for m in alive) - min(means[m] for m in alive)
        p = spread.agg(F.avg((F.col("s") >= seen).cast("int")).alias("p")).first()["p"]
        running = max(running, p)
        if running > alpha:
            break
        worst = min(alive, key=lambda m: means[m])
        gone[worst] = running
        alive.remove(worst)
    d.unpersist()
    rows = [(m, means[m], int(m in alive), gone.get(m)) for m in sorted(means)]
    return spark.createDataFrame(rows, "model string, mean_value double, in_set int, elimination_p double")


def stars(p: str) -> Column:
    c = F.col(p)
    return F.when(c < 0.001, "***").when(c < 0.01, "**").when(c < 0.05, "*").when(c < 0.10, "†").otherwise("")


# ---------------------------------------------------------------- curvature
KNOT_PROBS = (0.05, 0.275, 0.5, 0.725, 0.95)


def spline_basis(x: Column, knots: Sequence[float]) -> list[Column]:
    """Natural cubic spline columns: 1, x and one per inner knot pair."""
    last = len(knots) - 1
    cube = lambda k: F.pow(F.greatest(x - float(knots[k]), F.lit(0.0)), F.lit(3.0))
    slope = lambda k: (cube(k) - cube(last)) / float(knots[last] - knots[k])
    return [F.lit(1.0), x, *[slope(k) - slope(last - 1) for k in range(last - 1)]]


def _moments(basis: Sequence[Column], s: Column) -> list[Column]:
    """Sums needed for least squares: upper triangle of B'B, B's, s's."""
    p = len(basis)
    out = [F.sum(basis[i] * basis[j]).alias(f"g{i}_{j}") for i in range(p) for j in range(i, p)]
    return [*out, *[F.sum(basis[i] * s).alias(f"b{i}") for i in range(p)], F.sum(s * s).alias("ss")]


def _unpack(row, p: int):
    g = np.zeros((p, p))
    for i in range(p):
        for j in range(i, p):
            g[i, j] = g[j, i] = row[f"g{i}_{j}"]
    return g, np.array([row[f"b{i}"] for i in range(p)]), row["ss"]


def _knots(df: DataFrame, x: str) -> list[float]:
    return sorted({r["value"] for r in percentiles(df, [], x, list(KNOT_PROBS)).collect()})


def signed_sums(sums: DataFrame, entity: str, values: Sequence[str], reps: int, seed: int | str) -> DataFrame:
    """(rep, values): the sums of ``values`` (doubles without nulls) over the rows of ``sums``, each under its entity's sign in that rep, which is the low bit
    of ``unit_hash(seed, rep, entity)``.

    Tasks digest all reps of some hundred entities together and add up what they read, so one row for each rep and task is shuffled. ``sums`` is
    read twice: stage it if it is costly."""
    names = list(values)
    parts = int(sums.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(1, min(4 * parts, -(-sums.count() // 256)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, total = [f"{seed}|{rep}".encode() for rep in range(reps)], np.zeros((reps, len(names)))
        for batch in batches:
            tails = [b"" if e is None else b"|" + e.encode() for e in batch.column("e").to_pylist()]  # concat_ws leaves nulls out
            v = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in names])
            for at in range(0, len(tails), 512):
                odd = (md5_starts(heads, tails[at : at + 512]) >> np.uint64(32)) & np.uint64(1)  # of the first 8 hex digits
                total += (2.0 * odd - 1.0) @ v[at : at + 512]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(reps), pa.int32()), *(pa.array(c) for c in total.T)], names=["rep", *names])

    schema = ", ".join(["rep int", *(f"`{c}` double" for c in names)])
    dealt = sums.select(F.col(entity).cast("string").alias("e"), *names).repartition(tasks)
    return dealt.mapInArrow(run, schema).groupBy("rep").agg(*[F.sum(c).alias(c) for c in names])


def spline_gain(df: DataFrame, x: str, s: str, entity: str, reps: int = 999, seed: int | str = 42) -> DataFrame:
    """Spline R2 gain over a line with a wild cluster bootstrap of the linear null.

    ``df`` is read once. Its rows are staged, for knots, one set of moment sums and per-entity sums of basis x
    residual (p + 1 numbers per entity); a rep is a signed sum of those vectors.
    """
    spark = df.sparkSession
    base = staged(df.where(F.col(x).isNotNull() & F.col(s).isNotNull()).select(
        F.col(entity).alias("e"), F.col(x).cast("double").alias("x"), F.col(s).cast("double").alias("s")
    ))
    knots = _knots(base, "x")
    if len(knots) < 4:
        return spark.createDataFrame([(None, None, None, None, None, 0)], "linear_r2 double, spline_r2 double, gain double, p_value double, null_p95 double, n_reps int")
    basis = spline_basis(F.col("x"), knots)
    p = len(basis)
    g, b, ss = _unpack(base.agg(*_moments(basis, F.col("s"))).first(), p)
    lin = np.linalg.solve(g[:2, :2], b[:2])
    n, total = g[0, 0], b[0]
    tss = ss - total**2 / n
    scale = 1.0 / np.sqrt(np.diag(g))  # standardise columns before inverting
    inv = scale[:, None] * np.linalg.pinv(g * scale[:, None] * scale[None, :]) * scale[None, :]
    inv2 = np.linalg.inv(g[:2, :2])
    fit_lin, fit_spl = b[:2] @ inv2 @ b[:2], b @ inv @ b
    gain = (fit_spl - fit_lin) / tss
    fitted = F.lit(float(lin[0])) + F.lit(float(lin[1])) * F.col("x")
    resid = F.col("s") - fitted
    per_entity = base.groupBy("e").agg(*[F.sum(basis[i] * resid).alias(f"c{i}") for i in range(p)], F.sum(fitted * resid).alias("cf"))
    per_rep = signed_sums(staged(per_entity), "e", [*[f"c{i}" for i in range(p)], "cf"], reps, seed)
    start = g[:, :2] @ lin  # B' fitted
    y = [F.lit(float(start[i])) + F.col(f"c{i}") for i in range(p)]
    quad = lambda m, k: sum((F.lit(float(m[i, j])) * y[i] * y[j] for i in range(k) for j in range(k)), F.lit(0.0))
    f_sq = float(lin @ g[:2, :2] @ lin)
    e_sq = float(ss - 2 * lin @ b[:2] + f_sq)
    sq = F.lit(f_sq + e_sq) + 2 * F.col("cf")
    null = per_rep.select(((quad(inv, p) - quad(inv2, 2)) / (sq - y[0] * y[0] / float(n))).alias("g"))
    out = null.agg(F.count("g").alias("n_reps"), F.count_if(F.col("g") >= float(gain)).alias("_hit"), F.percentile("g", F.lit(0.95)).alias("null_p95"))
    centred = total**2 / n
    return out.select(
        F.lit(float((fit_lin - centred) / tss)).alias("linear_r2"), F.lit(float((fit_spl - centred) / tss)).alias("spline_r2"),
        F.lit(float(gain)).alias("gain"), ((F.col("_hit") + 1) / (F.col("n_reps") + 1)).alias("p_value"), "null_p95",
        F.col("n_reps").cast("int").alias("n_reps"),
    )


def out_of_fold_gain(df: DataFrame, x: str, s: str, entity: str, k: int = 5, seed: int | str = 42) -> float:
    """Out-of-fold R2 gain of the spline; each fold's knots come from its training rows.

    ``df`` is read once and its rows staged; only moment sums per fold and side reach the driver.
    """
    base = staged(df.where(F.col(x).isNotNull() & F.col(s).isNotNull()).select(
        F.col(x).cast("double").alias("x"), F.col(s).cast("double").alias("s"), (unit_hash(seed, entity) % k).cast("int").alias("own")
    ))
    rss_lin = rss_spl = ss = total = n = 0.0
    for fold in range(k):
        train = base.where(F.col("own") != fold)
        knots = _knots(train, "x")
        basis = spline_basis(F.col("x"), knots) if len(knots) >= 4 else [F.lit(1.0), F.col("x")]
        p = len(basis)
        sides = {r["held"]: _unpack(r, p) for r in base.groupBy((F.col("own") == fold).alias("held")).agg(*_moments(basis, F.col("s"))).collect()}
        if True not in sides:
            continue
        g, b, _ = sides[False]
        tg, tb, tss = sides[True]
        spl, lin = np.linalg.lstsq(g, b, rcond=None)[0], np.linalg.solve(g[:2, :2], b[:2])
        rss_spl += tss - 2 * spl @ tb + spl @ tg @ spl
        rss_lin += tss - 2 * lin @ tb[:2] + lin @ tg[:2, :2] @ lin
        ss, total, n = ss + tss, total + tb[0], n + tg[0, 0]
    return float((rss_lin - rss_spl) / (ss - total**2 / n))


def segmented(df: DataFrame, x: str, s: str, probs: Sequence[float]) -> DataFrame:
    """Two-slope fit, breakpoint by least residual sum of squares on a quantile grid.

    ``df`` is read once and its rows staged. One pass sums five moments per gap between breakpoints; suffix sums over the
    gaps give every candidate's normal equations, solved in closed form.
    """
    base = staged(df.where(F.col(x).isNotNull() & F.col(s).isNotNull()).select(F.col(x).cast("double").alias("x"), F.col(s).cast("double").alias("s")))
    cuts = fitted(percentiles(base, [], "x", list(probs)).select(F.col("value").alias("c")).distinct())
    arr = cuts.agg(F.sort_array(F.collect_list("c")).alias("_c"))  # at most len(probs) values
    gap = F.size(F.filter("_c", lambda c: c < F.col("x")))
    X, S = F.col("x"), F.col("s")
    bins = base.join(F.broadcast(arr), F.lit(True)).groupBy(gap.alias("bin")).agg(
        F.count("*").alias("n"), F.sum(X).alias("sx"), F.sum(X * X).alias("sxx"), F.sum(S).alias("ss"), F.sum(X * S).alias("sxs"), F.sum(S * S).alias("sss")
    )
    pos = cuts.join(F.broadcast(arr), F.lit(True)).select("c", F.array_position("_c", F.col("c")).alias("pos"))
    j = bins.join(F.broadcast(pos), F.lit(True))  # grid x grid rows
    tot = lambda c: F.sum(c)
    up = lambda c: F.sum(F.when(F.col("bin") >= F.col("pos"), F.col(c)).otherwise(0))
    a = j.groupBy("c").agg(
        *[tot(v).alias(v) for v in ("n", "sx", "sxx", "ss", "sxs", "sss")], *[up(v).alias(f"u_{v}") for v in ("n", "sx", "sxx", "ss", "sxs")]
    )
    c = F.col
    h, hh = c("u_sx") - c("c") * c("u_n"), c("u_sxx") - 2 * c("c") * c("u_sx") + c("c") * c("c") * c("u_n")
    xh, hs = c("u_sxx") - c("c") * c("u_sx"), c("u_sxs") - c("c") * c("u_ss")
    # centred cross-products, then a 2 x 2 solve
    n = c("n")
    a = a.withColumns({
        "xx": c("sxx") - c("sx") * c("sx") / n, "xh": xh - c("sx") * h / n, "hh": hh - h * h / n,
        "xs": c("sxs") - c("sx") * c("ss") / n, "hs": hs - h * c("ss") / n, "yy": c("sss") - c("ss") * c("ss") / n,
    })
    det = F.nullif(c("xx") * c("hh") - c("xh") * c("xh"), F.lit(0.0))
    a = a.withColumns({"slope_low": (c("hh") * c("xs") - c("xh") * c("hs")) / det, "change": (c("xx") * c("hs") - c("xh") * c("xs")) / det})
    a = a.withColumn("rss", c("yy") - c("slope_low") * c("xs") - c("change") * c("hs")).where(c("rss").isNotNull())
    best = a.agg(F.min(F.struct(c("rss").alias("rss"), c("c").alias("breakpoint"), c("slope_low"), c("change"))).alias("b"))
    return best.select("b.breakpoint", "b.slope_low", "b.change", (c("b.slope_low") + c("b.change")).alias("slope_high"))


