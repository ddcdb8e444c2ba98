"""Alignment of two tokenizers over a corpus, with corpus-wide counts of the id pairs that end together.

A is a byte-level BPE of the tokenizers library over space + text, B a sentencepiece model over the text (it adds the space itself).
Two tokens are linked if their byte ranges end at the same offset; the offsets where both end cut a text's
ids into groups.

How often an id pair is linked is counted in two passes. The first aligns every document and leaves one list of
pairs and counts per task; its distinct pairs get a minimal perfect hash, under which each list is a dense vector, and the vectors
are summed up a tree. The second aligns the documents again and looks their pairs up, verified by the pair stored at the slot.

Of two tokens that end together the shorter one's bytes end the longer one's, so the vocabularies alone bound the number of pairs
(``pair_bound``); hash, keys and counts are sent to tasks under that bound, whatever the size of the corpus.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import discard, slices, stage, tree_sum, vector_row
from tidemark.llm.tokens import _UNSURE, AT_ONCE, Encoder, Memory, vocabulary

#: Most id pairs that two vocabularies may be able to link: 16 bytes each are sent to every worker.
MOST_PAIRS = 1 << 22


def byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(others)}


def bytes_a(tokenizer) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary. Added tokens are written in plain characters."""
    told = byte_level()
    entries = tokenizer.get_vocab(with_added_tokens=True)
    out = [b""] * (max(entries.values()) + 1)
    for entry, i in entries.items():
        out[i] = bytes(told[c] for c in entry) if all(c in told for c in entry) else entry.encode()
    return out


def bytes_b(model) -> list[bytes]:
    """The bytes of each id of a sentencepiece model: its piece with U+2581 as space, ``<0xHH>`` as that byte."""
    pieces = map(model.id_to_piece, range(model.get_piece_size()))
    return [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces]


def pair_bound(a: list[bytes], b: list[bytes]) -> int:
    """How many id pairs can end together: pairs of which one's bytes end the other's."""
    in_a, in_b = Counter(a), Counter(b)
    longer_a = sum(in_b[x[i:]] for x in a for i in range(len(x)))
    return longer_a + sum(in_a[x[i:]] for x in b for i in range(1, len(x)))


class Aligner:
    """Alignments of whole texts. Both vocabularies split at single spaces and line feeds before they merge, so a text's alignment is that of its
    pieces in a row, and pieces are remembered (``Memory``). Texts whose cuts are not certain (blanks in a row or of other kinds) and those
    with a piece that is not given back are aligned as a whole.

    Two fields tell an alignment: ``written``, the places of its tokens in ``self.words`` (decimal ids with the sign that follows
    them) in the order of the groups, and ``links``, a << 32 | b for each link."""

    def __init__(self, file_a: str, file_b: str):
        from sentencepiece import SentencePieceProcessor

        self.encoder, self.b = Encoder(file_a), SentencePieceProcessor(model_file=file_b)
        self.encoder.tokenizer.encode_special_tokens = True
        self.bytes_a, self.bytes_b = bytes_a(self.encoder.tokenizer), bytes_b(self.b)
        self.size_a, self.size_b = (np.array([*map(len, x)], np.int64) for x in (self.bytes_a, self.bytes_b))
        if not self.size_a.all() or not self.size_b.all():
            raise ValueError("a token without bytes ends nowhere of its own")
        ids = lambda x, ends: [f"{i}{e}" for i in range(len(x)) for e in ends]
        self.words = pa.array(ids(self.bytes_a, ",|") + ids(self.bytes_b, ",;"), pa.string())
        #: No piece of B goes on over a space or holds a line feed; A splits there by its pattern.
        self.cuttable = not any(re.search(rb"[^ ] |\n.|.\n", x, re.S) for x in self.bytes_b)
        self.blank = self.b.piece_to_id("▁")
        self.memory = Memory(written=np.int32, links=np.int64, given=np.bool_)

    def _tables(self, raws: list[str], a: tuple[np.ndarray, np.ndarray], b: list[list[int]]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        """The fields of texts with their ids of A (in a row, and how many each has) and of B. ``given`` is one mark for each: both
        vocabularies give back its bytes; else it has no tokens."""
        flat_a, n_a = a[0].astype(np.int64), a[1]
        n_b = np.fromiter(map(len, b), np.int64, len(b))
        flat_b = np.fromiter(chain.from_iterable(b), np.int64, int(n_b.sum()))
        data = [x.encode() for x in raws]
        given = np.ones(len(raws), bool)
        joined = [b"".join(map(t.__getitem__, f.tolist())) for t, f in ((self.bytes_a, flat_a), (self.bytes_b, flat_b))]
        if not joined[0] == joined[1] == b"".join(data):
            for tokens, flat, n in ((self.bytes_a, flat_a, n_a), (self.bytes_b, flat_b, n_b)):
                ends = np.cumsum(n)
                given &= [b"".join(map(tokens.__getitem__, flat[e - c : e].tolist())) == x for e, c, x in zip(ends.tolist(), n.tolist(), data)]
            flat_a, flat_b = flat_a[np.repeat(given, n_a)], flat_b[np.repeat(given, n_b)]
        size = np.array([len(x) if ok else 0 for x, ok in zip(data, given)], np.int64)
        end_a, end_b = np.cumsum(self.size_a[flat_a]), np.cumsum(self.size_b[flat_b])
        both, at_a, at_b = np.intersect1d(end_a, end_b, assume_unique=True, return_indices=True)
        # a token stands behind the other vocabulary's tokens of all groups before its own (and, for B, of its own)
        group_a, group_b = np.searchsorted(both, end_a), np.searchsorted(both, end_b)
        last_a, last_b = (np.isin(np.arange(len(x)), y) for x, y in ((flat_a, at_a), (flat_b, at_b)))
        written = np.zeros(len(flat_a) + len(flat_b), np.int32)
        written[np.arange(len(flat_a)) + np.append(0, at_b + 1)[group_a]] = 2 * flat_a + last_a
        written[np.arange(len(flat_b)) + (at_a + 1)[group_b] if len(both) else np.zeros(0, np.int64)] = 2 * (len(self.size_a) + flat_b) + last_b
        n_links = np.diff(np.searchsorted(both, np.cumsum(size), "right"), prepend=0)
        return {"written": (written, np.where(given, n_a + n_b, 0)), "links": (flat_a[at_a] << 32 | flat_b[at_b], n_links), "given": (given, np.ones(len(raws), np.int64))}

    def whole(self, texts: list[str]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        """The fields of whole texts, none of them empty."""
        raws = [f" {x}" for x in texts]
        found = [self.encoder.whole(x) for x in raws]
        flat = np.concatenate([np.zeros(0, np.uint32), *found])
        return self._tables(raws, (flat, np.fromiter(map(len, found), np.int64, len(found))), [self.b.encode(x) for x in texts])

    def _learn(self, pieces: list[str]) -> None:
        """Remember new pieces. B gets a piece without its space, which it adds, or behind a line feed."""
        first = lambda x: x[1:] if x.startswith(" ") else f"\n{x}"
        for at in range(0, len(pieces), 4 * AT_ONCE):
            some = pieces[at : at + 4 * AT_ONCE]
            b = self.b.encode([first(x) for x in some], num_threads=1)
            b = [([self.blank] if x == " " else ids) if x.startswith(" ") else ids[2:] for x, ids in zip(some, b)]
            self.memory.put(some, **self._tables(some, self.encoder.ids_of(some), b))

    def pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
        """For a batch: the offsets of each text's pieces, the number of each piece among the distinct ones, their places in the memory,
        and the rows that are to be aligned as a whole (they have no pieces)."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        unsure = pc.match_substring_regex(texts, _UNSURE + r"|\A[ \n]") if self.cuttable else pc.not_equal(texts, "")
        marked = pc.replace_substring(pc.replace_substring(pc.binary_join_element_wise(" ", texts, ""), " ", "\x00 "), "\n", "\x00\n\x00")
        self.memory.forget()
        while True:
            cuts = pc.split_pattern(pc.if_else(pc.or_(unsure, pc.equal(texts, "")), "", marked), "\x00")
            told = cuts.flatten().dictionary_encode()
            names = told.dictionary.to_pylist()
            if fresh := [x for x in names if x not in self.memory]:
                self._learn(fresh)
            places, number = self.memory.places(names), told.indices.to_numpy()
            offsets = cuts.offsets.to_numpy() - cuts.offsets[0].as_py()
            lost = ~self.memory.runs("given", places)[0]
            if not lost.any():
                return offsets, number, places, np.flatnonzero(unsure.to_numpy(zero_copy_only=False)).tolist()
            lost = np.append(0, np.cumsum(lost[number]))  # a piece that is not given back: the text as a whole decides
            unsure = pc.or_(unsure, pa.array(lost[offsets[1:]] > lost[offsets[:-1]]))


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(file_a: str, file_b: str) -> Aligner:
    """The worker's aligner of two vocabulary files, made once."""
    if (file_a, file_b) not in _ALIGNERS:
        _ALIGNERS[file_a, file_b] = Aligner(file_a, file_b)
    return _ALIGNERS[file_a, file_b]


def _added(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes and the sums of their counts."""
    found, at = np.unique(codes, return_inverse=True)
    total = np.zeros(len(found), np.int64)
    np.add.at(total, at, counts)
    return found, total


def linked(docs: DataFrame, file_a: str, file_b: str, text: str = "text") -> DataFrame:
    """First pass: one row per task with the id pairs that it found linked (a << 32 | b) and how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligned = aligner(file_a, file_b)
        codes, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for part in slices(batches, text):
            _, number, places, wholes = aligned.pieces(part.column(text))
            mine, n = aligned.memory.runs("links", places)
            often = np.repeat(np.bincount(number, minlength=len(places)), n)
            if wholes:
                more = aligned.whole(part.column(text).take(pa.array(wholes)).to_pylist())["links"][0]
                mine, often = np.concatenate([mine, more]), np.concatenate([often, np.ones(len(more), np.int64)])
            codes, counts = _added(np.concatenate([codes, mine[often > 0]]), np.concatenate([counts, often[often > 0]]))
        if len(codes):
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.list_(pa.int64())) for x in (codes, counts)], names=["pairs", "counts"])

    return docs.select(text).mapInArrow(run, "pairs array<long>, counts array<long>")


class PairHash:
    """Minimal perfect hash of distinct 64-bit keys: each level is a row of bits, set where one key alone falls; keys that fall together go on
    to the next level. A key's slot is the number of bits set before its own. ``keys`` holds the key of every slot, so
    keys that were never put in are told."""

    def __init__(self, levels: list[np.ndarray], keys: np.ndarray):
        self.levels, self.keys = levels, keys
        self.before = []
        done = 0
        for bits in levels:
            ends = np.cumsum(np.bitwise_count(bits), dtype=np.int64)
            self.before.append(done + np.append(0, ends[:-1]))
            done += int(ends[-1])

    @staticmethod
    def _place(keys: np.ndarray, level: int, words: int) -> np.ndarray:
        x = keys.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15 * (level + 1) & (1 << 64) - 1)
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        return (x ^ x >> np.uint64(31)) % np.uint64(64 * words)

    @classmethod
    def build(cls, keys: np.ndarray) -> PairHash:
        keys = np.ascontiguousarray(keys, np.int64)
        if len(np.unique(keys)) != len(keys):
            raise ValueError("keys repeat")
        levels, left = [], keys
        while len(left):
            words = -(-2 * len(left) // 64)
            at = cls._place(left, len(levels), words)
            alone = np.bincount(at.astype(np.int64), minlength=64 * words) == 1
            levels.append(np.packbits(alone, bitorder="little").view(np.uint64))
            left = left[~alone[at.astype(np.int64)]]
        out = cls(levels, np.zeros(len(keys), np.int64))
        out.keys[out._slots(keys)] = keys
        return out

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (bits, before) in enumerate(zip(self.levels, self.before)):
            at = self._place(keys[left], level, len(bits))
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            hit = (bits[word] >> bit & np.uint64(1)).astype(bool)
            below = bits[word] & ((np.uint64(1) << bit) - np.uint64(1))
            out[left[hit]] = (before[word] + np.bitwise_count(below))[hit]
            left = left[~hit]
        return out

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """Slots of the keys, -1 for keys that were not put in."""
        keys = np.ascontiguousarray(keys, np.int64)
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        slot = self._slots(keys)
        return np.where((slot >= 0) & (self.keys[slot] == keys), slot, -1)


def _hashed(found: DataFrame) -> PairHash:
    """The hash of the distinct pairs, built in a task (``pair_bound`` bounds them) and kept as a table of one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = np.sort(np.concatenate([np.zeros(0, np.int64), *(b.column("pair").to_numpy() for b in batches)]))
        made = PairHash.build(keys)
        yield pa.RecordBatch.from_arrays([pa.array([[x.tobytes() for x in made.levels]], pa.list_(pa.binary())), pa.array([made.keys.tobytes()], pa.binary())], names=["levels", "keys"])

    distinct = found.select(F.explode("pairs").alias("pair")).distinct()
    rows = stage(distinct.repartition(1).mapInArrow(run, "levels array<binary>, keys binary"), "pairhash").collect()  # one row
    levels, keys = (rows[0]["levels"], rows[0]["keys"]) if rows else ([], b"")
    return PairHash([np.frombuffer(x, np.uint64) for x in levels], np.frombuffer(keys, np.int64))


def _summed(found: DataFrame, sent) -> np.ndarray:
    """The lists of the first pass as dense vectors over the slots, added up a tree."""

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, total = sent.value, None
        for batch in batches:
            for codes, counts in zip(batch.column("pairs"), batch.column("counts")):
                slot = pairs.lookup(codes.values.to_numpy())
                if (slot < 0).any():
                    raise ValueError("a pair is not in the hash")
                total = np.zeros(len(pairs.keys), np.int64) if total is None else total
                total[slot] += counts.values.to_numpy()
        if total is not None:
            yield vector_row(total)

    total = tree_sum(found.mapInArrow(dense, "node long, v binary"), np.int64)
    return np.zeros(0, np.int64) if total is None else total


class PairCounts:
    """Corpus-wide counts of id pairs under their hash, and whether a pair is the most frequent one of its B id."""

    def __init__(self, pairs: PairHash, counts: np.ndarray):
        self.pairs, self.counts = pairs, counts
        of_b = (pairs.keys & 0xFFFFFFFF).astype(np.int64)
        most = np.zeros(int(of_b.max()) + 1 if len(of_b) else 0, np.int64)
        np.maximum.at(most, of_b, counts)
        self.best = counts == most[of_b]

    def __call__(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count and mark of each code; a code that was never counted raises."""
        slot = self.pairs.lookup(codes)
        if (slot < 0).any():
            raise ValueError("a pair was not counted")
        return self.counts[slot], self.best[slot]


def pair_counts(docs: DataFrame, file_a: str, file_b: str, text: str = "text", most_pairs: int = MOST_PAIRS) -> PairCounts:
    """First pass over all documents. Vocabularies that could link more than ``most_pairs`` id pairs are refused: the tables
    sent to tasks would have no fit bound."""
    held = aligner(file_a, file_b)
    bound = pair_bound(held.bytes_a, held.bytes_b)
    if bound > most_pairs:
        raise ValueError(f"the vocabularies can link {bound} id pairs, more than {most_pairs}")
    found = stage(linked(docs, file_a, file_b, text), "linked")
    pairs = _hashed(found)
    sent = docs.sparkSession.sparkContext.broadcast(pairs)  # 8 bytes and a few bits a pair
    out = PairCounts(pairs, _summed(found, sent))
    discard(found)
    return out


def alignments(docs: DataFrame, file_a: str | None = None, file_b: str | None = None, key: str = "doc_id", text: str = "text", with_groups: bool = False) -> DataFrame:
    """``key``, n_a, n_b (ids), n_groups, n_links, n_best (links whose count is the highest of their B id, ties included), count_sum (counts of the
    links added up), groups_sha256 (and ``groups`` itself, if asked for) of every document.

    Special tokens written in a text are plain text. Null and empty texts, and texts that a vocabulary does not give back byte for byte, have no
    tokens: zeros and an empty digest, and no part in the counts. Texts of any length are aligned whole. Repeated rows count and are
    answered each; null keys are kept. Other columns are ignored. An empty table gives an empty table."""
    file_a, file_b = file_a or vocabulary("byte_bpe_50k.json"), file_b or vocabulary("piece_bpe_32k.model")
    counted = docs.sparkSession.sparkContext.broadcast(pair_counts(docs, file_a, file_b, text))  # 17 bytes and a few bits a pair
    kind = docs.schema[key].dataType.simpleString()
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]

    def figures(aligned: Aligner, told: PairCounts, written: tuple[np.ndarray, np.ndarray], links: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """n_a, n_b, links, best and count_sum of each alignment."""
        count, best = told(links[0])
        in_a = written[0] < 2 * len(aligned.size_a)
        sums = lambda x, n: np.diff(np.append(0, np.cumsum(x, dtype=np.int64))[np.append(0, np.cumsum(n))])
        n_a = sums(in_a, written[1])
        return np.array([n_a, written[1] - n_a, links[1], sums(best, links[1]), sums(count, links[1])], np.int64)

    def lines(aligned: Aligner, written: np.ndarray, n: np.ndarray) -> list[str]:
        """The groups of each alignment as text."""
        listed = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), aligned.words.take(pa.array(written)))
        return [x[:-1] for x in pc.binary_join(listed, "").to_pylist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligned, told = aligner(file_a, file_b), counted.value
        for part in slices(batches, text, 1 << 20):
            offsets, number, places, wholes = aligned.pieces(part.column(text))
            per_piece = figures(aligned, told, aligned.memory.runs("written", places), aligned.memory.runs("links", places))
            moving = np.concatenate([np.zeros((5, 1), np.int64), np.cumsum(per_piece[:, number], axis=1)], axis=1)
            out = moving[:, offsets[1:]] - moving[:, offsets[:-1]]
            written, n = aligned.memory.runs("written", places[number])
            ends = np.append(0, np.cumsum(n))[offsets]
            groups = lines(aligned, written, np.diff(ends))
            if wholes:
                found = aligned.whole(part.column(text).take(pa.array(wholes)).to_pylist())
                out[:, wholes] = figures(aligned, told, found["written"], found["links"])
                for i, line in zip(wholes, lines(aligned, *found["written"])):
                    groups[i] = line
            n_a, n_b, n_links, n_best, count_sum = out
            columns = [part.column(key), *(pa.array(x, pa.int64()) for x in (n_a, n_b, n_links, n_links, n_best, count_sum))]
            columns.append(pa.array([hashlib.sha256(x.encode()).hexdigest() if x else "" for x in groups], pa.string()))
            columns += [pa.array(groups, pa.string())] if with_groups else []
            yield pa.RecordBatch.from_arrays(columns, names=["key", *names, "groups_sha256", *(["groups"] if with_groups else [])])

    schema = f"key {kind}, " + ", ".join(f"{x} long" for x in names) + ", groups_sha256 string" + (", groups string" if with_groups else "")
    return docs.select(key, text).mapInArrow(run, schema).withColumnRenamed("key", key)
