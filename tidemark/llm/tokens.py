"""Whole texts to token ids with a public vocabulary, in tasks.

Both vocabularies split a text into words before they merge, so a text's ids are those of its pieces in
a row, if it is cut only where the splitting pattern cuts anyway: at white space, and between a word and the ASCII marks
behind it. Each worker remembers the ids of the
pieces it has seen, up to a bound, and hands the new ones of a batch to the library together; a text for
which the cuts are not certain is encoded as a whole.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces that a worker remembers, and pieces that it hands to the library at a time.
REMEMBER, AT_ONCE = 300_000, 10_000
#: Texts that are encoded as a whole: the beginning of a special token, which the library takes out first, the cutting mark, and
#: (if white space makes tokens) blanks in a row or of another kind than spaces and line feeds.
_UNSURE_DROPPED = r"<\||\x00"
_UNSURE = _UNSURE_DROPPED + r"|[ \n][ \n]|[\t\r\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Upper-case letters whose NFC form may differ from that of their lower-case ones.
_MARKED = r"[A-Z]\p{M}"
#: Marks that part from the word before them (apostrophes do not), if a Latin letter ends it: every table knows those, and they stay one letter.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_WORD = r"[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{12f}\x{131}-\x{24f}]\z"


class Memory(dict):
    """Ragged number arrays of pieces that were met before: piece -> place, and per place a run of each field.

    When more than ``REMEMBER`` pieces are held, those go that were met in the fewest batches (half of them at least), so common
    ones are not learned again."""

    def __init__(self, **fields: type):
        super().__init__()
        self.fields = fields
        self._clear()

    def _clear(self) -> None:
        self.clear()
        self.flat = {f: np.zeros(1 << 16, t) for f, t in self.fields.items()}
        self.begin = {f: np.zeros(1 << 14, np.int64) for f in self.fields}
        self.met = np.zeros(1 << 14, np.int32)

    def put(self, pieces: list[str], **values: tuple[np.ndarray, np.ndarray]) -> None:
        """New pieces with (values of all in a row, how many each has) for every field."""
        first, end = len(self), len(self) + len(pieces)
        for f, (flat, n) in values.items():
            begin = self.begin[f] = _room(self.begin[f], end + 1)
            used = int(begin[first])
            self.flat[f] = _room(self.flat[f], used + len(flat))
            self.flat[f][used : used + len(flat)] = flat
            begin[first + 1 : end + 1] = used + np.cumsum(n)
        self.met = _room(self.met, end)
        self.met[first:end] = 0
        self.update(zip(pieces, range(first, end)))

    def places(self, pieces: list[str]) -> np.ndarray:
        """The places of a batch's pieces, all held; a repeated one is met once."""
        k = np.fromiter(map(self.__getitem__, pieces), np.int64, len(pieces))
        self.met[k] += 1  # once for each place
        return k

    def runs(self, field: str, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The field's values of the places in a row, and how many each has."""
        first = self.begin[field][k]
        n = self.begin[field][k + 1] - first
        ends = np.cumsum(n)
        return self.flat[field][np.repeat(first - ends + n, n) + np.arange(int(ends[-1]) if len(ends) else 0)], n

    def forget(self) -> None:
        """Make room if too many pieces are held."""
        if len(self) <= REMEMBER:
            return
        often = self.met[: len(self)]
        least = max(2, int(np.partition(often, len(often) // 2)[len(often) // 2]) + 1)
        k = np.flatnonzero(often >= least)
        names = [*self]
        kept = {f: self.runs(f, k) for f in self.fields}
        self._clear()
        self.put([names[i] for i in k.tolist()], **kept)


def _room(x: np.ndarray, size: int) -> np.ndarray:
    while len(x) < size:
        x = np.concatenate([x, np.zeros_like(x)])
    return x


class Encoder:
    """Ids of texts. ``dropped``: the vocabulary drops white space, so a text may be cut at every space."""

    #: Pieces that are joined into one text for the library.
    JOINED = 200

    def __init__(self, file: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark deals the cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.dropped = len(self._ids([" \n "])[0]) == 0
        plain = "ABCDEFGHIJKLMNOPQRSTUVWXYZ aB A"
        self.lowers = self.dropped and self._ids([plain]) == self._ids([plain.lower()])
        whole, parts = self._ids([x + end for end in _MARKS for x in ("ab" + end, "aB,")]), self._ids(["ab", "aB"])
        rest = self._ids([x + end for end in _MARKS for x in (end, ",")])
        self.parted = all(w == parts[i % 2] + r for i, (w, r) in enumerate(zip(whole, rest)))
        self.reset()
        # what is put between pieces: a line feed, or (where white space is dropped) a special token; pieces hold neither
        marks = [str(t) for t in self.tokenizer.get_added_tokens_decoder().values() if t.special and str(t).startswith("<|")]
        self.between = (marks[-1] if marks else None) if self.dropped else "\n"
        found = self._ids([self.between])[0] if self.between else []
        self.mark = found[0] if len(found) == 1 else None

    def reset(self) -> None:
        self.memory = Memory(ids=np.uint32)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def ids_of(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many pieces in a row, and how many each has."""
        parts = [self._some(pieces[at : at + AT_ONCE]) for at in range(0, len(pieces), AT_ONCE)]
        return np.concatenate([np.zeros(0, np.uint32), *(ids for ids, _ in parts)]), np.concatenate([np.zeros(0, np.int64), *(n for _, n in parts)])

    def _some(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for a few: the library gets them joined, and the ids are cut at the mark between them."""
        if self.mark is not None:
            own = [i for i, x in enumerate(pieces) if x in (" ", "\n", "")]
            asked = [*pieces]
            for i in own:
                asked[i] = "a"
            joined = [self.between.join(asked[a : a + self.JOINED]) for a in range(0, len(asked), self.JOINED)]
            ids = np.array([*chain.from_iterable(x for part in self._ids(joined) for x in (part, (self.mark,)))], np.uint32)
            cuts = np.flatnonzero(ids == self.mark)
            if len(cuts) == len(pieces):  # as many marks as pieces, or a piece holds one itself
                n = np.diff(cuts, prepend=-1) - 1
                flat = np.delete(ids, cuts)
                return self._replaced(flat, n, own, [self.whole(pieces[i]) for i in own]) if own else (flat, n)
        found = [self.whole(x) for x in pieces]
        return np.concatenate([np.zeros(0, np.uint32), *found]), np.fromiter(map(len, found), np.int64, len(found))

    @staticmethod
    def _replaced(flat: np.ndarray, n: np.ndarray, own: list[int], values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        ends = np.cumsum(n)
        parts, done = [], 0
        for i, v in zip(own, values):
            parts += [flat[done : ends[i] - n[i]], v]
            done = ends[i]
        n = n.copy()
        n[own] = [*map(len, values)]
        return np.concatenate([*parts, flat[done:]]), n

    def _cut(self, texts: pa.Array) -> pa.ListArray:
        """The pieces of each text."""
        if self.dropped:
            return pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        return pc.split_pattern(pc.replace_substring(pc.replace_substring(texts, " ", "\x00 "), "\n", "\x00\n\x00"), "\x00")

    def _distinct(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a batch's distinct pieces in a row, and how many each one's word and the marks behind it have."""
        words = pc.utf8_rtrim(pieces, _MARKS)
        cut = pc.and_(pc.match_substring_regex(words, _WORD), pc.not_equal(words, pieces)) if self.parted else pa.array(np.zeros(len(pieces), bool))
        stems = pc.if_else(cut, words, pieces).dictionary_encode()
        names = stems.dictionary.to_pylist()
        marks = [x[n:] for x, n in zip(pieces.filter(cut).to_pylist(), pc.utf8_length(words.filter(cut)).to_pylist())]
        if new := [x for x in dict.fromkeys(chain(names, marks, ("",))) if x not in self.memory]:
            self.memory.put(new, ids=self.ids_of(new))
        k = np.full((len(pieces), 2), self.memory.places([""])[0])
        k[:, 0] = self.memory.places(names)[stems.indices.to_numpy()]
        k[np.flatnonzero(cut.to_numpy(zero_copy_only=False)), 1] = self.memory.places(marks)
        return self.memory.runs("ids", k.ravel())

    def all(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text; null counts as empty. A batch's pieces are numbered by Arrow, so only its distinct ones are looked up."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        unsure = pc.match_substring_regex(texts, _UNSURE_DROPPED if self.dropped else _UNSURE)
        sure = pc.if_else(unsure, "", texts)
        if self.lowers:
            sure = pc.if_else(pc.match_substring_regex(sure, _MARKED), sure, pc.ascii_lower(sure))
        cuts = self._cut(sure)
        told = cuts.flatten().dictionary_encode()
        self.memory.forget()
        held, parts = self._distinct(told.dictionary)
        lengths = parts.reshape(-1, 2).sum(axis=1)
        at = told.indices.to_numpy()
        n = lengths[at]
        until = np.cumsum(n)
        ids = held[np.repeat((np.cumsum(lengths) - lengths)[at] - until + n, n) + np.arange(int(until[-1]) if len(until) else 0)]
        ends = np.concatenate([[0], np.cumsum(n)])[cuts.offsets.to_numpy() - cuts.offsets[0].as_py()]
        for i, whole in enumerate(unsure.to_pylist()):
            yield self.whole(texts[i].as_py()) if whole else ids[ends[i] : ends[i + 1]]

    def __call__(self, text: str | None) -> np.ndarray:
        return next(self.all(pa.array([text], pa.string())))


_ENCODERS: dict[str, Encoder] = {}


def encoder(file: str) -> Encoder:
    """The worker's encoder for a vocabulary file, made once."""
    if file not in _ENCODERS:
        _ENCODERS[file] = Encoder(file)
    return _ENCODERS[file]


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def encoded(texts: pa.Array, file: str, end: int) -> Iterator[np.ndarray]:
    """Ids of each text with the ``end`` id appended."""
    for ids in encoder(file).all(texts):
        yield np.append(ids, np.uint32(end))
