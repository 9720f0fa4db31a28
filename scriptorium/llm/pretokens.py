"""Splitting many texts into byte-level pre-tokens with numpy, and naming equal ones once.

The split is the public byte-level one: contractions, an optional blank before a run of letters, digits or other
characters, and white space whose last character stands apart when text follows. All texts of a batch lie in one
array of code points; character classes are looked up, and starts of pre-tokens are found by comparing neighbours.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np

LETTER, DIGIT, OTHER, SPACE, END = 0, 1, 2, 3, 4
#: Odd multiplier of the rolling hash, and the seed of the two character tables.
_BASE, _SEED = np.uint64(0x9E3779B97F4A7C15), 20_240_601


#: Letters and digits of Unicode 16, which the tokenizers library knows and Python 3.13 doesn't yet.
_NEW_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
_NEW_DIGITS = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))


@cache
def classes() -> np.ndarray:
    """The class of each code point; the one after the last marks the end of a text."""
    out = np.full(0x110001, OTHER, np.uint8)
    for point in range(0x110000):
        kind = unicodedata.category(chr(point))
        if kind[0] == "L":
            out[point] = LETTER
        elif kind[0] == "N":
            out[point] = DIGIT
        elif kind[0] == "Z":
            out[point] = SPACE
    out[[9, 10, 11, 12, 13, 0x85]] = SPACE
    for kind, ranges in ((LETTER, _NEW_LETTERS), (DIGIT, _NEW_DIGITS)):
        for low, high in ranges:
            out[low : high + 1] = kind
    out[0x110000] = END
    return out


@cache
def _char_codes() -> np.ndarray:
    return np.random.default_rng(_SEED).integers(1, 2**63, (2, 0x110001), dtype=np.uint64)


_held: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """The first n powers of the base modulo 2**64, and of its inverse; the most that were needed are kept."""
    if not _held or len(_held[0]) < n:
        with np.errstate(over="ignore"):
            inverse = _BASE
            for _ in range(6):
                inverse *= np.uint64(2) - _BASE * inverse
            size = 1 << max(10, int(n - 1).bit_length())
            _held[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, x, np.uint64)])) for x in (_BASE, inverse)]
    return [x[:n] for x in _held]


class Split:
    """Pre-tokens of a batch of texts, in order.

    points: the code points, each text followed by an end mark. start, stop: of each pre-token. text: which text it is
    from. Empty texts have none.
    """

    def __init__(self, texts: list[str]):
        raw = chr(0).join(texts).encode("utf-32-le")
        points = np.frombuffer(raw, "<u4").copy() if raw else np.zeros(0, np.uint32)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(sizes + 1) - 1
        points = np.append(points, np.uint32(0))[: int(ends[-1]) + 1 if len(ends) else 0]
        points[ends] = 0x110000
        self.points = points
        kind = classes()[points]
        first = np.empty(len(points), bool)
        if len(points):
            first[0] = True
            first[1:] = kind[1:] != kind[:-1]
        self._white_space(first, kind, points)
        self._contractions(first, kind, points)
        first |= kind == END
        at = np.flatnonzero(first)
        inner = kind[at] != END
        self.start = at[inner]
        self.stop = np.append(at[1:], len(points))[inner] if len(at) else at
        self.text = np.searchsorted(ends, self.start)

    @staticmethod
    def _white_space(first: np.ndarray, kind: np.ndarray, points: np.ndarray) -> None:
        """The last character of white space before other text starts a pre-token; a plain blank takes that text along."""
        last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] < SPACE)) if len(kind) else np.zeros(0, np.int64)
        first[last] = True
        first[last[points[last] == 32] + 1] = False

    @staticmethod
    def _contractions(first: np.ndarray, kind: np.ndarray, points: np.ndarray) -> None:
        """An apostrophe that starts a pre-token takes s, t, m, d, re, ve or ll along."""
        if len(kind) < 2:
            return
        mark = np.flatnonzero((points[:-1] == 39) & first[:-1] & (kind[1:] == LETTER))
        one = points[mark + 1]
        two = points[np.minimum(mark + 2, len(points) - 1)]
        size = np.zeros(len(mark), np.int64)
        size[np.isin(one, [ord(c) for c in "stmd"])] = 1
        for a, b in ("re", "ve", "ll"):
            size[(one == ord(a)) & (two == ord(b))] = 2
        mark, size = mark[size > 0], size[size > 0]
        first[mark + 1] = False
        after = mark + 1 + size
        inside = kind[after] == LETTER
        first[after[inside]] = True

    def named(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(the first pre-token of each distinct one, the distinct one that each pre-token is, two 64-bit hashes of each
        distinct one, in the order of the first). Hashes are of the characters alone, so they are names in any batch."""
        n = len(self.points)
        up, down = _powers(max(1, n))
        up, down = up[:n], down[:n]
        length = (self.stop - self.start).astype(np.uint64)
        sums = []
        with np.errstate(over="ignore"):
            for codes in _char_codes():
                rolled = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes[self.points] * up, dtype=np.uint64)])
                sums.append((rolled[self.stop] - rolled[self.start]) * down[self.start] + length * _BASE)
        order = np.argsort(sums[0])
        a, b = sums[0][order], sums[1][order]
        new = np.ones(len(order), bool)
        new[1:] = a[1:] != a[:-1]
        if np.any((b[1:] != b[:-1]) & ~new[1:]):
            order = np.lexsort((sums[1], sums[0]))
            a, b = sums[0][order], sums[1][order]
            new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        inverse = np.empty(len(order), np.int64)
        inverse[order] = np.cumsum(new) - 1
        return order[new], inverse, a[new], b[new]

    def strings(self, which: np.ndarray) -> list[str]:
        """The texts of some pre-tokens."""
        size = self.stop[which] - self.start[which]
        ends = np.cumsum(size)
        at = np.repeat(self.start[which] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)
        joined = self.points[at].astype("<u4").tobytes().decode("utf-32-le")
        return [joined[a:b] for a, b in zip((ends - size).tolist(), ends.tolist(), strict=True)]


def gather(offset: np.ndarray, size: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """The slices flat[offset:offset + size], one after another."""
    ends = np.cumsum(size)
    return flat[np.repeat(offset - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]


class WordEncoder:
    """Ids of texts from ids of their distinct pre-tokens; how those are made is up to merge().

    added: tokens that stand for themselves wherever they occur in a text, and their ids. store_words: most distinct
    words whose ids are kept, 60 bytes each or so.
    """

    store_words = 1_000_000

    def __init__(self, added: dict[str, int]):
        self.added = added
        self._forget()

    def _forget(self) -> None:
        """The store: hashes of words in order, the place of each, and at each place where its ids are in one flat array."""
        self._a, self._b, self._at = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self._offset, self._size, self._flat = np.zeros(1024, np.int64), np.zeros(1024, np.int32), np.zeros(4096, np.int32)
        self._words = self._ids = 0

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after another, number of ids of each word)."""
        raise NotImplementedError

    def _found(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(where each hash stands or belongs in the store, whether it is there, whether both hashes are)."""
        at = np.searchsorted(self._a, a)
        if not len(self._a):
            return at, np.zeros(len(a), bool), np.zeros(len(a), bool)
        near = np.minimum(at, len(self._a) - 1)
        same = self._a[near] == a
        return at, same, same & (self._b[near] == b)

    def word_ids(self, split: Split, which: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(offset, number of ids, flat ids) of each distinct word, by its hashes; unknown ones are merged together and kept."""
        at, same, known = self._found(a, b)
        unknown = np.flatnonzero(~known)
        if len(unknown) and self._words + len(unknown) > self.store_words:
            self._forget()
            at, same, known = self._found(a, b)
            unknown = np.flatnonzero(~known)
        place = np.zeros(len(a), np.int64)
        if len(self._a):
            place = self._at[np.minimum(at, len(self._a) - 1)].astype(np.int64)
        if len(unknown):
            place[unknown] = self._keep(split.strings(which[unknown]))
            fresh = unknown[~same[unknown]]
            fresh = fresh[np.concatenate([[True], a[fresh][1:] != a[fresh][:-1]])] if len(fresh) else fresh
            for name, values in (("_a", a[fresh]), ("_b", b[fresh]), ("_at", place[fresh])):
                setattr(self, name, np.insert(getattr(self, name), at[fresh], values))
        return self._offset[place], self._size[place].astype(np.int64), self._flat

    def _keep(self, words: list[str]) -> np.ndarray:
        """Places of new words, which are merged and stored."""
        flat, size = self.merge(words)
        first, begin = self._words, self._ids
        self._words, self._ids = first + len(words), begin + len(flat)
        for name, need in (("_offset", self._words), ("_size", self._words), ("_flat", self._ids)):
            held = getattr(self, name)
            if need > len(held):
                setattr(self, name, np.concatenate([held, np.zeros(max(need, 2 * len(held)) - len(held), held.dtype)]))
        self._flat[begin : self._ids] = flat
        self._size[first : self._words] = size
        self._offset[first : self._words] = begin + np.cumsum(size) - size
        return np.arange(first, self._words)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids (int32) of each text, as the tokenizers library gives them without special tokens added."""
        texts = [t or "" for t in texts]
        pieces, owner, special = [], [], []
        for i, text in enumerate(texts):
            for piece, token in self._apart(text):
                pieces.append(piece)
                owner.append(i)
                special.append(token)
        flat, size = self._encode_plain(pieces)
        ends = np.cumsum(size)
        parts: list[list[np.ndarray]] = [[] for _ in texts]
        for i, a, b, token in zip(owner, (ends - size).tolist(), ends.tolist(), special, strict=True):
            parts[i].append(flat[a:b])
            if token is not None:
                parts[i].append(np.array([token], np.int32))
        return [p[0] if len(p) == 1 else np.concatenate(p) for p in parts]

    def _apart(self, text: str) -> Iterator[tuple[str, int | None]]:
        """The text between added tokens, each piece with the added token that follows it (the last has none)."""
        while True:
            found = min(((at, -len(t), t) for t in self.added if (at := text.find(t)) >= 0), default=None)
            if found is None:
                yield text, None
                return
            at, _, token = found
            yield text[:at], self.added[token]
            text = text[at + len(token) :]

    def _encode_plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        split = Split(texts)
        which, name, a, b = split.named()
        offset, size, flat = self.word_ids(split, which, a, b)
        per = size[name]
        sizes = np.bincount(split.text, weights=per, minlength=len(texts)).astype(np.int64)
        return gather(offset[name], per, flat), sizes
