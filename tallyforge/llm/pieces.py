"""Pre-tokens of many texts at once, and a bounded table from pre-token to ids.

Pre-tokens of any script are cut by array operations: runs of one kind of character, contractions after an apostrophe,
single spaces that join what follows. Special tokens split a text before that. Texts with a character that this Python's
Unicode tables do not know yet are cut by the tokenizers library, whose tables are newer, so results are the same for
any text.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import numpy as np
import regex

from tallyforge.llm import textvec as tv

SPACE, LETTER, NUMBER, OTHER, UNKNOWN = range(5)
#: Fixed by Unicode: the code points of white space, first and last of each range.
BLANKS = ((0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))
#: Fixed by the tokenizers: what an apostrophe takes with it.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
_KINDS: list[np.ndarray] = []


def kinds() -> np.ndarray:
    """The kind of each code point."""
    if not _KINDS:
        of = {"L": LETTER, "N": NUMBER}
        table = np.fromiter((UNKNOWN if (g := unicodedata.category(chr(c))) == "Cn" else of.get(g[0], OTHER) for c in range(0x110000)), np.int8, 0x110000)
        for first, last in BLANKS:
            table[first : last + 1] = SPACE
        _KINDS.append(table)
    return _KINDS[0]


def _starts(kind: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    first = np.ones(len(kind), bool)
    first[1:] = kind[1:] != kind[:-1]
    inner = bounds[:-1]
    first[inner[inner < len(kind)]] = True
    return first


def _contract(codes: np.ndarray, bounds: np.ndarray, first: np.ndarray, joined: bool) -> None:
    """Marks contractions in `first`: an apostrophe that is a run of its own takes the letters of CONTRACTIONS with it.

    joined: a space before belongs to the apostrophe, which then starts nothing.
    """
    n = len(codes)
    at = np.flatnonzero(codes == 39)
    at = at[at + 1 < n]
    at = at[first[at] & first[at + 1]]
    if joined:
        opens = np.zeros(n + 1, bool)
        opens[bounds] = True
        at = at[opens[at] | (codes[at - 1] != 32)]
    closes = np.zeros(n + 2, bool)
    closes[bounds] = True
    at = at[~closes[at + 1]]
    for tail in CONTRACTIONS:
        hit = at[at + len(tail) < n]
        for k, c in enumerate(tail, 1):
            hit = hit[(codes[hit + k] == ord(c)) & ~closes[hit + k]]
        first[hit + 1] = False
        after = hit + 1 + len(tail)
        first[after[after < n]] = True


def spaced_pieces(codes: np.ndarray, bounds: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of one kind of character with one space before them; of a run of white space before text the last is apart."""
    if not len(codes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = _starts(kind, bounds)
    at = np.flatnonzero(first)
    end = np.append(at[1:], len(codes))
    closing = np.zeros(len(codes) + 1, bool)
    closing[bounds] = True
    blank = (kind[at] == SPACE) & ~closing[end]
    _contract(codes, bounds, first, True)
    b = end[blank]
    first[b - 1] = True
    first[b[codes[b - 1] == 32]] = False
    at = np.flatnonzero(first)
    return at, np.append(at[1:], len(codes))


def bare_pieces(codes: np.ndarray, bounds: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of letters, single numbers, and runs of other characters; white space is dropped."""
    if not len(codes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = _starts(kind, bounds) | (kind == NUMBER)
    _contract(codes, bounds, first, False)
    at = np.flatnonzero(first)
    end = np.append(at[1:], len(codes))
    keep = kind[at] != SPACE
    return at[keep], end[keep]


def ids_of(texts: list[str | None], cut: Callable, known: PieceTable, special: dict[str, int], whole: Callable[[str], list[int]], normal: Callable = lambda t: t) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row (null: none) and the number of ids of each.

    cut: spaced_pieces or bare_pieces; special: contents and ids of the tokens that split a text; whole: the ids of a
    text with a character of unknown kind; normal: what is done to a text between special tokens before it is cut.
    """
    raw, parts, owner, given = [], [], [], {}
    marks = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
    for k, t in enumerate(texts):
        for part in marks.split(t) if t and any(s in t for s in special) else [t]:
            if part in special:
                given[len(parts)] = [special[part]]
            raw.append("" if part in special else part)
            parts.append("" if part in special else normal(part))
            owner.append(k)
    codes, bounds = tv.flat(parts)
    kind = kinds()[codes]
    if (kind == UNKNOWN).any():
        for k in np.unique(tv.doc_of(np.flatnonzero(kind == UNKNOWN), bounds)).tolist():
            given[k], parts[k] = whole(raw[k]), ""
        codes, bounds = tv.flat(parts)
        kind = kinds()[codes]
    start, end = cut(codes, bounds, kind)
    ids, lens = known.ids(codes, start, end)
    counts = by_text(lens, start, bounds)
    if given:
        given = dict(sorted(given.items()))
        at = np.concatenate([[0], np.cumsum(counts)])[list(given)]
        sizes = [len(g) for g in given.values()]
        ids = np.insert(ids, np.repeat(at, sizes), np.array([i for g in given.values() for i in g], ids.dtype))
        counts[list(given)] += sizes
    return ids, np.bincount(owner, counts, len(texts)).astype(np.int64) if texts else np.zeros(0, np.int64)


class PieceTable:
    """Ids of pre-tokens by ascending hash, filled by `encode(list of str) -> list of id lists`, emptied when full."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], most: int = 700_000) -> None:
        self.encode, self.most = encode, most
        self._clear()

    def _clear(self) -> None:
        self.keys, self.number = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.flat, self.n = np.zeros(1 << 16, np.uint32), 0
        self.off, self.held = np.zeros(1 << 16, np.int64), 0

    def _add(self, hashes: np.ndarray, ids: list[list[int]]) -> None:
        """Appends the ids of pieces whose hashes ascend and are new."""
        lens = np.fromiter(map(len, ids), np.int64, len(ids))
        total = int(lens.sum())
        while self.n + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.held + len(ids) + 1 > len(self.off):
            self.off = np.concatenate([self.off, np.zeros_like(self.off)])
        self.flat[self.n : self.n + total] = np.fromiter((x for i in ids for x in i), np.uint32, total)
        self.off[self.held + 1 : self.held + 1 + len(ids)] = self.n + np.cumsum(lens)
        places = np.searchsorted(self.keys, hashes)
        self.keys, self.number = np.insert(self.keys, places, hashes), np.insert(self.number, places, np.arange(self.held, self.held + len(ids)))
        self.n, self.held = self.n + total, self.held + len(ids)

    def _known(self, hashes: np.ndarray) -> np.ndarray:
        if not self.held:
            return np.zeros(len(hashes), bool)
        return self.keys[np.minimum(np.searchsorted(self.keys, hashes), self.held - 1)] == hashes

    def ids(self, codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces in a row, and the number of ids of each piece."""
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if self.held > self.most:
            self._clear()
        h, at, back = np.unique(tv.span_hash(codes, start, end), return_index=True, return_inverse=True)
        if len(missed := np.flatnonzero(~self._known(h))):
            joined = codes.tobytes().decode("utf-32-le", "surrogatepass")
            spans = zip(start[at[missed]].tolist(), end[at[missed]].tolist(), strict=True)
            self._add(h[missed], self.encode([joined[a:b] for a, b in spans]))
        number = self.number[np.searchsorted(self.keys, h)][back]
        begin, lens = self.off[number], self.off[number + 1] - self.off[number]
        return self.flat[gather(begin, lens)], lens


def gather(begin: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices begin[0], begin[0] + 1, ... for lens[0] places, then those of the next."""
    ends = np.cumsum(lens)
    return np.repeat(begin - (ends - lens), lens) + np.arange(int(ends[-1]) if len(ends) else 0)


def by_text(lens: np.ndarray, starts: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Ids per text, from ids per piece and the pieces' starts."""
    total = np.concatenate([[0], np.cumsum(lens)])
    return np.diff(total[np.searchsorted(starts, bounds)])
