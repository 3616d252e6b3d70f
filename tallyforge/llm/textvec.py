"""Array helpers shared by the text operators: many texts become one code point array with document bounds.

Everything here works on bounded slices (`slices`), whatever the batch or the text, and is called from inside Spark
tasks only. A single text longer than a slice is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SLICE_CHARS = 1_000_000
_BASE = 0x9E3779B97F4A7C15 | 1
_POW = {"n": 0, "pow": np.zeros(0, U64), "inv": np.zeros(0, U64)}


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_CODE_HASH = mix(np.arange(1, 0x3001, dtype=U64) * U64(0xD6E8FEB86659FD93))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _POW["n"] < n:
        m = max(n, SLICE_CHARS + 200_000)
        for key, base in (("pow", _BASE), ("inv", pow(_BASE, -1, 1 << 64))):
            steps = np.full(m, base, U64)
            steps[0] = 1
            _POW[key] = np.cumprod(steps, dtype=U64)
        _POW["n"] = m
    return _POW["pow"][:n], _POW["inv"][: n + 1]


def slices(texts: list[str | None], limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Index ranges of texts with about `limit` characters each."""
    begin, held = 0, 0
    for k, t in enumerate(texts):
        held += len(t) if t else 0
        if held >= limit:
            yield begin, k + 1
            begin, held = k + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def parts(column: pa.Array, limit: int = SLICE_CHARS) -> Iterator[tuple[int, int, list[str | None]]]:
    """Index ranges of a column with about `limit` characters each, and the texts of each; no more than that is held."""
    ends = np.cumsum(pc.utf8_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < len(ends):
        b = min(len(ends), int(np.searchsorted(ends, (ends[a - 1] if a else 0) + limit)) + 1)
        yield a, b, column.slice(a, b - a).to_pylist()
        a = b


def flat(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in a row (null: none), and the n + 1 bounds of the texts."""
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) if t else 0 for t in texts], out=bounds[1:])
    joined = "".join(t for t in texts if t)
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), bounds


def is_word(codes: np.ndarray) -> np.ndarray:
    """True outside 0x20 and 0x09-0x0D."""
    return ~((codes == 32) | ((codes >= 9) & (codes <= 13)))


def runs(mask: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal True runs of mask that cross no document bound."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = mask.copy()
    first[1:] &= ~mask[:-1]
    last = mask.copy()
    last[:-1] &= ~mask[1:]
    inner = bounds[1:-1]
    inner = inner[(inner > 0) & (inner < len(mask))]
    first[inner] |= mask[inner]
    last[inner - 1] |= mask[inner - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def span_hash(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the code points of each span; equal spans anywhere have equal hashes."""
    n = len(codes)
    pow_, inv = _powers(max(n, 1) + 1)
    small = codes < len(_CODE_HASH)
    v = _CODE_HASH[np.where(small, codes, 0)]
    if not small.all():
        v = np.where(small, v, mix((codes.astype(U64) + U64(1)) * U64(0xD6E8FEB86659FD93)))
    sums = np.zeros(n + 1, U64)
    np.cumsum(v * pow_[:n], out=sums[1:])
    h = (sums[end] - sums[start]) * inv[start]
    return mix(h ^ ((end - start).astype(U64) * U64(0xA24BAED4963EE407)))


def doc_of(starts: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The index of the document in which each start lies."""
    return np.searchsorted(bounds, starts, "right") - 1


def sums_by(values: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Wrapping uint64 sums of values by document; doc ascends."""
    total = np.zeros(len(values) + 1, U64)
    np.cumsum(values, out=total[1:])
    at = np.searchsorted(doc, np.arange(n + 1))
    return total[at[1:]] - total[at[:-1]]
