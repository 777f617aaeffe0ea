"""Vectorised text kernels: NumPy over the UTF-8 buffers of Arrow string columns.

A batch is cut into runs of whole rows of about `limit` bytes, so that memory follows the
longest text and not the batch. Word digests are 64 bits: a polynomial in an odd base modulo
2**64, taken from prefix sums, and finished with an avalanche mix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
BASE_INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
PIECE = 1 << 19
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective avalanche of 64-bit values."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n, modulo 2**64."""
    if len(_powers[0]) < n:
        for k, base in enumerate((BASE, BASE_INVERSE)):
            full = np.full(max(n, PIECE + 4096), base, U)
            full[0] = 1
            _powers[k] = np.multiply.accumulate(full)
    return _powers[0][:n], _powers[1][:n]


def buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its row offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    n = len(column)
    if n == 0 or at is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), off


def runs(off: np.ndarray, limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of whole rows of at most `limit` bytes, or of one row."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def byte_table(keep, lower: bool) -> np.ndarray:
    """A map of bytes: 0 for separators; keep(b) says which bytes belong to words."""
    table = np.array([b if keep(b) else 0 for b in range(256)], np.uint8)
    if lower:
        for b in range(65, 91):
            table[b] = table[b] and b + 32
    return table


#: Words are runs of anything but ASCII white space; A-Z are lower-cased.
WHITE_WORDS = byte_table(lambda b: b not in (32, 9, 10, 11, 12, 13) and b != 0, True)
#: The same where NUL bytes occur: they are word characters too, with a value of their own.
WHITE_WORDS[0] = 255
#: Words are runs of ASCII letters and of bytes of other letters.
LETTER_WORDS = byte_table(lambda b: 65 <= b <= 90 or 97 <= b <= 122 or b >= 128, True)


def words(data: np.ndarray, off: np.ndarray, table: np.ndarray, head: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Digests of all words of the rows, each row's first word, and with `head` the digests of the words' first bytes (last, if negative).

    Rows longer than a piece are hashed in pieces that end between words.
    """
    lo, end = int(off[0]), int(off[-1])
    parts, heads, starts = [], [], []
    p = lo
    while p < end:
        q = min(p + PIECE, end)
        if q < end:
            inside = np.flatnonzero(table[data[p:q]] == 0)
            if len(inside):
                q = p + int(inside[-1]) + 1
            else:
                while q < end and table[data[q]] != 0:
                    q += 1
        h, s, hh = _piece(table[data[p:q]], off[(off > p) & (off < q)] - p, head)
        parts.append(h)
        starts.append(s + p)
        heads.append(hh)
        p = q
    h = np.concatenate(parts) if parts else np.zeros(0, U)
    s = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    return h, np.searchsorted(s, off), (np.concatenate(heads) if heads else np.zeros(0, U)) if head else None


def _piece(b: np.ndarray, cuts: np.ndarray, head: int):
    inside = b != 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[cuts] |= inside[cuts]
    s = np.flatnonzero(first)
    if not len(s):
        return np.zeros(0, U), s, np.zeros(0, U)
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    if len(cuts):
        last[cuts - 1] |= inside[cuts - 1]
    e = np.flatnonzero(last) + 1
    power, inverse = powers(len(b) + 1)
    total = np.zeros(len(b) + 1, U)
    np.cumsum(b.astype(U) * power[: len(b)], out=total[1:])
    h = mix((total[e] - total[s]) * inverse[s] + (e - s).astype(U) * U(0xD6E8FEB86659FD93))
    if not head:
        return h, s, None
    if head < 0:
        f = np.maximum(s, e + head)
        return h, s, mix((total[e] - total[f]) * inverse[f])
    f = np.minimum(e, s + head)
    return h, s, mix((total[f] - total[s]) * inverse[s])


def shingles(h: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Digests of the runs of `width` words of each row (of all its words, if there are fewer), and each row's first."""
    k = np.diff(first)
    m = np.where(k > 0, np.maximum(k - width + 1, 1), 0)
    at = np.zeros(len(m) + 1, np.int64)
    np.cumsum(m, out=at[1:])
    i = np.arange(at[-1]) + np.repeat(first[:-1] - at[:-1], m)
    stop = np.repeat(first[1:], m)
    out = np.zeros(len(i), U)
    padded = np.concatenate([h, np.zeros(width, U)])
    for j in range(width):
        out = out * U(0xA24BAED4963EE407) + np.where(i + j < stop, padded[i + j], U(0)) * U(2 * j + 1)
        out ^= out >> U(29)
    return mix(out), at
