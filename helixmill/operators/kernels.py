"""Alignment kernels: vectorised scores of batches, and tracebacks of single winners.

Scores cost 10 for a substitution, 11 for opening and 1 for extending a gap, in a band of 15
diagonals; costs never reach 99.
"""

from __future__ import annotations

import numpy as np

SUB, OPEN, EXTEND, REACH, NONE = 10, 11, 1, 7, 99
LONGEST_ALLELE = 6


#: Codes by byte; all but ACTG count as 0.
BYTE_CODES = np.zeros(256, np.uint8)
BYTE_CODES[[ord(c) for c in "ACTG"]] = range(4)


def codes(sequences) -> np.ndarray:
    """Symbols of equal-length sequences as codes 0 to 3; unknown, of any character set, counts as 0."""
    raw = np.frombuffer("".join(sequences).encode("latin-1", "replace"), np.uint8).reshape(len(sequences), -1)
    return BYTE_CODES[raw]


def word_codes(words: np.ndarray, word: int = 26) -> np.ndarray:
    """The codes of rows of words, the first symbol of each in its highest bits."""
    shifts = np.arange(2 * (word - 1), -1, -2).astype(np.uint64)
    return ((words.astype(np.uint64)[:, :, None] >> shifts) & np.uint64(3)).astype(np.uint8).reshape(len(words), -1)


def pack(code: np.ndarray) -> np.ndarray:
    """Four codes to a byte, the first in the low bits."""
    c = code.reshape(len(code), -1, 4)
    return c[..., 0] | c[..., 1] << 2 | c[..., 2] << 4 | c[..., 3] << 6


def substitutions(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Substitution scores of packed rows, cut off once over `most`; -1 where a shift of 1 to 4 symbols after a poor byte hints at a gap."""
    x = a ^ b
    cost = SUB * np.bitwise_count((x | x >> 1) & 0x55).astype(np.int32)
    n = cost.shape[1]
    total = np.cumsum(cost, 1)
    word = [sum(v[:, k + 1 : n - 3 + k].astype(np.uint64) << np.uint64(8 * k) for k in range(4)) for v in (a, b)]
    hint = np.zeros((len(a), n - 4), bool)
    for bits in (2, 4, 6, 8):
        low, up = np.uint64((1 << (32 - bits)) - 1), np.uint64(bits)
        hint |= (word[0] & low == word[1] >> up) | (word[1] & low == word[0] >> up)
    reached = np.concatenate([np.zeros((len(a), 1), int), total[:, :-1]], 1) <= most
    gap = (hint & (cost[:, : n - 4] > SUB) & reached[:, : n - 4]).any(1)
    end = np.where((total > most).any(1), np.argmax(total > most, 1), n - 1)
    return np.where(gap, -1, total[np.arange(len(a)), end])


def gapped(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Scores of code rows with gaps, the last 7 symbols of either free; rows whose band is over `most` throughout end with that row's least score."""
    count, n = a.shape
    span = n + REACH + 2
    above = np.full((span, count), NONE, np.int32)
    above[: REACH + 1] = SUB * np.arange(REACH + 1)[:, None]
    above_q = np.full((span, count), NONE, np.int32)
    best = np.full(count, NONE, np.int32)
    early = np.full(count, -1, np.int32)
    for i in range(1, n + 1):
        here, p, q = np.full((span, count), NONE, np.int32), np.full(count, NONE, np.int32), np.full((span, count), NONE, np.int32)
        if i <= REACH:
            here[0] = SUB * i
        least = np.full(count, NONE, np.int32)
        for j in range(max(1, i - REACH), min(n, i + REACH) + 1):
            p = np.minimum(here[j - 1] + OPEN, p + EXTEND)
            q[j] = np.minimum(above[j] + OPEN, above_q[j] + EXTEND)
            here[j] = np.minimum(np.minimum(above[j - 1] + SUB * (a[:, i - 1] != b[:, j - 1]), p), q[j])
            least = np.minimum(least, here[j])
        if i < n - REACH:
            early = np.where((early < 0) & (least > most), least, early)
        else:
            best = np.minimum(best, here[n])
        above, above_q = here, q
    best = np.minimum(best, above[n - REACH : n + 1].min(0))
    return np.where(early >= 0, early, best)


def score(a, b, most: int = 40) -> np.ndarray:
    """Substitution scores, and gapped ones where those hint at a gap."""
    if not len(a):
        return np.zeros(0, np.int32)
    return score_codes(codes(a), codes(b), most)


def score_codes(x: np.ndarray, y: np.ndarray, most: int = 40) -> np.ndarray:
    out = substitutions(pack(x), pack(y), most)
    flagged = np.flatnonzero(out < 0)
    if len(flagged):
        out[flagged] = gapped(x[flagged], y[flagged], most)
    return out.astype(np.int32)


#: Codes by byte for comparing symbols: unknown is a symbol of its own.
SYMBOL_CODES = np.full(256, 4, np.uint8)
SYMBOL_CODES[[ord(c) for c in "ACTG"]] = range(4)


def directions(g: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Steps of rows of genome and read codes by (row, genome index, band): 0 match, 1 SUB, 2 INS, 3 DEL; and where each row's path ends."""
    count, n = g.shape
    span = n + REACH + 2
    none = lambda: np.full((span, count), NONE, np.int32)
    step = np.zeros((n + 1, 2 * REACH + 1, count), np.uint8)
    above, above_q = none(), none()
    above[: REACH + 1] = SUB * np.arange(REACH + 1)[:, None]
    last = np.full((n + 1, count), NONE, np.int32)  # the column of the read's end
    for i in range(1, n + 1):
        here, here_q, p = none(), none(), np.full(count, NONE, np.int32)
        if i <= REACH:
            here[0] = SUB * i
        for j in range(max(1, i - REACH), min(n, i + REACH) + 1):
            p = np.minimum(here[j - 1] + OPEN, p + EXTEND)
            q = here_q[j] = np.minimum(above[j] + OPEN, above_q[j] + EXTEND)
            differ = g[:, i - 1] != r[:, j - 1]
            diagonal, gap = above[j - 1] + SUB * differ, np.minimum(p, q)
            here[j] = np.minimum(diagonal, gap)
            step[i, j - i + REACH] = np.where(diagonal < gap, differ, np.where(p < q, 2, 3))
        last[i] = here[n]
        above, above_q = here, here_q
    ends = [(i, n) for i in range(n - REACH, n + 1)] + [(n, j) for j in range(n - REACH, n + 1)]
    cost = np.stack([last[i] if j == n else above[j] for i, j in ends])
    best = np.argmin(cost, 0)  # the first of the least
    at = np.array(ends)[best]
    nowhere = cost.min(0) >= NONE
    return step, np.where(nowhere, 0, at[:, 0]), np.where(nowhere, 0, at[:, 1])


def traces(g: np.ndarray, r: np.ndarray) -> list[list[tuple[str, int, int]]]:
    """Steps of each row that are not matches, in order: (SUB, INS or DEL, genome index, read index). All rows are walked at once."""
    step, i, j = directions(g, r)
    rows, out = np.arange(len(g)), [[] for _ in range(len(g))]
    while len(rows := rows[(i[rows] > 0) & (j[rows] > 0)]):
        band = j[rows] - i[rows] + REACH  # paths of hopeless pairs may leave it, and go straight there
        s = np.where((band >= 0) & (band <= 2 * REACH), step[i[rows], np.clip(band, 0, 2 * REACH), rows], 0)
        i[rows] -= s != 2
        j[rows] -= s != 3
        for k in np.flatnonzero(s):
            row = rows[k]
            out[row].append((("SUB", "INS", "DEL")[s[k] - 1], int(i[row]), int(j[row])))
    return [steps[::-1] for steps in out]


def trace(genome: str, read: str) -> list[tuple[str, int, int]]:
    """The steps of one pair of equal length."""
    g, r = (SYMBOL_CODES[np.frombuffer(x.encode("latin-1", "replace"), np.uint8)][None] for x in (genome, read))
    return traces(g, r)[0]


def joined(steps: list[tuple[str, int, int]], genome: str, read: str) -> list[tuple[str, int, int, str]]:
    """Steps as edits (kind, genome index, read index, bases): those of one gap are one."""
    out: list[tuple[str, int, int, str]] = []
    for kind, i, j in steps:
        if kind == "SUB":
            out.append((kind, i, j, read[j]))
        elif out and out[-1][0] == kind == "INS" and out[-1][1] == i:
            out[-1] = (*out[-1][:3], out[-1][3] + read[j])
        elif out and out[-1][0] == kind == "DEL" and out[-1][2] == j:
            out[-1] = (*out[-1][:3], out[-1][3] + genome[i])
        else:
            out.append((kind, i, j, read[j] if kind == "INS" else genome[i]))
    return out


def alleles(found: list[tuple[str, int, int, str]], genome: str, start: int) -> list[tuple[int, str, str]]:
    """Edits from `start` on as (0-based position, ref, alt), left-normalised; an allele over 6 symbols ends the list."""
    out = []
    for kind, i, _, bases in found:
        at = start + i
        if kind == "SUB":
            out.append((at, genome[at], bases))
            continue
        at -= 1
        while at > 0 and bases[-1] == genome[at]:
            bases, at = genome[at] + bases[:-1], at - 1
        if at < 0:
            continue
        if len(bases) + 1 > LONGEST_ALLELE:
            break
        out.append((at, genome[at], genome[at] + bases) if kind == "INS" else (at, genome[at] + bases, genome[at]))
    return out


def variants_of(windows: list[str], starts: list[int], reads: list[str], scores: list[int], seed: int = 14) -> list[list[tuple[int, str, str]]]:
    """The variants of reads mapped at `starts` of their windows, which go on for the read's length at least. Substitutions alone where they explain the score, else a traceback of all such reads of a length at once."""
    out: list[list] = [[] for _ in reads]
    for size in sorted({len(r) for r in reads}):
        own = [k for k, r in enumerate(reads) if len(r) == size and scores[k] != 0 and size > REACH]
        if not own:
            continue
        places = [windows[k][starts[k] : starts[k] + size] for k in own]
        g, r = (SYMBOL_CODES[np.frombuffer("".join(x).encode("latin-1", "replace"), np.uint8)].reshape(len(own), size) for x in (places, [reads[k] for k in own]))
        differ = g != r
        differ[:, :seed] = False
        plain = SUB * differ.sum(1) == np.array([scores[k] for k in own])
        for n in np.flatnonzero(plain):
            k = own[n]
            out[k] = [(starts[k] + int(i), windows[k][starts[k] + int(i)], reads[k][int(i)]) for i in np.flatnonzero(differ[n])]
        gapped_ = np.flatnonzero(~plain)
        for lo in range(0, len(gapped_), 4096):  # a row's steps take 2 KB
            some = gapped_[lo : lo + 4096]
            for n, steps in zip(some, traces(g[some], r[some]), strict=True):
                k = own[n]
                out[k] = alleles(joined(steps, places[n], reads[k]), windows[k], starts[k])
    return out


def variants(genome: str, start: int, read: str, score: int) -> list[tuple[int, str, str]]:
    """The variants of one read mapped at `start`."""
    return variants_of([genome.ljust(start + len(read), "N")], [start], [read], [score])[0]
