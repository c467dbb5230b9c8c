"""The alignment rescue: barcodes of reads whose linkers the patterns miss.

The anchor (linkers with wildcard segments between) is fitted whole into a
read: global in the anchor, free at both ends of the read, affine gaps.  A batch
of reads is aligned at once, one read position at a time over all of them, which
keeps a row of scores for each read.  The walk back looks at a short window
before the end only, since no optimal fit is longer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The anchor and the scores.
ANCHOR = "CTCGAVVVVVVCTCVVVVVVCAT"
MATCH, MISMATCH, OPEN, EXTEND = 2, -1, -1, -2
LEAST_START, UMI, TERMINAL = 40, 12, 8

N = len(ANCHOR)
WINDOW = 40
NEVER = -(2**28)
_PATTERN = np.frombuffer(ANCHOR.encode(), np.uint8)
_J = np.arange(N + 1, dtype=np.int32)
_TOP = np.where(_J == 0, 0, OPEN + EXTEND * _J).astype(np.int32)
SCHEMA = "bc1 string, bc2 string, bc3 string, bc4 string, umi string, cdna string"


def _row(s: np.ndarray, ix: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The next row of scores (all, gap in anchor, gap in read) for each read."""
    nx = np.maximum(ix + EXTEND, s + (OPEN + EXTEND))
    nx[:, 0] = NEVER
    base = np.empty_like(s)
    base[:, 0] = 0
    np.add(s[:, :-1], np.where(letters[:, None] == _PATTERN[None, :], MATCH, MISMATCH), out=base[:, 1:])
    np.maximum(base[:, 1:], nx[:, 1:], out=base[:, 1:])
    # A gap in the read that opens at k and ends at j scores base[k] + OPEN + EXTEND * (j - k).
    run = np.maximum.accumulate(base - EXTEND * _J, axis=1)
    dy = np.full_like(s, NEVER)
    dy[:, 1:] = run[:, :-1] + OPEN + EXTEND * _J[1:]
    return np.maximum(base, dy), nx, dy


def _padded(reads: list[bytes], width: int) -> np.ndarray:
    out = np.zeros((len(reads), width), np.uint8)
    for k, r in enumerate(reads):
        out[k, : len(r)] = np.frombuffer(r, np.uint8)
    return out


def fit_ends(reads: list[bytes]) -> np.ndarray:
    """Where the best fit of each read ends: the first of equal scores."""
    size = np.array([len(r) for r in reads])
    letters = np.ascontiguousarray(_padded(reads, int(size.max(initial=0))).T)
    s = np.repeat(_TOP[None, :], len(reads), axis=0)
    ix = np.full_like(s, NEVER)
    best, end = s[:, N].copy(), np.zeros(len(reads), np.int64)
    for i in range(len(letters)):
        s, ix, _ = _row(s, ix, letters[i])
        better = (s[:, N] > best) & (i < size)
        best[better], end[better] = s[better, N], i + 1
    return end


def fit_walks(reads: list[bytes], ends: np.ndarray) -> list[list[int]]:
    """For each read, the read position after each anchor column; entry 0 is the start."""
    windows = [r[max(0, e - WINDOW) : e] for r, e in zip(reads, ends.tolist(), strict=True)]
    letters = np.ascontiguousarray(_padded(windows, WINDOW).T)
    s = np.repeat(_TOP[None, :], len(reads), axis=0)
    ix = np.full_like(s, NEVER)
    dy = np.where(_J[None, :] == 0, NEVER, s)
    rows = [(s, ix, dy)]
    for i in range(WINDOW):
        rows.append(_row(rows[-1][0], rows[-1][1], letters[i]))
    every = [np.stack([r[part] for r in rows], axis=1) for part in range(3)]  # by read, then position
    anchor = ANCHOR.encode()
    out = []
    for k, w in enumerate(windows):
        scores, ins, dels = (x[k].tolist() for x in every)
        i, j, layer, at = len(w), N, "s", [0] * (N + 1)
        while j > 0:
            s, ix, dy = scores[i], ins[i], dels[i]
            if layer == "s":
                if i > 0 and s[j] == scores[i - 1][j - 1] + (MATCH if w[i - 1] == anchor[j - 1] else MISMATCH):
                    at[j] = i
                    i, j = i - 1, j - 1
                else:
                    layer = "i" if s[j] == ix[j] else "d"
            elif layer == "i":
                if ix[j] == scores[i - 1][j] + OPEN + EXTEND:
                    layer = "s"
                i -= 1
            else:
                if dy[j] == s[j - 1] + OPEN + EXTEND:
                    layer = "s"
                at[j] = i
                j -= 1
        at[0] = i
        shift = int(ends[k]) - len(w)
        # Read bases inserted after a column belong to the part that follows it.
        out.append([x + shift for x in at])
    return out


def extract(reads: list[str | None]) -> list[tuple[str, ...] | None]:
    """(bc1, bc2, bc3, bc4, umi, cdna) of each read, or None if the anchor finds no place."""
    out: list[tuple[str, ...] | None] = [None] * len(reads)
    raw = {i: r.encode("latin-1", "replace") for i, r in enumerate(reads) if r is not None and len(r) >= N}
    order = sorted(raw, key=lambda i: len(raw[i]))
    for low in range(0, len(order), 512):
        some = order[low : low + 512]
        ends = fit_ends([raw[i] for i in some])
        room = [k for k, i in enumerate(some) if ends[k] >= LEAST_START and ends[k] + TERMINAL <= len(raw[i])]
        if not room:
            continue
        walks = fit_walks([raw[some[k]] for k in room], ends[room])
        for k, at in zip(room, walks, strict=True):
            i = some[k]
            r, a = reads[i], at[0]
            if a < LEAST_START or at[N] + TERMINAL > len(r):
                continue
            out[i] = (
                r[at[N] : at[N] + TERMINAL],
                r[at[14] : at[20]],
                r[at[5] : at[11]],
                r[a - TERMINAL : a],
                r[a - TERMINAL - UMI : a - TERMINAL],
                r[: a - TERMINAL - UMI],
            )
    return out


def _seal(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    for reads in batches:
        found = extract(list(reads))
        yield pd.DataFrame([x or (None,) * 6 for x in found], columns=names, dtype=object)


def seal_extract(read: Column) -> Column:
    """Struct of bc1, bc2, bc3, bc4, umi and cdna; all null for a null read or without a fit."""
    return F.pandas_udf(_seal, SCHEMA)(read)
