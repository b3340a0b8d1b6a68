"""Shortest edit scripts between two texts, in bytes, with a limit beyond which they are given up.

A shortest script deletes what isn't in a longest common subsequence of the old text and inserts what isn't in one of the
new text. `common_length` finds its length exactly: equal ends are taken off; where the bytes that both have, in whatever
order, are too few, that settles it; then furthest reaching paths are followed by number of edits, all diagonals at once,
which takes time by the edits rather than the lengths; and short texts, or texts with more than MOST_EDITS edits, go through
a bit vector of the longer one, a step a byte of the shorter, until the limit is certain to be missed.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Edits up to which paths are followed, and the length of the shorter text up to which that isn't worth while.
MOST_EDITS, SHORT = 1500, 2048
#: Rows of the bit vector between two looks at what can still be reached.
STRIDE = 256


def common_head(a: bytes, b: bytes) -> int:
    """How many bytes both begin with, by comparing stretches of doubling, then halving, lengths."""
    n, at, step = min(len(a), len(b)), 0, 32
    while at < n and a[at : at + step] == b[at : at + step]:
        at, step = at + step, 2 * step
    at = min(at, n)
    while step:
        if at + step <= n and a[at : at + step] == b[at : at + step]:
            at += step
        step //= 2
    return at


def _windows(x: bytes, pad: int) -> np.ndarray:
    """The eight bytes from each place on as one number."""
    padded = x + bytes([pad]) * 16
    return np.ndarray(shape=(len(x) + 8,), dtype="<u8", buffer=padded, strides=(1,))


def _paths(a: bytes, b: bytes, most: int) -> int | None:
    """Fewest deletions and insertions that make b of a; None if more than `most`."""
    n, m = len(a), len(b)
    wa, wb = _windows(a, 0), _windows(b, 255)
    low, x = 0, np.zeros(1, dtype=np.int64)  # x[i]: furthest place in a on diagonal (place in a - place in b) low + 2 * i
    for d in range(most + 1):
        if d:
            x = np.maximum(np.append(x, -1), np.append(-1, x + 1))
            low -= 1
        k = low + 2 * np.arange(len(x))
        fits = (x >= 0) & (x <= n) & (x - k <= m) & (x >= k)
        if not fits.any():
            return None
        first, last = int(fits.argmax()), len(fits) - int(fits[::-1].argmax())
        x, k, fits, low = x[first:last], k[first:last], fits[first:last], int(k[first])
        x = np.where(fits, x, -1)
        live = np.flatnonzero(fits & (x < n) & (x - k < m))
        for _ in range(3):
            if not len(live):
                break
            at = x[live]
            unlike = wa[at] ^ wb[at - k[live]]
            same = unlike == 0
            lowest = unlike & (~unlike + np.uint64(1))
            run = np.where(same, 8, (np.frexp(lowest.astype(np.float64))[1] - 1) // 8)
            run = np.minimum(run, np.minimum(n - at, m - (at - k[live])))
            x[live] = at + run
            live = live[same & (run == 8) & (x[live] < n) & (x[live] - k[live] < m)]
        for i in live.tolist():  # long equal stretches, a few
            at = int(x[i])
            x[i] = at + common_head(a[at : at + 4096], b[at - int(k[i]) : at - int(k[i]) + 4096])
            while x[i] - at == 4096:
                at = int(x[i])
                x[i] = at + common_head(a[at : at + 4096], b[at - int(k[i]) : at - int(k[i]) + 4096])
        if ((x == n) & (x - k == m)).any():
            return d
    return None


def _bits(a: bytes, b: bytes, least: int) -> int | None:
    """Length of a longest common subsequence, or None as soon as it is sure to be under `least`. Zeros of v are matches."""
    m, found = len(b), np.frombuffer(b, dtype=np.uint8)
    masks = {c: int.from_bytes(np.packbits(found == c, bitorder="little").tobytes(), "little") for c in set(a)}
    ones = (1 << m) - 1
    v = ones
    for i, c in enumerate(a):
        u = v & masks[c]
        if u:
            v = (v + u) | (v - u)
        if i % STRIDE == STRIDE - 1:
            v &= ones
            if m - v.bit_count() + len(a) - i - 1 < least:
                return None
    length = m - (v & ones).bit_count()
    return length if length >= least else None


def common_length(a: bytes, b: bytes, least: int = 0) -> int | None:
    """Length of a longest common subsequence of a and b, or None if it is less than `least`."""
    head = common_head(a, b)
    a, b = a[head:], b[head:]
    tail = common_head(a[::-1], b[::-1])
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    ends, rest = head + tail, least - head - tail
    if not a or not b:
        return ends if rest <= 0 else None
    if (Counter(a) & Counter(b)).total() < rest:
        return None
    if min(len(a), len(b)) > SHORT:
        most = len(a) + len(b) - 2 * max(0, rest)
        edits = _paths(a, b, min(most, MOST_EDITS))
        if edits is not None:
            return ends + (len(a) + len(b) - edits) // 2
        if most <= MOST_EDITS:
            return None
    inner = _bits(a, b, max(0, rest)) if len(a) <= len(b) else _bits(b, a, max(0, rest))
    return None if inner is None else ends + inner


def edit_counts(old: Column, new: Column, limit: float | None = None) -> Column:
    """(deleted, inserted): bytes of a shortest edit script; null for a null text, and where `limit` is given and the
    script deletes that share of the old text or more (of an empty text nothing is deleted)."""

    @F.pandas_udf(T.StructType().add("deleted", "long").add("inserted", "long"))
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        out = []
        for x, y in zip(a, b, strict=True):
            if x is None or y is None:
                out.append((None, None))
                continue
            x, y = x.encode(), y.encode()
            # deleted / len(x) < limit, in the doubles that a report divides in.
            least = 0 if limit is None else next(k for k in range(max(0, int(len(x) * (1 - limit)) - 1), len(x) + 2) if k > len(x) or (len(x) - k) / max(1, len(x)) < limit)
            same = common_length(x, y, least)
            out.append((None, None) if same is None else (len(x) - same, len(y) - same))
        return pd.DataFrame(out, columns=["deleted", "inserted"], dtype="Int64")

    found = run(old, new)
    return F.when(found["deleted"].isNotNull(), found)
