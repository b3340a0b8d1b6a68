"""Importance resampling towards a target: hashed n-gram features, a gain a bucket, and a Gumbel draw without replacement.

Features are runs of 1 to `n` consecutive words; a feature's bucket is the CRC-32 of its words joined by one space. Each
word's CRC is computed once. CRC-32 is linear over GF(2): the CRC of two strings joined is the first one's, moved by the
length of the second, plus the second one's, and moving by 2^j bytes is a fixed 32 x 32 matrix (`SHIFTS`). So n-grams are
composed from the CRCs and lengths of their words, and no n-gram is ever written out.

Counts by bucket cover all documents and the whole target; what is collected is a row a bucket, a parameter. Every text is
read once: its buckets are staged, and counting and scoring read those.

A null text counts as empty and has no features: its weight is 0. A repeated row, or doc_id, is a row of its own; a null
doc_id is drawn like the empty id and comes last among ties. Extra columns are left out. Empty documents give no rows; an
empty target gives every bucket its smoothed share of nothing, so gains depend on the documents alone.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.common import chunks, numbered, stage

N, BUCKETS, SEED, MIN_WORDS, PERCENT = 1, 10_000, 2024, 20, 10
#: Bytes of text whose words are taken at a time; a longer stretch without a word's end is taken whole.
PIECE = 4_000_000
#: Words up to this length go through the table a byte a step, all words at once; longer ones one by one.
LANE = 48

_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


# --- CRC-32 as algebra --------------------------------------------------------------------------------------------


def _byte_table() -> np.ndarray:
    """The register's change by each byte, for the reflected polynomial of CRC-32."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


TABLE = _byte_table()


def _apply(operator: np.ndarray, v: np.ndarray) -> np.ndarray:
    """A linear operator, given by its values for each byte of the register, on registers."""
    return operator[0][v & 255] ^ operator[1][(v >> 8) & 255] ^ operator[2][(v >> 16) & 255] ^ operator[3][v >> 24]


def _shifts(n: int = 32) -> list[np.ndarray]:
    """Operators that move a CRC by 2^0, 2^1, ... 2^(n-1) bytes, each the square of the one before."""
    basis = np.arange(256, dtype=np.uint32)[None, :] << np.array([[0], [8], [16], [24]], dtype=np.uint32)
    out = [(basis >> 8) ^ TABLE[basis & 255]]
    while len(out) < n:
        out.append(_apply(out[-1], out[-1]))
    return out


SHIFTS = _shifts()


def moved(crc: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Each CRC moved by as many bytes as `by` says."""
    out, j = crc, 0
    while len(by) and (by >> j).any():
        out = np.where((by >> j) & 1, _apply(SHIFTS[j], out), out)
        j += 1
    return out


def joined(a: np.ndarray, b: np.ndarray, b_bytes: np.ndarray) -> np.ndarray:
    """CRCs of strings joined, from those of both parts and the second one's length."""
    return moved(a, b_bytes) ^ b


def crcs(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of each stretch of buf, all stretches a byte a step."""
    n = ends - starts
    order = np.argsort(np.minimum(n, LANE + 1).astype(np.int16), kind="stable")[::-1]
    at, sizes = starts[order], n[order]
    long = int(np.searchsorted(-sizes, -LANE, side="left"))
    out = np.empty(len(n), dtype=np.uint32)
    reg = np.full(len(n), 0xFFFFFFFF, dtype=np.uint32)
    for k in range(int(sizes[long]) if long < len(sizes) else 0):
        live = slice(long, long + int(np.searchsorted(-sizes[long:], -k, side="left")))
        r = reg[live]
        reg[live] = (r >> 8) ^ TABLE[(r ^ buf[at[live] + k]) & 255]
    out[order] = ~reg
    for i in range(long):
        out[order[i]] = zlib.crc32(buf[at[i] : at[i] + sizes[i]].tobytes())
    return out


def words(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CRC, length and text number of every word of the texts, A-Z counting as a-z."""
    buf = _LOWER[np.frombuffer(b" ".join(blobs) + b" ", dtype=np.uint8)]
    ends_of_texts = np.cumsum(np.fromiter((len(b) + 1 for b in blobs), dtype=np.int64, count=len(blobs)))
    found, lo = [], 0
    while lo < len(buf):
        hi = min(len(buf), lo + PIECE)
        while hi < len(buf) and _WORD[buf[hi - 1]]:
            gap = np.flatnonzero(~_WORD[buf[hi : hi + PIECE]])
            hi = hi + int(gap[0]) + 1 if len(gap) else min(len(buf), hi + PIECE)
        inside = np.concatenate(([False], _WORD[buf[lo:hi]], [False]))
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + lo
        starts, ends = edge[0::2], edge[1::2]
        found.append((crcs(buf, starts, ends), ends - starts, np.searchsorted(ends_of_texts, starts, side="right")))
        lo = hi
    crc, size, text = (np.concatenate(x) for x in zip(*found, strict=True))
    return crc, size, text


SPACE = np.uint32(zlib.crc32(b" "))


def ngram_crcs(crc: np.ndarray, size: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """CRC and text number of every run of 1 to n words of one text, joined by one space; in the order of texts."""
    out, texts, total = [crc], [text], crc
    if n > 1:
        with_space = joined(np.full(len(crc), SPACE, dtype=np.uint32), crc, size)
        for m in range(2, n + 1):
            if len(crc) < m:
                break
            total = joined(total[:-1], with_space[m - 1 :], size[m - 1 :] + 1)
            same = text[m - 1 :] == text[: len(total)]
            out.append(total[same])
            texts.append(text[: len(total)][same])
        found, of = np.concatenate(out), np.concatenate(texts)
        order = np.argsort(of, kind="stable")
        return found[order], of[order]
    return crc, text


# --- on tables ----------------------------------------------------------------------------------------------------


def width(buckets: int) -> str:
    return "<u2" if buckets <= 1 << 16 else "<u4"


def hashed(docs: DataFrame, key: str, n: int = N, buckets: int = BUCKETS) -> DataFrame:
    """key, n_words and features (each one's bucket, as bytes of unsigned integers of `width`) of every row of docs."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts = [t if isinstance(t, str) else None for t in part["text"].tolist()]
            for lo, hi in chunks(texts):
                crc, size, of = words([(t or "").encode("utf-8", "surrogatepass") for t in texts[lo:hi]])
                n_words = np.bincount(of, minlength=hi - lo)
                found, of = ngram_crcs(crc, size, of, n)
                data = (found % np.uint32(buckets)).astype(width(buckets))
                ends = np.cumsum(np.bincount(of, minlength=hi - lo))
                yield pd.DataFrame({"key": part["key"].iloc[lo:hi].to_numpy(), "n_words": n_words, "features": [x.tobytes() for x in np.split(data, ends[:-1])]})

    # The key goes as text: a null among numbers would make pandas round them.
    rows = docs.select(F.col(key).cast("string").alias("key"), "text").mapInPandas(run, "key string, n_words long, features binary")
    return rows.select(F.col("key").cast(docs.schema[key].dataType).alias(key), "n_words", "features")


def bucket_counts(features: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket stands in all rows: summed in each task, then by bucket; a row a bucket is collected."""
    kind = width(buckets)

    def tally(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(buckets, dtype=np.int64)
        for part in parts:
            for data in part["features"]:
                if data:
                    total += np.bincount(np.frombuffer(data, dtype=kind), minlength=buckets)
        used = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": used, "n": total[used]})

    found = features.select("features").mapInPandas(tally, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(buckets, dtype=np.int64)
    out[found["bucket"].to_numpy(dtype=np.int64)] = found["n"].to_numpy(dtype=np.int64)
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log of a bucket's smoothed share of the target over that of the documents, rounded down."""
    b, s, t = len(raw), int(raw.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(((int(y) + 1) * (s + b)) / ((int(x) + 1) * (t + b)))) for x, y in zip(raw, target, strict=True)], dtype=np.int64)


def noise(key: str, seed: int = SEED) -> int:
    """A Gumbel variate in thousandths, fixed by the seed and the key."""
    h = int(hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(features: DataFrame, gain: np.ndarray, key: str, seed: int = SEED) -> DataFrame:
    """key, n_words, n_features, weight (mean gain, rounded down) and score (weight and noise) of every row."""
    shared, kind = features.sparkSession.sparkContext.broadcast(gain), width(len(gain))  # a number a bucket

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        values = shared.value
        for part in parts:
            n = np.array([len(x) // np.dtype(kind).itemsize for x in part["features"]], dtype=np.int64)
            total = np.array([int(values[np.frombuffer(x, dtype=kind)].sum()) if x else 0 for x in part["features"]], dtype=np.int64)
            weight = total // np.maximum(n, 1)
            score = weight + np.array([noise("" if k is None else k, seed) for k in part["key"]], dtype=np.int64)
            yield pd.DataFrame({"key": part["key"].to_numpy(), "n_words": part["n_words"].to_numpy(), "n_features": n, "weight": weight, "score": score})

    rows = features.select(F.col(key).cast("string").alias("key"), "n_words", "features").mapInPandas(run, "key string, n_words long, n_features long, weight long, score long")
    return rows.withColumn("key", F.col("key").cast(features.schema[key].dataType)).withColumnRenamed("key", key)


def resample(docs: DataFrame, target: DataFrame, n: int = N, buckets: int = BUCKETS, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row; rank is null for rows that aren't drawn.

    Of the rows with min_words words, `percent` percent (rounded down) are drawn: the highest scores, ties by doc_id. That
    is a draw without replacement with odds by exp(weight / 1000). Ranks come from a range sort, so no task holds them all.
    """
    features = stage(hashed(docs, "doc_id", n, buckets), "importance-features")
    aim = hashed(target.select(F.lit(0).alias("doc_id"), "text"), "doc_id", n, buckets)
    rows = stage(scored(features, gains(bucket_counts(features, buckets), bucket_counts(aim, buckets)), "doc_id", seed), "importance-scores")
    can = rows.where(F.col("n_words") >= min_words)
    drawn = can.count() * percent // 100
    order = can.withColumns({"__down": -F.col("score"), "__last": F.col("doc_id").isNull()})
    at = numbered(order, ["__down", "__last", "doc_id", "n_features", "weight"], "__nth")
    out = ["doc_id", "n_features", "weight", "score"]
    ranked = at.select(*out, F.when(F.col("__nth") < drawn, F.col("__nth") + 1).alias("rank"))
    return ranked.unionByName(rows.where(F.col("n_words") < min_words).select(*out, F.lit(None).cast("long").alias("rank")))
