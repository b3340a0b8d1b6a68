"""Quality classifier: hashed word n-gram logistic regression, trained by follow-the-regularised-leader.

Features are words and pairs of words as written, the shapes of words (runs of letters, capitals and digits as one sign
each), and pairs of equal words, hashed into 2^BITS weights; each occurrence counts 1 / sqrt(number of occurrences in the
text), so a text's margin is a sparse dot product. Training goes over at most MAX_TRAIN labelled
rows (those of the smallest hash of their doc_id, of texts up to MAX_TRAIN_CHARS characters) on the driver; scoring
reads every whole text on the executors and needs only the weights, whose size is fixed.

A null, empty or blank text has the intercept's score. Rows are scored one by one, so repeated rows score alike. Several
labels of one document count by their largest; null labels and labels of null ids are left out. Of texts that repeat a
doc_id, one counts. Without labelled rows every score is 0.5. Rows without an id are scored like all others. score()
raises an error where the table has a column of the score's name already; other extra columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.common import chunks, mix, ngram_hashes, stage, word_hashes

BITS = 18
MAX_TRAIN, MAX_TRAIN_CHARS = 5000, 40_000
EPOCHS = 3
THRESHOLD = 0.7
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.002, 0.01
_MASK = np.uint64((1 << BITS) - 1)
_SALT, _SHAPES = np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9FB21C651E98DF25)
#: Index of the feature "a word, then the same word".
SAME = 12_345


def indexes(words: np.ndarray, shapes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Weight indexes by word, by its shape, by pair of neighbours, and where a pair is twice the same word."""
    index = lambda h: (h & _MASK).astype(np.int64)
    return index(mix(words ^ _SALT)), index(mix(shapes ^ _SHAPES)), index(ngram_hashes(words, 2)), words[1:] == words[:-1]


def features(words: np.ndarray, shapes: np.ndarray) -> np.ndarray:
    """Indexes of all features of one text, repeats included."""
    one, shape, two, same = indexes(words, shapes)
    return np.concatenate((one, shape, two, np.full(int(same.sum()), SAME)))


def train(rows: list[tuple[bytes | bytearray, int]], epochs: int = EPOCHS) -> np.ndarray:
    """Weights of the features, and the intercept as the last, from (indexes as unsigned 32-bit integers, label). The
    rows' order counts."""
    size = (1 << BITS) + 1
    z, n = np.zeros(size), np.zeros(size)

    def weights(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    for _ in range(epochs):
        for idx, label in rows:  # counted anew each time, which spares the driver's memory
            i, count = np.unique(np.frombuffer(idx, dtype=np.uint32), return_counts=True)
            i, x = np.append(i.astype(np.int64), size - 1), np.append(count / np.sqrt(max(1, count.sum())), 1.0)
            w = weights(i)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - label) * x
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - sigma * w
            n[i] += g * g
    return weights(np.arange(size))


def margins(texts: list[str | None], weights: np.ndarray) -> np.ndarray:
    out = np.full(len(texts), weights[-1])
    for a, b in chunks(texts):
        h, off = word_hashes(texts[a:b], lower=False)
        if not len(h):
            continue
        one, shape, two, same = indexes(h, word_hashes(texts[a:b], lower=False, shape=True)[0])
        words = np.concatenate(([0.0], np.cumsum(weights[one] + weights[shape])))
        pairs = np.concatenate(([0.0], np.cumsum(weights[two] + weights[SAME] * same), [0.0]))
        equal = np.concatenate(([0], np.cumsum(same), [0]))
        begin, end = off[:-1], off[1:]
        n, last = end - begin, np.maximum(end - 1, begin)
        total = words[end] - words[begin] + np.where(n > 1, pairs[last] - pairs[begin], 0.0)
        count = 3 * n - 1 + np.where(n > 1, equal[last] - equal[begin], 0)
        out[a:b] += total / np.sqrt(np.maximum(1, count))
    return out


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, max_chars: int = MAX_TRAIN_CHARS) -> np.ndarray:
    """Train on labels (doc_id, quality) and the texts of docs, whatever rows labels holds."""
    chosen = labels.where(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    texts = docs.select("doc_id", "text").where(F.length("text") <= max_chars)
    # Ids first, so that no text but the chosen ones leaves its executor, and those only as features.
    drawn = stage(texts.select("doc_id").distinct().join(chosen, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train), "quality-sample")
    rows = texts.join(F.broadcast(drawn), "doc_id")

    def extract(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            listed = part["text"].tolist()
            h, off = word_hashes(listed, lower=False)
            shapes = word_hashes(listed, lower=False, shape=True)[0]
            yield pd.DataFrame({"doc_id": part["doc_id"], "quality": part["quality"], "idx": [features(h[off[i] : off[i + 1]], shapes[off[i] : off[i + 1]]).astype(np.uint32).tobytes() for i in range(len(listed))]})

    found = [tuple(r) for r in rows.mapInPandas(extract, "doc_id long, quality int, idx binary").groupBy("doc_id").agg(F.max("quality"), F.min("idx")).collect()]  # max_train rows at most
    if not found:
        return np.zeros((1 << BITS) + 1)
    mixed = mix(np.array([r[0] for r in found], dtype=np.int64).astype(np.uint64))
    order = sorted(range(len(found)), key=lambda k: (int(mixed[k]), found[k][2]))
    return train([(found[k][2], int(found[k][1])) for k in order])


def score(docs: DataFrame, weights: np.ndarray, text: str = "text", into: str = "score") -> DataFrame:
    """docs with one more column, the probability that a text's label is 1."""
    if into in docs.columns:
        raise ValueError(f"column {into} exists")
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float64))

    @F.pandas_udf("double")
    def probability(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            m = np.clip(margins([t if isinstance(t, str) else None for t in part.tolist()], shared.value), -35, 35)
            yield pd.Series(1 / (1 + np.exp(-m)))

    return docs.withColumn(into, probability(F.col(text)))
