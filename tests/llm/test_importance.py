import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagequarry.llm import importance as I

SCHEMA = "doc_id long, text string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_features(text, n):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(lower)
    return w, [" ".join(w[i : i + m]) for m in range(1, n + 1) for i in range(len(w) - m + 1)]


def plain(docs, target, n, buckets, percent, min_words):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    feats = [(d, *plain_features(t, n)) for d, t in docs]
    s, t = Counter(bucket(f) for _, _, fs in feats for f in fs), Counter(bucket(f) for _, x in target for f in plain_features(x, n)[1])
    total_s, total_t = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (total_s + buckets) / ((s[b] + 1) * (total_t + buckets))))
    rows = []
    for d, w, fs in feats:
        weight = sum(gain(bucket(f)) for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append((d, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w)))
    can = sorted((r for r in rows if r[4] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    rank = Counter()
    drawn = [r[:4] for r in can[: len(can) * percent // 100]]
    out = [(*r, i + 1) for i, r in enumerate(drawn)]
    rank.update(drawn)
    for r in rows:
        if rank[r[:4]]:
            rank[r[:4]] -= 1
        else:
            out.append((*r[:4], None))
    return out


def key(r):
    return tuple((x is None, x or 0) for x in r)


@given(st.lists(st.binary(max_size=80), min_size=1, max_size=30), st.binary(max_size=300))
@settings(max_examples=60, deadline=None)
def test_crc_algebra(parts, tail):
    buf = np.frombuffer(b"".join(parts) + b"!", dtype=np.uint8)
    ends = np.cumsum([len(p) for p in parts])
    starts = ends - [len(p) for p in parts]
    got = I.crcs(buf, starts, ends)
    assert got.tolist() == [zlib.crc32(p) for p in parts]
    last = np.full(len(parts), zlib.crc32(tail), dtype=np.uint32)
    assert I.joined(got, last, np.full(len(parts), len(tail))).tolist() == [zlib.crc32(p + tail) for p in parts]


def test_ngrams_need_no_strings(monkeypatch):
    """Composed CRCs are those of the joined words, across pieces, beside long words and between texts."""
    monkeypatch.setattr(I, "PIECE", 7)
    texts = ["One two-THREE  2four", "", "é" * 40 + " ß x", None, "a", "---", "z " * 30]
    crc, size, of = I.words([(t or "").encode() for t in texts])
    for n in (1, 2, 3, 5):
        found, owner = I.ngram_crcs(crc, size, of, n)
        for i, t in enumerate(texts):
            assert found[owner == i].tolist() == [zlib.crc32(f.encode()) for f in plain_features(t, n)[1]]


@pytest.mark.parametrize("n", [1, 2, 3])
def test_agrees_with_a_plain_version(spark, n):
    rng = np.random.default_rng(7)
    vocabulary = ["Alpha", "beta", "γάμμα", "x9", "DELTA", "e", "ünï", "Ω" * 60]
    docs = [(i, " ".join(rng.choice(vocabulary, int(rng.integers(0, 60))))) for i in range(120)]
    docs += [(None, "alpha " * 30), (None, None), (200, None), (201, ""), (202, "--- !!"), (5, docs[5][1]), (5, docs[6][1]), (203, "beta gamma " * 30_000)]
    target = [(0, "alpha beta e e"), (1, None), (2, "x9 X9")]
    frame = spark.createDataFrame([(d, t, "n", 1) for d, t in docs], "doc_id long, text string, key string, rank int").repartition(5)
    got = I.resample(frame, spark.createDataFrame(target, "item_id long, text string"), n=n, buckets=97, percent=10, min_words=20)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(plain(docs, target, n, 97, 10, 20), key=key)


def test_wide_buckets_and_empty_tables(spark):
    docs = [(1, "a b c " * 10), (2, "c d " * 20)]
    frame, none = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame([], SCHEMA)
    got = I.resample(frame, none, buckets=100_000, percent=50)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(plain(docs, [], 1, 100_000, 50, 20), key=key)
    assert I.resample(none, frame).count() == 0
