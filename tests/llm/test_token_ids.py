import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagequarry.llm import token_ids as K

pytest.importorskip("tokenizers")
SCHEMA = "doc_id long, text string"


@given(st.lists(st.integers(0, 400), min_size=1, max_size=3000))
@settings(max_examples=40, deadline=None)
def test_code_round_trip(ids):
    ids = np.array(ids)
    book = K.Codebook(K.code_lengths(np.bincount(ids, minlength=500)))
    marks, payload = book.encode(ids)
    one, two = book.decode([(len(ids), marks, payload), (len(ids), marks, payload)])
    assert np.array_equal(one, ids) and np.array_equal(two, ids)


def test_more_ids_than_short_codes():
    """Vocabularies of more than 2^16 ids in use."""
    rng = np.random.default_rng(5)
    ids = np.concatenate((np.arange(150_000), rng.integers(0, 150_000, 20_000), np.full(500_000, 7)))
    lengths = K.code_lengths(np.bincount(ids))
    assert lengths.max() == 18 and sum(2.0 ** -lengths.astype(float)) == 1.0
    book = K.Codebook(lengths)
    marks, payload = book.encode(ids)
    assert np.array_equal(book.decode([(len(ids), marks, payload)])[0], ids)


def test_lengths_are_a_full_code_of_bounded_length():
    counts = np.array([2**min(i, 40) for i in range(60)] + [0] * 5)
    n = K.code_lengths(counts).astype(int)
    assert n.max() <= K.MAX_BITS and (n[60:] == 0).all()
    assert sum(2.0 ** -n[:60]) == 1.0


def test_lengths_are_optimal_where_no_limit_binds():
    import heapq

    counts = np.random.default_rng(3).integers(1, 1000, 50)
    heap = [(int(c), i, [i]) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    want = np.zeros(50, dtype=int)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for i in a[2] + b[2]:
            want[i] += 1
        heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
    assert (counts * K.code_lengths(counts)).sum() == (counts * want).sum()


def test_files_hold_the_tokenizers_ids(spark, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(K, "BLOCK_TOKENS", 500)
    texts = [None, "", "Hello, World! it's 42", "A\tb\n\nc  ", "é ñ ÇA x y", "<|endoftext|> x", "a\x1cb c", "wort " * 2000, "😀 don't 'S"]
    rows = [(100 - i, t) for i, t in enumerate(texts)] + [(7, "same"), (7, "same"), (7, "other")] + [(1000 + i, f"text {i} " * (i % 17)) for i in range(200)]
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in K.round_trip(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect())
    t = Tokenizer.from_file(K.tokenizer_path())
    ids = {(i, x): t.encode(x or "", add_special_tokens=False).ids + [2] for i, x in rows}
    crc = lambda x: zlib.crc32(np.array(x, dtype="<u4").tobytes())
    assert [g[1] for g in got] == sorted(i for i, _ in rows)
    start = 0
    for g in got:
        assert g[0] == start
        start += g[2]
    assert sorted(g[1:] for g in got) == sorted((i, len(ids[i, x]), crc(ids[i, x])) for i, x in rows)


def test_empty_table_and_null_ids(spark):
    assert K.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = K.round_trip(spark.createDataFrame([(None, "a", 1), (2**60 + 1, "b", 1)], SCHEMA + ", n int")).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == [None, 2**60 + 1]


def by_text(e, texts):
    """Lists of ids of texts, as the encoder gives them."""
    out = []
    for n, ids in e.encode([t.encode() for t in texts]):
        ends = np.cumsum(n)
        assert ends[-1] == len(ids)
        out += [ids[b - a : b].tolist() for a, b in zip(n, ends, strict=True)]
    return out


def whole(e, texts):
    return [e.tokenizer.encode(t, add_special_tokens=False).ids + [K.END] for t in texts]


def test_words_are_encoded_once_whatever_their_case_and_signs(monkeypatch):
    e, learned = K.Encoder(K.tokenizer_path()), []
    learn = e.learn
    monkeypatch.setattr(e, "learn", lambda new: (learned.extend(new), learn(new)))
    texts = ["Straße, (straße) STRAßE!", "straße*** 77straße", "ÉTÉ été. Été;"]
    assert by_text(e, texts) == whole(e, texts)
    assert sorted(learned) == sorted(p.encode() for p in ("straße", ",", "(", ")", "!", "***", "7", "été", ".", ";"))


ODD = [*"aAsStTjJ'09,.<|>!\x7f \t\n\x0b\x1c\x1f\x00\x85\xa0éÉß×ÿÞ̧́̌̀ΣσİıſK²º　漢\U0001f600ͅ", "'s", "'RE", "'ll", "<|endoftext|>", "<|ENDOFTEXT|>", "</w>", "don't"]


@given(st.lists(st.lists(st.sampled_from(ODD), max_size=30).map("".join), min_size=1, max_size=8), st.sampled_from([1, 9, 4_000_000]))
@settings(max_examples=300, deadline=None)
def test_pieces_and_slices_change_no_ids(texts, size):
    e = K.encoder(K.tokenizer_path())
    assert e.cuts
    with pytest.MonkeyPatch.context() as m:
        m.setattr(K, "CHUNK", size)
        m.setattr(K, "MAX_CACHED", 50)
        assert by_text(e, texts) == whole(e, texts)


def test_tokenizers_that_join_blanks_get_whole_texts():
    import public_tokenizers

    e = K.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["Hello,  the world", "", "a\n\n  b c"]
    assert by_text(e, texts) == whole(e, texts)


def test_blocks_over_small_batches_hold_whole_documents_in_order(spark, monkeypatch):
    """Blocks end with the document that fills them, wherever the batches between Spark and Python end."""
    monkeypatch.setattr(K, "BLOCK_TOKENS", 40)
    docs = spark.createDataFrame([(None if i == 3 else i, "word " * (i * 7 % 31)) for i in range(200)], SCHEMA).coalesce(1)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "3")
        path = f"{K.shared_dir(spark)}/small-batches"
        tokens = K.tokenize(docs, K.tokenizer_path())
        K.write(tokens, path)
        rows = K.read(spark, path).orderBy("part", "seq", "nth").collect()
    finally:
        spark.conf.set(name, before)
    want = sorted((-1 if i == 3 else i, i * 7 % 31) for i in range(200))
    assert [(-1 if r["doc_id"] is None else r["doc_id"], r["n"] - 1) for r in rows] == want
    assert all(len(r["ids"]) == 4 * r["n"] and r["ids"][-4:] == b"\x02\0\0\0" for r in rows)
    blocks = {}
    for r in rows:
        blocks.setdefault((r["part"], r["seq"]), []).append(r)
    for (part, seq), some in blocks.items():
        assert [r["at"] for r in some] == [sum(x["n"] for x in some[:k]) for k in range(len(some))]
        assert sum(r["n"] for r in some[:-1]) < 40
        assert sum(r["n"] for r in some) >= 40 or (part, seq + 1) not in blocks
