import json
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagequarry.llm import token_counts as K

tokenizers = pytest.importorskip("tokenizers")
PARTS = ["a", "b", "e", "'s", "'", "'re", "'ll", "'v", " ", "  ", "\n", "\t", " ", " ", "1", "23", "é", "ß", "中文", "😀", "!", "?!", "<|endoftext|>", "<|endo", "the", "ing", "\x1c", "\x85", "ü", "٣", "½", "́", "‍", "_", "--", "=" * 20, "\r\n", "q" * 70]


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(K.tokenizer_path())
    return lambda texts: [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]


@given(st.lists(st.one_of(st.lists(st.sampled_from(PARTS), max_size=40).map("".join), st.text(max_size=50)), min_size=1, max_size=20))
@settings(max_examples=150, deadline=None)
def test_counts_of_hostile_texts(library, texts):
    assert K.transducer(K.tokenizer_path()).count(texts) == library(texts)


def test_long_pretokens_and_a_table_that_starts_anew(library, monkeypatch):
    """Runs that never settle, periodic ones, random ones; few states held."""
    monkeypatch.setattr(K, "MAX_STATES", 3000)
    rng = random.Random(3)
    texts = ["a" * n for n in range(1, 400, 7)] + ["ab" * n for n in range(1, 200, 13)] + ["=" * n for n in range(1, 500, 17)] + [" " * n + "x" for n in range(0, 200, 11)]
    texts += ["".join(rng.choice(letters) for _ in range(n)) for n in (64, 65, 128, 129, 1000, 20_000) for letters in ("ab", "aeinrst", "abcdefghijklmnopqrstuvwxyz")]
    machine = K.Transducer(K.tokenizer_path())
    got = [n for i in range(0, len(texts), 20) for n in machine.count(texts[i : i + 20])]
    assert got == library(texts)


def test_maps_are_walked_when_rounds_run_out(library, monkeypatch):
    monkeypatch.setattr(K, "ROUNDS", 0)
    texts = ["a" * 1001, "abcab" * 300]
    assert K.transducer(K.tokenizer_path()).count(texts) == library(texts)


@given(st.integers(1, 40), st.integers(1, 5), st.integers(0, 1000))
@settings(max_examples=50, deadline=None)
def test_scan_composes_in_order(n, q, seed):
    rng = np.random.default_rng(seed)
    to, counts = rng.integers(0, q, (n, q)), rng.integers(-3, 9, (n, q))
    reached, totals = K.composed(to, counts)
    for s in range(q):
        state = total = 0
        state = s
        for i in range(n):
            total += counts[i, state]
            state = to[i, state]
            assert (reached[i, s], totals[i, s]) == (state, total)


@given(st.lists(st.integers(0, 49_999), min_size=2, max_size=2))
@settings(max_examples=300, deadline=None)
def test_neighbours_stand_as_merging_says(tokens):
    """`stands` against merging the bytes of both from the start."""
    machine = K.transducer(K.tokenizer_path())
    a, b = (t if t in machine.made else 0 for t in tokens)
    parts = [machine.of_byte[x] for x in machine.text[a] + machine.text[b]]
    while len(parts) > 1:
        r, i = min((machine.rank.get(p, 1 << 60), i) for i, p in enumerate(zip(parts, parts[1:], strict=False)))
        if r == 1 << 60:
            break
        parts[i : i + 2] = [machine.ids[machine.text[parts[i]] + machine.text[parts[i + 1]]]]
    if machine.whole(a) and machine.whole(b):
        assert machine.stands(a, b) == (parts == [a, b])


def test_pieces_of_long_texts(library, monkeypatch):
    monkeypatch.setattr(K, "PIECE", 50)
    rng = random.Random(4)
    for _ in range(200):
        text = "".join(rng.choice(PARTS) for _ in range(120)).replace("<|endoftext|>", "")
        pieces = list(K.pieces_of(text))
        assert "".join(pieces) == text and sum(library(pieces)) == library([text])[0]


def test_table_of_documents(spark, library):
    long = "Some words, 12 of them; it's fine.\n" * 40_000
    docs = [(1, "Hello  world's"), (1, "Hello  world's"), (None, "x"), (2, None), (3, ""), (4, long), (5, "<|endoftext|>" * 3 + " a"), (6, "word " * 600)]
    frame = spark.createDataFrame([(d, t, 9, "z") for d, t in docs], "doc_id long, text string, n_tokens int, key string").repartition(3)
    got = K.count(frame)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = [(d, len((t or "").encode()), n, n > 512) for (d, t), n in zip(docs, library([t or "" for _, t in docs]), strict=True)]
    order = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(map(tuple, got.collect()), key=order) == sorted(want, key=order)
    assert K.count(frame.limit(0)).count() == 0


def test_other_files_are_refused(tmp_path):
    with open(K.tokenizer_path("word_bpe_49k.json")) as f:
        file = json.load(f)
    path = tmp_path / "t.json"
    path.write_text(json.dumps(file))
    with pytest.raises(ValueError):
        K.Transducer(str(path))
