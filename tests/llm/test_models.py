import math
import random

import numpy as np
import pytest
import zstandard

from pagequarry.llm import language_id as L
from pagequarry.llm import quality_model as Q
from pagequarry.llm.common import mix, ngram_hashes, word_hashes

SCHEMA = "doc_id long, text string, lang string"


def good_and_bad(n=400):
    rng = random.Random(4)
    words = "the of and house road town garden light water stone".split()
    rows = []
    for i in range(n):
        t = [rng.choice(words) for _ in range(rng.randint(5, 60))]
        rows.append((i, " ".join(w + "###" for w in t) if i % 5 == 0 else " ".join(t), int(i % 5 != 0)))
    return rows


def test_held_out_accuracy(spark):
    rows = good_and_bad()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows if i % 4], "doc_id long, quality int")
    w = Q.fit(docs, labels)
    got = {r["doc_id"]: r["score"] for r in Q.score(docs, w).select("doc_id", "score").collect()}
    held = [(got[i] >= 0.7) == bool(q) for i, _, q in rows if i % 4 == 0]
    assert sum(held) / len(held) >= 0.95
    assert np.array_equal(w, Q.fit(docs.repartition(3), labels))


def test_margin_is_a_plain_dot_product():
    rng = np.random.default_rng(0)
    w = rng.normal(size=(1 << Q.BITS) + 1)
    texts = ["a b c a b", "one", "", None, "x  y\nz", "long " * 3000]
    for t, m in zip(texts, Q.margins(texts, w), strict=True):
        h, _ = word_hashes([t], lower=False)
        shapes, _ = word_hashes([t], lower=False, shape=True)
        found = [int(x) for x in mix(h ^ Q._SALT) & Q._MASK] + [int(x) for x in mix(shapes ^ Q._SHAPES) & Q._MASK] + [int(x) for x in ngram_hashes(h, 2) & Q._MASK]
        found += [Q.SAME for a, b in zip(h, h[1:], strict=False) if a == b]
        assert m == pytest.approx(w[-1] + sum(w[i] for i in found) / max(1, len(found)) ** 0.5, rel=1e-9)
        assert sorted(Q.features(h, shapes)) == sorted(found)


def test_shapes_of_words():
    def plain(word):
        classes = ["a" if c.islower() or ord(c) > 127 else "A" if c.isupper() else "0" if c.isdigit() else c for c in word]
        return "".join(c for i, c in enumerate(classes) if not i or classes[i - 1] != c)

    texts = ["The cat### 12a", None, "Xy dog### é\tB9 !!", " z", "", "aB aB A a1 1a ab-cd ef-g"]
    h, off = word_hashes(texts, lower=False, shape=True)
    words = [w for t in texts for w in (t or "").split()]
    assert len(h) == len(words) and off.tolist() == word_hashes(texts, lower=False)[1].tolist()
    for i, a in enumerate(words):
        assert [h[i] == x for x in h] == [plain(a) == plain(b) for b in words]


def plain_ftrl(rows, epochs):
    """Follow the regularised leader, weight by weight, as published: per-coordinate rates, L1 and L2."""
    z, n = {}, {}

    def weight(i):
        zi = z.get(i, 0.0)
        return 0.0 if abs(zi) <= Q.L1 else -(zi - math.copysign(Q.L1, zi)) / ((Q.BETA + n.get(i, 0.0) ** 0.5) / Q.ALPHA + Q.L2)

    for _ in range(epochs):
        for idx, label in rows:
            x = {}
            for i in idx:
                x[i] = x.get(i, 0.0) + 1 / len(idx) ** 0.5
            x["intercept"] = 1.0
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - label) * v
                sigma = ((n.get(i, 0.0) + g * g) ** 0.5 - n.get(i, 0.0) ** 0.5) / Q.ALPHA
                z[i] = z.get(i, 0.0) + g - sigma * w[i]
                n[i] = n.get(i, 0.0) + g * g
    return {i: weight(i) for i in z}


def test_training_agrees_with_a_plain_version():
    rng = random.Random(2)
    rows = [([rng.choice((rng.randrange(40), rng.randrange(1 << Q.BITS))) for _ in range(rng.randint(1, 30))], rng.randint(0, 1)) for _ in range(80)]
    got = Q.train([(np.array(i, dtype=np.uint32).tobytes(), y) for i, y in rows], epochs=3)
    want = plain_ftrl(rows, 3)
    assert got[-1] == pytest.approx(want.pop("intercept"))
    assert {int(i): got[i] for i in np.flatnonzero(got[:-1])} == pytest.approx({i: v for i, v in want.items() if v})


def test_quality_null_ids_long_texts_and_clashing_columns(spark):
    rows = good_and_bad(60)
    docs = spark.createDataFrame([(i, t, 5.0, "x") for i, t, _ in rows] + [(None, "the of ###", 5.0, "x"), (7, "house " * 300_000, 5.0, "x")], "doc_id long, text string, quality double, idx string")
    w = Q.fit(docs, spark.createDataFrame([(i, q) for i, _, q in rows] + [(None, 0), (3, None)], "doc_id long, quality int"))
    scored = Q.score(docs, w)
    assert scored.columns == [*docs.columns, "score"] and scored.count() == 62 and scored.where("score between 0 and 1").count() == 62
    with pytest.raises(ValueError):
        Q.score(scored, w)


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (2, "")], "doc_id long, text string")
    w = Q.fit(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r["score"] for r in Q.score(docs, w).collect()} == {0.5}
    assert Q.score(docs.limit(0), w).count() == 0


@pytest.fixture(scope="module")
def spoken():
    rng = random.Random(8)
    vocab = {"xx": "klaru menti orbo talek suvi parno delta rimo".split(), "yy": "groß über schön wagen straße mädchen füße tür".split(), "zz": "the and with from house river stone light".split()}
    return [(i, " ".join(rng.choice(vocab[lang]) for _ in range(rng.randint(3, 80))), lang) for i, lang in enumerate(rng.choice(list(vocab)) for _ in range(400))]


def test_languages_are_told_apart(spark, spoken):
    df = spark.createDataFrame(spoken, SCHEMA)
    found = L.learn(df.where("doc_id % 5 <> 0"))
    assert set(found) == {"xx", "yy", "zz"}
    got = {r["doc_id"]: r for r in L.predict(df.where("doc_id % 5 = 0"), found).collect()}
    right = [got[i]["lang_pred"] == lang for i, _, lang in spoken if i % 5 == 0]
    assert sum(right) / len(right) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_language_edges(spark, spoken):
    found = L.learn(spark.createDataFrame(spoken, SCHEMA))
    odd = spark.createDataFrame([(1, None, None), (2, "", None), (3, "12 % 34 _", None), (4, "é", None), (5, "the " * 50000, None)], SCHEMA)
    got = {r["doc_id"]: r for r in L.predict(odd, found).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and got[4]["lang_pred"] in found and got[5]["lang_pred"] == "zz"
    assert L.learn(odd) == {}
    assert {r["lang_pred"] for r in L.predict(odd, {}).collect()} == {"und"}


def test_every_language_has_a_dictionary(spark, spoken):
    """Languages of short texts only, of long ones only, and more than 200 of them."""
    rng = random.Random(12)
    rows = [(i, (t + " ") * 10, lang) for i, t, lang in spoken]
    rows += [(1000 + i, " ".join(rng.choice("kivi talo metsä järvi yö".split()) for _ in range(4)), "fi") for i in range(30)]
    rows += [(2000 + i, " ".join(rng.choice("pohon rumah jalan sungai malam".split()) for _ in range(5000)), "id") for i in range(5)]
    rows += [(3000 + i, "".join(rng.choice("bcdfgaeiou") for _ in range(250)), f"l{i}") for i in range(210)]
    found = L.learn(spark.createDataFrame(rows, SCHEMA))
    assert set(found) == {r[2] for r in rows}
    assert list(found)[:3] == sorted(list(found)[:3], key=lambda x: (-sum(r[2] == x for r in rows), x))
    sizer = L.Sizer({x: found[x] for x in ("xx", "yy", "zz", "fi", "id")})
    assert sizer.predict("metsä talo yö järvi")[0] == "fi" and sizer.predict("sungai malam rumah pohon")[0] == "id"


def test_verdicts_agree_with_plain_compression(spark, spoken):
    found = L.learn(spark.createDataFrame(spoken, SCHEMA))
    texts = [t for _, t, _ in spoken[:60]] + ["the " * 30_000, "Straße! 12 the", "नमस्ते दुनिया के लोग", "x"]
    got = {r["doc_id"]: r for r in L.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), found).collect()}
    for i, t in enumerate(texts):
        data = L.plain(t)
        sizes = {}
        for lang, d in found.items():
            made = zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            c = zstandard.ZstdCompressor(level=L.LEVEL, dict_data=made, write_content_size=False, write_dict_id=False)
            sizes[lang] = sum(len(c.compress(data[k : k + L.PIECE])) for k in range(0, len(data), L.PIECE))
        order = sorted(sizes.values())
        assert sizes[got[i]["lang_pred"]] == order[0]
        assert got[i]["margin"] == pytest.approx((order[1] - order[0]) / order[0])
        assert got[i]["rejected"] == (got[i]["margin"] < L.MIN_MARGIN)


def test_letters_and_marks(spark, spoken):
    found = L.learn(spark.createDataFrame(spoken, SCHEMA))
    got = {r["doc_id"]: r["lang_pred"] for r in L.predict(spark.createDataFrame([(1, "² ½ Ⅷ"), (2, "\u0301"), (3, "ª"), (4, "中")], "doc_id long, text string"), found).collect()}
    assert got[1] == got[2] == "und" and got[3] != "und" and got[4] != "und"
    assert L.plain("नमस्ते, ไทยนี้ ½ A1") == "नमस्ते ไทยนี้ a".encode()


def test_language_ties_repeats_null_ids_and_clashing_columns(spark):
    ties = {"bb": b"same words here", "aa": b"same words here"}
    df = spark.createDataFrame([(2**60 + 1, "same", "z", 1)] * 3 + [(None, "same", "z", 1)], "doc_id long, text string, lang_pred string, margin int")
    rows = L.predict(df, ties).collect()
    assert len(rows) == 4 and {r["lang_pred"] for r in rows} == {"bb"} and all(r["rejected"] for r in rows)
    assert sorted({r["doc_id"] for r in rows}, key=str) == [2**60 + 1, None]
    assert L.predict(df.limit(0), ties).count() == 0
    assert L.learn(spark.createDataFrame([(1, "a b c", "x")] * 500 + [(1, "d e f", "x"), (None, "g", "x")], SCHEMA)) == {"x": b"a b c"}
