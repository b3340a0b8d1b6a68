import random
import re

import pytest

from pagequarry.llm import decontamination as D

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"
QUESTION = "A farmer named Paul has 12 apples and sells 5 kg of pears to Mary, then Paul buys 12 more apples for 3 euros"


def filler(n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def tables(spark):
    items = [(0, filler(30, 1)), (1, QUESTION), (2, "too short"), (3, None), (4, filler(16, 2) + " " + filler(16, 3))]
    docs = [
        (10, filler(50, 9) + " " + items[0][1] + " " + filler(50, 10)),
        (11, "x " * 20 + items[0][1].upper() + "."),
        (12, " ".join(w if i != 14 else "changed" for i, w in enumerate(items[0][1].split()))),
        (13, filler(20, 5) + " " + QUESTION.replace("12", "40").replace("Paul", "Anna").replace("5", "6")),
        (14, QUESTION.replace("12 apples", "40 apples").replace("Paul", "Anna")),
        (15, "A farmer named Anna has 40 apples and sells 5 kg of pears to Mary, then Zoe buys 77 more apples for 3 euros"),
        (16, filler(300, 6)),
        (17, None),
        (18, ""),
        (19, (items[0][1] + " ") * 30),
        (20, items[4][1]),
        (21, "too short"),
        (22, " ".join(items[0][1].split()[:9])),
    ]
    docs += [(10, docs[0][1])]
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), dict(docs), dict(items)


def test_leaks_are_found_and_others_left_alone(spark, tables):
    docs, items, _, _ = tables
    got = {(r["doc_id"], r["item_id"]): r for r in D.matches(docs, items).collect()}
    assert {(10, 0), (12, 0), (19, 0), (20, 4), (13, 1), (11, 0)} <= set(got)
    assert not {16, 17, 18, 21, 22} & {d for d, _ in got}
    assert got[13, 1]["reparameterised"] and not got[10, 0]["reparameterised"]
    assert (15, 1) not in got  # one name of the question stands for two names there
    assert len([1 for d, _ in got if d == 10]) == 1


def test_windows_agree_with_a_plain_count(spark, tables):
    """Without placeholders, `matched` is the number of the item's 5-word windows that the document holds."""
    docs, items, texts, wanted = tables
    words = lambda t: [w for w in re.split(r"[^a-z0-9]+", t.lower()) if w]
    for r in D.matches(docs, items).where("item_id IN (0, 4)").collect():
        a, b = words(texts[r["doc_id"]]), words(wanted[r["item_id"]])
        held = {tuple(a[i : i + 5]) for i in range(len(a) - 4)}
        assert r["matched"] == sum(tuple(b[i : i + 5]) in held for i in range(len(b) - 4))


def test_template_words(spark):
    df = spark.createDataFrame([(1, 'We saw Paris, 12 km or 3.5 then 7kg x. "Anna" McX aB USA 1,000,5'), (2, "Then")], DOCS)
    n, u, m = D.NUMBER, D.UNIT, D.NAME
    got = {r[0]: r for r in df.select("doc_id", D.template_words(df["text"]), D.marks(D.template_words(df["text"]))).collect()}
    assert got[1][1] == [m + "we", "saw", m + "paris", n + "12", u + "km", "or", n + "3.5", "then", n + "7", u + "kg", "x", m + "anna", m + "mcx", "ab", "usa", n + "1,000,5"]
    assert got[1][2] == [m, "saw", m, n, u, "or", n, "then", n, u, "x", m, m, "ab", "usa", n] and got[2][2] == [m]


def test_short_items_match_as_they_stand(spark):
    items = [(1, "two plus two indeed"), (2, "Paul owns 7"), (3, "so it"), (4, "one window of five")]
    docs = [(1, "he said two plus two indeed."), (2, "Paul owns 7 cows"), (3, "Anna owns 7 cows"), (4, "Paul owns 8"), (5, "so it is"), (6, "two plus two"), (None, "x two plus two indeed")]
    got = {(r["doc_id"], r["item_id"]) for r in D.matches(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()}
    assert got == {(1, 1), (2, 2), (None, 1)}


NAMES = "Anna Ben Clara David Erik Fatima Greta Hugo Ines Jonas Karim Lena Marta Nils Olga Pedro".split()
SHAPES = [
    '{a} has {x} {u} of rope and cuts {y} {u} off. {a} then gives half of what is left to {b}. How much does {a} keep?',
    'The teacher said: "{a} read {x} pages on Monday and {y} pages on Tuesday". How many pages did {a} read, if {b} read {x} pages?',
    "A train leaves at {x} km per hour while {a} drives {y} km. {b} waits {z} hours. How far is {a} from the train after {z} hours?",
    "{a}, who owns {x} hens, sells {y} eggs to {b} every day; how many days until {b} has bought {z} eggs from {a}?",
    "If {x} workers build a wall in {y} days, how many workers does {a} need to build it in {z} days, given that {b} helps?",
]


def test_reparameterised_questions(spark):
    """Other names, numbers and units in a question's place, amid other text: nine in ten found, unlike questions left alone."""
    rng = random.Random(31)
    ask = lambda shape: shape.format(**dict(zip("ab", rng.sample(NAMES, 2), strict=True)), **dict(zip("xyz", rng.sample(range(2, 900), 3), strict=True)), u=rng.choice(["meters", "feet", "km"]))
    items = [(i, ask(s)) for i, s in enumerate(SHAPES)]
    docs, want = [], set()
    for d in range(200):
        docs.append((d, f"{filler(rng.randint(0, 40), d)}. {ask(SHAPES[d % 5])} {filler(rng.randint(0, 40), d + 1000)}"))
        want.add((d, d % 5))
    plain = "{a} saw {x} {u} of snow. The next day {b} saw {y} more, which {a} called a record for {z} years in the village of {b}."
    docs += [(1000 + d, f"{ask(plain)} {filler(30, d)}") for d in range(50)]
    docs += [(2000 + d, " ".join(str(rng.randrange(1000)) for _ in range(400))) for d in range(5)]
    got = {(r["doc_id"], r["item_id"]): r for r in D.matches(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()}
    assert len(want & set(got)) >= 0.9 * len(want) and set(got) <= want
    assert sum(r["reparameterised"] for r in got.values()) >= 0.9 * len(got)


def test_numbers_alone_are_told_by_value(spark):
    rng = random.Random(5)
    table = [" ".join(str(rng.randrange(10**6)) for _ in range(60)) for _ in range(3)]
    docs = [(i, t + " " + filler(10, i)) for i, t in enumerate(table)] + [(9, (table[0] + " ") * 200)]
    got = {(r["doc_id"], r["item_id"]) for r in D.matches(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(7, table[0]), (8, table[1])], ITEMS)).collect()}
    assert got == {(0, 7), (1, 8), (9, 7)}


def test_repeated_ids_null_ids_long_texts_and_extra_columns(spark):
    half = QUESTION.split()
    docs = [(1, " ".join(half[:9])), (1, " ".join(half[14:])), (None, QUESTION), (2, filler(60_000, 77) + " " + QUESTION), (2, filler(50, 78))]
    df = spark.createDataFrame([(*d, "x", 5, 6) for d in docs], DOCS + ", item_id string, at int, h int")
    got = [(r["doc_id"], r["item_id"]) for r in D.matches(df, spark.createDataFrame([(1, QUESTION)], ITEMS)).collect()]
    assert sorted(got, key=str) == [(2, 1), (None, 1)]


def test_empty_tables_and_shuffled_join(spark, tables, monkeypatch):
    docs, items, _, _ = tables
    assert D.matches(docs.limit(0), items).count() == 0 and D.matches(docs, items.limit(0)).count() == 0
    want = sorted(map(tuple, D.matches(docs, items).collect()))
    monkeypatch.setattr(D, "MAX_BROADCAST", 0)
    assert sorted(map(tuple, D.matches(docs, items).collect())) == want
    assert not re.search("Python|Pandas|Arrow", D.matches(docs, items)._jdf.queryExecution().toString())


def test_edited_copies_are_found(spark):
    head, numbers = filler(14, 21), "start 11 42 37 58 64 91 23 75 88 16 29 53 71 34 end"
    half = head + " Q 12 x 7 y and 12 of 9 were 30 then 12 or 5 made"
    items = [(1, QUESTION), (2, half), (3, numbers)]
    docs = [
        (1, QUESTION[::-1].replace("21", "31", 1)[::-1]),  # the second 12 alone
        (2, filler(20, 22) + " " + QUESTION[::-1].replace("21", "31", 1)[::-1].replace("Mary", "Mary")),
        (3, half[: half.index(" then")] + " 4 30 99 " + filler(10, 23) + " 44 12 17"),  # the rest faces other numbers
        (4, numbers.replace("23 75", "23 new 75")),
        (5, numbers.replace(" 91 ", " ")),
        (7, "A farmer named Anna has 40 apples and sells 5 kg of pears to Mary, then Zoe buys 77 more apples for 3 euros " + filler(30, 24) + " more apples for 3 euros"),
    ]
    assert docs[0][1] == QUESTION.replace("12 more", "13 more")
    got = {(r["doc_id"], r["item_id"]): r for r in D.matches(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()}
    assert {(1, 1), (2, 1), (3, 2), (4, 3), (5, 3)} <= set(got), sorted(got)
    assert got[1, 1]["coverage"] == 1.0 and got[1, 1]["reparameterised"]
    assert (7, 1) not in got
