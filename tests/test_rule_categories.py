import re

from pagequarry.plans.queries import ORACLES, QUERIES

from .oracle import SF, connection

#: Heads cut within a character, and aggregation stages: what the query rule_categories leaves out.
TEXTS = [
    "é" * 24 + "x_id", "é" * 23 + "x_id", "é" * 22 + " License", "é" * 21 + " License", "語" * 16 + "_id", "語" * 15 + "a_id", "語" * 15 + "ab_id", "語" * 15 + "abc_id", "😀" * 12 + "_id", "😀" * 11 + "abc_id", "😀" * 11 + "abcd_id",
    "{ $match: { a: <value> } }", "{ $match: 1 }", "é $group:\n {x: <y\nz>}", "$1: <x>", "$a: <x>", "$ab: <>", "$ab: <>>", "$ab <x>", "from é", "import x", "License", "plain", "warning $match: 1", "", None,
]


def plain_category(text):
    text = text or ""
    head = text.encode()[:50].decode("utf-8", "ignore")
    stage = re.search(r"(?s)\$[a-zA-Z]{2,}: ?(.*?<.+?>)?", text)
    if text.startswith(("import ", "from ")) or "License" in head:
        return "Usage example"
    if any(x in head for x in ("warning", "deprecated", "_id")):
        return "Example return object"
    return "Uncategorized" if not stage else "Syntax example" if stage[1] else "Usage example"


def test_cut_heads_and_stages(spark, tmp_path):
    rows = [(i, t, "en") for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    want = {i: plain_category(t) for i, t, _ in rows}
    assert {r["doc_id"]: r["category"] for r in QUERIES["rule_categories_of_all"](spark, str(tmp_path)).collect()} == want
    con = connection()
    con.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert dict(con.execute("SELECT doc_id, category FROM (" + ORACLES["rule_categories_of_all"] + ")").fetchall()) == want


def test_every_document_has_a_category(spark):
    texts = dict(connection().execute("SELECT doc_id, text FROM documents").fetchall())
    got = {r["doc_id"]: r["category"] for r in QUERIES["rule_categories_of_all"](spark, SF).collect()}
    assert got == {i: plain_category(t) for i, t in texts.items()}
