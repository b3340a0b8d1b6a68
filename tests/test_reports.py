from pyspark.sql import functions as F

from pagequarry.operators import reports


def test_a_table_with_shares(spark):
    counts = spark.createDataFrame([("b", 1), ("a longer key than the column", 2), ("c", 1), ("total", 4)], "key string, count long")
    text = reports.text_of(reports.count_table(counts, "By kind", "Kind", width=8))
    assert text.split("\n") == [
        "By kind",
        "Total code examples by Kind: 4",
        "+----------+-----------------+--------------------+",
        "| Kind     | Count           | % of Total         |",
        "+----------+-----------------+--------------------+",
        "| a longer key than the column | 2               | 50.0%              |",
        "| b        | 1               | 25.0%              |",
        "| c        | 1               | 25.0%              |",
        "+----------+-----------------+--------------------+",
    ]
    assert reports.text_of(reports.count_table(counts, "By kind", "Kind"), limit=2).split("\n")[-1] == "..."


def test_tables_by_group_with_sums(spark):
    pages = spark.createDataFrame([("c1", "p", "None", "x", 2), ("c1", "p", "s", "a", 3), ("c2", "q", "None", "y", 1)], "collection string, product string, sub_product string, page_id string, count long")
    lines = reports.page_usage_tables(pages)
    first = reports.text_of(lines.where("collection = 'c1'")).split("\n")
    assert first[0] == "Total new Applied Usage Example Counts by Page in Collection c1" and first[-1] == "Total new applied usage example counts in collection c1: 5"
    assert [x.split("|")[3].strip() for x in first[4:6]] == ["a", "x"] and len(first) == 8
    products = spark.createDataFrame([("q", 1, "None", 1), ("p", 5, "None", 2), ("p", 5, "s", 3)], "product string, product_count long, sub_product string, count long")
    rows = [x for x in reports.text_of(reports.product_table(products)).split("\n") if x.startswith("| ")]
    assert [[c.strip() for c in r.split("|")[1:5:2]] for r in rows[1:]] == [["p", "s"], ["p", "None"], ["q", "None"]]


def test_large_groups_are_numbered_by_ranges(spark):
    pages = spark.range(20_000).select(F.lit("c").alias("collection"), F.format_string("p%06d", "id").alias("page_id"))
    lines = reports.mismatch_tables(pages).where("section = 2")
    assert lines.count() == 20_000 and lines.where(F.substring("line", 3, 7) != F.format_string("p%06d", "rank")).count() == 0
