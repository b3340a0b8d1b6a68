import json
import os
import time

import pytest
from pyspark.sql import functions as F

from pagequarry.sources import snapshots
from pagequarry.streaming import ingest

def at():
    return F.lit("2025-06-01").cast("timestamp")


def line(page, codes, deleted=False, user="man"):
    tree = {"type": "root", "children": [{"type": "section", "children": [{"type": "code", "lang": "python", "value": c} for c in codes]}]}
    return json.dumps({"type": "page", "data": {"page_id": page, "github_username": user, "deleted": deleted, "ast": tree}})


def arrive(folder, name, *lines):
    os.makedirs(folder, exist_ok=True)
    path = f"{folder}/{name}"
    with open(path + ".tmp", "w") as f:
        f.write("\n".join([json.dumps({"type": "timestamp", "data": 1}), *lines]) + "\n")
    os.rename(path + ".tmp", path)


def run(spark, folder, store, checkpoint, name="pages"):
    q = ingest.start(ingest.page_lines(spark, folder, files_a_batch=1), store, checkpoint, name, at(), buckets=8, once=True)
    assert q.awaitTermination(300)


def rows(df):
    nodes = F.sort_array(F.transform("nodes", lambda n: F.struct(n["sha_256_hash"], n["is_removed"], n["instances_on_page"], n["code"], n["date_added"], n["date_updated"], n["date_removed"], n["category"], n["language"])))
    return sorted(tuple(map(str, r)) for r in df.select("page_id", "github_username", "code_nodes_total", "date_added", "date_last_updated", F.to_json("languages"), nodes).collect())


@pytest.fixture(scope="module")
def ran(spark, tmp_path_factory):
    """Three arrivals, one micro-batch each, taken in two runs of the stream."""
    tmp = tmp_path_factory.mktemp("incremental")
    folder, store = f"{tmp}/in", snapshots.Store(spark, f"file://{tmp}/store")
    pages = {f"p{i}": [f"print({i})", "shared = 1", "shared = 1"][: 1 + i % 3] for i in range(30)}
    thirds = [[line(p, c) for p, c in list(pages.items())[k::3]] for k in range(3)]
    arrive(folder, "a.ndjson", *thirds[0], line("p3", ["old line, laid over in the same file"]), line("p3", pages["p3"]))
    arrive(folder, "b.ndjson", *thirds[1])
    run(spark, folder, store, f"{tmp}/check")
    time.sleep(1.1)  # the order of arrival goes by the files' times
    arrive(folder, "c.ndjson", *thirds[2])
    run(spark, folder, store, f"{tmp}/check")
    return tmp, folder, store, pages


def test_three_arrivals_equal_one_batch(spark, ran):
    tmp, folder, store, pages = ran
    assert store.versions() == [1, 2, 3]
    one = snapshots.Store(spark, f"file://{tmp}/one")
    arrive(f"{tmp}/all", "all.ndjson", *[line(p, c) for p, c in pages.items()])
    assert ingest.upsert(ingest.placed(spark.read.text(f"{tmp}/all")), 0, one, "batch", at(), buckets=8)
    assert rows(store.read("pages")) == rows(one.read("pages"))
    got = {r["page_id"]: r["code_nodes_total"] for r in store.read("pages").collect()}
    assert got == {p: len(c) for p, c in pages.items()}


def test_a_batch_that_comes_again_changes_nothing(spark, ran):
    tmp, folder, store, _ = ran
    before, manifest = rows(store.read("pages")), store.manifest()
    last = ingest.placed(spark.read.text(f"{folder}/c.ndjson"))
    assert not ingest.upsert(last, manifest["marks"]["pages"], store, "pages", at(), buckets=8)
    assert store.manifest() == manifest and rows(store.read("pages")) == before


def test_changes_deletions_and_untouched_buckets(spark, ran):
    tmp, folder, _, pages = ran
    store = snapshots.Store(spark, f"file://{tmp}/more")
    lines = lambda *ls: ingest.placed(spark.createDataFrame([(x,) for x in ls], "value string").withColumn("_metadata", F.struct(F.lit(0).alias("file_modification_time"), F.lit("f").alias("file_path"), F.lit(0).alias("file_block_start"))))
    ingest.upsert(lines(*[line(p, c) for p, c in pages.items()]), 0, store, "s", at(), buckets=8)
    later = F.lit("2025-07-01").cast("timestamp")
    folders = store.manifest()["tables"]["pages"]["folders"]
    ingest.upsert(lines(line("p1", ["print(1)"]), line("p2", ["other = 5"]), line("p0", [], deleted=True), line("new", ["x = 1"])), 1, store, "s", later, buckets=8)
    now = store.manifest()["tables"]["pages"]["folders"]
    assert 0 < sum(folders[p] != now.get(p) for p in folders) <= 4
    got = {r["page_id"]: r for r in store.read("pages").collect()}
    assert set(got) == (set(pages) | {"new"}) - {"p0"}
    alive = lambda p: sorted(n["code"] for n in got[p]["nodes"] if not n["is_removed"])
    assert alive("p1") == ["print(1)"] and alive("p2") == ["other = 5"] and alive("new") == ["x = 1"]
    assert got["p1"]["code_nodes_total"] == 1 and len(got["p1"]["nodes"]) == 2  # what went stays, marked
    assert got["p3"]["date_last_updated"].month == 6 and got["p1"]["date_last_updated"].month == 7 and got["new"]["date_added"].month == 7
    assert sum(v["total"] for m in got["p1"]["languages"] for v in m.values()) == 1
    # The same pages again: nothing is rewritten within them.
    ingest.upsert(lines(*[line(p, c) for p, c in pages.items() if p not in ("p0", "p1", "p2")]), 2, store, "s", F.lit("2025-08-01").cast("timestamp"), buckets=8)
    assert {r["page_id"] for r in store.read("pages").where("month(date_last_updated) = 8").collect()} == set()
    # A batch without pages publishes nothing, and an old one is passed over.
    assert ingest.upsert(lines('{"type":"asset","data":{}}'), 3, store, "s", at(), buckets=8) and store.versions()[-1] == 3
    assert not ingest.upsert(lines(line("p5", [])), 1, store, "s", at(), buckets=8)
