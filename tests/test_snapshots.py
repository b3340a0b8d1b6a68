import datetime
import os

import pytest

from pagequarry.sources import snapshots

NOW = datetime.timedelta(0)


@pytest.fixture
def store(spark, tmp_path):
    return snapshots.Store(spark, f"file://{tmp_path}/store")


def rows(spark, *values):
    return spark.createDataFrame(list(values), "page_id string, n long")


def held(df):
    return sorted(map(tuple, df.collect()))


def test_versions_are_read_as_they_were(spark, store):
    assert store.versions() == [] and store.manifest() == {} and not store.has("pages")
    with pytest.raises(KeyError):
        store.read("pages")
    assert store.publish({"pages": rows(spark, ("a", 1)), "summaries": rows(spark, ("s", 0))}, on=0) == 1
    assert store.publish({"pages": rows(spark, ("a", 2), ("b", 1))}, label="run 2") == 2
    assert held(store.read("pages", 1)) == [("a", 1)] and held(store.read("pages")) == [("a", 2), ("b", 1)]
    assert held(store.read("summaries")) == [("s", 0)]  # carried over, not copied
    assert store.manifest(2)["tables"]["summaries"] == store.manifest(1)["tables"]["summaries"]
    assert store.label_of("run 2") == 2 and store.label_of("run 3") is None
    assert held(snapshots.compared(store.read("pages", 1), store.read("pages", 2), "page_id")) == [("a", "changed"), ("b", "added")]


def test_a_writer_that_dies_leaves_the_old_version(spark, store, monkeypatch):
    store.publish({"pages": rows(spark, ("a", 1)), "summaries": rows(spark, ("s", 1))})
    with monkeypatch.context() as m:
        m.setattr(snapshots.Store, "_rename", lambda *_: (_ for _ in ()).throw(OSError("killed")))
        with pytest.raises(OSError):
            store.publish({"pages": rows(spark, ("a", 9)), "summaries": rows(spark, ("s", 9))})
    fails = rows(spark, ("a", 1)).selectExpr("page_id", "CASE WHEN n > 5 THEN n ELSE CAST(raise_error('midway') AS BIGINT) END n")
    with pytest.raises(Exception, match="midway"):
        store.publish({"pages": rows(spark, ("a", 7)), "summaries": fails})
    assert store.versions() == [1] and held(store.read("pages")) == [("a", 1)] and held(store.read("summaries")) == [("s", 1)]
    assert store.collect_garbage(1) == []  # young: the writer might still run
    assert len(store.collect_garbage(1, NOW)) >= 3
    assert held(store.read("pages")) == [("a", 1)]
    assert store.publish({"pages": rows(spark, ("a", 2))}) == 2


def test_two_writers(spark, store, monkeypatch):
    store.publish({"pages": rows(spark, ("a", 1))})
    other = snapshots.Store(spark, store.root)
    stale = other.manifest()
    store.publish({"pages": rows(spark, ("a", 2))}, on=1)
    with pytest.raises(snapshots.Conflict):
        other.publish({"pages": rows(spark, ("a", 3))}, on=1)
    with monkeypatch.context() as m:  # looked before the other one's rename, renames after it
        m.setattr(other, "manifest", lambda *_: stale)
        with pytest.raises(snapshots.Conflict):
            other.publish({"pages": rows(spark, ("a", 3))}, on=1)
    assert store.versions() == [1, 2] and held(store.read("pages")) == [("a", 2)]


def test_backups_rotate_and_hold_their_data(spark, store):
    for n, day in enumerate(("2025-01-01", "2025-01-02", "2025-01-03"), 1):
        store.publish({"pages": rows(spark, ("a", n))})
        left = store.backup(day, 2)
    assert left == ["backup_2025-01-02", "backup_2025-01-03"]
    assert store.backup("2025-01-03", 2) == left  # again on the same day
    store.publish({"pages": rows(spark, ("a", 4))})
    assert len(store.collect_garbage(1, NOW)) == 1  # of version 1; 2 and 3 are pinned
    assert store.versions() == [4]
    assert held(store.read("pages", "backup_2025-01-02")) == [("a", 2)]
    assert store.restore("backup_2025-01-02") == 5 and held(store.read("pages")) == [("a", 2)]


def test_parts_are_replaced_alone(spark, store):
    part = lambda df: df.selectExpr("*", "CAST(n % 3 AS INT) p")
    store.publish_parts("t", part(rows(spark, ("a", 0), ("b", 1), ("c", 2))), "p", {0, 1, 2})
    store.publish_parts("t", part(rows(spark, ("d", 4))), "p", {1, 2}, marks={"s": 7})
    assert held(store.read("t")) == [("a", 0), ("d", 4)] and held(store.read("t", 1)) == [("a", 0), ("b", 1), ("c", 2)]
    assert held(store.read("t", parts={1})) == [("d", 4)] and held(store.read("t", parts={2})) == []
    assert store.read("t").columns == ["page_id", "n"] and store.manifest()["marks"] == {"s": 7}
    before = store.manifest()["tables"]["t"]["folders"]["0"]
    assert store.manifest(1)["tables"]["t"]["folders"]["0"] == before
    with pytest.raises(ValueError):
        store.publish_parts("t", part(rows(spark, ("x", 0))), "p", {1})
    other = snapshots.Store(spark, store.root + "-copy")
    assert store.copy_to(other) == 1 and held(other.read("t")) == [("a", 0), ("d", 4)]


def test_odd_names_and_types(spark, store):
    df = spark.createDataFrame([("a", [1], {"k": (1, None)})], "`page id, x` string, `n:1` array<int>, m map<string,struct<p:int,q:string>>")
    store.publish({"t": df})
    assert store.read("t").collect() == df.collect() and store.read("t").schema == df.schema
    assert not [n for n in os.listdir(store.root.removeprefix("file://") + "/versions") if n.startswith(".") and not n.endswith(".crc")]
