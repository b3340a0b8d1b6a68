import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from pagequarry.llm import decontamination, mixing, quality_model
from pagequarry.llm import queries as Q
from pagequarry.llm.common import read_table, stage

from .test_near_dedup import plain_components, plain_sets

SF = "/root/testdata/sf0.001"


def test_stages_follow_each_other(spark):
    docs = read_table(spark, SF, "documents")
    columns, bench = docs.columns, [r["text"] for r in read_table(spark, SF, "benchmark").collect()]
    seen = []
    for name, f in P.STAGES:
        docs = stage(f(spark, docs, SF), "test")
        seen.append((name, docs))
        if name != P.STAGES[-1][0]:
            assert docs.columns == columns, name
    counts = [d.count() for _, d in seen]
    assert counts[0] >= counts[1] >= counts[2] and counts[3] == counts[4] > 0
    texts = [r["text"] for r in seen[1][1].select("text").collect()]
    assert len(texts) == len(set(texts))
    assert not [1 for r in seen[2][1].select("text").collect() for b in bench if b in r["text"]]


def test_every_stage_against_a_plain_version(spark):
    """On documents with repeated ids, null ids, copies, junk and leaks, each stage on what the one before it kept."""
    docs = read_table(spark, SF, "documents")
    rows = [tuple(r) for r in docs.collect()]
    bench = {r["item_id"]: r["text"] for r in read_table(spark, SF, "benchmark").collect()}
    good = [r for r in rows if r[1] and 400 < len(r[1]) < 3000][:30]
    rows += [(None, *r[1:]) for r in good[:6]] + [(good[7][0], *r[1:]) for r in good[8:12]] + good[:3]
    rows += [(90_000 + i, r[1] + " " + t, *r[2:]) for i, (r, t) in enumerate(zip(good[12:20], list(bench.values())[:8], strict=True))]
    key = lambda r: (str(r[0]), r[1] or "")
    now = stage(spark.createDataFrame(rows, docs.schema), "test")
    for name, f in P.STAGES:
        before = sorted((tuple(r) for r in now.collect()), key=key)
        after_df = stage(f(spark, now, SF), "test")
        after = [tuple(r) for r in after_df.collect()]
        if name == "quality classifier":
            weights = quality_model.fit(now, read_table(spark, SF, "labels"))
            p = 1 / (1 + np.exp(-np.clip(quality_model.margins([r[1] for r in before], weights), -35, 35)))
            assert sorted(after, key=key) == [r for r, x in zip(before, p, strict=True) if x >= quality_model.THRESHOLD]
        elif name == "near duplicates":
            comps, sets = plain_components(list(enumerate(r[1] for r in before)), 5), plain_sets(list(enumerate(r[1] for r in before)), 5)
            groups = {}
            for k, c in comps.items():
                groups.setdefault(c if sets[k] else ("empty", k), []).append(before[k])
            assert len(after) == len(groups) < len(before)
            least = {c: min((r[0] for r in g if r[0] is not None), default=None) for c, g in groups.items()}
            assert sorted(str(r[0]) for r in after) == sorted(map(str, least.values()))
            assert not set(after) - set(before)
        elif name == "benchmark decontamination":
            assert not [r for r in after for t in bench.values() if t in r[1]]
            found = {(r["doc_id"], r["text_hash"]) for r in decontamination.matches(now, read_table(spark, SF, "benchmark")).collect()}
            hashes = {(r["doc_id"], r["text"]): r["h"] for r in now.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()}
            assert sorted(after, key=key) == [r for r in before if (r[0], hashes[r[0], r[1]]) not in found]
        elif name == "mixing":
            copies = {(r["doc_id"], r["text_hash"]): r["copies"] for r in mixing.mix(now).collect()}
            hashes = {(r["doc_id"], r["text"]): r["h"] for r in now.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()}
            assert sorted(after, key=key) == [r for r in before for _ in range(copies[r[0], hashes[r[0], r[1]]])]
        else:
            size = lambda t: len((t or "").encode())
            assert sorted(((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in after_df.collect())) == sorted((str(r[0]), size(r[1]) + 8, zlib.crc32((r[1] or "").encode())) for r in before)
            slots = sorted((r["shard"], r["slot"]) for r in after_df.collect())
            assert all(b[1] == a[1] + 1 if a[0] == b[0] else b[1] == 0 for a, b in zip(slots, slots[1:], strict=False)) and slots[0][1] == 0
        now = after_df


def test_odd_rows_pass_through(spark):
    docs = read_table(spark, SF, "documents").limit(40)
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", None, 0), (90001, None, None, "s", None), (90001, None, None, "s", None)], docs.schema)
    rows = docs.unionByName(odd).withColumn("size", docs["doc_id"])
    for _, f in P.STAGES:
        rows = stage(f(spark, rows, SF), "test")
    assert rows.count() > 0


def test_empty_documents(spark):
    rows = read_table(spark, SF, "documents").limit(0)
    for _, f in P.STAGES:
        rows = stage(f(spark, rows, SF), "test")
    assert rows.count() == 0


def test_names_of_queries():
    numbers = sorted(int(n[2:].split("_")[0]) for n in Q.queries())
    assert numbers == list(range(1, 14))
    assert [n for n, _ in P.STAGES] and P.ORACLE_SQL is None


@pytest.mark.parametrize("name", ["op1_ring_shards", "op7_html_layout", "op11_crc_importance", "op12_transducer_counts"])
def test_queries_return_every_row(spark, name):
    table = "pages" if "html" in name else "documents"
    assert Q.queries()[name](spark, SF).count() == read_table(spark, SF, table).count()
