import hashlib
import random

from pagequarry.operators import cdc


def test_pages_that_differ_are_found_without_exploding(spark):
    """Against multisets of hashes; order, removed nodes and stored counts of instances play their part."""
    rng = random.Random(8)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    stored, incoming, want = [], [], set()
    for p in range(200):
        old = [rng.choice("abcdef") for _ in range(rng.randint(0, 5))]
        new = rng.sample(old, len(old)) if p % 2 else [rng.choice("abcdef") for _ in range(rng.randint(0, 5))]
        nodes = [(sha(c), None, old.count(c)) for c in dict.fromkeys(old)] + [(sha("gone"), True, 0)] * (p % 3)
        if p % 5 or old:
            stored.append((f"p{p}", rng.sample(nodes, len(nodes)) if old or p % 4 else None))
        incoming += [(f"p{p}", sha(c)) for c in new]
        if sorted(old) != sorted(new):
            want.add(f"p{p}")
    left = spark.createDataFrame(stored, "page_id string, nodes array<struct<sha_256_hash:string,is_removed:boolean,instances_on_page:long>>")
    right = spark.createDataFrame(incoming, "page_id string, sha_256_hash string")
    found = cdc.changed_pages(left, right)
    assert {r["page_id"] for r in found.collect()} == want
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
    assert all(r["old_n"] != r["new_n"] for r in cdc.changed_pages(left, right, strict_counts=True).collect())


def test_digest_tells_apart_what_sums_of_counts_do_not(spark):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    left = spark.createDataFrame([("p", [(sha("a"), False, 2), (sha("b"), False, 1)])], "page_id string, nodes array<struct<sha_256_hash:string,is_removed:boolean,instances_on_page:long>>")
    right = lambda *codes: spark.createDataFrame([("p", sha(c)) for c in codes], "page_id string, sha_256_hash string")
    assert cdc.changed_pages(left, right("a", "b", "a")).count() == 0
    assert cdc.changed_pages(left, right("a", "b", "b")).count() == 1 == cdc.changed_pages(left, right("a", "b", "c")).count()
