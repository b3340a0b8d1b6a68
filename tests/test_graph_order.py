import random

from pagequarry.operators import trees


def plain(links, root):
    """A depth-first walk: (node, enter, leave, depth, cut) in order."""
    out = []

    def visit(node, path, depth):
        cut = node in path
        at = len(out)
        out.append(None)
        if not cut:
            for _, target in sorted(links.get(node, [])):
                visit(target, [*path, node], depth + 1)
        out[at] = (node, at, len(out) - 1, depth, cut)

    visit(root, [], 0)
    return out


def test_order_is_that_of_a_walk(spark):
    """Shared files, repeated inclusions, cycles, several roots."""
    rng = random.Random(3)
    nodes = [f"f{i}" for i in range(12)]
    links = {n: sorted({(k, rng.choice(nodes[max(0, i - 2) :])) for k in range(rng.randint(0, 3))}) for i, n in enumerate(nodes)}
    edges = spark.createDataFrame([(n, t, k) for n, ts in links.items() for k, t in ts], "source string, target string, ordinal int")
    roots = spark.createDataFrame([("f0",), ("f3",), ("lone",), ("f3",)], "node string")
    got = trees.numbered(trees.include_tree(edges, roots)).collect()
    for root in ("f0", "f3", "lone"):
        own = sorted((r for r in got if r["root"] == root), key=lambda r: r["enter"])
        assert [(r["node"], r["enter"], r["leave"], r["depth"], r["is_cut"]) for r in own] == plain(links, root)
    assert trees.numbered(trees.include_tree(edges, roots.limit(0))).count() == 0


def test_what_lies_below_is_a_range(spark):
    names = ["a/b/c.rst", "a/b/d/e.rst", "a/b.rst", "a2/x.rst", "top.rst", "a/b/d/f.rst", "a/b/c.rst", "it's/q.rst"]
    labels = trees.numbered(trees.folder_tree(spark.createDataFrame([(n,) for n in names], "path string")))
    rows = {r["id"]: r for r in labels.collect()}
    assert rows[""]["leave"] == len(rows) - 1 == sorted(r["enter"] for r in rows.values())[-1]
    of = spark.createDataFrame([("", "a/b/"), ("", "a/b/d/")], "root string, id string")
    found = sorted((r["above"], r["id"]) for r in trees.below(labels, of).where("is_file").collect())
    assert found == [("a/b/", "a/b/c.rst"), ("a/b/", "a/b/d/e.rst"), ("a/b/", "a/b/d/f.rst"), ("a/b/d/", "a/b/d/e.rst"), ("a/b/d/", "a/b/d/f.rst")]
    edges = spark.createDataFrame([("p1", "a/b/c.rst"), ("p2", "a/b.rst"), ("p3", "a/b/d/f.rst"), ("p1", "a/b/d/e.rst"), ("p4", "it's/q.rst")], "source string, target string")
    assert sorted(r["source"] for r in trees.users_below(labels, edges, "a/b/").collect()) == ["p1", "p3"]
    assert [r["source"] for r in trees.users_below(labels, edges, "it's/").collect()] == ["p4"]
