"""Change detection between a stored and an incoming snapshot of pages and their code nodes."""

from __future__ import annotations

import math
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.functions.edits import edit_counts
from pagequarry.functions.scalars import key_url
from pagequarry.operators.ranks import kept, ranked, staged

MAX_CHANGE = 0.30
#: Pairs that an item may be expected to have in a band of changes, and the steps by which a band may be smaller than the limit.
PAIRS_AN_ITEM, BANDS = 8, 10
#: Items left that a task of a round holds: rounds over few items leave few files.
TASK_ITEMS = 20_000


def classify_pages(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """(page_id, status): deleted, existing, new or removed. incoming: page_id, deleted."""
    a = stored.select("page_id").distinct().withColumn("stored", F.lit(True))
    b = incoming.groupBy("page_id").agg(F.max(F.coalesce("deleted", F.lit(False))).alias("deleted"))
    joined = a.join(b, "page_id", "full")
    status = F.when(F.col("deleted"), "deleted").when(F.col("stored") & F.col("deleted").isNotNull(), "existing").when(F.col("stored"), "removed").otherwise("new")
    return joined.select("page_id", status.alias("status"))


# Words of a page name that say nothing about what it holds.
STOP_WORDS = ["and", "the", "to", "a", "of", "in"]


def name_words(page_id: Column, parent: bool = True) -> Column:
    """Words of a page id's last part, and of the one before it unless parent is False, without stop words."""
    parts = F.split(page_id, r"[|/]")
    taken = F.slice(parts, F.greatest(F.lit(1), F.size(parts) - (1 if parent else 0)), 2)
    return F.array_except(F.array_distinct(F.flatten(F.transform(taken, lambda p: F.split(p, "-")))), F.array(*[F.lit(w) for w in STOP_WORDS]))


def page_moves(removed: DataFrame, new: DataFrame, parent: bool = True) -> DataFrame:
    """(old_id, new_id) of pages of equal, non-zero counts whose names share a word; one to one.

    Both: page_id, code_count, literal_count, io_count.
    """
    counts = ["code_count", "literal_count", "io_count"]
    words = lambda df: df.where(F.col("code_count") != 0).select("page_id", *counts, F.explode(name_words(F.col("page_id"), parent)).alias("word"))
    return matched_by_word(words(removed), words(new), "page_id", counts).select("old_id", "new_id")


def matched_by_word(old: DataFrame, new: DataFrame, key: str, same: list[str]) -> DataFrame:
    """(*same, old_id, new_id): a one-to-one matching of rows of old and new that agree in `same` and share a word.

    Both: key, *same, word; a row a word. No pairs are made but those of the result's size: in each round every item takes
    the word that the fewest items of both sides share (rare words say more; then the first word), and the items of both
    sides that took the same word are matched in the order of their keys. The rarest word of all is taken by all who have
    it, so each round settles some word, and rounds end when no word is left on both sides.
    """
    group = [*same, "word"]
    a, b = (kept(df.select(F.col(key).alias(name), *group).distinct()) for df, name in ((old, "old_id"), (new, "new_id")))
    done = None
    while True:
        live = a.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).join(b.groupBy(*group).agg(F.count(F.lit(1)).alias("m")), group)
        live = kept(live.select(*group, F.struct(F.col("n") * F.col("m"), "word").alias("best")))
        if not live.limit(1).count():
            return done if done is not None else a.join(b, group).select(*same, "old_id", "new_id").limit(0)
        taken = lambda df, name: ranked(df.join(live, group).groupBy(name, *same).agg(F.min("best").alias("best")).select(name, *same, F.col("best.word").alias("word")), group, [name])  # noqa: E731, B023
        pairs = kept(taken(a, "old_id").join(taken(b, "new_id"), [*group, "rank"]).select(*same, "old_id", "new_id"))
        done = pairs if done is None else done.unionByName(pairs)
        a = kept(a.join(pairs.select("old_id", *same), ["old_id", *same], "left_anti"))
        b = kept(b.join(pairs.select("new_id", *same), ["new_id", *same], "left_anti"))


def one_to_one(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """A greedy matching of pairs by ascending `rank`: pairs that are first on both sides are fixed, then their sides leave.

    Each round fixes the least pair left at least, and about all but a fraction of them where ranks are in random order;
    give ties a hash of the pair as the second part of the rank.
    """
    left, done = kept(pairs), None
    while True:
        first_a, first_b = (left.groupBy(k).agg(F.min("rank").alias("rank")) for k in (a, b))
        fixed = kept(left.join(first_a, [a, "rank"], "left_semi").join(first_b, [b, "rank"], "left_semi"))
        if not fixed.limit(1).count():
            return done if done is not None else fixed
        done = fixed if done is None else done.unionByName(fixed)
        left = kept(left.join(fixed.select(a), a, "left_anti").join(fixed.select(b), b, "left_anti"))


def edit_share(old: Column | str, new: Column | str, limit: float = MAX_CHANGE) -> Column:
    """Share of the old text's bytes that a shortest edit script to the new one deletes; 1 if that is all, if it is `limit`
    or more, or if a text is empty or null. It decides between texts of equal length."""
    old, new = (F.col(c) if isinstance(c, str) else c for c in (old, new))
    size = F.octet_length(old)
    deleted = edit_counts(old, new, limit)["deleted"]
    return F.when((size > 0) & (F.octet_length(new) > 0) & (deleted < size), deleted / size).otherwise(F.lit(1.0))


def change_share(old: Column, new: Column, limit: float = MAX_CHANGE) -> Column:
    """Share of a text that changed: the difference of both lengths in bytes over the old length or, for equal lengths, what a
    shortest edit script deletes. 1 where nothing is left of the old text or the share is `limit` or more."""
    size, other = F.octet_length(old), F.octet_length(new)
    net = F.abs(other - size) / size
    shared = F.arrays_overlap(F.split(old, ""), F.split(new, ""))
    uneven = F.when((size > 0) & shared & (net < limit), net).otherwise(F.lit(1.0))
    return F.when(size == other, edit_share(old, new, limit)).otherwise(uneven)


def classify_nodes(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Hash counts on both sides: (page_id, sha_256_hash, old_count, new_count, status).

    status is unchanged where a hash is on both sides, else new or removed; multiplicities are kept.
    """
    n = lambda df, name: df.groupBy("page_id", "sha_256_hash").agg(F.count(F.lit(1)).alias(name))
    joined = n(stored, "old_count").join(n(incoming, "new_count"), ["page_id", "sha_256_hash"], "full")
    status = F.when(F.col("old_count").isNull(), "new").when(F.col("new_count").isNull(), "removed").otherwise("unchanged")
    return joined.select("page_id", "sha_256_hash", F.coalesce("old_count", F.lit(0)).alias("old_count"), F.coalesce("new_count", F.lit(0)).alias("new_count"), status.alias("status"))


def _characters(code: Column) -> dict[str, Column]:
    """The characters of a text: two numbers with a bit for each of ASCII, and the others as an array."""
    held = F.array_distinct(F.split(code, ""))
    bits = lambda lo: F.aggregate(F.filter(held, lambda c: (F.ascii(c) >= lo) & (F.ascii(c) < lo + 64)), F.lit(0).cast("long"), lambda m, c: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.ascii(c) - lo)))
    return {"low": bits(0), "high": bits(64), "others": F.filter(held, lambda c: F.ascii(c) >= 128)}


def _order(change: Column, old_hash: Column, new_hash: Column) -> Column:
    """Change, then a hash of the pair, as one number, which aggregates hold without sorting their rows."""
    wide = "decimal(38,0)"
    tie = F.xxhash64(old_hash, new_hash).cast(wide) + F.lit(Decimal(1 << 63)).cast(wide)
    return ((change * float(1 << 62)).cast("long").cast("decimal(19,0)") * F.lit(Decimal(1 << 64)) + tie).cast(wide)


def _classes(change: float):
    """Classes of sizes: sizes that differ by less than `change` of the old one are in classes of which the new one's lies
    two below to one above the old one's."""
    width = math.log(1 + change * 1.001)
    return lambda size: F.floor(F.log(size.cast("double")) / F.lit(width))


def _band(live: DataFrame, done: float, limit: float) -> tuple[float, int]:
    """The largest change over `done`, of some steps up to limit, below which items have PAIRS_AN_ITEM pairs or so, on average;
    else the smallest one. 0 if items of one side only are left. Then the number of items."""
    steps = [x for x in (limit / 4**k for k in range(BANDS)) if x > done]
    sizes = live.groupBy("page_id", "bytes").agg(F.count_if("is_old").alias("n"), F.count_if(~F.col("is_old")).alias("m"))
    tried = F.explode(F.array(*[F.struct(F.lit(k).alias("step"), _classes(x)(F.col("bytes")).alias("class")) for k, x in enumerate(steps)]))
    near = sizes.select("page_id", "n", "m", tried.alias("t")).groupBy("t.step", "page_id", "t.class").agg(F.sum("n").cast("double").alias("n"), F.sum("m").cast("double").alias("m"))
    found = {r["step"]: r for r in near.groupBy("step").agg(F.sum(2 * F.col("n") * F.col("m")).alias("pairs"), F.sum("n").alias("n"), F.sum("m").alias("m")).collect()}
    if not found or not found[0]["n"] or not found[0]["m"]:
        return 0, 0
    items = int(found[0]["n"] + found[0]["m"])
    return next((x for k, x in enumerate(steps) if found[k]["pairs"] <= PAIRS_AN_ITEM * items), steps[-1]), items


def _side(live: DataFrame, old: bool) -> DataFrame:
    name = "old" if old else "new"
    return live.where(F.col("is_old") == old).select("page_id", *[F.col(c).alias(f"{name}_{c}") for c in live.columns if c not in ("page_id", "is_old")])


def _shared() -> Column:
    """Whether both texts of a pair have a character in common."""
    bits = lambda name: F.col(f"old_{name}").bitwiseAND(F.col(f"new_{name}")) != 0
    return bits("low") | bits("high") | F.arrays_overlap("old_others", "new_others")


def _uneven_pairs(live: DataFrame, change: float) -> DataFrame:
    """(old_id, new_id, order) of pairs of unequal lengths below a change. They are made from lengths and are nowhere kept."""
    of = _classes(change)
    near = _side(live, False).withColumn("class", F.explode(F.array(*[of(F.col("new_bytes")) + i for i in (-1, 0, 1, 2)])))
    pairs = _side(live, True).withColumn("class", of(F.col("old_bytes"))).join(near, ["page_id", "class"])
    found = F.abs(F.col("new_bytes") - F.col("old_bytes")) / F.col("old_bytes")
    return pairs.where((F.col("new_bytes") != F.col("old_bytes")) & (found < change) & _shared()).select("old_id", "new_id", _order(found, F.col("old_sha_256_hash"), F.col("new_sha_256_hash")).alias("order"))


def _even_pairs(texts: DataFrame, live: DataFrame, change: float) -> DataFrame:
    """(old_id, new_id, order) of pairs of equal lengths below a change; a text goes once to where its length is."""
    key = ["page_id", "bytes"]
    ids = live.groupBy(*key).agg(F.count_if("is_old").alias("n"), F.count_if(~F.col("is_old")).alias("m")).where("n > 0 AND m > 0").select(*key)
    left = texts.join(live.select("id"), "id", "left_semi").join(ids, key, "left_semi")
    pairs = _side(left, True).withColumnRenamed("old_bytes", "bytes").join(_side(left, False).withColumnRenamed("new_bytes", "bytes"), key).where(_shared())
    found = pairs.withColumn("change", edit_share("old_code", "new_code", change)).where(F.col("change") < change)
    return found.select("old_id", "new_id", _order(F.col("change"), F.col("old_sha_256_hash"), F.col("new_sha_256_hash")).alias("order"))


def similar_nodes(texts: DataFrame, limit: float = MAX_CHANGE) -> DataFrame:
    """(old_id, new_id): texts of a page matched one to one, most similar first.

    texts: id, page_id, sha_256_hash, is_old, code, bytes, low, high, others. Pairs are looked at in bands of changes, least
    first, so that most items are matched before pairs are many: a band ends when no two items left are that similar. In each
    round the pairs that are first on both sides are fixed. A round makes its pairs anew and keeps the first one an item only,
    so what is written grows with the items, whatever the number of pairs; of equal lengths, those below the band's change.
    """
    live, done, change = kept(texts.drop("code")), None, 0.0
    while change < limit:
        change, items = _band(live, change, limit)
        if not items:
            break
        tasks = items // TASK_ITEMS + 1
        even = kept(_even_pairs(texts, live, change))
        some = even.limit(1).count() > 0
        while True:
            pairs = _uneven_pairs(live, change)
            if some:
                ids = lambda old, name: live.where(F.col("is_old") == old).select(F.col("id").alias(name))  # noqa: E731, B023
                pairs = pairs.unionByName(even.join(ids(True, "old_id"), "old_id", "left_semi").join(ids(False, "new_id"), "new_id", "left_semi").select(*pairs.columns))
            seen = F.explode(F.array(F.struct(F.lit(True).alias("is_old"), F.col("old_id").alias("id"), F.col("new_id").alias("other"), "order"), F.struct(F.lit(False).alias("is_old"), F.col("new_id").alias("id"), F.col("old_id").alias("other"), "order")))
            first = pairs.select(seen.alias("s")).groupBy("s.is_old", "s.id").agg(F.min_by("s.other", "s.order").alias("other")).coalesce(tasks)
            both = first.groupBy(F.when(F.col("is_old"), F.col("id")).otherwise(F.col("other")).alias("old_id"), F.when(F.col("is_old"), F.col("other")).otherwise(F.col("id")).alias("new_id"))
            fixed = kept(both.count().where("count = 2").select("old_id", "new_id").coalesce(tasks))
            if not fixed.limit(1).count():
                break
            done = fixed if done is None else done.unionByName(fixed)
            live = kept(live.join(fixed.select(F.explode(F.array("old_id", "new_id")).alias("id")), "id", "left_anti").coalesce(tasks))
    return done if done is not None else live.select(F.col("id").alias("old_id"), F.col("id").alias("new_id")).limit(0)


def diff_nodes(stored: DataFrame, incoming: DataFrame, limit: float = MAX_CHANGE) -> DataFrame:
    """(page_id, old_hash, new_hash, old_count, new_count, status): unchanged, updated, new or removed, a row a hash or pair.

    Both: page_id, sha_256_hash, code; a row an instance. What hashes don't settle is paired on its page by similarity,
    most similar first, one to one: two texts are similar if they have a character in common and the share of the old
    one's bytes that changed is below limit. That share is the difference of lengths; for equal lengths, `edit_share`.
    Pairs are made of lengths and characters, and only equal lengths bring the texts themselves together.
    """
    by_hash = kept(classify_nodes(stored, incoming))
    key = ["page_id", "sha_256_hash"]
    texts = lambda df, status: df.join(by_hash.where(F.col("status") == status), key, "left_semi").groupBy(*key).agg(F.min("code").alias("code")).withColumn("is_old", F.lit(status == "removed"))
    one_each = texts(stored, "removed").unionByName(texts(incoming, "new")).where("code <> ''")
    one_each = staged(one_each.withColumns({"id": F.monotonically_increasing_id(), "bytes": F.octet_length("code"), **_characters(F.col("code"))}))
    facts = one_each.drop("code")
    named = lambda name: facts.select(F.col("id").alias(f"{name}_id"), *(["page_id"] if name == "old" else []), F.col("sha_256_hash").alias(f"{name}_hash"))
    updated = kept(similar_nodes(one_each, limit).join(named("old"), "old_id").join(named("new"), "new_id").select("page_id", "old_hash", "new_hash"))
    n = lambda name, count: by_hash.select("page_id", F.col("sha_256_hash").alias(f"{name}_hash"), count)
    both = updated.join(n("old", "old_count"), ["page_id", "old_hash"]).join(n("new", "new_count"), ["page_id", "new_hash"]).withColumn("status", F.lit("updated"))
    none = F.lit(None).cast("string")
    rest = by_hash.join(updated.select("page_id", F.explode(F.array("old_hash", "new_hash")).alias("sha_256_hash")), key, "left_anti")
    rest = rest.select("page_id", F.when(F.col("status") == "new", none).otherwise(F.col("sha_256_hash")).alias("old_hash"), F.when(F.col("status") == "removed", none).otherwise(F.col("sha_256_hash")).alias("new_hash"), "old_count", "new_count", "status")
    return both.select(*rest.columns).unionByName(rest)


def live_nodes(pages: DataFrame) -> DataFrame:
    """(page_id, n: node) of the nodes that are on their page."""
    return pages.select("page_id", F.explode("nodes").alias("n")).where(~F.coalesce("n.is_removed", F.lit(False)))


def _instances(node: Column) -> Column:
    return F.when(node > 1, node).otherwise(1)


def _hash_parts(h: Column) -> list[Column]:
    """Two numbers of 60 bits of a hash in hexadecimal digits."""
    return [F.coalesce(F.conv(F.substring(h, at, 15), 16, 10), F.lit("0")).cast("decimal(38,0)") for at in (1, 16)]


def changed_pages(stored: DataFrame, nodes: DataFrame, strict_counts: bool = False) -> DataFrame:
    """(page_id, old_n, new_n) of the pages whose live nodes, with their instances, differ from the incoming ones.

    stored: page_id, nodes. nodes: page_id, sha_256_hash; a row an instance. Each side is summed to a digest a page that
    doesn't depend on order: the number of instances and the sums of two parts of their hashes. Stored nodes are summed
    within their array; nothing is exploded, and only digests are shuffled. strict_counts: numbers alone decide.
    """
    number = "decimal(38,0)"
    alive = F.filter(F.coalesce("nodes", F.array().cast(stored.schema["nodes"].dataType)), lambda n: ~F.coalesce(n["is_removed"], F.lit(False)))
    total = lambda part: F.aggregate(alive, F.lit(0).cast(number), lambda s, n: (s + part(n) * _instances(n["instances_on_page"])).cast(number))
    one = F.lit(1).cast(number)
    old = stored.select("page_id", total(lambda n: one).cast("long").alias("old_n"), F.array(*[total(lambda n, i=i: _hash_parts(n["sha_256_hash"])[i]) for i in (0, 1)]).alias("old_sums"))
    sums = nodes.groupBy("page_id").agg(F.count(F.lit(1)).alias("new_n"), *[F.sum(p).cast(number).alias(f"s{i}") for i, p in enumerate(_hash_parts(F.col("sha_256_hash")))])
    new = sums.select("page_id", "new_n", F.array("s0", "s1").alias("new_sums"))
    zeros = F.array(F.lit(0).cast(number), F.lit(0).cast(number))
    both = old.join(new, "page_id", "full").select("page_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("old_n", "new_n")], *[F.coalesce(c, zeros).alias(c) for c in ("old_sums", "new_sums")])
    differ = F.col("old_n") != F.col("new_n")
    return both.where(differ if strict_counts else differ | (F.col("old_sums") != F.col("new_sums"))).select("page_id", "old_n", "new_n")


def update_pages(stored: DataFrame, incoming: DataFrame, nodes: DataFrame, at: Column, strict_counts: bool = False) -> DataFrame:
    """Stored pages as they are after a run, for the pages that came in; page_id, nodes, totals and dates are rewritten.

    stored: page_id, nodes (array of structs), code_nodes_total, languages, keywords, date_last_updated, and what else is to
    be kept. incoming: page_id, keywords. nodes: page_id and the fields of a stored node, a row an instance.

    A page without nodes on both sides, or whose nodes are all unchanged, keeps them, and they are not looked at one by one
    (`changed_pages`). Else its nodes are the unchanged
    ones (with the instances counted now), the updated ones (the old node with new code, hash and date), new ones, the
    removed ones (marked, without instances), and all that had been removed before. Keywords are replaced if their number
    differs. strict_counts: pages of equal counts of nodes count as unchanged, whatever their texts.
    """
    fields = [f.name for f in stored.schema["nodes"].dataType.elementType]
    touched = kept(changed_pages(stored.join(incoming.select("page_id"), "page_id", "left_semi"), nodes, strict_counts).select("page_id"))
    old_all = live_nodes(stored.join(touched, "page_id", "left_semi")).select("page_id", "n.*")
    new_all = nodes.join(touched, "page_id", "left_semi")
    diff = kept(diff_nodes(old_all, new_all))
    one_each = lambda df, name: df.groupBy("page_id", F.col("sha_256_hash").alias(f"{name}_hash")).agg(F.min_by(F.struct(*fields), F.struct("date_added", "category", "language")).alias(name))
    joined = diff.join(one_each(old_all, "old"), ["page_id", "old_hash"], "left").join(one_each(new_all.select("page_id", *fields), "new"), ["page_id", "new_hash"], "left")
    count = F.col("new_count").cast("long")
    old, new = F.col("old"), F.col("new")
    node = (
        F.when(F.col("status") == "unchanged", old.withField("instances_on_page", count))
        .when(F.col("status") == "updated", old.withField("code", new["code"]).withField("sha_256_hash", new["sha_256_hash"]).withField("date_updated", at).withField("instances_on_page", count))
        .when(F.col("status") == "new", new.withField("date_added", at).withField("instances_on_page", count))
        .otherwise(old.withField("is_removed", F.lit(True)).withField("date_removed", at).withField("instances_on_page", F.lit(0).cast("long")))
    )
    made = joined.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("status", F.coalesce("old_hash", "new_hash").alias("h"), node.alias("n")))).alias("made"), F.sum("new_count").alias("total"), F.max((F.col("status") != "unchanged") | (F.col("old_count") != F.col("new_count"))).alias("changed"))  # a page's nodes
    made = made.where("changed").drop("changed")
    arriving = incoming.select("page_id", F.col("keywords").alias("new_keywords"))
    out = stored.join(arriving, "page_id", "left").join(made, "page_id", "left")
    gone = F.filter(F.coalesce("nodes", F.array().cast(stored.schema["nodes"].dataType)), lambda n: F.coalesce(n["is_removed"], F.lit(False)))
    new_words = F.col("new_keywords").isNotNull() & (F.size("new_keywords") > 0) & keywords_changed(F.col("keywords"), F.col("new_keywords"))
    is_made = F.col("made").isNotNull()
    cast = lambda c, name: c.cast(stored.schema[name].dataType)
    values = {
        "nodes": F.when(is_made, F.concat(F.transform("made", lambda m: m["n"]), gone)).otherwise(F.col("nodes")),
        "code_nodes_total": F.when(is_made, cast(F.col("total"), "code_nodes_total")).otherwise(F.col("code_nodes_total")),
        "keywords": F.when(new_words, F.col("new_keywords")).otherwise(F.col("keywords")),
        "date_last_updated": F.when(is_made | new_words, cast(at, "date_last_updated")).otherwise(F.col("date_last_updated")),
    }
    return out.withColumns(values).select(*stored.columns)


def move_pages(stored: DataFrame, moves: DataFrame, at: Column, site: Column) -> DataFrame:
    """Stored pages with the moved ones (old_id, new_id) under their new id, URL and date; the old ids are gone."""
    joined = stored.join(moves, stored["page_id"] == moves["old_id"], "left")
    moved = F.col("new_id").isNotNull()
    values = {"page_id": F.when(moved, F.col("new_id")).otherwise(F.col("page_id"))}
    if "page_url" in stored.columns:
        values["page_url"] = F.when(moved, key_url(F.col("new_id"), site)).otherwise(F.col("page_url"))
    if "date_last_updated" in stored.columns:
        values["date_last_updated"] = F.when(moved, at.cast(stored.schema["date_last_updated"].dataType)).otherwise(F.col("date_last_updated"))
    return joined.withColumns(values).select(*stored.columns)


def page_states(stored: DataFrame, incoming: DataFrame, moves: DataFrame) -> DataFrame:
    """classify_pages with the pages of moves (old_id, new_id) as moved, under their new id; their old ids are left out."""
    states = classify_pages(stored, incoming).join(moves.select(F.col("old_id").alias("page_id")), "page_id", "left_anti")
    to = moves.select(F.col("new_id").alias("page_id"), F.lit(True).alias("moved"))
    return states.join(to, "page_id", "left").select("page_id", F.when(F.col("moved"), "moved").otherwise(F.col("status")).alias("status"))


def existing_page_status(old_count: Column, new_count: Column, changed: Column | None = None) -> Column:
    """What becomes of a page that is there on both sides, by its node counts. changed: a real difference was found;
    without it, equal counts mean unchanged."""
    same = F.when(changed, "updated").otherwise("unchanged") if changed is not None else F.lit("unchanged")
    return F.when((old_count == 0) & (new_count == 0), "empty").when(old_count == 0, "all new").when(new_count == 0, "all removed").when(old_count == new_count, same).otherwise("updated")


def mark_removed(nodes: DataFrame, at: Column) -> DataFrame:
    """Nodes as removed at a time: no instances are left."""
    return nodes.withColumns({"is_removed": F.lit(True), "date_removed": at, "instances_on_page": F.lit(0).cast("long")})


def keywords_changed(old: Column, new: Column) -> Column:
    return F.coalesce(F.size(old), F.lit(0)) != F.coalesce(F.size(new), F.lit(0))


#: Messages of a change by its kind; {page}, {old}, {new} and {n} are filled in.
# The wording of the log.
MESSAGES = {
    "page created": "Page created: Page ID: {page}, {n} new code examples",
    "page removed": "Page removed: Page ID: {page}",
    "page updated": "Page updated: Page ID: {page}",
    "page moved": "Page moved: Old page ID: {old}, new page ID: {page}",
    "keywords updated": "Keywords updated: Page ID: {page}",
    "examples created": "Code example created: Page ID: {page}, {n} new code examples added",
    "examples updated": "Code example updated: Page ID: {page}, {n} code examples updated",
    "examples removed": "Code example removed: Page ID: {page}, {n} code examples removed",
    "usage added": "Applied usage example added: Page ID: {page}, {n} new applied usage examples added",
    "code count": "Code node count change: Page ID: {page}, was {old}, now {new}",
}


def change_messages(changes: DataFrame) -> DataFrame:
    """(project, message) of changes (project, kind, page_id, old, new, n); a kind that isn't known has its name and page."""
    message = F.concat_ws(": Page ID: ", "kind", "page_id")
    for kind, template in MESSAGES.items():
        values = {"page": F.col("page_id"), "old": F.col("old"), "new": F.col("new"), "n": F.col("n")}
        filled = F.lit(template)
        for name, value in values.items():
            filled = F.replace(filled, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
        message = F.when(F.col("kind") == kind, filled).otherwise(message)
    return changes.select("project", message.alias("message"))
