"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

A text becomes a template: numbers, units and names turn into typed placeholders, signs go, the rest is lower-cased. The
windows of WINDOW template words of the benchmark are hash-joined with those of all documents. A document and an item
match where at least MIN_COVERAGE of the item's windows are found at about one shift between item and document (SLACK
words either way, so that small insertions don't break a match), and where the values behind the placeholders are
consistent. Only places within matched windows count, each at the shift that agrees best around it. Values that stand
there once can't tell; of the places of repeated ones, half or more must hold the item's own value or the same new value
as another place of it, unless SAME_SHARE of all places hold the item's own. So a re-parameterised question and an edited
copy are found, and text that only shares the shape is not.

Every word in title case counts as a name, wherever it stands: in a sentence's beginning and in quotes too. A window of
nothing but placeholders is told by their values, since its template says nothing; so number tables aren't all alike. The
values of other windows are only looked at in documents that passed the count, in a second look at those texts.

Items of fewer than WINDOW template words have one window of their own length, which counts only with the item's own
values; items of fewer than MIN_WORDS words are no evidence and match nothing, as do null or blank texts. Documents are
told apart by doc_id and text (as its hash), so a repeated id mixes no texts and rows without an id are judged too; rows
equal in both give one row for each item. Repeated items count as items of their own. Empty tables give no rows.

The benchmark's windows are broadcast only after they have been counted against MAX_BROADCAST; beyond that the join
shuffles. The same holds for the ids of the second look. Hits are folded by place in the item before anything is
gathered, so a group never holds more places than the item has, whatever the document repeats.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.common import let, stage

WINDOW, MIN_WORDS, MIN_COVERAGE, SLACK = 5, 3, 0.5, 8
SAME_SHARE = 0.75
MAX_BROADCAST = 500_000
# Unit words that a number may stand before.
UNITS = [
    "km", "cm", "mm", "kg", "mg", "lbs", "lb", "oz", "ml", "meters", "meter", "metres", "metre", "miles", "mile", "feet", "foot", "inches", "inch", "yards", "yard",
    "grams", "gram", "pounds", "pound", "liters", "liter", "litres", "litre", "seconds", "second", "minutes", "minute", "hours", "hour", "days", "day", "weeks", "week",
    "months", "month", "years", "year", "dollars", "dollar", "euros", "euro", "cents", "cent", "percent", "degrees", "degree",
]
#: Marks that stand for a name, a number and a unit; texts don't hold these control characters.
NAME, NUMBER, UNIT = "\x01", "\x02", "\x03"


def template_words(text: Column) -> Column:
    """Array of the template's words; each placeholder is followed by what it stands for, in the same place."""
    t = F.coalesce(text, F.lit(""))
    # Each pattern begins with a rare character class, so that most positions are passed over at once.
    t = F.regexp_replace(t, r"\p{Lu}(?<![\p{L}\p{N}].)\p{Ll}[\p{L}\p{N}]*", NAME + "$0")
    n = F.regexp_replace(t, rf"(\p{{N}}(?:[.,:/]?\p{{N}})*)(?:\x20?((?i:{'|'.join(UNITS)}))\b)?", f"{NUMBER}$1 {UNIT}$2")
    n = F.regexp_replace(n, rf"\x20{UNIT}(?!\p{{L}})", "")
    t = F.lower(F.when(F.rlike(t, F.lit(r"\p{N}")), n).otherwise(t))
    # The signs between a number's digits stay.
    return F.filter(F.split(t, r"(?:[^\p{L}\p{N}\x01-\x03](?!(?<=\p{N}.)\p{N}))+"), lambda w: w != "")


def valued(word: Column) -> Column:
    return word < "\x04"


def marks(words: Column) -> Column:
    """The template alone: placeholders without their values."""
    return F.transform(words, lambda w: F.when(valued(w), F.substring(w, 1, 1)).otherwise(w))


def window_hashes(words: Column, n: int = WINDOW) -> Column:
    """Array of the hashes of the templates of all runs of n words, in order; of the words with values where all are placeholders."""
    none = F.array().cast("array<bigint>")
    run = lambda xs, i: F.xxhash64(*[F.get(xs, i + j) for j in range(n)])
    # Of letters and digits, none sorts before the placeholders' marks.
    bare = lambda ws, i: valued(F.greatest(*[F.get(ws, i + j) for j in range(n)]))
    each = lambda x: F.transform(F.sequence(F.lit(0), F.size(x["w"]) - n), lambda i: F.when(bare(x["w"], i), run(x["w"], i)).otherwise(run(x["m"], i)))
    return let(words, lambda w: F.when(F.size(w) < n, none).otherwise(let(F.struct(w.alias("w"), marks(w).alias("m")), each)))


def _cells(shift: Column) -> Column:
    return F.array(F.floor(shift / (2 * SLACK)) * 2, F.floor((shift + SLACK) / (2 * SLACK)) * 2 + 1)


def _key(docs: DataFrame) -> list[Column]:
    return [docs["doc_id"], F.xxhash64(docs["text"]).alias("text_hash")]


def _hits(docs: DataFrame, items: DataFrame, window: int, few: bool) -> DataFrame:
    found = docs.select(*_key(docs), F.posexplode(window_hashes(template_words(F.col("text")), window)).alias("i", "h"))
    hits = found.join(F.broadcast(items) if few else items, "h")
    # Cells of the shift overlap by half, so a match that wanders by SLACK words lies in one of two neighbours whole.
    cell = F.explode(_cells(F.col("i") - F.col("at")))
    return hits.select("doc_id", "text_hash", "item_id", "n_windows", "at", cell.alias("cell")).distinct()


def _short(docs: DataFrame, benchmark: DataFrame, window: int) -> DataFrame | None:
    """(doc_id, text_hash, item_id) where a document holds an item of MIN_WORDS to window - 1 words as it stands."""
    lengths = [n for n in range(MIN_WORDS, window)]
    at = lambda ws, i, n: F.xxhash64(*[F.get(ws, i + j) for j in range(n)])
    words = benchmark.select("item_id", template_words(F.col("text")).alias("w")).where(F.size("w").between(MIN_WORDS, window - 1))
    whole = F.coalesce(*[F.when(F.size("w") == n, at(F.col("w"), F.lit(0), n)) for n in lengths])
    items = stage(words.select("item_id", whole.alias("h"), F.size("w").alias("size")), "bench-short")
    used = [r["size"] for r in items.select("size").distinct().collect()]  # window - MIN_WORDS rows at most
    if not used:
        return None
    runs = lambda w: F.array_distinct(F.concat(*[F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: at(w, i, n))).otherwise(F.array().cast("array<bigint>")) for n in used]))  # noqa: E731, B023
    found = docs.select(*_key(docs), F.explode(let(template_words(F.col("text")), runs)).alias("h"))
    return found.join(F.broadcast(items) if items.count() <= MAX_BROADCAST else items, "h").select("doc_id", "text_hash", "item_id").distinct()


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """(doc_id, text_hash, item_id, matched, n_windows, coverage, reparameterised) for every contaminated document and item."""
    hashed = benchmark.select("item_id", window_hashes(template_words(F.col("text")), window).alias("hs"))
    items = stage(hashed.select("item_id", F.size("hs").alias("n_windows"), F.posexplode("hs").alias("at", "h")), "bench-windows")
    few = items.count() <= MAX_BROADCAST
    enough = F.col("matched") >= F.ceil(F.col("n_windows") * F.lit(min_coverage))
    key = ["doc_id", "text_hash", "item_id"]
    cells = _hits(docs, items, window, few).groupBy(*key, "n_windows", "cell").agg(F.count(F.lit(1)).alias("matched")).where(enough)
    best = stage(cells.groupBy(*key, "n_windows").agg(F.max("matched").alias("matched")), "bench-counts")
    with_slots = benchmark.select("item_id", template_words(F.col("text")).alias("iw")).where(F.exists("iw", valued))
    ids = stage(best.join(with_slots, "item_id").select(F.col("doc_id").alias("d"), F.col("text_hash").alias("t"), "item_id", "iw"), "bench-pairs")
    small = ids.count() <= MAX_BROADCAST // 10
    same = docs["doc_id"].eqNullSafe(F.col("d")) & (F.xxhash64(docs["text"]) == F.col("t"))
    texts = docs.select("doc_id", "text").join(F.broadcast(ids) if small else ids, same).select("d", "t", "item_id", "iw", template_words(F.col("text")).alias("dw"))
    judged = texts.select("d", "t", "item_id", let(F.struct("iw", "dw"), lambda x: _slots(x["iw"], x["dw"], window, min_coverage)).alias("s")).groupBy("d", "t", F.col("item_id").alias("judged_item")).agg(F.max("s.consistent").alias("consistent"), F.min("s.changed").alias("changed"))
    on = best["doc_id"].eqNullSafe(judged["d"]) & (best["text_hash"] == judged["t"]) & best["item_id"].eqNullSafe(judged["judged_item"])
    long = best.join(judged, on, "left").where(F.coalesce("consistent", F.lit(True))).select(*key, "matched", "n_windows", F.coalesce("changed", F.lit(False)).alias("reparameterised"))
    short = _short(docs, benchmark, window)
    if short is not None:
        long = long.unionByName(short.withColumns({"matched": F.lit(1).cast("long"), "n_windows": F.lit(1), "reparameterised": F.lit(False)}))
    return long.select(*key, "matched", F.col("n_windows").cast("long").alias("n_windows"), (F.col("matched") / F.col("n_windows")).alias("coverage"), "reparameterised")


def _slots(item: Column, doc: Column, window: int, min_coverage: float) -> Column:
    """Struct of whether the item's placeholder values are consistent with the document's in some cell, and whether they changed.

    A cell of shifts is tried if it holds enough of the item's windows. The placeholders of both that face each other
    within matched windows are compared, each place of the item at the shift with the most equal values around it.
    """
    count = lambda xs, f: F.size(F.filter(xs, f))

    def facing(near: Column) -> Column:
        words = F.flatten(F.transform(near, lambda x: F.transform(F.sequence(F.lit(0), F.lit(window - 1)), lambda o: F.struct((x["j"] + o).alias("p"), x["s"].alias("s"), F.get(item, x["j"] + o).alias("a"), F.get(doc, x["j"] + o + x["s"]).alias("b")))))
        return F.array_distinct(F.filter(words, lambda x: valued(x["a"])))

    def chosen(faced: Column) -> Column:
        equal = lambda x: -count(faced, lambda y: (y["s"] == x["s"]) & (F.abs(y["p"] - x["p"]) < window) & (y["a"] == y["b"]))
        ranked = F.array_sort(F.transform(faced, lambda x: F.struct(x["p"].alias("p"), equal(x).alias("equal"), (-count(faced, lambda y: y["s"] == x["s"])).alias("n"), x["a"].alias("a"), x["b"].alias("b"))))
        return let(ranked, lambda r: F.filter(r, lambda x, k: ~F.get(r, k - 1)["p"].eqNullSafe(x["p"])))

    def verdict(places: Column) -> Column:
        again = F.filter(places, lambda x: count(places, lambda y: y["a"] == x["a"]) > 1)
        held = lambda x: (x["a"] == x["b"]) | (count(places, lambda y: (y["a"] == x["a"]) & (y["b"] == x["b"])) > 1)
        same = count(places, lambda x: x["a"] == x["b"])
        return F.struct(((2 * count(again, held) >= F.size(again)) | (same >= SAME_SHARE * F.size(places))).alias("consistent"), (same < F.size(places)).alias("changed"))

    def judged(hs: Column) -> Column:
        found = F.flatten(F.transform(hs["d"], lambda h, i: F.filter(F.transform(hs["i"], lambda g, j: F.when(g == h, F.struct(j.alias("j"), (i - j).alias("s")))), lambda x: x.isNotNull())))
        enough = lambda near: F.size(F.array_distinct(F.transform(near, lambda x: x["j"]))) >= F.ceil(F.size(hs["i"]) * F.lit(min_coverage))
        groups = lambda pairs: F.transform(F.array_distinct(F.flatten(F.transform(pairs, lambda x: _cells(x["s"])))), lambda c: F.filter(pairs, lambda x: F.array_contains(_cells(x["s"]), c)))
        results = F.transform(F.filter(let(found, groups), enough), lambda near: let(let(facing(near), chosen), verdict))
        return let(F.filter(results, lambda r: r["consistent"]), lambda good: F.struct((F.size(good) > 0).alias("consistent"), (~F.exists(good, lambda r: ~r["changed"])).alias("changed")))

    # Only the document's windows that the item has are compared with its places.
    hashes = let(F.struct(window_hashes(item, window).alias("i"), window_hashes(doc, window).alias("d")), lambda x: F.struct(x["i"].alias("i"), F.transform(x["d"], lambda h: F.when(F.array_contains(x["i"], h), h)).alias("d")))
    return let(hashes, judged)
