"""Quality rules by distribution divergence, in DataFrame functions only.

For every document: its counts of character classes and of common words, held by Jensen-Shannon distance against the
same histograms of each language. Both the references and what words are common (a language's TOP_WORDS most frequent
ones) are learned from all documents of the table itself. Languages with a hundredth of the rows or more, at most a
hundred, are held against every document. All others with MIN_REFERENCE_ROWS documents and MIN_REFERENCE_CHARS characters
have a reference too: it is joined to their own documents, and documents that nothing has accepted are held against each
of them. A document passes if some one language has both distances within the limits. Documents of a language with less
evidence than that can't be judged by distance: the base rule alone decides. Documents below the minimum lengths aren't
judged by the test in question.

A null or blank text has no words, fails the base rule and isn't kept. Rows are judged one by one, so repeated rows get
equal verdicts. A table without any language makes no reference; then only the base rule counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagequarry.llm.common import BLANK_RUN, let, numbered, stage, words_of

#: References up to this number, counted first, are broadcast for the join by language.
MAX_BROADCAST = 10_000

#: Common words of a language, and how many lists of words share the lookup table.
TOP_WORDS, BUCKETS = 60, 256
#: Character classes by pattern; what matches none counts as "other".
CLASSES = {"lower": "[a-z]", "upper": "[A-Z]", "digit": "[0-9]", "blank": r"[\x20\x09-\x0D]", "point": "[.,;:'()?-]", "symbol": r"[#*$%&|<>!\[\]{}=+_/\\^~@`\"]", "accented": r"[^\x00-\x7F]"}
MIN_WORDS, MIN_CHARS = 50, 200
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE = 0.24, 0.38
LEAST_SHARE = 0.01
#: Evidence that makes a reference of a language below LEAST_SHARE.
MIN_REFERENCE_ROWS, MIN_REFERENCE_CHARS = 10, 5_000
LN2 = 0.6931471805599453


def n_matching(text: Column, pattern: str) -> Column:
    """Code points of text that match a pattern of one character; cheapest for texts of few characters that do."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern + "+", ""))


def repeated_words(words: Column, n: int = 3) -> Column:
    """Number of words that lie in a window of n words found twice or more in the array, the first find included.

    Windows are told apart by 64-bit hashes. Only where some repeat are they sorted with their places, which brings equal
    ones together.
    """
    hashes = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(n)]))
    placed = lambda hs: F.array_sort(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    twice = lambda s: F.filter(s, lambda x, j: (F.get(s, j - 1)["h"].eqNullSafe(x["h"])) | (F.get(s, j + 1)["h"].eqNullSafe(x["h"])))
    places = lambda s: F.array_sort(F.transform(twice(s), lambda x: x["i"]))
    covered = lambda p: F.aggregate(p, F.struct(F.lit(0).alias("n"), F.lit(-n).alias("last")), lambda a, x: F.struct((a["n"] + F.least(F.lit(n), x - a["last"])).alias("n"), x.alias("last")))["n"]
    counted = lambda hs: F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0)).otherwise(let(let(placed(hs), places), covered))
    return F.when(F.size(words) < n, F.lit(0)).otherwise(let(hashes(words), counted))


def common_words(docs: DataFrame, top: int = TOP_WORDS) -> DataFrame:
    """lang, word, n and id of the most frequent words of every language; a word has the same id in all languages."""
    counts = docs.where(F.col("lang").isNotNull()).select("lang", F.explode(words_of(F.col("text"))).alias("word")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    # Spark keeps the first rows of each language on the map side already.
    best = counts.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).where(F.col("nth") <= top).drop("nth")
    best = stage(best, "quality-words")
    ids = numbered(best.select("word").distinct(), ["word"], "id").select("word", F.col("id").cast("int").alias("id"))
    return stage(best.join(ids, "word"), "quality-word-ids")


def lookup(words: DataFrame) -> Column | None:
    """Array of BUCKETS arrays of (w, id): where the common words' ids are found by hash."""
    listed: list[list[Column]] = [[] for _ in range(BUCKETS)]
    for r in words.select("word", "id", F.pmod(F.xxhash64("word"), F.lit(BUCKETS)).alias("at")).distinct().orderBy("id").collect():  # TOP_WORDS rows a language at most
        listed[r["at"]].append(F.struct(F.lit(r["word"]).alias("w"), F.lit(r["id"]).alias("id")))
    none = F.array().cast("array<struct<w:string,id:int>>")
    return F.array(*[F.array(*x) if x else none for x in listed]) if any(listed) else None


def base_measures(docs: DataFrame, words: DataFrame) -> DataFrame:
    """doc_id, lang, and the measures of the base rules and histograms of every text. words: from common_words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != "")
    table, listed = lookup(words), [r["word"] for r in words.select("word").distinct().collect()]
    common = lambda w: F.filter(w, lambda x: x.isin(listed))
    id_of = lambda x: F.get(F.filter(F.get(table, F.pmod(F.xxhash64(x), F.lit(BUCKETS)).cast("int")), lambda e: e["w"] == x), F.lit(0))["id"]
    hist = lambda f: F.transform(F.array_distinct(f), lambda x: F.struct(id_of(x).alias("id"), (F.size(f) - F.size(F.array_remove(f, x))).alias("n")))
    # Small letters and blanks are most of a text; the other classes are counted in what is left without them.
    whole = docs.select("doc_id", "lang", text.alias("text"), F.regexp_replace(text, r"[a-z\x20\x09-\x0D]+", "").alias("rest"))
    few = {c: p for c, p in CLASSES.items() if c not in ("lower", "blank")}
    split = whole.select(
        "doc_id", "lang", words_of(F.col("text")).alias("words"), F.length("text").alias("n_chars"), F.length("rest").alias("n_rest"),
        F.length(F.regexp_replace("text", BLANK_RUN, "")).alias("word_chars"),
        n_matching(F.col("rest"), "[#*$%&|<>]").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"),
        *[n_matching(F.col("rest"), p).alias(f"c_{c}") for c, p in few.items()],
    )
    split = split.withColumn("c_blank", F.col("n_chars") - F.col("word_chars")).withColumn("c_lower", F.col("word_chars") - F.col("n_rest"))
    return split.select(
        "doc_id", "lang", "n_chars", F.size("words").cast("long").alias("n_words"), F.col("word_chars").cast("long").alias("word_chars"), F.col("n_symbols").cast("long").alias("n_symbols"), F.col("n_dup_lines").cast("long").alias("n_dup_lines"),
        let(F.col("words"), lambda w: repeated_words(w)).cast("long").alias("n_repeat_words"),
        (F.array().cast("array<struct<id:int,n:int>>") if table is None else let(let(F.col("words"), common), hist)).alias("hist"),
        F.array(*[F.col(f"c_{c}") for c in CLASSES], F.greatest(F.lit(0), F.col("n_chars") - sum(F.col(f"c_{c}") for c in CLASSES))).alias("classes"),
    )


def reference_table(measured: DataFrame, words: DataFrame) -> DataFrame:
    """lang, rows, chars, the shares of each class, and those of the language's common words by id, of every language with words."""
    known = measured.where(F.col("lang").isNotNull())
    sums = known.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"), F.sum("n_chars").alias("chars"), F.sum("n_words").alias("n_words"), *[F.sum(F.get("classes", F.lit(i))).alias(f"c{i}") for i in range(len(CLASSES) + 1)])
    counts = words.groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct("id", "n"))).alias("of"))  # TOP_WORDS entries at most
    shares = F.transform_values("of", lambda _, n: n / F.col("n_words"))
    return sums.where((F.col("chars") > 0) & (F.col("n_words") > 0)).join(counts, "lang").select("lang", "rows", "chars", F.array(*[F.col(f"c{i}") / F.col("chars") for i in range(len(CLASSES) + 1)]).alias("classes"), shares.alias("words"))


def references(measured: DataFrame, table: DataFrame) -> list[dict]:
    """Shares of each class and each common word by language, from its table; at most 1/LEAST_SHARE languages."""
    return [r.asDict() for r in table.where(F.col("rows") >= (measured.count() or 1) * LEAST_SHARE).orderBy("lang").collect()]


def _term(p: Column, q: Column) -> Column:
    """What one bin adds to twice the divergence, where p is above 0."""
    m = (p + q) / 2
    return p * F.log(p / m) + F.when(q > 0, q * F.log(F.greatest(q, F.lit(1e-300)) / m)).otherwise(0.0)


def js_distance_words(hist: Column, n_words: Column, shares: dict[int, float] | Column) -> Column:
    """Square root of the divergence (base 2) over a language's common words and all others together.

    shares: by id of the word. Words that the document lacks add q ln 2; those common elsewhere only are among the others.
    """
    if isinstance(shares, Column):
        ref, total = shares, F.aggregate(F.map_values(shares), F.lit(0.0), lambda a, x: a + x)
    else:
        ref, total = F.create_map(*[F.lit(x) for pair in sorted(shares.items()) for x in pair]), F.lit(sum(shares.values()))
    n = F.greatest(n_words, F.lit(1)).cast("double")
    start = F.struct(F.lit(0.0).alias("d"), F.lit(0.0).alias("p"), F.lit(0.0).alias("q"))

    def step(a, e):
        add = lambda q: F.struct((a["d"] + F.coalesce(_term(e["n"] / n, q), F.lit(0.0))).alias("d"), (a["p"] + F.when(q.isNotNull(), e["n"] / n).otherwise(0.0)).alias("p"), (a["q"] + F.coalesce(q, F.lit(0.0))).alias("q"))
        return let(F.try_element_at(ref, e["id"]), add)

    rest = F.greatest(F.lit(0.0), 1 - total)
    other = lambda p: F.when(p < 1, _term(F.greatest(1 - p, F.lit(1e-12)), rest)).otherwise(rest * LN2)
    return let(F.aggregate(hist, start, step), lambda a: F.sqrt(F.greatest(F.lit(0.0), (a["d"] + other(a["p"]) + F.greatest(F.lit(0.0), total - a["q"]) * LN2) / (2 * LN2))))


def js_distance_classes(classes: Column, n_chars: Column, shares: list[float] | Column) -> Column:
    n = F.greatest(n_chars, F.lit(1)).cast("double")
    refs = [F.get(shares, F.lit(i)) for i in range(len(CLASSES) + 1)] if isinstance(shares, Column) else [F.lit(float(q)) for q in shares]
    bins = [F.when(F.get(classes, F.lit(i)) > 0, _term(F.greatest(F.get(classes, F.lit(i)) / n, F.lit(1e-12)), q)).otherwise(q * LN2) for i, q in enumerate(refs)]
    return F.sqrt(F.greatest(F.lit(0.0), sum(bins) / (2 * LN2)))


def judge(docs: DataFrame, max_class_distance: float = MAX_CLASS_DISTANCE, max_word_distance: float = MAX_WORD_DISTANCE, min_words: int = MIN_WORDS, min_chars: int = MIN_CHARS) -> DataFrame:
    """The measures of every row of docs, distances to the nearest language, and whether the row is kept."""
    words = common_words(docs)
    measured = stage(base_measures(docs, words), "quality-measures")
    table = stage(reference_table(measured, words), "quality-references")
    refs = references(measured, table)
    frequent = [r["lang"] for r in refs]
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = measured.withColumn("base_failed", failed)
    accepts = lambda near: ((F.col("n_words") < min_words) | (near["w"] <= max_word_distance)) & ((F.col("n_chars") < min_chars) | (near["c"] <= max_class_distance))
    # Distances to a reference, whether it refuses the text, and the greater of both distances as parts of their limits. One
    # reference that accepts is enough, so the nearest is the nearest of those that do, if any does.
    measure = lambda w, c, lang: let(F.struct(js_distance_words(F.col("hist"), F.col("n_words"), w).alias("w"), js_distance_classes(F.col("classes"), F.col("n_chars"), c).alias("c")), lambda x: F.struct((~accepts(x)).alias("refused"), F.greatest(x["w"] / max_word_distance, x["c"] / max_class_distance).alias("far"), x["w"].alias("w"), x["c"].alias("c"), lang.alias("lang")))
    nearest = F.array_min(F.array(*[measure(r["words"], r["classes"], F.lit(r["lang"])) for r in refs])) if refs else F.lit(None).cast("struct<refused:boolean,far:double,w:double,c:double,lang:string>")
    out = out.withColumn("near", nearest)
    rare = table.where(~F.col("lang").isin(frequent) & (F.col("rows") >= MIN_REFERENCE_ROWS) & (F.col("chars") >= MIN_REFERENCE_CHARS)).select("lang", F.col("words").alias("rw"), F.col("classes").alias("rc"))
    n_rare = rare.count()
    known = F.col("lang").isNull() | F.col("lang").isin(frequent)
    if n_rare:
        # Their own documents first; each of these languages has few of the rows, so the join has no hot key.
        own = out.where(~known).join(F.broadcast(rare) if n_rare <= MAX_BROADCAST else rare, "lang", "left")
        own = own.withColumn("near", F.when(F.col("rw").isNotNull(), F.array_min(F.array_compact(F.array("near", measure(F.col("rw"), F.col("rc"), F.col("lang")))))).otherwise(F.col("near"))).withColumn("judged", F.col("rw").isNotNull()).select(*out.columns, "judged")
        out = out.where(known).withColumn("judged", F.lit(True)).unionByName(own)
        # Then what nothing has accepted: all references as one value, of a row a language.
        out = out.withColumn("rare", rare.agg(F.collect_list(F.struct("lang", "rw", "rc"))).scalar())
        every = F.array_min(F.array_append(F.transform("rare", lambda r: measure(r["rw"], r["rc"], r["lang"])), F.col("near")))
        out = out.withColumn("near", F.when(F.col("judged") & ~F.col("base_failed") & ~F.coalesce(accepts(F.col("near")), F.lit(False)), every).otherwise(F.col("near")))
    else:
        out = out.withColumn("judged", known)
    verdict = F.coalesce(~F.col("judged") | accepts(F.col("near")), F.lit(True))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & verdict).alias("kept"), F.col("near.w").alias("word_distance"), F.col("near.c").alias("class_distance"), F.col("near.lang").alias("nearest_lang"))
