"""From incoming trees to stored pages: code nodes, page assembly, language arrays, run counters, moves read from logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.functions import directives, rst
from pagequarry.functions import scalars as S
from pagequarry.functions import vocabulary as V
from pagequarry.operators.catalog import instances
from pagequarry.operators.cdc import matched_by_word
from pagequarry.operators.includes import resolve_includes


def code_nodes(pages: DataFrame, words: V.RuleWords = V.RuleWords()) -> DataFrame:
    """Code nodes of pages (page_id, ast): trimmed code, hash, language, extension, category, whether a model must decide."""
    raw = rst.code_node_table(pages.select(F.col("page_id").alias("path"), F.col("ast").alias("content")))
    language = S.catalogue_language(F.col("language"))
    code = S.trim_space(F.col("code"))
    rows = raw.select(F.col("path").alias("page_id"), code.alias("code"), language.alias("language"), F.col("category").alias("author"))
    decided = S.assigned_category(F.col("code"), F.col("language"), F.col("author"), None, words)
    return rows.select("page_id", "code", "language", S.catalogue_extension(F.col("language")).alias("file_extension"), S.code_hash(F.col("code")).alias("sha_256_hash"), decided.alias("d")).select("page_id", "code", "language", "file_extension", "sha_256_hash", "d.category", F.col("d.by_model").alias("llm_categorized"))


def unique_with_counts(nodes: DataFrame) -> DataFrame:
    """One node for each hash of a page, with how often it stands there."""
    held = [c for c in nodes.columns if c not in ("page_id", "sha_256_hash")]
    grouped = nodes.groupBy("page_id", "sha_256_hash").agg(F.count(F.lit(1)).alias("instances_on_page"), F.max(F.struct(*held)).alias("n"))
    return grouped.select("page_id", "sha_256_hash", "instances_on_page", *[F.col(f"n.{c}").alias(c) for c in held])


def languages_array(nodes: DataFrame, languages: list[str] = V.LANGUAGES) -> DataFrame:
    """(page_id, languages): a single-entry map for each canonical language, in order, with totals by instances.

    nodes may carry `directive`; literalinclude and io-code-block are then counted apart as well. Partial sums are made
    on the map side, a column a language and kind; no array is gathered.
    """
    known = F.when(F.col("language").isin(languages), F.col("language")).otherwise("undefined")
    kind = F.col("directive") if "directive" in nodes.columns else F.lit("")
    rows = nodes.select("page_id", known.alias("l"), kind.alias("k"), instances().alias("n"))
    sums = rows.groupBy("page_id").agg(*[F.sum(F.when((F.col("l") == x) & test, F.col("n")).otherwise(0)).alias(f"{i}_{name}") for i, x in enumerate(languages) for name, test in (("all", F.lit(True)), ("inc", F.col("k") == "literalinclude"), ("io", F.col("k") == "io-code-block"))])
    entries = [F.create_map(F.lit(x), F.struct(F.col(f"{i}_inc").alias("literal_includes"), F.col(f"{i}_io").alias("io_code_block"), F.col(f"{i}_all").alias("total"))) for i, x in enumerate(languages)]
    return sums.select("page_id", F.array(*entries).alias("languages"))


def empty_languages(languages: list[str] = V.LANGUAGES) -> Column:
    """The language array of a page without code: every language with zeros."""
    zero = F.lit(0).cast("long")
    return F.array(*[F.create_map(F.lit(x), F.struct(zero.alias("literal_includes"), zero.alias("io_code_block"), zero.alias("total"))) for x in languages])


def new_pages(nodes: DataFrame, pages: DataFrame, at: Column) -> DataFrame:
    """Pages as they are stored first: unique nodes, language array, totals. pages: page_id and what else is to be kept."""
    unique = unique_with_counts(nodes)
    held = [c for c in unique.columns if c != "page_id"]
    grouped = unique.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("sha_256_hash", *[c for c in held if c != "sha_256_hash"]))).alias("nodes"), F.sum("instances_on_page").alias("code_nodes_total"))
    return pages.join(grouped, "page_id", "left").join(languages_array(unique), "page_id", "left").withColumns({"code_nodes_total": F.coalesce("code_nodes_total", F.lit(0)), "date_added": at})


def run_counters(changes: DataFrame) -> DataFrame:
    """Sums of `count` by project and kind of change, with the page counts a report lists."""
    return changes.groupBy("project", "kind").agg(F.sum(F.coalesce("count", F.lit(1))).alias("total"), F.countDistinct("page_id").alias("pages"))


def inconsistent_pages(pages: DataFrame) -> DataFrame:
    """Pages whose stored total isn't the sum of their nodes' instances."""
    total = F.aggregate("nodes", F.lit(0).cast("long"), lambda a, n: a + F.when(n["instances_on_page"] > 0, n["instances_on_page"]).otherwise(1))
    return pages.select("page_id", "code_nodes_total", F.coalesce(total, F.lit(0)).alias("counted")).where("code_nodes_total <> counted")


def log_moves(removed: DataFrame, created: DataFrame) -> DataFrame:
    """(project, old_id, new_id) of pages that a run's log shows as removed and created with equal counts of examples and a
    common part of their ids; one to one. Both: project, page_id, count."""
    parts = lambda df: df.select("project", "count", "page_id", F.explode(F.array_distinct(F.split("page_id", r"\|"))).alias("word"))
    return matched_by_word(parts(removed), parts(created), "page_id", ["project", "count"]).select("project", "old_id", "new_id")


def usage_without_moves(usage: DataFrame, moves: DataFrame) -> DataFrame:
    """Usage rows (project, page_id, ...) whose page isn't where another one moved to."""
    return usage.join(moves.select("project", F.col("new_id").alias("page_id")), ["project", "page_id"], "left_anti")


def extraction_report(examples: DataFrame) -> DataFrame:
    """Counts of extracted examples by language, by directive and by file, in one pass: (kind, key, count)."""
    keys = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("key")) for k, c in (("language", "language"), ("directive", "directive"), ("file", "path"))])
    return examples.select(F.explode(keys).alias("k")).groupBy("k.kind", "k.key").agg(F.count(F.lit(1)).alias("count"))


def procedure_totals(procedures: DataFrame) -> DataFrame:
    """Procedures and their variations by kind, and over all where the kind is null; those of one tab set or tutorial under
    one heading count as one procedure."""
    group = F.when(F.col("tab_group").isNull(), F.col("line")).otherwise(-F.col("tab_group"))
    logical = procedures.groupBy("path", "title", "kind", group.alias("at")).agg(F.sum(F.size("variations")).alias("n"))
    return logical.rollup("kind").agg(F.count(F.lit(1)).alias("procedures"), F.sum("n").alias("variations"))


def procedures_by_heading(procedures: DataFrame) -> DataFrame:
    """(path, title, procedures, steps, variations): what each heading of a file holds."""
    return procedures.groupBy("path", "title").agg(F.count(F.lit(1)).alias("procedures"), F.sum("steps").alias("steps"), F.sum(F.size("variations")).alias("variations"))


def procedures_of_selection(procedures: DataFrame, selection: str) -> DataFrame:
    return procedures.where(F.array_contains("variations", selection))


def distinct_procedures(procedures: DataFrame) -> DataFrame:
    """Procedures of equal content under one heading: where first, and all their variations in order."""
    rows = procedures.select("path", "title", "hash", "line", F.explode("variations").alias("v"))
    return rows.groupBy("path", "title", "hash").agg(F.min("line").alias("line"), F.array_sort(F.collect_set("v")).alias("variations"))


def example_files(examples: DataFrame, preserve_dirs: bool = False) -> DataFrame:
    """(path, content) of the file that each example is written to. examples: path, directive, index, sub, language, content."""
    name = S.output_name(F.col("path"), F.col("directive"), F.col("index"), F.col("sub"), F.col("language"))
    folder = F.regexp_extract("path", "^(.*/)?[^/]*$", 1)
    return examples.select(F.concat(folder, name).alias("path") if preserve_dirs else name.alias("path"), "content")


def procedure_files(texts: DataFrame) -> DataFrame:
    """(path, content) of the file that each variation of a procedure is written to: slug of title and variation, and the
    beginning of the content's hash. texts: from procedure_texts."""
    name = F.concat_ws("-", F.nullif(S.slug(F.col("title")), F.lit("")), F.nullif(S.slug(F.col("variation")), F.lit("")), F.substring("hash", 1, 6))
    return texts.select(F.concat(name, F.lit(".rst")).alias("path"), "content").distinct()


def included_examples(examples: DataFrame, files: DataFrame) -> DataFrame:
    """Examples with the part of a file that they include, where they include one; those whose file or tag is missing are
    left out. examples: from example_table; files: path, content."""
    own = examples.where(F.col("includes").isNull())
    edges = examples.where(F.col("includes").isNotNull()).withColumnsRenamed({"path": "source", "includes": "ref"})
    found = resolve_includes(edges, files).where(F.col("target").isNotNull()).join(files.select(F.col("path").alias("target"), F.col("content").alias("file")), "target")
    parts = found.withColumn("content", directives.included_part(F.col("file"), F.col("options"))).where(F.col("content").isNotNull())
    return own.unionByName(parts.withColumnsRenamed({"source": "path", "ref": "includes"}).select(*own.columns))
