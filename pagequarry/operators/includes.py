"""Includes of documentation sources: source folders, what a reference stands for, inline expansion, files that are followed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.functions import directives, rst
from pagequarry.functions.scalars import is_version
from pagequarry.operators.graph import closure
from pagequarry.operators.ranks import kept

#: Kinds of references that stand for parts of YAML files: those of `steps` by file name, the others by an entry `ref:`.
BY_NAME, BY_REF = "steps", ("extracts", "release")


def source_dir(path: Column) -> Column:
    """The nearest folder named source above a path; null if there is none."""
    return F.nullif(F.regexp_extract(path, r"^((?:.*/)?source)/", 1), F.lit(""))


def product_dir(path: Column) -> Column:
    """The product's folder: the one above source, without the version between them."""
    above = F.regexp_replace(source_dir(path), "/?source$", "")
    last = F.element_at(F.split(above, "/"), -1)
    return F.when(is_version(last), F.regexp_replace(above, "/?[^/]*$", "")).otherwise(above)


def versions_of(files: DataFrame) -> DataFrame:
    """(product, version) of all versions that a tree holds, null for a product without any. files: path."""
    found = files.select(product_dir(F.col("path")).alias("product"), F.regexp_replace(source_dir(F.col("path")), "/?source$", "").alias("above")).where(F.col("above").isNotNull()).distinct()
    last = F.element_at(F.split("above", "/"), -1)
    return found.select("product", F.when(is_version(last), last).alias("version"))


def version_paths(files: DataFrame, product: str, relative: str) -> DataFrame:
    """(version, path, found) of a file at relative below source in every version of a product."""
    wanted = versions_of(files).where(F.col("product") == product)
    path = F.concat_ws("/", "product", "version", F.lit("source"), F.lit(relative))
    return wanted.select("version", path.alias("path")).join(files.select("path").distinct().withColumn("found", F.lit(True)), "path", "left").select("version", "path", F.coalesce("found", F.lit(False)).alias("found"))


def yaml_refs(files: DataFrame) -> DataFrame:
    """(dir, kind, ref, path) of the entries `ref:` of files <dir>/<kind>-*.yaml. files: path, content."""
    pattern = rf"^(.*/)?({'|'.join(BY_REF)})-[^/]*\.yaml$"
    rows = files.where(F.rlike("path", F.lit(pattern))).select("path", F.regexp_extract("path", pattern, 1).alias("dir"), F.regexp_extract("path", pattern, 2).alias("kind"), F.explode(F.split("content", "\n")).alias("line"))
    ref = F.regexp_replace(F.trim(F.regexp_extract("line", r"^\s*ref:(.*)$", 1)), r"^[\"']+|[\"']+$", "")
    return rows.select("dir", "kind", ref.alias("ref"), "path").where("ref <> ''").distinct()


def resolve_includes(edges: DataFrame, files: DataFrame) -> DataFrame:
    """Edges (source, ref, ...) with the file that a reference stands for, null if there is none. files: path[, content].

    A reference {{name}} is replaced by what the source's own `replacement:` says first. A path with steps/ in it stands for
    the file steps-<name>.yaml, one with extracts/ or release/ for the YAML file of that kind that has the reference's name
    as an entry `ref:`; else it counts from the nearest source folder, then from the file's own one, each as it is and with
    .rst and .txt. The first that exists is taken.
    """
    refs = edges.select("source", "ref").distinct().withColumn("path", F.col("ref"))
    if "content" in files.columns:
        name = F.trim(F.regexp_extract("ref", r"^\{\{(.*)\}\}$", 1))
        values = directives.replacement_table(files.where(F.col("content").contains("replacement:")))
        named = refs.withColumn("name", name).join(values.select(F.col("path").alias("source"), "name", "value"), ["source", "name"], "left")
        refs = named.select("source", "ref", F.coalesce("value", "path").alias("path"))
    root = F.coalesce(F.concat(source_dir(F.col("source")), F.lit("/")), F.lit(""))
    folder = F.regexp_extract("source", "^(.*/)?[^/]*$", 1)
    bare = F.regexp_replace("path", "^/", "")
    plain = F.flatten(F.array(*[F.array(F.concat(b, bare), F.concat(b, bare, F.lit(".rst")), F.concat(b, bare, F.lit(".txt"))) for b in (root, folder)]))
    steps = F.concat(root, F.regexp_replace(bare, rf"{BY_NAME}/(.*?)(\.[^./]*)?$", rf"{BY_NAME}-$1.yaml"))
    tries = F.when(bare.contains(f"{BY_NAME}/"), F.concat(F.array(steps), plain)).otherwise(F.concat(F.array(F.lit(None).cast("string")), plain))
    tried = refs.select("source", "ref", F.posexplode(tries).alias("rank", "target")).where(F.col("target").isNotNull())
    hits = tried.join(files.select(F.col("path").alias("target")).distinct(), "target").select("source", "ref", "rank", "target")
    if "content" in files.columns:
        pattern = rf"^(.*?)({'|'.join(BY_REF)})/(.*?)(\.[^./]*)?$"
        by_ref = refs.where(F.rlike(bare, F.lit(pattern))).select("source", F.col("ref").alias("asked"), F.concat(root, F.regexp_extract(bare, pattern, 1)).alias("dir"), F.regexp_extract(bare, pattern, 2).alias("kind"), F.regexp_extract(bare, pattern, 3).alias("ref"))
        found = by_ref.join(yaml_refs(files), ["dir", "kind", "ref"]).groupBy("source", "asked").agg(F.min("path").alias("target"))
        hits = hits.unionByName(found.select("source", F.col("asked").alias("ref"), F.lit(-1).alias("rank"), "target"))
    best = hits.groupBy("source", "ref").agg(F.min_by("target", "rank").alias("target"))
    return edges.join(best, ["source", "ref"], "left")


def expand_includes(files: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """(path, content) of files, or of those of roots (path), with their include directives replaced by what they include.

    Included lines are indented like the directive. A directive stays if its file isn't there or is being included above
    it already. YAML step files come in as a procedure. Each round replaces all directives that the last one brought in;
    only lines with a directive go on, and what a file becomes is put together once, in the order of its lines.
    """
    steps = files.where(F.rlike("path", F.lit(rf"(^|/){BY_NAME}-[^/]*\.yaml$")))
    texts = kept(files.join(steps.select("path"), "path", "left_anti").select("path", "content").unionByName(rst.rendered_step_files(steps)))
    chosen = texts if roots is None else texts.join(roots.select("path").distinct(), "path", "left_semi")
    directive = r"^\s*\.\. include::\s*(\S.*?)\s*$"
    start = chosen.select("path", F.posexplode(F.split("content", "\n")).alias("i", "line"))
    lines = kept(start.select("path", F.array("i").alias("at"), "line", F.col("path").alias("source"), F.array("path").alias("trail"), F.regexp_extract("line", directive, 1).alias("ref")))
    done = lines.where("ref = ''").select("path", "at", "line")
    while True:
        open_ = lines.where("ref <> ''")
        if not open_.limit(1).count():
            break
        resolved = resolve_includes(open_.select("source", "ref").distinct(), files)
        found = open_.join(resolved, ["source", "ref"]).withColumn("cut", F.col("target").isNull() | F.array_contains("trail", F.col("target")))
        found = kept(found.join(texts.select(F.col("path").alias("target"), F.col("content").alias("included")), "target", "left"))
        done = done.unionByName(found.where(F.col("cut") | F.col("included").isNull()).select("path", "at", "line"))
        inner = found.where(~F.col("cut") & F.col("included").isNotNull())
        brought = inner.select("path", "at", F.regexp_extract("line", r"^(\s*)", 1).alias("indent"), "target", "trail", F.posexplode(F.split("included", "\n")).alias("i", "inner"))
        line = F.when(F.trim("inner") == "", "").otherwise(F.concat("indent", "inner"))
        lines = kept(brought.select("path", F.concat("at", F.array("i")).alias("at"), line.alias("line"), F.col("target").alias("source"), F.concat("trail", F.array("target")).alias("trail"), F.regexp_extract("inner", directive, 1).alias("ref")))
        done = done.unionByName(lines.where("ref = ''").select("path", "at", "line"))
    whole = done.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("at", "line"))).alias("lines"))  # the lines of one text
    return whole.select("path", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("content"))


def followed(files: DataFrame, roots: DataFrame) -> DataFrame:
    """Files (path, content) that roots (path) are or reach through include directives; each once."""
    edges = resolve_includes(directives.edge_table(files).where("directive = 'include'").select("source", "ref"), files)
    links = edges.where(F.col("target").isNotNull()).select("source", "target")
    reached = closure(links, roots.select(F.col("path").alias("node"))).select(F.col("node").alias("path")).distinct()
    return files.join(reached, "path", "left_semi")
