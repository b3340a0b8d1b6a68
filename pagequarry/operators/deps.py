"""Dependency manifests: discovery in a listing, parsing of several formats, and the kind of each update."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.functions.scalars import update_type

# Manifest names by type, and directories that are never looked into.
MANIFESTS = {"package.json": "npm", "pom.xml": "maven", "requirements.txt": "pip", "go.mod": "go"}
PRUNED = ["node_modules", ".git", "vendor", "target", "dist", "build"]


def manifests(files: DataFrame, ignore: list[str] = ()) -> DataFrame:
    """(path, type, dir, filename) of manifest files outside pruned directories. files: path."""
    parts = F.split("path", "/")
    name = F.element_at(parts, -1)
    kind = F.when(name.endswith(".csproj"), "nuget")
    for file, k in MANIFESTS.items():
        kind = kind.when(name == file, k)
    pruned = F.arrays_overlap(F.slice(parts, 1, F.size(parts) - 1), F.array(*[F.lit(d) for d in [*PRUNED, *ignore]]))
    found = files.where(~F.coalesce(pruned, F.lit(False))).select("path", kind.alias("type"), F.when(F.size(parts) > 1, F.regexp_replace("path", "/[^/]*$", "")).otherwise(".").alias("dir"), name.alias("filename"))
    return found.where(F.col("type").isNotNull())


def npm_dependencies(files: DataFrame) -> DataFrame:
    """(path, name, version, is_dev) of package.json contents."""
    parsed = files.select("path", F.from_json("content", "dependencies map<string,string>, devDependencies map<string,string>").alias("j"))
    both = F.array(F.struct(F.col("j.dependencies").alias("m"), F.lit(False).alias("is_dev")), F.struct(F.col("j.devDependencies").alias("m"), F.lit(True).alias("is_dev")))
    rows = parsed.select("path", F.explode(both).alias("g")).select("path", "g.is_dev", F.explode("g.m").alias("name", "version"))
    return rows.select("path", "name", F.regexp_replace("version", r"^[\^~>=<\s]+", "").alias("version"), "is_dev")


def _lines(files: DataFrame) -> DataFrame:
    return files.select("path", F.posexplode(F.split("content", "\r?\n")).alias("line_no", "line"))


def pip_requirements(files: DataFrame) -> DataFrame:
    """(path, name, version) of requirements lines; comments, options and blank lines are passed over."""
    pattern = r"^\s*([A-Za-z0-9][A-Za-z0-9._-]*)(?:\[[^\]]*\])?\s*(?:[=<>!~]=?=?\s*([^\s,;#]+))?"
    rows = _lines(files).where(F.rlike("line", F.lit(r"^\s*[A-Za-z0-9]")))
    return rows.select("path", F.regexp_extract("line", pattern, 1).alias("name"), F.nullif(F.regexp_extract("line", pattern, 2), F.lit("")).alias("version"))


def go_requirements(files: DataFrame) -> DataFrame:
    """(path, name, version, is_direct) of go.mod require lines."""
    pattern = r"^\s*(?:require\s+)?([\w.\-/~]+\.[\w.\-/~]+)\s+(v[\w.\-+]+)"
    rows = _lines(files).where(F.rlike("line", F.lit(pattern)))
    return rows.select("path", F.regexp_extract("line", pattern, 1).alias("name"), F.regexp_extract("line", pattern, 2).alias("version"), (~F.col("line").contains("// indirect")).alias("is_direct"))


def maven_dependencies(files: DataFrame) -> DataFrame:
    """(path, name, version) of <dependency> elements, name as group:artifact."""
    blocks = files.select("path", F.explode(F.regexp_extract_all("content", F.lit(r"(?s)<dependency>(.*?)</dependency>"), F.lit(1))).alias("b"))
    tag = lambda t: F.regexp_extract("b", rf"<{t}>\s*([^<]*?)\s*</{t}>", 1)
    return blocks.select("path", F.concat_ws(":", tag("groupId"), tag("artifactId")).alias("name"), F.nullif(tag("version"), F.lit("")).alias("version"))


def nuget_references(files: DataFrame) -> DataFrame:
    rows = files.select("path", F.explode(F.regexp_extract_all("content", F.lit(r"<PackageReference[^>]*>"), F.lit(0))).alias("b"))
    return rows.select("path", F.regexp_extract("b", r'Include="([^"]*)"', 1).alias("name"), F.nullif(F.regexp_extract("b", r'Version="([^"]*)"', 1), F.lit("")).alias("version"))


# Lines of two package managers' lists of newer versions: name, version in use, latest version.
LISTED = {"go": r"^(\S+)\s+(v\S+)\s+\[(v[^\]]+)\]", "dotnet": r"^\s*>\s+(\S+)\s+\S+\s+(\S+)\s+(\S+)"}


def listed_updates(outputs: DataFrame, tool: str, direct_only: DataFrame | None = None) -> DataFrame:
    """(path, name, current, latest, update_type) of the lines of a tool's list of newer versions. outputs: path, content.

    direct_only: (path, name) to keep, as go_requirements gives them.
    """
    pattern = LISTED[tool]
    part = lambda i: F.regexp_extract("line", pattern, i)
    rows = _lines(outputs).where(F.rlike("line", F.lit(pattern))).select("path", part(1).alias("name"), part(2).alias("current"), part(3).alias("latest"))
    if direct_only is not None:
        rows = rows.join(direct_only.select("path", "name").distinct(), ["path", "name"], "left_semi")
    bare = lambda c: F.regexp_replace(c, "^v", "")
    return rows.withColumn("update_type", update_type(bare("current"), bare("latest")))


def updates(current: DataFrame, latest: DataFrame, direct_only: DataFrame | None = None) -> DataFrame:
    """(name, current, latest, update_type) of dependencies that another version is known for.

    direct_only: names to keep, compared exactly.
    """
    rows = current.join(latest, "name").where(F.col("current") != F.col("latest"))
    if direct_only is not None:
        rows = rows.join(direct_only.select("name").distinct(), "name", "left_semi")
    return rows.select("name", "current", "latest", update_type(F.col("current"), F.col("latest")).alias("update_type"))
