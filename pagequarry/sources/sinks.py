"""Sinks: reports as CSV, metrics and audit rows appended, files and usages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.operators.ranks import ranked


def numbered_feedback(rows: DataFrame) -> DataFrame:
    """entry_number, docs_property, url and comment in the order of property, url, comment and id."""
    out = ranked(rows.select("docs_property", "url", "comment", "id"), [], ["docs_property", "url", "comment", "id"])
    return out.select((F.col("rank") + 1).alias("entry_number"), "docs_property", "url", "comment")


def write_csv(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").option("header", True).csv(path)


def append(rows: DataFrame, path: str, *by: str) -> None:
    rows.write.mode("append").partitionBy(*by).parquet(path)


def audit_row(rows: DataFrame, at: Column) -> DataFrame:
    """Audit rows as they are appended: stamped, and an error never counts as a success."""
    return rows.withColumns({"ts": at, "success": F.when(F.col("event_type") == "error", False).otherwise(F.col("success"))})


def write_files(rows: DataFrame, root: str, dry_run: bool = False) -> DataFrame:
    """Write each row (path, content) to the file root/path, from the executors; returns (path, bytes) of all of them.

    root is any URI that pyarrow knows. Names are the rows' own, so a task that runs again writes the same files; two rows
    of one path are an error. dry_run writes nothing.
    """
    if rows.groupBy("path").count().where("count > 1").limit(1).count():
        raise ValueError("two rows of one path")

    def put(part) -> None:
        from pyarrow.fs import FileSystem

        fs, base = FileSystem.from_uri(root)
        for row in part:
            name = f"{base}/{row['path']}"
            fs.create_dir(name.rpartition("/")[0], recursive=True)
            with fs.open_output_stream(name) as out:
                out.write((row["content"] or "").encode())

    if not dry_run:
        rows.select("path", "content").foreachPartition(put)
    return rows.select("path", F.coalesce(F.octet_length("content"), F.lit(0)).alias("bytes"))


def usage_paths(found: DataFrame) -> DataFrame:
    """Paths of usages, each once."""
    return found.select(F.col("source").alias("value")).distinct()


def usage_lines(found: DataFrame) -> DataFrame:
    """Usages as lines for people: directive, file and line."""
    return found.select(F.format_string("[%s] %s:%d", "directive", "source", "line").alias("value"))


def usage_json(rows: DataFrame) -> DataFrame:
    """Rows as JSON text, one a row."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))
