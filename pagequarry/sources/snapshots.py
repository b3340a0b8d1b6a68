"""Versioned tables: each run's changes become visible at once, or not at all.

A store is a folder on any file system that Spark reads:

* `data/<unique>/<table>` holds one written table, or some parts of one, and never changes;
* `versions/v<number>.json` names the folders of every table of one version, with a label, the time, and marks (how far each
  stream has come);
* `labels/<label>.json` pins a version under a name, as a backup.

A publish first writes all changed tables into new folders, then a manifest under a temporary name, and commits by renaming it
to the next number; that rename is the only step that readers see. A writer that dies before it leaves the old version as it
was, and unreferenced folders that `collect_garbage` removes once they are older than `grace`. Two writers of one number: the
second one's rename finds the name taken and fails, so no change is lost. On stores whose rename isn't atomic or may overwrite
(object stores), publish from one writer at a time. Manifests are a few hundred bytes; data never passes the driver.
"""

from __future__ import annotations

import datetime
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Conflict(RuntimeError):
    """Another writer published meanwhile."""


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), spark._jsc.hadoopConfiguration())

    # --- files ---

    def _names(self, folder: str) -> list[str]:
        at = self._path(f"{self.root}/{folder}")
        return sorted(f.getPath().getName() for f in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _read(self, name: str) -> dict:
        stream = self._fs.open(self._path(f"{self.root}/{name}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _write(self, name: str, value: dict) -> None:
        stream = self._fs.create(self._path(f"{self.root}/{name}"), True)
        try:
            stream.write(bytearray(json.dumps(value, sort_keys=True).encode()))
        finally:
            stream.close()

    def _rename(self, old: str, new: str) -> bool:
        """Rename unless the new name is taken."""
        from py4j.protocol import Py4JJavaError

        option = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(option, 0)
        try:
            self._context.rename(self._path(f"{self.root}/{old}"), self._path(f"{self.root}/{new}"), options)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        return True

    def _remove(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.root}/{name}"), True)

    # --- versions ---

    def versions(self) -> list[int]:
        """Numbers of the versions that are there, ascending."""
        return sorted(int(n[1:-5]) for n in self._names("versions") if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | str | None = None) -> dict:
        """number, label, at and tables (name to folder) of a version: a number, a label, or the latest; {} for an empty store."""
        if isinstance(version, str):
            return self._read(f"labels/{version}.json")
        if version is None:
            there = self.versions()
            if not there:
                return {}
            version = there[-1]
        return self._read(f"versions/v{version:08d}.json")

    def read(self, table: str, version: int | str | None = None, parts: set[int] | None = None) -> DataFrame:
        """A table as it was in a version, or some of its parts. A frame once read stays good until its version is collected."""
        tables = self.manifest(version).get("tables", {})
        if table not in tables:
            raise KeyError(f"no table {table} in version {version}")
        entry = tables[table]
        schema = T.StructType.fromJson(entry["schema"])
        folders = [f for p, f in entry["folders"].items() if parts is None or int(p) in parts]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{f}" for f in folders])

    def has(self, table: str) -> bool:
        return table in self.manifest().get("tables", {})

    def publish(self, tables: dict[str, DataFrame], label: str | None = None, on: int | None = None, at: str | None = None, marks: dict[str, int] | None = None) -> int:
        """Write tables and commit them with the latest version's other tables as the next version; returns its number.

        on: the version that the changes were made of (0: an empty store); if another one has been published since, the
        write is refused with Conflict. Without it, the changes lie over whatever is latest.
        """
        written = {}
        for name, df in tables.items():
            folder = f"data/{uuid.uuid4().hex}/{name}"
            df.write.parquet(f"{self.root}/{folder}")
            written[name] = {"folders": {"0": folder}, "schema": json.loads(df.schema.json())}
        return self._commit(written, label, on, at, marks)

    def publish_parts(self, table: str, rows: DataFrame, part: str, touched: set[int], label: str | None = None, on: int | None = None, at: str | None = None, marks: dict[str, int] | None = None) -> int:
        """Like publish, for the parts `touched` of one table; the others stand. The column `part` says where each of the new
        rows belongs; it isn't stored. A touched part without rows goes."""
        folder = f"data/{uuid.uuid4().hex}/{table}"
        rows.withColumnRenamed(part, "__part").write.partitionBy("__part").parquet(f"{self.root}/{folder}")
        there = {int(n.removeprefix("__part=")) for n in self._names(folder) if n.startswith("__part=")}
        if not there <= touched:
            raise ValueError(f"rows of parts {sorted(there - touched)}, which aren't replaced")
        old = self.manifest().get("tables", {}).get(table, {"folders": {}})["folders"]
        folders = {p: f for p, f in old.items() if int(p) not in touched} | {str(p): f"{folder}/__part={p}" for p in sorted(there)}
        return self._commit({table: {"folders": folders, "schema": json.loads(rows.drop(part).schema.json())}}, label, on, at, marks)

    def _commit(self, written: dict, label: str | None, on: int | None, at: str | None, marks: dict[str, int] | None = None) -> int:
        latest = self.manifest()
        number = latest.get("number", 0)
        if on is not None and on != number:
            raise Conflict(f"version {number} is there, the changes are of {on}")
        value = {"number": number + 1, "label": label, "at": at or datetime.datetime.now(datetime.UTC).isoformat(), "tables": latest.get("tables", {}) | written, "marks": latest.get("marks", {}) | (marks or {})}
        temporary = f"versions/.{uuid.uuid4().hex}"
        self._write(temporary, value)
        if not self._rename(temporary, f"versions/v{number + 1:08d}.json"):
            self._remove(temporary)
            raise Conflict(f"version {number + 1} has been published meanwhile")
        return number + 1

    def label_of(self, label: str) -> int | None:
        """The version that was published under a label, if it is there."""
        for v in reversed(self.versions()):
            if self.manifest(v).get("label") == label:
                return v
        return None

    def copy_to(self, other: Store, version: int | str | None = None) -> int:
        """Publish all tables of a version in another store, with data of its own."""
        return other.publish({t: self.read(t, version) for t in self.manifest(version).get("tables", {})})

    # --- backups and clearing ---

    def backup(self, day: str, keep: int) -> list[str]:
        """Pin the latest version as backup_<day> and let the oldest backups beyond the latest `keep` go; returns those left.

        A backup is a name: versions never change, so nothing is copied. The new one is there before any old one goes.
        """
        self._write(f"labels/.{day}", self.manifest())
        self._remove(f"labels/backup_{day}.json")
        self._rename(f"labels/.{day}", f"labels/backup_{day}.json")
        there = self.backups()
        for name in there[: max(0, len(there) - keep)]:
            self._remove(f"labels/{name}.json")
        return self.backups()

    def backups(self) -> list[str]:
        return [n[:-5] for n in self._names("labels") if n.startswith("backup_") and n.endswith(".json")]

    def restore(self, version: int | str, label: str | None = None) -> int:
        """Publish the tables of an earlier version again, as the next one; nothing is copied."""
        latest = self.manifest().get("number", 0)
        return self._commit(self.manifest(version)["tables"], label or f"restored {version}", latest, None)

    def collect_garbage(self, keep: int, grace: datetime.timedelta = datetime.timedelta(days=1)) -> list[str]:
        """Let all versions but the latest `keep` go, then data that neither a version nor a backup names and that is older
        than `grace`, so that a running writer keeps what it has written. Returns the folders that went."""
        for v in self.versions()[:-keep] if keep > 0 else []:
            self._remove(f"versions/v{v:08d}.json")
        named = [self.manifest(v) for v in self.versions()] + [self.manifest(n) for n in self.backups()]
        held = {f.split("/")[1] for m in named for e in m.get("tables", {}).values() for f in e["folders"].values()}
        before = (datetime.datetime.now(datetime.UTC) - grace).timestamp() * 1000
        gone = [n for n in self._names("data") if n not in held and self._fs.getFileStatus(self._path(f"{self.root}/data/{n}")).getModificationTime() <= before]
        for n in gone:
            self._remove(f"data/{n}")
        for n in self._names("versions"):
            if n.startswith(".") and not n.endswith(".crc") and self._fs.getFileStatus(self._path(f"{self.root}/versions/{n}")).getModificationTime() <= before:
                self._remove(f"versions/{n}")
        return gone


def compared(old: DataFrame, new: DataFrame, key: str, *values: str) -> DataFrame:
    """(key, status) of the rows of two versions: added, removed, changed (any of `values` differs) or same. Keys are unique."""
    values = values or tuple(c for c in new.columns if c != key)
    side = lambda df, name: df.select(key, F.struct(*values).alias(name))
    joined = side(old, "__old").join(side(new, "__new"), key, "full")
    status = F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(), "removed").when(F.col("__old").eqNullSafe(F.col("__new")), "same").otherwise("changed")
    return joined.select(key, status.alias("status"))
