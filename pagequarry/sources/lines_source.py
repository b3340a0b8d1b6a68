"""A data source of page lines, for batch reads: files are split by bytes, and filters on the lines' type are taken in.

`register(spark)`, then `spark.read.format("page_lines").load(path)` gives path, start (the byte where a
line begins), type and data (the page as JSON text). Options: `split_bytes` (bytes a task reads, 64 MB by default) and
`drop_unterminated` (true: a last line without a line end, as a broken transfer leaves it, doesn't count). A task reads the
lines that begin in its stretch, to their end, so every line is read once whatever the splits. Lines that aren't JSON objects
are passed over. path is a file or folder on any file system that pyarrow knows, local paths included; files whose names begin
with '_' or '.' are left out.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

SPLIT_BYTES = 64 << 20
CHUNK = 1 << 20


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and let it take filters in."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PageLines)


class Stretch(InputPartition):
    def __init__(self, path: str, lo: int, hi: int):
        self.path, self.lo, self.hi = path, lo, hi


class PageLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "page_lines"

    def schema(self) -> str:
        return "path string, start long, type string, data string"

    def reader(self, schema) -> DataSourceReader:
        return Reader(self.options)


def file_system(path: str):
    from pyarrow.fs import FileSystem, LocalFileSystem

    return FileSystem.from_uri(path) if ":/" in path else (LocalFileSystem(), path)


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.split = max(1, int(options.get("split_bytes", SPLIT_BYTES)))
        self.drop = str(options.get("drop_unterminated", "false")).lower() == "true"
        self.types: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equality and membership on the type are taken in; the rest stays with Spark."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("type",):
                wanted = {f.value}
            elif isinstance(f, In) and f.attribute == ("type",):
                wanted = set(f.value)
            else:
                yield f
                continue
            self.types = wanted if self.types is None else self.types & wanted

    def partitions(self) -> list[InputPartition]:
        from pyarrow.fs import FileSelector, FileType

        fs, at = file_system(self.path)
        info = fs.get_file_info(at)
        if info.type == FileType.NotFound:
            raise FileNotFoundError(self.path)
        infos = [info] if info.type == FileType.File else sorted((f for f in fs.get_file_info(FileSelector(at, recursive=True)) if f.type == FileType.File and f.base_name[0] not in "_."), key=lambda f: f.path)
        scheme = self.path.partition(":/")[0] + "://" if ":/" in self.path else ""
        return [Stretch(scheme + f.path, lo, min(f.size, lo + self.split)) for f in infos for lo in range(0, f.size, self.split)]

    def read(self, part: Stretch) -> Iterator[tuple]:
        fs, at = file_system(part.path)
        with fs.open_input_file(at) as f:
            for start, line in lines_between(f, part.lo, part.hi, self.drop):
                try:
                    row = json.loads(line)
                except ValueError:
                    continue
                if isinstance(row, dict) and (self.types is None or row.get("type") in self.types):
                    data = row.get("data")
                    yield part.path, start, row.get("type"), None if data is None else json.dumps(data, ensure_ascii=False, separators=(",", ":"))


def lines_between(f, lo: int, hi: int, drop_unterminated: bool) -> Iterator[tuple[int, bytes]]:
    """(start, line) of the lines of a file that begin at lo up to hi; a line begins at 0 and after every line end."""
    at = max(0, lo - 1)
    f.seek(at)
    rest, start, skip = b"", at, lo > 0  # the byte before lo tells whether a line begins at lo
    while start < hi or skip:
        data = f.read(CHUNK)
        if not data:
            if rest and not skip and not drop_unterminated and start < hi:
                yield start, rest
            return
        rest += data
        begin = 0
        while (end := rest.find(b"\n", begin)) >= 0:
            if not skip:
                if start >= hi:
                    return
                if end > begin:
                    yield start, rest[begin:end]
            skip = False
            start += end + 1 - begin
            begin = end + 1
        rest = rest[begin:]
        if skip:
            start, rest = start + len(rest), b""
