import io
import json
import random

import pytest
from pyspark.sql import functions as F

from pagequarry.sources import lines_source, readers

TYPES = ["page", "asset", "timestamp", "page"]


def make(path, n, seed, end="\n"):
    rng = random.Random(seed)
    lines = [json.dumps({"type": TYPES[i % 4], "data": {"page_id": f"p{seed}-{i}", "text": "é" * rng.randint(0, 60)}}, ensure_ascii=False) for i in range(n)]
    lines[2:2] = ["", "not json", "[1]", "{}"]
    path.write_text("\n".join(lines) + end)
    return lines


@pytest.mark.parametrize("chunk", [1, 7, 1 << 20])
def test_every_line_is_read_once(monkeypatch, chunk):
    monkeypatch.setattr(lines_source, "CHUNK", chunk)
    rng = random.Random(chunk)
    for _ in range(200):
        text = b"".join(rng.choice([b"a", b"bc", b"\n", b"\n\n", b"\xc3\xa9"]) for _ in range(rng.randint(0, 30)))
        want, at = [], 0
        for line in text.split(b"\n"):
            if line:
                want.append((at, line))
            at += len(line) + 1
        for split in (1, 2, 3, 10, 100):
            for drop in (False, True):
                got = [x for lo in range(0, len(text), split) for x in lines_source.lines_between(io.BytesIO(text), lo, min(len(text), lo + split), drop)]
                whole = want if not drop or text.endswith(b"\n") else [x for x in want if x[0] + len(x[1]) < len(text)]
                assert got == whole, (text, split, drop)


def test_source_agrees_with_text_lines(spark, tmp_path):
    lines_source.register(spark)
    (tmp_path / "sub").mkdir()
    make(tmp_path / "a.ndjson", 200, 1)
    make(tmp_path / "sub" / "b.ndjson", 50, 2, end='\n{"type":"page","data":{"page_id":"cut off')
    make(tmp_path / "_ignored", 5, 3)
    (tmp_path / "empty.ndjson").write_text("")
    load = lambda **o: spark.read.format("page_lines").options(**o).load(str(tmp_path))
    parsed = spark.read.text([str(tmp_path / "a.ndjson"), str(tmp_path / "sub")]).select(F.from_json("value", "type string, data struct<page_id:string,text:string>").alias("j")).where("j.type IS NOT NULL")
    want = sorted((r[0], r[1], r[2]) for r in parsed.where("j.data.page_id IS NOT NULL AND j.data.page_id <> 'cut off'").select("j.type", "j.data.page_id", "j.data.text").collect())
    for split in (50, 1000, 1 << 20):
        found = load(split_bytes=split)
        page = F.from_json("data", "page_id string, text string")
        assert sorted(tuple(r) for r in found.where("data IS NOT NULL").select("type", page["page_id"], page["text"]).collect()) == want
    assert load(split_bytes=500).rdd.getNumPartitions() > 20
    assert spark.read.format("page_lines").load(f"file://{tmp_path}/a.ndjson").count() == 201  # with the empty object


def test_types_are_pushed_down(spark, tmp_path):
    lines_source.register(spark)
    make(tmp_path / "a.ndjson", 100, 1)
    rows = spark.read.format("page_lines").load(str(tmp_path))
    assert rows.where("type = 'page'").count() == 50 and rows.where("type IN ('asset', 'timestamp')").count() == 50
    assert rows.where("type = 'page' AND type = 'asset'").count() == 0
    assert rows.where("type = 'page' AND data LIKE '%p1-0\"%'").count() == 1
    reader = lines_source.Reader({"path": str(tmp_path)})
    left = list(reader.pushFilters([lines_source.EqualTo(("type",), "page"), lines_source.EqualTo(("path",), "x")]))
    assert reader.types == {"page"} and len(left) == 1


def test_unterminated_lines(spark, tmp_path):
    lines_source.register(spark)
    (tmp_path / "x.ndjson").write_text('{"type":"page","data":{"page_id":"a"}}\n{"type":"page","data":{"page_id":"b"}}')
    load = lambda drop: spark.read.format("page_lines").option("drop_unterminated", drop).option("split_bytes", 10).load(str(tmp_path)).count()
    assert (load("false"), load("true")) == (2, 1)


def test_pages_of_the_source(spark, tmp_path):
    """The data column goes where the plain reader's pages go."""
    lines_source.register(spark)
    make(tmp_path / "a.ndjson", 40, 5)
    lines = spark.read.format("page_lines").load(str(tmp_path)).where("type = 'page'").select(F.concat(F.lit('{"type":"page","data":'), "data", F.lit("}")).alias("value"))
    got = readers.pages_of_lines(lines).select("page_id").collect()
    want = readers.page_stream(spark, str(tmp_path / "a.ndjson")).select("page_id").collect()
    assert sorted(got) == sorted(want)
