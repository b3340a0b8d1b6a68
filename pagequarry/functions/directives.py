"""Directives of reStructuredText as expressions: found, with their blocks, options and contents, within one pass over lines.

A text is an array of lines (`lines_of`), each with its indentation. A directive's block ends before the next line that isn't
blank and isn't indented more. The pass keeps one open directive and the list of finished ones, so its work is the lines plus
what it finds; nothing leaves the engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagequarry.functions.scalars import dedent

# Directives that are looked at, by name.
NAMES = "literalinclude code-block io-code-block input output include figure image toctree".split()
KINDS = ["literalinclude", "code-block", "io-code-block"]
BLANKS = " \t\r\n\x0b\x0c"
OPTION = r"^\s+:([\w-]+):\s*(.*)$"
_DONE = "array<struct<kind:string,argument:string,at:int,indent:int,end:int>>"


def stripped(s: Column) -> Column:
    return F.btrim(s, F.lit(BLANKS))


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def lines_of(lines: Column) -> Column:
    """Array of (s, blank, indent, kind, argument) of an array of lines; kind is empty where no directive stands."""
    pattern = r"^\.\. (" + "|".join(NAMES) + r")::\s*(.*)$"

    def line(x: Column) -> Column:
        bare = stripped(x)
        return F.struct(x.alias("s"), (bare == "").alias("blank"), F.length(F.regexp_extract(x, r"^[ \t]*", 0)).alias("indent"), F.regexp_extract(bare, pattern, 1).alias("kind"), stripped(F.regexp_extract(bare, pattern, 2)).alias("argument"))

    return F.transform(lines, line)


def found(lines: Column, kinds: list[str]) -> Column:
    """Directives (kind, argument, at, indent, end) of some kinds, in order: lines at (from 0) up to end. Those within the block
    of another one found are part of it."""
    none = F.lit(None).cast("struct<kind:string,argument:string,at:int,indent:int>")
    start = F.struct(F.lit(0).alias("i"), none.alias("open"), F.array().cast(_DONE).alias("done"))
    closed = lambda s, end: F.concat(s["done"], F.array(F.struct(s["open"]["kind"].alias("kind"), s["open"]["argument"].alias("argument"), s["open"]["at"].alias("at"), s["open"]["indent"].alias("indent"), end.alias("end"))))

    def step(s: Column, x: Column) -> Column:
        ends = s["open"].isNotNull() & ~x["blank"] & (x["indent"] <= s["open"]["indent"])
        is_open = s["open"].isNotNull() & ~ends
        begins = ~is_open & x["kind"].isin(kinds)
        here = F.struct(x["kind"].alias("kind"), x["argument"].alias("argument"), s["i"].alias("at"), x["indent"].alias("indent"))
        return F.struct((s["i"] + 1).alias("i"), F.when(begins, here).when(is_open, s["open"]).otherwise(none).alias("open"), F.when(ends, closed(s, s["i"])).otherwise(s["done"]).alias("done"))

    return F.aggregate(lines, start, step, lambda s: F.when(s["open"].isNotNull(), closed(s, s["i"])).otherwise(s["done"]))


def with_blocks(lines: Column, directives: Column) -> Column:
    """Directives (kind, argument, at) with options (a map) and block (the lines of their content)."""

    def one(d: Column) -> Column:
        inside = F.slice(lines, d["at"] + 2, d["end"] - d["at"] - 1)
        # Options are the lines at the block's beginning that look like one.
        is_option = F.transform(inside, lambda x: F.rlike(x["s"], F.lit(OPTION)) & (x["indent"] > d["indent"]))
        first = F.array_position(is_option, False)
        n = F.when(first == 0, F.size(inside)).otherwise(first - 1).cast("int")
        pairs = F.transform(F.slice(inside, 1, n), lambda x: F.struct(F.regexp_extract(x["s"], OPTION, 1).alias("key"), stripped(F.regexp_extract(x["s"], OPTION, 2)).alias("value")))
        last = let(pairs, lambda p: F.filter(p, lambda e, i: ~F.exists(F.slice(p, i + 2, F.size(p)), lambda later: later["key"] == e["key"])))
        return F.struct(d["kind"].alias("kind"), d["argument"].alias("argument"), d["at"].alias("at"), F.map_from_entries(last).alias("options"), F.transform(F.slice(inside, n + 1, F.size(inside)), lambda x: x["s"]).alias("block"))

    return F.transform(directives, one)


def content_of(block: Column) -> Column:
    """A block's lines as text, dedented and stripped, blank lines empty."""
    return stripped(plain_dedent(F.array_join(block, "\n")))


def plain_dedent(text: Column) -> Column:
    return F.regexp_replace(dedent(text), r"(?m)^[ \t\r\x0b\x0c]+$", "")


def directive_table(files: DataFrame, kinds: list[str] = KINDS) -> DataFrame:
    """(path, kind, argument, at, options, block) of the directives of files (path, content); a null content has none."""
    texts = files.where(F.col("content").contains(".. ")).select("path", "content")
    return texts.select("path", F.explode(blocks_of(F.split("content", "\n"), kinds)).alias("d")).select("path", "d.*")


def blocks_of(lines: Column, kinds: list[str]) -> Column:
    """Directives of an array of lines with their blocks; the lines are looked at once."""
    return let(lines_of(lines), lambda x: with_blocks(x, found(x, kinds)))


def example_table(files: DataFrame) -> DataFrame:
    """(path, directive, index, sub, language, content, includes, options): examples of files.

    index counts from 1 by directive. A literalinclude carries the path that it includes in `includes`, for a join with the
    files. Parts of an io-code-block (sub: input or output) that name a file are passed over; their index is used up.
    """
    w = Window.partitionBy("path", "kind").orderBy("at")  # one text's directives
    rows = directive_table(files).withColumn("index", F.row_number().over(w))
    language = lambda o: F.coalesce(F.try_element_at(o, F.lit("language")), F.lit(""))
    kind, none = F.col("kind"), F.map_from_entries(F.array().cast("array<struct<key:string,value:string>>"))
    item = lambda *values: F.struct(*[v.alias(n) for n, v in zip(("sub", "language", "content", "includes", "options"), values, strict=True)])
    empty, null = F.lit(""), F.lit(None).cast("string")
    own = item(empty, F.coalesce(F.nullif("argument", empty), language(F.col("options"))), content_of(F.col("block")), null, F.col("options"))
    included = item(empty, language(F.col("options")), empty, F.col("argument"), F.col("options"))
    parts = F.transform(F.filter(blocks_of(F.col("block"), ["input", "output"]), lambda p: p["argument"] == ""), lambda p: item(p["kind"], language(p["options"]), content_of(p["block"]), null, none))
    items = F.when(kind == "io-code-block", parts).when(kind == "literalinclude", F.array(included)).otherwise(F.array(own))
    return rows.select("path", kind.alias("directive"), "index", F.explode(items).alias("i")).select("path", "directive", "index", "i.*")


def included_part(content: Column, options: Column) -> Column:
    """What a literalinclude takes of a file, null if a tag that it names is missing."""
    option = lambda name: F.try_element_at(options, F.lit(name))

    def after(text: Column) -> Column:
        at = F.position(option("start-after"), text)
        line_end = F.call_function("locate", F.lit("\n"), text, at)
        cut = F.when(at > 0, F.when(line_end > 0, F.substring(text, line_end + 1, F.length(text))).otherwise(""))
        return F.when(option("start-after").isNull(), text).otherwise(cut)

    def before(text: Column) -> Column:
        at = F.position(option("end-before"), text)
        head = F.substring(text, F.lit(1), at - 1)
        whole = F.greatest(F.lit(0), F.length(head) - F.length(F.substring_index(head, "\n", -1)) - 1)
        return F.when(option("end-before").isNull(), text).when(at > 0, F.substring(head, F.lit(1), whole))

    taken = let(let(content, after), before)
    return let(taken, lambda t: stripped(F.when(option("dedent").isNotNull(), plain_dedent(t)).otherwise(t)))


def edge_table(files: DataFrame) -> DataFrame:
    """(source, directive, ref, line from 1): references of files to others. Entries of a toctree count; so do input and output,
    but only within an io-code-block."""
    edge = "array<struct<directive:string,ref:string,line:int>>"
    start = F.struct(F.lit(0).alias("i"), F.lit(-1).alias("io"), F.lit(-1).alias("toc"), F.array().cast(edge).alias("out"))

    def step(s: Column, x: Column) -> Column:
        ends = lambda base: ~x["blank"] & (x["indent"] <= base)
        io, toc = F.when(ends(s["io"]), -1).otherwise(s["io"]), F.when(ends(s["toc"]), -1).otherwise(s["toc"])
        row = lambda directive, ref: F.array(F.struct(directive.alias("directive"), ref.alias("ref"), (s["i"] + 1).alias("line")))
        none = F.array().cast(edge)
        named = x["argument"] != ""
        own = F.when(x["kind"].isin("include", "literalinclude", "figure", "image") & named, row(x["kind"], x["argument"])).when(x["kind"].isin("input", "output") & named & (io >= 0), row(F.lit("io-code-block"), x["argument"])).otherwise(none)
        bare = stripped(x["s"])
        inner = F.regexp_extract(bare, "^.*<([^>]+)>$", 1)
        entry = F.when((toc >= 0) & ~x["blank"] & ~bare.startswith(":"), row(F.lit("toctree"), F.when(inner != "", inner).otherwise(bare))).otherwise(none)
        out = F.when((F.size(own) > 0) | (F.size(entry) > 0), F.concat(s["out"], own, entry)).otherwise(s["out"])
        return F.struct((s["i"] + 1).alias("i"), F.when(x["kind"] == "io-code-block", x["indent"]).otherwise(io).alias("io"), F.when(x["kind"] == "toctree", x["indent"]).otherwise(toc).alias("toc"), out.alias("out"))

    rows = files.where(F.col("content").contains("::")).select(F.col("path").alias("source"), lines_of(F.split("content", "\n")).alias("lines"))
    return rows.select("source", F.explode(F.aggregate("lines", start, step, lambda s: s["out"])).alias("e")).select("source", "e.*")


def replacement_table(files: DataFrame) -> DataFrame:
    """(path, name, value) of the template variables that files set under `replacement:`."""
    block = F.regexp_extract("content", r"(?m)^replacement:[ \t]*\n((?:[ \t]+.*\n?|\n)*+)", 1)
    entry = r"^[ \t]+([\w-]+):[ \t]*[\"']?(.*?)[\"']?[ \t]*$"
    lines = files.select("path", F.explode(F.split(block, "\n")).alias("line")).where(F.rlike("line", F.lit(entry)))
    return lines.select("path", F.regexp_extract("line", entry, 1).alias("name"), F.regexp_extract("line", entry, 2).alias("value"))
