"""Scalar functions as Column expressions: hashes, ids and URLs, languages, categories, paths, versions."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagequarry.functions import vocabulary as V


def lookup(column: Column, table: Mapping[str, str], default: Column | None = None) -> Column:
    """Value of a small fixed table by key; default (or null) where it has none."""
    pairs = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    found = F.element_at(pairs, column)
    return found if default is None else F.coalesce(found, default)


def trim_space(text: Column) -> Column:
    """Without blanks at both ends, in the sense of Unicode."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def code_hash(code: Column) -> Column:
    """SHA-256 of trimmed code, in hexadecimal digits."""
    return F.sha2(trim_space(code).cast("binary"), 256)


def json_field(text: Column, name: str, kind: str) -> Column:
    """A field of a JSON text as a type; null where there is none."""
    return F.from_json(text, f"`{name}` {kind}")[name]


def page_key(page_id: Column) -> Column:
    """Path-like page id without its first three parts, joined by '|'; empty with no more parts."""
    return F.array_join(F.slice(F.split(page_id, "/"), 4, 1_000_000), "|")


def page_url(page_id: Column, site: Column) -> Column:
    return F.concat(last_slash_off(site), F.lit("/"), F.array_join(F.slice(F.split(page_id, "/"), 4, 1_000_000), "/"))


def key_url(key: Column, site: Column) -> Column:
    return F.concat(last_slash_off(site), F.lit("/"), F.replace(key, F.lit("|"), F.lit("/")))


def last_slash_off(url: Column) -> Column:
    return F.regexp_replace(url, "/$", "")


def last_segment(url: Column) -> Column:
    return F.element_at(F.split(last_slash_off(url), "/"), -1)


def file_extension(path: Column) -> Column:
    """Extension of a path's last part with its dot; empty without one."""
    return F.regexp_extract(path, r"(\.[^./]*)$", 1)


def language_of_path(path: Column) -> Column:
    return lookup(file_extension(path), V.LANGUAGE_OF_EXTENSION, F.lit("undefined"))


def catalogue_language(language: Column) -> Column:
    return lookup(language, {k: k for k in V.LANGUAGES} | V.CATALOGUE_ALIASES, F.lit("undefined"))


def tree_language(language: Column) -> Column:
    low = F.lower(trim_space(language))
    return lookup(low, {k: k for k in V.TREE_EXTENSION} | V.TREE_ALIASES, low)


def catalogue_extension(language: Column) -> Column:
    return lookup(catalogue_language(language), V.EXTENSION)


def tree_extension(language: Column) -> Column:
    return lookup(tree_language(language), V.TREE_EXTENSION, F.lit(".txt"))


def include_language(option: Column, path: Column, child: Column) -> Column:
    """Language of an included file: its option, else its path's, else its last nested block's."""
    known = lambda c: F.nullif(c, F.lit("undefined"))
    return F.coalesce(known(catalogue_language(option)), known(language_of_path(path)), known(catalogue_language(child)), F.lit("undefined"))


def io_language(option: Column, child: Column, path: Column) -> Column:
    """Language of an input or output block: its option, else its nested code's, else its file's."""
    known = lambda c: F.nullif(c, F.lit("undefined"))
    return F.coalesce(known(catalogue_language(option)), known(catalogue_language(child)), known(language_of_path(path)), F.lit("undefined"))


def keywords(meta: Column) -> Column:
    return F.transform(F.split(meta, ","), lambda x: trim_space(x))


def language_bucket(language: Column) -> Column:
    return lookup(language, {x: b for b, xs in V.BUCKETS.items() for x in xs}, F.lit(""))


def author_category(value: Column) -> Column:
    """Category that an author's free wording means; empty if none."""
    low = F.lower(value)
    rules = [("syntax", V.SYNTAX), ("usage", V.USAGE), ("return", V.RETURN_OBJECT), ("configuration", V.CONFIGURATION), ("command", V.OTHER_COMMAND)]
    return F.coalesce(*[F.when(low.contains(word), category) for word, category in rules], F.lit(""))


def _any(column: Column, words: tuple[str, ...], how: str) -> Column:
    tests = [getattr(column, how)(w) for w in words]
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def rule_category(code: Column, language: Column, words: V.RuleWords = V.RuleWords()) -> Column:
    """Category by rules alone; UNCATEGORIZED if none holds.

    Prefixes come first: those of syntax only in the buckets shell, text and undefined, then commands of other tools, then
    usage. Then strings within the first head_bytes bytes, cut to whole characters; then an aggregation stage anywhere,
    which is a syntax example if a placeholder in angle brackets follows it.
    """
    bucket = language_bucket(language)
    head = F.when(F.octet_length(code) > words.head_bytes, _byte_prefix(code, words.head_bytes)).otherwise(code)
    stage = F.rlike(code, F.lit(words.stage_pattern))
    found = (
        F.when(bucket.isin("shell", "text", "undefined") & _any(code, words.syntax_prefixes, "startswith"), V.SYNTAX)
        .when(_any(code, words.command_prefixes, "startswith"), V.OTHER_COMMAND)
        .when(_any(code, words.usage_prefixes, "startswith"), V.USAGE)
        .when(_any(head, words.usage_strings, "contains"), V.USAGE)
        .when(_any(head, words.return_strings, "contains"), V.RETURN_OBJECT)
        .when(_any(head, words.command_strings, "contains"), V.OTHER_COMMAND)
        .when(stage & (F.regexp_extract(code, words.stage_pattern, 1) != ""), V.SYNTAX)
        .when(stage, V.USAGE)
    )
    return F.coalesce(found, F.lit(V.UNCATEGORIZED))


def _byte_prefix(text: Column, n: int) -> Column:
    """The characters that lie whole within the first n bytes."""
    ends = F.aggregate(F.split(F.substring(text, 1, n), ""), F.struct(F.lit(0).alias("b"), F.lit(0).alias("c")), lambda a, ch: F.struct((a["b"] + F.octet_length(ch)).alias("b"), (a["c"] + (a["b"] + F.octet_length(ch) <= n).cast("int")).alias("c")))
    return F.when(F.octet_length(text) == F.length(text), F.substring(text, 1, n)).otherwise(F.substring(text, F.lit(1), ends["c"]))


def assigned_category(code: Column, language: Column, author: Column, fallback: Column | None = None, words: V.RuleWords = V.RuleWords()) -> Column:
    """Struct (category, by_model): the author's category, else the rules', else a model's if it is one of the five."""
    ruled = rule_category(code, language, words)
    model = F.when(fallback.isin(*V.CATEGORIES), fallback).otherwise(V.UNCATEGORIZED) if fallback is not None else F.lit(V.UNCATEGORIZED)
    own = F.nullif(author_category(author), F.lit(""))
    return F.struct(F.coalesce(own, F.nullif(ruled, F.lit(V.UNCATEGORIZED)), model).alias("category"), (own.isNull() & (ruled == V.UNCATEGORIZED)).alias("by_model"))


def focus_area(page: Column, sub_product: Column, areas: list[tuple[str, str]]) -> Column:
    """Sub-product by what a page id contains: the first of areas (text, name) that holds, else sub_product."""
    out = sub_product
    for text, name in reversed(areas):
        out = F.when(page.contains(text), name).otherwise(out)
    return out


def sub_product_of_url(url: Column, dirs: list[tuple[str, str]], ignore_case: bool = False) -> Column:
    """Sub-product by directories (text, name) within a URL; the last one of the list that is found wins."""
    out = F.lit(None).cast("string")
    for text, name in dirs:
        out = F.when((F.lower(url) if ignore_case else url).contains(text.lower() if ignore_case else text), name).otherwise(out)
    return out


def output_name(path: Column, directive: Column, index: Column, sub: Column, language: Column) -> Column:
    """base.directive.index[.sub].ext"""
    base = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    return F.concat(F.concat_ws(".", base, directive, index.cast("string"), F.nullif(sub, F.lit(""))), tree_extension(language))


def slug(title: Column) -> Column:
    """Lower-case a-z and 0-9; blanks, '_' and '/' become '-', runs of it one, none at the ends; '-' itself goes first."""
    low = F.regexp_replace(F.lower(title), r"[^a-z0-9 _/]", "")
    return F.regexp_replace(F.regexp_replace(low, r"[ _/]+", "-"), r"^-+|-+$", "")


def procedure_hash(title: Column, steps: Column) -> Column:
    """SHA-256 of a title and an array of (title, content) steps, each followed by '|'."""
    parts = F.flatten(F.transform(steps, lambda s: F.array(s["title"], s["content"])))
    return F.sha2(F.array_join(F.concat(F.array(title), parts), "|").cast("binary"), 256)


def update_type(current: Column, latest: Column) -> Column:
    """major, minor, patch, none, or unknown with fewer than three parts, by the first part that differs."""
    a, b = (F.split(F.regexp_replace(c, "^v", ""), r"\.") for c in (current, latest))
    return F.when((F.size(a) < 3) | (F.size(b) < 3), "unknown").when(a[0] != b[0], "major").when(a[1] != b[1], "minor").when(a[2] != b[2], "patch").otherwise("none")


# --- paths -------------------------------------------------------------------------------------------------------


def glob_pattern(glob: str, deep: bool = True) -> str:
    """Regular expression of a glob. deep: '**' crosses '/'; '*' and '?' never do."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        if deep and glob.startswith("**/", i):
            out.append("(?:[^/]+/)*")
            i += 3
        elif deep and glob.startswith("**", i):
            out.append(".*")
            i += 2
        elif c == "*":
            out.append("[^/]*")
            i += 1
        elif c == "?":
            out.append("[^/]")
            i += 1
        elif c == "{" and "}" in glob[i:]:
            end = glob.index("}", i)
            out.append("(?:" + "|".join(re.escape(x) for x in glob[i + 1 : end].split(",")) + ")")
            i = end + 1
        elif c == "[" and "]" in glob[i + 1 :]:
            end = glob.index("]", i + 1)
            out.append("[" + glob[i + 1 : end].replace("!", "^", 1) + "]" if glob[i + 1] == "!" else glob[i : end + 1])
            i = end + 1
        elif c == "\\" and i + 1 < len(glob):
            out.append(re.escape(glob[i + 1]))
            i += 2
        else:
            out.append(re.escape(c))
            i += 1
    return "^" + "".join(out) + "$"


def java_groups(pattern: str) -> str:
    """A pattern with named groups written (?P<n>) in Java's spelling."""
    return pattern.replace("(?P<", "(?<")


def whole_word(text: Column, needle: str, ignore_case: bool = True) -> Column:
    """Whether a needle stands in a text with no letter, digit or '_' beside it."""
    if not needle:
        raise ValueError("an empty needle matches nothing in particular")
    flag = "(?i)" if ignore_case else ""
    return F.rlike(text, F.lit(flag + r"(?<![A-Za-z0-9_])" + re.escape(needle) + r"(?![A-Za-z0-9_])"))


def part_of(text: Column, needle: str, ignore_case: bool = True) -> Column:
    if not needle:
        raise ValueError("an empty needle matches nothing in particular")
    return F.lower(text).contains(needle.lower()) if ignore_case else text.contains(needle)


def fill_path(template: str | Column, path: Column, variables: Mapping[str, Column] | None = None) -> Column:
    """A path template with ${path}, ${filename}, ${dir}, ${ext} and own variables filled in; null if any is left."""
    out = fill_names(template, path, variables)
    return F.when(~out.contains("${"), out)


def fill_names(template: str | Column, path: Column, variables: Mapping[str, Column] | None = None) -> Column:
    """fill_path, with what is left as it stands."""
    name = F.element_at(F.split(path, "/"), -1)
    folder = F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit("."))
    values = {"path": path, "filename": name, "dir": folder, "ext": F.regexp_replace(file_extension(path), r"^\.", "")} | dict(variables or {})
    out = F.lit(template) if isinstance(template, str) else template
    for key, value in values.items():
        out = F.replace(out, F.lit("${" + key + "}"), value)
    return out


def fill_message(template: str, values: Mapping[str, Column]) -> Column:
    """A message template with every ${name} of values filled in; others stay."""
    out = F.lit(template)
    for key, value in values.items():
        out = F.replace(out, F.lit("${" + key + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def project_of_path(path: Column) -> Column:
    """First part of a path under content/, null for a file directly beneath it."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 2, parts[1])


def version_of_path(path: Column) -> Column:
    """Second part under content/ if that names a version, else null."""
    parts = F.split(path, "/")
    return F.when((F.size(parts) > 3) & is_version(parts[2]), parts[2])


def is_version(name: Column) -> Column:
    return name.isin("current", "manual", "upcoming") | name.startswith("v")


def dedent(text: Column, tab: int = 1) -> Column:
    """A text without the indentation that all its lines share, blank lines aside, which become empty. tab: how many places a
    tab counts for; as many characters are cut, from lines that have them. Without common indentation the text stays."""
    lines, blanks = F.split(text, "\n"), F.lit(" \t\r\x0b\x0c")
    blank = lambda x: F.btrim(x, blanks) == ""
    lead = lambda x: F.regexp_extract(x, r"^[ \t]*", 0)
    depth = lambda x: F.length(lead(x)) + (tab - 1) * F.length(F.regexp_replace(lead(x), " ", ""))
    least = F.array_min(F.transform(F.filter(lines, lambda x: ~blank(x)), depth))
    cut = lambda n: F.array_join(F.transform(lines, lambda x: F.when(blank(x), "").when(F.length(x) >= n, F.substring(x, n + 1, F.length(x))).otherwise(x)), "\n")
    return F.when(least > 0, F.element_at(F.transform(F.array(least), cut), 1)).otherwise(text)


def emphasized_lines(ranges: Column) -> Column:
    """Line numbers of an array of [low, high] pairs; null if a pair has another size."""
    return F.when(F.forall(ranges, lambda r: F.size(r) == 2), F.flatten(F.transform(ranges, lambda r: F.sequence(r[0], r[1]))))
