"""Directives, examples and references of one text, line by line: what the expressions are held against."""

from __future__ import annotations

import re

from pagequarry.functions.rst import DIRECTIVE, block_of, dedent, indent_of


def parse_directives(text: str, kinds: tuple[str, ...] = ("literalinclude", "code-block", "io-code-block")) -> list[dict]:
    """Directives in order: kind, argument, options, content, line, and nested input and output of io-code-block."""
    lines, out, i = text.split("\n"), [], 0
    while i < len(lines):
        m = DIRECTIVE.match(lines[i].strip())
        if not m or m[1] not in kinds:
            i += 1
            continue
        options, content, j = block_of(lines, i, indent_of(lines[i]))
        found = {"kind": m[1], "argument": m[2].strip(), "options": options, "content": dedent(content).strip(), "line": i + 1, "parts": []}
        if m[1] == "io-code-block":
            found["parts"] = parse_directives("\n".join(content), ("input", "output"))
        out.append(found)
        i = j
    return out


def included_part(content: str, options: dict[str, str]) -> str | None:
    """What a literalinclude takes of a file, None if a tag that it names is missing."""
    if (tag := options.get("start-after")) is not None:
        at = content.find(tag)
        if at < 0:
            return None
        end = content.find("\n", at)
        content = "" if end < 0 else content[end + 1 :]
    if (tag := options.get("end-before")) is not None:
        at = content.find(tag)
        if at < 0:
            return None
        content = content[: max(0, content.rfind("\n", 0, at))]
    if "dedent" in options:
        content = dedent(content.split("\n"))
    return content.strip()


def code_examples(text: str) -> list[dict]:
    """Examples of a file: directive, index (from 1, by directive), language, content, sub (input or output).

    A literalinclude carries the path that it includes in `includes`, for a join with the files. Parts of an
    io-code-block that name a file are passed over; their index is used up.
    """
    out: list[dict] = []
    seen: dict[str, int] = {}
    for d in parse_directives(text):
        seen[d["kind"]] = index = seen.get(d["kind"], 0) + 1
        if d["kind"] == "io-code-block":
            for part in d["parts"]:
                if not part["argument"]:
                    out.append({"directive": d["kind"], "index": index, "sub": part["kind"], "language": part["options"].get("language", ""), "content": part["content"], "includes": None, "options": {}})
        elif d["kind"] == "literalinclude":
            out.append({"directive": d["kind"], "index": index, "sub": "", "language": d["options"].get("language", ""), "content": "", "includes": d["argument"], "options": d["options"]})
        else:
            out.append({"directive": d["kind"], "index": index, "sub": "", "language": d["argument"] or d["options"].get("language", ""), "content": d["content"], "includes": None, "options": d["options"]})
    return out


def include_edges(text: str) -> list[dict]:
    """References of a file to others: directive, ref, line. Entries of a toctree count; so do input and output, but only
    within an io-code-block."""
    out: list[dict] = []
    lines = text.split("\n")
    inside: tuple[int, int] | None = None  # lines of the io-code-block at hand
    for i, line in enumerate(lines):
        m = DIRECTIVE.match(line.strip())
        if not m:
            continue
        kind, argument = m[1], m[2].strip()
        if kind == "io-code-block":
            inside = (i, block_of(lines, i, indent_of(line))[2])
        elif kind in ("include", "literalinclude", "figure", "image") and argument:
            out.append({"directive": kind, "ref": argument, "line": i + 1})
        elif kind in ("input", "output") and argument and inside and inside[0] < i < inside[1]:
            out.append({"directive": "io-code-block", "ref": argument, "line": i + 1})
        elif kind == "toctree":
            j = i + 1
            while j < len(lines) and (not lines[j].strip() or indent_of(lines[j]) > indent_of(line)):
                name = lines[j].strip()
                if name and not name.startswith(":"):
                    inner = re.match(r".*<([^>]+)>$", name)
                    out.append({"directive": "toctree", "ref": inner[1] if inner else name, "line": j + 1})
                j += 1
    return out
