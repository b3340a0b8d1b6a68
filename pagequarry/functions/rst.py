"""Procedures of reStructuredText, files of YAML steps and syntax trees.

Plain functions over one file's text, and table functions over DataFrames of (path, content) that run them batch by batch.
Directives, examples and references are expressions (`directives`).
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

DIRECTIVE = re.compile(r"^\.\. (literalinclude|code-block|io-code-block|input|output|include|figure|image|toctree|procedure|step|tabs|tab|tabs-drivers|selected-content|composable-tutorial)::\s*(.*)$")
OPTION = re.compile(r"^\s+:([\w-]+):\s*(.*)$")
LIST_ITEM = re.compile(r"^(?:(\d+)|([A-Za-z])|#)\.\s+(\S.*)$")


def indent_of(line: str) -> int:
    return len(line) - len(line.lstrip(" \t"))


def block_of(lines: list[str], i: int, base: int) -> tuple[dict[str, str], list[str], int]:
    """Options, content lines and the line after a directive at i whose own indentation is base."""
    options: dict[str, str] = {}
    j = i + 1
    while j < len(lines) and (m := OPTION.match(lines[j])) and indent_of(lines[j]) > base:
        options[m[1]] = m[2].strip()
        j += 1
    content: list[str] = []
    while j < len(lines) and (not lines[j].strip() or indent_of(lines[j]) > base):
        content.append(lines[j])
        j += 1
    while content and not content[-1].strip():
        content.pop()
    return options, content, j


def dedent(lines: list[str]) -> str:
    """Lines without the indentation that all that aren't blank share."""
    least = min((indent_of(x) for x in lines if x.strip()), default=0)
    return "\n".join(x[least:] if x.strip() else "" for x in lines)


def content_hash(steps: list[dict]) -> str:
    """Of titles, contents, variations and sub-procedures of all steps: tells whether two procedures are the same."""
    parts: list[str] = []
    for s in steps:
        parts += [s["title"], s["content"]]
        for kind, options in s.get("variations", ()):
            parts += [kind, *options, *[f"{k}:{options[k]}" for k in sorted(options)]]
        for kind, sub in s.get("subs", ()):
            parts += [kind, *[x for t in sub for x in (t["title"], t["content"])]]
    return hashlib.sha256("".join(f"{x}|" for x in parts).encode()).hexdigest()


def is_heading(lines: list[str], i: int) -> bool:
    """Whether line i is underlined by a line of one sign that is as long at least."""
    under = lines[i + 1].strip() if i + 1 < len(lines) else ""
    return bool(under) and under[0] in "=-~`^\"'+*#" and not under.strip(under[0]) and len(under) >= len(lines[i].strip())


def next_marker(marker: str) -> str:
    """The list marker after a number or letter: 1 → 2, a → b, z → aa."""
    if marker.isdigit():
        return str(int(marker) + 1)
    return {"z": "aa", "Z": "AA"}.get(marker, chr(ord(marker) + 1) if len(marker) == 1 else marker)


def list_steps(lines: list[str], i: int) -> tuple[list[dict], str, int]:
    """Steps of the ordered list at line i, its kind (numbered or lettered), and the line after it.

    A marker `#.` goes on from the one before it, and the marker that it stands for leads its title.
    """
    base, steps, kind, last = indent_of(lines[i]), [], "", ""
    while i < len(lines):
        m = LIST_ITEM.match(lines[i].strip())
        if not lines[i].strip() or indent_of(lines[i]) > base:
            if steps:
                steps[-1]["content"].append(lines[i])
        elif m and indent_of(lines[i]) == base:
            kind = kind or ("numbered" if m[1] else "lettered" if m[2] else "")
            own = m[1] or m[2]
            last = own or (next_marker(last) if last else {"numbered": "1", "lettered": "a"}.get(kind, ""))
            steps.append({"title": m[3].strip() if own or not last else f"{last}. {m[3].strip()}", "content": []})
        else:
            break
        i += 1
    return [{"title": s["title"], "content": dedent(s["content"]).strip()} for s in steps], kind, i


def blocks(lines: list[str], name: str) -> Iterator[tuple[str, dict[str, str], list[str], int]]:
    """(argument, options, content, line) of the directives of a name among lines, those nested in one of them left out."""
    i = 0
    while i < len(lines):
        m = DIRECTIVE.match(lines[i].strip())
        if m and m[1] == name:
            options, content, j = block_of(lines, i, indent_of(lines[i]))
            yield m[2].strip(), options, content, i
            i = j
        else:
            i += 1


def parse_step(title: str, lines: list[str]) -> dict:
    """A step with its general content, variations [(kind, {option: content})] and sub-procedures (kind, steps)."""
    variations, selected, subs, general, i = [], {}, [], [], 0
    while i < len(lines):
        m = DIRECTIVE.match(lines[i].strip())
        if m and m[1] == "tabs":
            _, content, i = block_of(lines, i, indent_of(lines[i]))
            variations.append(("tabs", {o["tabid"]: dedent(c).strip() for _, o, c, _ in blocks(content, "tab") if o.get("tabid")}))
        elif m and m[1] == "selected-content":
            options, content, i = block_of(lines, i, indent_of(lines[i]))
            selected[selections(options)] = dedent(content).strip()
        elif LIST_ITEM.match(lines[i].strip()):
            steps, kind, j = list_steps(lines, i)
            subs.append((kind, steps))
            general += lines[i:j]
            i = j
        else:
            general.append(lines[i])
            i += 1
    return {"title": title, "content": dedent(general).strip(), "variations": variations + ([("selected-content", selected)] if selected else []), "subs": subs}


def selections(options: dict[str, str]) -> str:
    return ", ".join(x.strip() for x in options.get("selections", "").split(","))


def procedure_of(kind: str, title: str, line: int, steps: list[dict], group: int | None = None, named: list[str] | None = None) -> dict:
    """named: what tells this procedure from others of its group; else the tabs of its steps vary it."""
    tabs = sorted({o for s in steps for k, v in s.get("variations", ()) if k == "tabs" for o in v})
    return {"kind": kind, "title": title, "line": line, "steps": steps, "group": group, "variations": tabs or [""] if named is None else named, "hash": content_hash(steps)}


def directive_steps(content: list[str]) -> list[dict]:
    return [parse_step(title, inner) for title, _, inner, _ in blocks(content, "step")]


def tutorial_procedures(content: list[str], title: str, line: int) -> list[dict]:
    """Procedures of a composable tutorial: the one that stands before any selected content, with the selections of its
    steps; else those of all selected contents, equal ones under one heading once with all their selections."""
    chosen = list(blocks(content, "selected-content"))
    first = next(((c, at) for _, _, c, at in blocks(content, "procedure")), None)
    if first and not any(at < first[1] for _, _, _, at in chosen):
        steps = directive_steps(first[0])
        return [procedure_of("tutorial", title, line, steps, line, sorted({o for s in steps for k, v in s["variations"] if k == "selected-content" for o in v}))]
    found: dict[tuple[str, str], dict] = {}
    for _, options, inner, _ in chosen:
        head, i = title, 0
        while i < len(inner):
            m = DIRECTIVE.match(inner[i].strip())
            if is_heading(inner, i):
                name = inner[i].strip()
                head = head if name.lower() in ("", "procedure", "overview", "steps") else name
                i += 2
            elif m and m[1] == "procedure":
                _, body, i = block_of(inner, i, indent_of(inner[i]))
                made = procedure_of("tutorial", head, line, directive_steps(body), line, [])
                found.setdefault((head, made["hash"]), made)["variations"].append(selections(options))
            else:
                i += 1
    return [found[k] for k in sorted(found)]


def tab_procedures(content: list[str], title: str, line: int) -> list[dict]:
    """The first procedure of each tab, in order of the tabs' ids."""
    tabs = {o["tabid"]: procedures_in(c, title) for _, o, c, _ in blocks(content, "tab") if o.get("tabid")}
    return [found[0] | {"title": title, "line": line, "group": line, "variations": [tab]} for tab, found in sorted(tabs.items()) if found]


def heading_steps(lines: list[str], i: int) -> tuple[list[dict], int]:
    """Steps under numbered headings ("1. ...") from line i on, up to a heading without a number after the first step's."""
    marks = [k for k in range(i, len(lines)) if is_heading(lines, k) and re.match(r"\d+\.", lines[k].strip()) and len(lines[k].strip()) > 2]
    ends = [*marks[1:], len(lines)]
    return [parse_step(lines[a].strip(), lines[a + 2 : b]) for a, b in zip(marks, ends, strict=True)], len(lines)


def procedures_in(lines: list[str], title: str = "") -> list[dict]:
    out, i = [], 0
    while i < len(lines):
        m = DIRECTIVE.match(lines[i].strip())
        if is_heading(lines, i):
            name = lines[i].strip()
            generic = name.lower() in ("procedure", "steps")
            title = name if name and name.lower() != "overview" else title
            start, i = i, i + 2
            if generic:
                k = next((k for k in range(i, len(lines)) if lines[k].strip()), len(lines))
                if k < len(lines) and is_heading(lines, k) and re.match(r"\d+\.", lines[k].strip()):
                    steps, i = heading_steps(lines, k)
                    out.append(procedure_of("headings", title, start + 1, steps))
        elif m and m[1] in ("procedure", "tabs", "composable-tutorial"):
            _, content, j = block_of(lines, i, indent_of(lines[i]))
            if m[1] == "procedure":
                out.append(procedure_of("directive", title, i + 1, directive_steps(content)))
            else:
                out += (tab_procedures if m[1] == "tabs" else tutorial_procedures)(content, title, i + 1)
            i = j
        elif LIST_ITEM.match(lines[i].strip()):
            steps, _, j = list_steps(lines, i)
            out.append(procedure_of("ordered-list", title, i + 1, [s | {"variations": [], "subs": []} for s in steps]))
            i = j
        else:
            i += 1
    return out


def procedures(text: str) -> list[dict]:
    """Procedures of a file in order: directives, ordered lists, numbered headings, tab sets and composable tutorials.

    Each has kind, title (the heading above), line, steps, variations, group (the line of the tab set or tutorial that it
    belongs to) and hash. Includes must be expanded before.
    """
    return procedures_in(text.split("\n"))


def procedure_text(p: dict, variation: str = "") -> str:
    """A procedure as reStructuredText for one of its variations: general content, and what its steps hold for that one."""
    out = [p["title"], "=" * len(p["title"]), ""] if p["title"] else []
    out += [".. procedure::", ""]
    for s in p["steps"]:
        out += [f"   .. step:: {s['title']}", ""]
        parts = [s["content"], *[v[o] for _, v in s.get("variations", ()) for o in v if o == variation]]
        for part in filter(None, parts):
            out += [" " * 6 + x if x else "" for x in part.split("\n")] + [""]
    return "\n".join(out).rstrip() + "\n"


def yaml_steps(text: str) -> list[dict[str, str]]:
    """Steps of a YAML file of several documents: title, pre, post and action of each, of flat keys with plain, quoted or
    block values; a document that has other lines at its margin is passed over."""
    out = []
    for doc in text.split("\n---\n"):
        step: dict[str, str] = {}
        key, good = None, True
        for line in doc.split("\n"):
            m = re.match(r"^([A-Za-z_][\w-]*):(?:\s+(.*))?$", line)
            if m:
                key = m[1]
                step[key] = "" if (m[2] or "").strip() in ("|", "|-", ">", ">-", "") else m[2].strip().strip("\"'")
            elif not line.strip() or line[0] in " \t-#":
                if key:
                    step[key] += "\n" + line
            elif line.strip() not in ("---", "..."):
                good = False
        if step and good:
            out.append({k: dedent(v.split("\n")).strip("\n") for k, v in step.items()})
    return out


def rendered_steps(text: str) -> str:
    """A YAML file of steps as a procedure directive; an action is told by a line in its place."""
    out = [".. procedure::", "   :style: normal", ""]
    for s in yaml_steps(text):
        out += [f"   .. step:: {s.get('title', '')}", ""]
        for part in (s.get("pre", "").strip(), "(Action content from YAML)" if "action" in s else "", s.get("post", "").strip()):
            if part:
                out += [f"      {x}" for x in part.split("\n")] + [""]
    return "\n".join(out)


def ast_nodes(tree: str, kind: str | None = None, name: str | None = None) -> list[dict]:
    """Nodes of a JSON syntax tree by type or name, in pre-order; `children` are walked with a stack of our own."""
    try:
        stack = [json.loads(tree)]
    except (TypeError, ValueError):
        return []
    out = []
    while stack:
        node = stack.pop()
        if not isinstance(node, dict):
            continue
        if (kind is None or node.get("type") == kind) and (name is None or node.get("name") == name):
            out.append(node)
        stack.extend(reversed(node.get("children") or []))
    return out


# --- over DataFrames -----------------------------------------------------------------------------------------------


def _table(files: DataFrame, schema: str, rows) -> DataFrame:
    names = [c.strip().split(" ")[0] for c in re.split(r",(?![^<]*>)", schema)]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = [(p, *r) for p, c in zip(part["path"], part["content"], strict=True) if isinstance(c, str) for r in rows(c)]
            yield pd.DataFrame(out, columns=names)

    return files.select("path", "content").mapInPandas(run, schema)


def procedure_table(files: DataFrame) -> DataFrame:
    """Procedures of files whose includes are expanded; n_subs counts sub-procedures of steps."""
    row = lambda p: (p["kind"], p["title"], p["line"], len(p["steps"]), sum(len(s.get("subs", ())) for s in p["steps"]), p["group"], p["variations"], p["hash"])
    return _table(files, "path string, kind string, title string, line int, steps int, n_subs int, tab_group int, variations array<string>, hash string", lambda c: [row(p) for p in procedures(c)])


def procedure_texts(files: DataFrame) -> DataFrame:
    """A row a procedure and variation: its title and its text for that variation."""
    return _table(files, "path string, line int, title string, variation string, hash string, content string", lambda c: [(p["line"], p["title"], v, p["hash"], procedure_text(p, v)) for p in procedures(c) for v in p["variations"] or [""]])


def rendered_step_files(files: DataFrame) -> DataFrame:
    """Files of YAML steps (path, content) with their content as a procedure directive."""
    return _table(files, "path string, content string", lambda c: [(rendered_steps(c),)])


def code_node_table(pages: DataFrame) -> DataFrame:
    """Code nodes of pages' trees. pages: path, content (the tree as JSON)."""
    return _table(pages, "path string, language string, code string, category string", lambda c: [(n.get("lang") or "", n.get("value") or "", n.get("category") or "") for n in ast_nodes(c, kind="code")])
