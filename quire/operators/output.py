"""Books as files: names, Markdown, line numbers, indexes. One row a file; writing is in sources.sinks."""

from __future__ import annotations

import html
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import lines as L
from quire.operators.arrow import grouped

_ESCAPES = (("\\", "\\\\"), ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("|", "\\|"), ("\n", "<br>"))


def encode_row(cells: list[str], width: int) -> str:
    """A row of a Markdown table, padded to the width."""
    out = []
    for c in cells + [""] * (width - len(cells)):
        c = c.strip()
        for a, b in _ESCAPES:
            c = c.replace(a, b)
        out.append(f" {c} |")
    return "|" + "".join(out)


def decode_row(line: str) -> list[str]:
    """The cells of a row: encode_row() undone."""
    cells = re.findall(r"((?:\\.|[^\\|])*)\|", line.strip().removeprefix("|") + ("" if line.strip().endswith("|") else "|"))
    return [html.unescape(re.sub(r"\\(.)", r"\1", c.strip().replace("<br>", "\n"))) for c in cells]


def render_table(rows: list[list[str]]) -> str:
    width = max(map(len, rows), default=0)
    if not width:
        return ""
    return "\n".join([encode_row(rows[0], width), "|" + "---|" * width, *(encode_row(r, width) for r in rows[1:])]) + "\n"


def table_markdown(tables: DataFrame, key: str) -> DataFrame:
    """Rows (key, rows) to (key, markdown)."""
    from quire.operators.arrow import mapped

    return mapped(tables.select(key, "rows"), lambda r: [{key: r[key], "markdown": render_table(r["rows"])}], f"{key} {tables.schema[key].dataType.simpleString()}, markdown string")


def fenced(lines: list[str]) -> str:
    """Lines in a text fence; what looks like a fence is moved in."""
    while lines and not lines[0].strip():
        lines = lines[1:]
    while lines and not lines[-1].strip():
        lines = lines[:-1]
    if not lines:
        return ""
    real = [x for x in lines if x.strip()]
    cut = min(len(x) - len(x.lstrip(" ")) for x in real)
    body = [x[cut:] if x[:cut].strip(" ") == "" and len(x) >= cut else x.lstrip(" ") for x in lines]
    return "```text\n" + "".join((" " + x if x.strip().startswith("```") else x) + "\n" for x in body) + "```\n"


def file_names(groups: DataFrame) -> DataFrame:
    """Rows (book, chapter, chapter_title, section, first_seen) with `file`: the folder of the chapter and a name that no other section has, whatever the case of its letters.

    Names are dealt in order of appearance and generated ones are taken as well, so this is a fold over a book's sections.
    """
    t = groups.select("book", "chapter", "section", "first_seen", T.chapter_folder(F.col("chapter"), F.coalesce("chapter_title", F.lit(""))).alias("folder"), T.safe_name(F.col("section")).alias("name"))

    def of(rows: list[dict]) -> list[dict]:
        used: set[str] = set()
        out = []
        for r in sorted(rows, key=lambda r: r["first_seen"]):
            stem = f"{r['folder']}/{r['name']}"
            file, n = f"{stem}.md", 2
            while file.lower() in used:
                file, n = f"{stem}-{n}.md", n + 1
            used.add(file.lower())
            out.append({"book": r["book"], "chapter": r["chapter"], "section": r["section"], "first_seen": r["first_seen"], "file": file})
        return out

    return grouped(t, ["book"], of, "book string, chapter int, section string, first_seen long, file string")


def figure_names(figures: DataFrame) -> DataFrame:
    """Rows (book, ord, source) with `name`: the base name, numbered where another source has it already."""

    def of(rows: list[dict]) -> list[dict]:
        used: set[str] = set()
        names: dict[str, str] = {}
        for r in sorted(rows, key=lambda r: r["ord"]):
            if r["source"] not in names:
                base = r["source"].rpartition("/")[2]
                stem, dot, end = base.rpartition(".") if "." in base else (base, "", "")
                name, n = base, 2
                while name.lower() in used:
                    name, n = f"{stem}-{n}{dot}{end}", n + 1
                used.add(name.lower())
                names[r["source"]] = name
        return [{"book": rows[0]["book"], "source": s, "name": n} for s, n in names.items()]

    return grouped(figures, ["book"], of, "book string, source string, name string")


def _body(lines: list[str]) -> str:
    """Wrapped lines joined and rendered, as operators.lines does by windows; used where a block is rendered whole."""
    units: list[str] = []
    buf = ""
    for raw in [*lines, ""]:
        t = raw.strip()
        if buf and (not t or _starts(t) or buf[-1] in "。！？!?"):
            units.append(buf)
            buf = ""
        if t:
            buf = t if not buf else buf + (" " if re.match(r"[A-Za-z0-9]\Z", buf[-1]) and re.match("[A-Za-z0-9]", t[0]) else "") + t
    out, in_list, in_def = "", False, False
    for u in units:
        if T.PARAMETER in u:
            out += ("" if in_list else "\n") + f"- {_code(u)}\n"
            in_list = in_def = True
        elif _bullet(u):
            out += ("" if in_list else "\n") + ("  " if in_def else "") + f"- {_code(u[1:].strip())}\n"
            in_list = True
        else:
            out += ("\n" if in_list else "") + _code(u) + "\n"
            in_list = in_def = False
    return out + "\n" if units else ""


def _bullet(s: str) -> bool:
    return s[0] in T.BULLETS and not re.match(r"※\s*\d", s)


def _starts(s: str) -> bool:
    return _bullet(s) or T.PARAMETER in s


_RUN = re.compile(f"(?:{T._GLUE}|{T._GROUP})*{T._GROUP}(?:{T._GLUE}|{T._GROUP})*")


def _code(s: str) -> str:
    return _RUN.sub(lambda m: m[0] if "`" in m[0] else f"`{m[0]}`", s)


def entry_markdown(title: str, fields: list[dict]) -> str:
    out = f"## {title}\n\n"
    for f in fields:
        lines = f["lines"]
        if f["label"] in ("入力形式", "入力例"):
            real = [x for x in lines if x.strip()]
            cut = min((len(x) - len(x.lstrip(" ")) for x in real), default=0)
            body = "\n".join(x[cut:] if len(x) - len(x.lstrip(" ")) >= cut else x.lstrip(" ") for x in lines).strip("\n ")
            out += f"{f['label']}:\n```\n{body}\n```\n\n" if body else ""
            continue
        body = _body(lines)
        one = [x for x in body.split("\n") if x]
        if not one or (len(one) == 1 and one[0].strip() in T.EMPTY_FIELDS):
            continue
        single = len(one) == 1 and not one[0].startswith("- ")
        out += f"{f['label']}: {one[0]}\n\n" if single else f"{f['label']}:\n{body}"
    return out


def heading_markdown(number: str, title: str, depth: int, blocks: list[dict], figures: dict[str, str] | None = None) -> str:
    out = "#" * min(6, depth + 1) + " " + _code(f"{number} {title}".strip()) + "\n\n"
    for b in blocks:
        if b["kind"] == "layout":
            text = fenced(b["lines"])
            out += text and text + "\n"
        elif b["kind"] == "table":
            text = render_table(b["rows"])
            out += text and text + "\n"
        elif b["kind"] == "figure":
            name = (figures or {}).get(b["figure_source"], "")
            out += fenced(b["lines"]) + (f"<sup>[図]({'<' + name + '>' if set(name) & set(' ()') else name})</sup>\n" if name else "") + "\n"
        else:
            out += _body(b["lines"])
    return out


def numbered(items: DataFrame, names: DataFrame) -> DataFrame:
    """Items (book, chapter, section, ord, text) with their file and the line at which each begins in it."""
    t = items.join(names.select("book", "chapter", "section", "file"), ["book", "chapter", "section"])
    return L.item_lines(t, ["book", "file"], "ord")


def file_contents(items: DataFrame) -> DataFrame:
    """numbered() items to one row a file: (book, file, content). A file is a section, a bounded group."""
    one = items.groupBy("book", "file").agg(F.min("section").alias("section"), F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("x"))
    return one.select("book", "file", F.concat(F.lit("# "), "section", F.lit("\n\n"), F.array_join(F.col("x.text"), "")).alias("content"))


def book_index(groups: DataFrame, titles: DataFrame) -> DataFrame:
    """index.md lines by (book, chapter, first_seen): sections with their files and sizes."""
    t = groups.join(titles, ["book", "chapter"], "left")
    return t.select("book", "chapter", "first_seen", F.format_string("- [%s](%s) — %d", F.col("section"), T.link_target(F.col("file")), F.col("n")).alias("line"), F.format_string("## %d. %s", F.col("chapter"), F.coalesce("title", F.lit(""))).alias("head"))


def book_readme(counts: DataFrame) -> DataFrame:
    """README text of rows (book, title, kind, source, version, items, files)."""
    line = F.concat_ws("\n", F.concat(F.lit("# "), "title"), F.lit(""), F.when(F.col("kind") == "web", F.concat(F.lit("- source: "), "source", F.lit(" (web)"))).otherwise(F.concat(F.lit("- source: "), "source")), F.when(F.col("version") != "", F.concat(F.lit("- version: "), "version")), F.format_string("- items: %d, files: %d", F.col("items"), F.col("files")), F.lit(""))
    return counts.select("book", line.alias("content"))
