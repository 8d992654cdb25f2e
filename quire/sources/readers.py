"""Readers of manifests, profiles, indexes, inventories, pages, glyphs and ssh configurations."""

from __future__ import annotations

import glob
import os
import posixpath
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import commands as C
from quire.functions import text as T

# The variable that names an inventory, a profile's defaults, and header lines of the files.
PROFILE = {
    "name": "crm", "pageWidth": 516.0, "pageHeight": 728.88, "marginTop": 45.0, "marginBottom": 45.0, "columns": 2, "gutterLeft": 256.0, "gutterRight": 262.0, "headerBand": 690.0, "footerBand": 690.0, "entryMarker": "■",
    "fieldLabels": ["入力形式", "パラメータ", "説明", "デフォルト値", "実行モード", "ユーザ権限", "入力例", "ノート"], "webUnnumberedHeadings": False, "chapterSep": "", "footerSection": False, "headingMinSize": 0.0,
}
COMMANDS_HEADER = ("command", "entry", "file", "line", "source")
SECTIONS_HEADER = ("section", "title", "file", "line", "source")
DERIVED_HEADER = ("kind", "ix", "ix-r", "ref_ix", "ref_ixr", "note")
INVENTORY_VARIABLE = "IX_INVENTORY"
DOC_FIELDS = ("name", "series", "book", "kind", "url", "version", "versionSource", "profile", "title")
_BOM = "^\\x{FEFF}"


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Rows (file, line_no, line) of text files, whole files at a time so that numbers hold; a leading byte-order mark goes."""
    t = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", _BOM, "").alias("v"))
    return t.select("file", F.posexplode(F.split("v", "\n")).alias("p", "line")).select("file", (F.col("p") + 1).alias("line_no"), F.regexp_replace("line", r"\r\z", "").alias("line"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a manifest, with their defaults. None at all is an error."""
    from quire.operators.fetching import completed_docs

    text = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", _BOM, "").alias("v"))
    one = ", ".join(f"{f}: string" for f in DOC_FIELDS)
    t = text.select(F.from_json("v", f"struct<docs: array<struct<{one}>>>").alias("m")).select(F.posexplode("m.docs").alias("ord", "d")).select("ord", "d.*")
    t = t.select("ord", *(F.coalesce(f, F.lit("")).alias(f) for f in DOC_FIELDS))
    if t.isEmpty():
        raise ValueError(f"{path}: no docs")
    return completed_docs(t)


def profile(spark: SparkSession, path: str) -> dict:
    """A profile over the defaults: what the file names holds, an empty list or 0 included."""
    import json

    given = json.loads(spark.read.text(path, wholetext=True).select(F.regexp_replace("value", _BOM, "")).first()[0])
    return PROFILE | {k: v for k, v in given.items() if k in PROFILE}


def save_profile(values: dict, path: str) -> None:
    import json

    with open(path, "w", encoding="utf-8") as f:
        f.write(json.dumps(values, ensure_ascii=False, indent=2) + "\n")


def tsv(lines: DataFrame, names: tuple[str, ...], checked: bool) -> DataFrame:
    """Rows of the tab-separated lines with at least so many columns; the file has no quoting."""
    c = F.split("line", "\t")
    ok = F.lit(True)
    if checked:
        ok = F.when(F.col("line_no") == 1, F.assert_true(F.startswith("line", F.lit(names[0] + "\t")), F.lit(f"the header isn't that of {names[0]}")).isNull()).otherwise(True)
    t = lines.where(ok).where((F.col("line_no") > 1) & (F.size(c) >= len(names)))
    return t.select("file", "line_no", *(F.get(c, F.lit(i)).alias(n if n != "file" else "target") for i, n in enumerate(names)))


def command_index(spark: SparkSession, path: str) -> DataFrame:
    """Rows (ord, command, entry, source) of a commands.tsv; shorter rows are passed over."""
    t = tsv(numbered_lines(spark, path), COMMANDS_HEADER, checked=True)
    return t.select(F.col("line_no").alias("ord"), "command", "entry", "source")


def section_index(spark: SparkSession, path: str) -> DataFrame:
    """Rows (ord, section, title, target, line, source) of a sections.tsv. A line that is no number from 1 on fails the read."""
    t = tsv(numbered_lines(spark, path), SECTIONS_HEADER, checked=False)
    n = F.when(F.col("line").rlike(r"^\d+\z"), F.col("line").try_cast("int"))
    n = F.when(n >= 1, n).otherwise(F.raise_error(F.concat(F.lit("bad line "), "line")).cast("int"))
    return t.select(F.col("line_no").alias("ord"), "section", "title", "target", n.alias("line"), "source")


def derived_rows(spark: SparkSession, path: str) -> DataFrame:
    """Difference rows given by hand: blank lines and comments are passed over, the header and six columns are checked."""
    t = numbered_lines(spark, path).where((T.trim(F.col("line")) != "") & ~F.startswith("line", F.lit("#")))
    first = t.agg(F.min_by("line", "line_no").alias("l"), F.min("line_no").alias("n")).first()
    if first["l"] != "\t".join(DERIVED_HEADER):
        raise ValueError(f"{path}: another header")
    c = F.split("line", "\t")
    c = F.when(F.size(c) == 6, c).otherwise(F.raise_error(F.concat(F.lit("not six columns: "), "line")).cast("array<string>"))
    t = t.where(F.col("line_no") != first["n"]).select(F.col("line_no").alias("ord"), c.alias("c"))
    g = lambda i: F.get("c", F.lit(i))
    return t.select("ord", g(0).alias("kind"), g(1).alias("left"), g(2).alias("right"), F.lit("derived").alias("source"), g(3).alias("ref_left"), g(4).alias("ref_right"), g(5).alias("note"))


def difference_tables(spark: SparkSession, folder: str, sections: DataFrame, title: str = "IXシリーズとの差分") -> DataFrame:
    """Tables (table_id, kind, ref, rows) of the difference chapter: the last section of the index whose title holds `title` and whose number has no dot names the file.

    A heading's kind comes from its words or its parent's kind; its ref is the index row that points at its line, or the ref before.
    """
    from quire.operators.arrow import mapped
    from quire.operators.output import decode_row

    chapter = sections.where(F.contains("title", F.lit(title)) & ~F.contains("section", F.lit("."))).agg(F.max_by("target", "ord").alias("target")).first()["target"]
    if chapter is None:
        raise ValueError(f"no section {title}")
    refs = sections.where(F.col("target") == chapter).select("line", "source")
    lines = numbered_lines(spark, posixpath.join(folder, chapter)).join(refs.withColumnRenamed("line", "line_no"), "line_no", "left")
    one = lines.agg(F.array_sort(F.collect_list(F.struct("line_no", "line", "source"))).alias("x"))  # one chapter's file

    def of(r: dict) -> list[dict]:
        import re

        words = [(w, k) for w, k in C.DIFFERENCE_KINDS]
        kinds: dict[int, str] = {}
        kind, ref, rows, out = "", "", [], []
        for x in [*r["x"], {"line": "", "source": None}]:
            if kind and re.match(r"\|.*\|\s*\Z", x["line"]):
                if not re.match(r"\|(?:\s*:?-+:?\s*\|)+\s*\Z", x["line"]):
                    rows.append(decode_row(x["line"]))
                continue
            if len(rows) >= 2:
                out.append({"table_id": f"{len(out):08d}", "kind": kind, "ref": ref, "rows": rows})
            rows = []
            if m := re.match(r"(#{2,6}) (\S+) (.+)\Z", x["line"]):
                depth = len(m[1])
                kind = next((k for w, k in words if w in m[3]), kinds.get(depth - 1, ""))
                kinds = {d: k for d, k in kinds.items() if d < depth} | {depth: kind}
                ref = x["source"] or ref
        return out

    return mapped(one, of, "table_id string, kind string, ref string, rows array<array<string>>")


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """Rows (name, entry map): the map under `devices`, or the whole file; names that begin with _ are passed over, entries must be objects."""
    text = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", _BOM, "").alias("v"))
    body = F.coalesce(F.get_json_object("v", "$.devices"), "v")
    raw = text.select(F.explode(F.map_filter(F.from_json(body, "map<string, string>"), lambda k, _: ~F.startswith(k, F.lit("_")))).alias("name", "e"))
    ok = F.when(F.startswith(F.ltrim("e"), F.lit("{")), F.from_json("e", "map<string, string>")).otherwise(F.raise_error(F.concat("name", F.lit(": not an object"))).cast("map<string, string>"))
    return raw.select("name", ok.alias("entry"))


def inventory_path(override: str | None, env: dict[str, str], default: str) -> tuple[str, bool]:
    """(path, may be absent): the flag, else the variable, else the default, which alone may be absent."""
    named = override or env.get(INVENTORY_VARIABLE, "")
    return (named, False) if named else (default, True)


def pages(spark: SparkSession, folder: str) -> DataFrame:
    """Rows (path, html) of the .html files under the folder, the ending in small letters; paths are relative."""
    t = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).where(F.col("path").rlike(r"\.html\z"))
    root = posixpath.normpath(folder.removeprefix("file://"))
    rel = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), f"^{root}/", "")
    return t.select(rel.alias("path"), F.decode("content", "utf-8").alias("html"))


def image_files(spark: SparkSession, folder: str) -> DataFrame:
    """Rows (name, content) of the folder's .png files, whatever the case of the ending; folders inside are passed over."""
    t = spark.read.format("binaryFile").load(folder).where(F.lower("path").rlike(r"\.png\z"))
    return t.select(F.substring_index("path", "/", -1).alias("name"), "content")


def glyphs(spark: SparkSession, path: str, pages: int | None = None) -> DataFrame:
    """Glyph rows in Parquet; a limit on pages reaches the scan."""
    t = spark.read.parquet(path)
    return t.where(F.col("page") <= pages) if pages else t


def page_size(glyph_rows: DataFrame) -> DataFrame:
    """Width and height of each document's first page."""
    return glyph_rows.where("page = 1").groupBy("doc").agg(F.first("width").alias("width"), F.first("height").alias("height"))


def web_meta(spark: SparkSession, path: str) -> DataFrame:
    names = ("name", "title", "url", "version", "series", "profile", "fetched")
    kind = ", ".join(f"{n} string" for n in names)
    return spark.read.schema(kind).option("multiLine", "true").json(path).select(*(F.coalesce(n, F.lit("")).alias(n) for n in names))


def etags(spark: SparkSession, path: str) -> DataFrame:
    """Rows (path, etag, last_modified) of a cache's sidecar."""
    t = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string, struct<etag: string, last_modified: string>>")).alias("path", "e"))
    return t.select("path", "e.etag", "e.last_modified")


def config_lines(spark: SparkSession, path: str) -> DataFrame:
    """Rows (seq, line) of a configuration file."""
    t = spark.read.text(path, wholetext=True).select(C.config_lines(F.regexp_replace("value", _BOM, "")).alias("l"))
    return t.select(F.posexplode("l").alias("p", "line")).select((F.col("p") + 1).alias("seq"), "line")


#: Fixed value: a directive is a word, white space or one equals sign, and the rest.
_DIRECTIVE = re.compile(r"(\w+)(?:[ \t]*=[ \t]*|[ \t]+)(.*)\Z")


def _ssh_words(rest: str) -> list[str]:
    """Words, those in double quotes whole; nothing is an escape."""
    return [q or w for q, w in re.findall(r'"([^"]*)"|([^\s"]+)', rest)]


def _ssh_lines(file: str, level: int, depth: int) -> list[tuple[str, str]]:
    """(key in small letters, rest) of each directive, those of included files in place; a file that isn't there has none."""
    if level > depth:
        raise ValueError(f"{file}: Include goes deeper than {depth}")
    out: list[tuple[str, str]] = []
    if not os.path.isfile(file):
        return out
    with open(file, encoding="utf-8-sig", errors="replace") as f:
        found = [_DIRECTIVE.match(x.strip()) for x in f]
    for m in filter(None, found):
        key, rest = m[1].lower(), m[2].strip()
        if key != "include":
            out.append((key, rest))
            continue
        for pattern in _ssh_words(rest):
            p = os.path.expanduser(pattern)
            for one in sorted(glob.glob(p if os.path.isabs(p) else os.path.join(os.path.dirname(file), p))):
                out += _ssh_lines(one, level + 1, depth)
    return out


def ssh_directives(spark: SparkSession, path: str, depth: int = 8) -> DataFrame:
    """Rows (patterns, ord, key, value) of an ssh configuration, Include files read in place; deeper than `depth` is an error.

    patterns are those of the Host line above, `*` before any; one with `!` in front excludes. Of Match lines only `all`, `host`
    and `originalhost` have a meaning here, others are an error. A configuration is a few small files, so this runs in the driver.
    """
    rows, patterns = [], ["*"]
    for i, (key, rest) in enumerate(_ssh_lines(path, 0, depth)):
        if key == "host":
            patterns = _ssh_words(rest)
        elif key == "match":
            kind, *names = _ssh_words(rest.lower() if rest.lower() == "all" else rest)
            if kind.lower() not in ("all", "host", "originalhost"):
                raise ValueError(f"{path}: Match {kind} isn't supported")
            patterns = ["*"] if kind.lower() == "all" else [x for n in names for x in n.split(",")]
        else:
            value = rest[1:-1] if len(rest) > 1 and rest[0] == rest[-1] == '"' else rest
            rows.append((patterns, i, key, value))
    return spark.createDataFrame(rows, "patterns array<string>, ord int, key string, value string")
