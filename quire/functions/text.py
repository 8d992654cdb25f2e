"""Text expressions: white space, line classes, Markdown and TSV encodings.

All are built-in functions; those over arrays (transform, filter, aggregate) run outside generated code, but in the JVM. Patterns are written so that Java's engine and RE2 read them alike: no
look-around, `\\z` for the very end, code points as \\x{...}.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space, what folds into one space, and the characters of the tests below.
SPACE = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
FOLDED = r"[ \t\r\n\x{3000}]+"
GLYPH_SPACE = r"[\t-\r \x{00}\x{A0}\x{3000}\x{FEFF}]"
JAPANESE = r"[\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{FF66}-\x{FF9D}]"
BULLETS = "•・※➢‒–—-*"
PARAMETER = "．．．"
ENDS = "[。！？!?]"
EMPTY_FIELDS = ("なし", "なし。", "特になし", "特になし。", "－", "-", "省略可能", "省略可能。")
LABELS = {"ユーザ権限": "ユーザー権限"}
UNTITLED, OTHER_CHAPTER = "無題", "ch00-その他"
VERSION = r"[A-Za-z0-9]+(?:[._+-][A-Za-z0-9]+)*"


def trim(s: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.btrim(s, F.lit(SPACES))


def collapse(s: Column) -> Column:
    """Runs of blanks, tabs, line ends and ideographic spaces become one space; the ends are trimmed."""
    return trim(F.regexp_replace(s, FOLDED, " "))


def indent(s: Column) -> Column:
    return F.length(s) - F.length(F.ltrim(s))


def normalize_label(s: Column) -> Column:
    return F.coalesce(*(F.when(s == a, F.lit(b)) for a, b in LABELS.items()), s)


def heading_number(s: Column) -> Column:
    """Full-width digits and stops to ASCII."""
    return F.translate(s, "０１２３４５６７８９．", "0123456789.")


def footer_section(s: Column) -> Column:
    """struct<section, printed>: the first `n-n` and what the footer holds beside it; both empty without one."""
    printed = F.regexp_extract(s, r"\b(\d+-\d+)\b", 1)
    at = F.instr(s, printed)
    rest = F.concat(F.substring(s, F.lit(1), at - 1), F.substring(s, at + F.length(printed), F.length(s)))
    return F.when(printed == "", F.struct(F.lit("").alias("section"), F.lit("").alias("printed"))).otherwise(F.struct(collapse(rest).alias("section"), printed.alias("printed")))


def running_header(s: Column, sep: str) -> Column:
    """struct<chapter, section> at the first separator."""
    if not sep:
        return F.struct(F.lit("").alias("chapter"), s.alias("section"))
    at = F.instr(s, F.lit(sep))
    return F.struct(F.when(at > 0, F.substring(s, F.lit(1), at - 1)).otherwise("").alias("chapter"), F.when(at > 0, F.substring(s, at + len(sep), F.length(s))).otherwise(s).alias("section"))


def chapter_of(printed: Column) -> Column:
    return F.coalesce(F.regexp_extract(printed, r"^(\d+)-\d+\z", 1).try_cast("int"), F.lit(0))


def first_token(s: Column) -> Column:
    return F.regexp_extract(s, rf"^{SPACE}*([^\t-\r \x{{85}}\x{{A0}}\x{{3000}}]+)", 1)


def trimmed_lines(s: Column) -> Column:
    """Lines without blank ones at either end."""
    inner = F.regexp_replace(F.regexp_replace(s, rf"^(?:{SPACE}*\n)+", ""), rf"(?:\n{SPACE}*)+\z", "")
    return F.when(trim(s) == "", F.array().cast("array<string>")).otherwise(F.split(inner, "\n"))


def interior_gap(s: Column) -> Column:
    """The longest run of spaces inside the line."""
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(F.trim(s), F.lit(" +"), F.lit(0)), F.length)), F.lit(0))


def has_japanese(s: Column) -> Column:
    return s.rlike(JAPANESE)


def is_bullet(s: Column) -> Column:
    return s.rlike(r"^[•・※➢‒–—*\-]") & ~s.rlike(rf"^※{SPACE}*[0-9]")


def strip_bullet(s: Column) -> Column:
    return F.when(s.rlike(r"^[•・※➢‒–—*\-]"), trim(F.substring(s, F.lit(2), F.length(s)))).otherwise(s)


def is_parameter(s: Column) -> Column:
    return F.contains(s, F.lit(PARAMETER))


def starts_unit(s: Column) -> Column:
    return is_bullet(s) | is_parameter(s)


def ends_sentence(s: Column) -> Column:
    return s.rlike(rf"{ENDS}{SPACE}*\z")


def is_empty_field(lines: Column) -> Column:
    return (F.size(lines) == 1) & trim(F.get(lines, F.lit(0))).isin(*EMPTY_FIELDS)


def line_rule(s: Column, trimmed: Column | None = None) -> Column:
    """Which rule classifies the line: blank, bullet, sentence, gap, foreign, short or long. trimmed: trim(s), where it is at hand as a column."""
    t = trim(s) if trimmed is None else trimmed
    return (
        F.when(t == "", F.lit("blank"))
        .when(is_bullet(t), F.lit("bullet"))
        .when(F.substring(t, -1, 1).isin("。", "！", "？", "!", "?"), F.lit("sentence"))
        .when(F.contains(s, F.lit("   ")) & (interior_gap(s) >= 3), F.lit("gap"))
        .when(~has_japanese(t), F.lit("foreign"))
        .when(F.length(t) < 22, F.lit("short"))
        .otherwise(F.lit("long"))
    )


def line_kind(rule: Column) -> Column:
    return F.when(rule.isin("gap", "foreign", "short"), F.lit("layout")).when(rule == "blank", F.lit("blank")).otherwise(F.lit("prose"))


def joiner(before: Column, after: Column) -> Column:
    """A space between two ASCII letters or digits."""
    return F.when(before.rlike(r"[A-Za-z0-9]\z") & after.rlike("^[A-Za-z0-9]"), F.lit(" ")).otherwise(F.lit(""))


# A variable in angle brackets, and the characters that make one run with it.
_GROUP = r"<[^\s<>](?:[^<>\n]{0,38}[^\s<>])?>"
_GLUE = r"[!-;=?-_a-~]"


def inline_markup(s: Column) -> Column:
    """Runs around <variables> become code spans; a run that holds a back-tick stays."""
    run = f"(?:{_GLUE}|{_GROUP})*{_GROUP}(?:{_GLUE}|{_GROUP})*"
    pieces, between = F.regexp_extract_all(s, F.lit(f"({run})"), F.lit(0)), F.split(s, run, -1)
    wrapped = F.transform(pieces, lambda x: F.when(F.contains(x, F.lit("`")), x).otherwise(F.concat(F.lit("`"), x, F.lit("`"))))
    joined = F.array_join(F.zip_with(between, wrapped, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return F.when(F.contains(s, F.lit("<")), joined).otherwise(s)


def link_target(path: Column) -> Column:
    return F.when(path.rlike("[ ()]"), F.concat(F.lit("<"), path, F.lit(">"))).otherwise(path)


def safe_name(s: Column) -> Column:
    t = F.regexp_replace(F.regexp_replace(trim(s), r'[<>:"/\\|?*\x{00}-\x{1F}]', "-"), r"^[ .]+|[ .]+\z", "")
    return F.when(t == "", F.lit(UNTITLED)).otherwise(F.substring(t, 1, 60))


def chapter_folder(chapter: Column, title: Column) -> Column:
    return F.when(chapter > 0, F.concat(F.lit("ch"), F.when(chapter < 10, F.lpad(chapter.cast("string"), 2, "0")).otherwise(chapter.cast("string")), F.lit("-"), safe_name(title))).otherwise(F.lit(OTHER_CHAPTER))


def tsv_cell(s: Column) -> Column:
    return collapse(F.replace(F.replace(s, F.lit("\t"), F.lit(" ")), F.lit("\n"), F.lit(" / ")))


def table_cell(s: Column) -> Column:
    """One cell of a Markdown table."""
    for a, b in (("\\", "\\\\"), ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("|", "\\|"), ("\n", "<br>")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def dedent(lines: Column) -> Column:
    """Without the common indent of spaces of the lines that aren't blank."""
    real = F.filter(lines, lambda x: trim(x) != "")
    n = F.coalesce(F.array_min(F.transform(real, indent)), F.lit(0))
    return F.transform(lines, lambda x: F.when(indent(x) >= n, F.substring(x, n + 1, F.length(x))).otherwise(F.ltrim(x)))


def blank_lines(gap: Column, spacing: Column) -> Column:
    ratio = gap / F.when(spacing > 0, spacing)
    return F.when(ratio >= 2.2, F.lit(2)).when(ratio >= 1.35, F.lit(1)).otherwise(F.lit(0))


def source_ref(path: Column, anchor: Column, page: Column) -> Column:
    return F.when(path != "", F.when(anchor != "", F.concat_ws("#", path, anchor)).otherwise(path)).when(page > 0, F.concat(F.lit("p"), page.cast("string"))).otherwise("")


def matches_version(title: Column, version: Column) -> Column:
    return F.array_contains(F.regexp_extract_all(title, F.lit(VERSION), F.lit(0)), version)


def doc_error(series: Column, book: Column) -> Column:
    """Null for a good manifest row."""
    return F.when(book == "", F.lit("no book")).when(~book.isin("crm", "fd", "ex", "slog"), F.lit("unknown book")).when(series == "", F.lit("no series"))


def columns_match(left: Column, right: Column, total: Column) -> Column:
    count = lambda s: F.length(F.regexp_replace(s, SPACE, ""))
    slack = F.least(F.lit(24), F.greatest(F.lit(4), F.floor(total / 50)))
    return (F.abs(count(left) + count(right) - total) <= slack) & (count(right) > 0)


def mask_url_tokens(s: Column, mask: str = "[REDACTED]") -> Column:
    """Whole tokens that hold `://` and `@` or `?`."""
    return F.regexp_replace(s, r"\S*://\S*[@?]\S*|\S*[@?]\S*://\S*", mask)


def columns_wide(s: Column) -> Column:
    """Columns of a character cell grid: East Asian wide characters take two."""
    wide = r"[\x{1100}-\x{115F}\x{2E80}-\x{A4CF}\x{AC00}-\x{D7A3}\x{F900}-\x{FAFF}\x{FE30}-\x{FE6F}\x{FF00}-\x{FF60}\x{FFE0}-\x{FFE6}]"
    return F.length(s) + F.regexp_count(s, F.lit(wide))


def prefix_lines(s: Column, prefix: str) -> Column:
    return F.regexp_replace(s, r"(?m)^(?!\z)", prefix)


def text_key(s: Column) -> Column:
    return F.regexp_replace(s, SPACE, "")


def or_default(s: Column, kind: str, default, least=None) -> Column:
    """A parsed number, or the default where the text is none or under `least`."""
    x = trim(s).try_cast(kind)
    return F.coalesce(F.when(x >= least, x) if least is not None else x, F.lit(default))


def page_list(spec: Column, pages: Column) -> Column:
    """`3,1-2,2` to [3, 1, 2]: ranges are clamped to 1..pages, repeats dropped; empty: all pages. Null for a bad, reversed or empty specification."""
    part = F.transform(F.split(spec, ","), trim)
    good = F.forall(part, lambda x: x.rlike(r"^\d{1,9}(?:\s*-\s*\d{1,9})?\z"))
    lo = lambda x: F.regexp_extract(x, r"^(\d+)", 1).try_cast("int")
    hi = lambda x: F.coalesce(F.regexp_extract(x, r"-\s*(\d+)\z", 1).try_cast("int"), lo(x))
    rows = F.transform(part, lambda x: F.when(F.greatest(lo(x), F.lit(1)) <= F.least(hi(x), pages), F.sequence(F.greatest(lo(x), F.lit(1)), F.least(hi(x), pages))).otherwise(F.array().cast("array<int>")))
    some = F.array_distinct(F.flatten(rows))
    ok = good & F.forall(part, lambda x: lo(x) <= hi(x))
    return F.when(trim(spec) == "", F.sequence(F.lit(1), pages)).when(ok, F.when(F.size(some) > 0, some))


def relative_link(folder: Column, target: Column) -> Column:
    """The way from a folder to a file, both relative to the same root and without `.` or `..`: up as often as needed, then down."""
    a, b = (F.filter(F.split(x, "/"), lambda p: p != "") for x in (folder, target))
    same = F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.size(a), F.lit(1))), lambda n: (n <= F.size(a)) & (n < F.size(b)) & (F.slice(a, F.lit(1), n) == F.slice(b, F.lit(1), n))))
    up = F.array_repeat(F.lit(".."), F.size(a) - same)
    return F.array_join(F.concat(up, F.slice(b, same + 1, F.size(b))), "/")
