"""Expressions on command syntax: keywords, families, alternatives, diagnostics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import collapse, indent, trim

KEYWORD = r"^[a-z][a-z0-9./-]*\z"
# Labels of syntax fields, kinds of difference tables by words of their titles (first that fits), message words.
SYNTAX, EXAMPLE = "入力形式", "入力例"
DIFFERENCE_KINDS = (("廃止", "removed"), ("表現の変更", "renamed"), ("モード", "moved"), ("デフォルト値", "range"), ("設定範囲", "range"), ("その他変更", "changed"))
UNIFIED = r"([a-z][a-z0-9-]*(?: [a-z][a-z0-9-]*)*) ?コマンドに統一"
ALTERNATIVES = r"[\[{] ?([a-z0-9-]+(?: \| [a-z0-9-]+)+) ?[\]}]"
FAILURE_WORDS = ("invalid", "incomplete", "ambiguous", "error", "failed", "failure", "denied", "cannot", "can't", "unable", "insufficient", "not found", "not allowed", "not permitted", "not supported")


def tokens(s: Column) -> Column:
    return F.filter(F.split(trim(F.regexp_replace(s, r"[\t-\r \x{3000}\x{A0}]+", " ")), " "), lambda x: x != "")


def keywords(s: Column) -> Column:
    """The leading run of keyword tokens."""
    t = tokens(s)
    stop = F.array_position(F.transform(t, lambda x: x.rlike(KEYWORD)), False)
    return F.slice(t, F.lit(1), F.when(stop == 0, F.size(t)).otherwise(stop.cast("int") - 1))


def family(s: Column) -> Column:
    """The first two keywords, three after show or clear; all where there are fewer."""
    k = keywords(s)
    return F.array_join(F.slice(k, F.lit(1), F.when(F.get(k, F.lit(0)).isin("show", "clear"), F.lit(3)).otherwise(F.lit(2))), " ")


def covers(n: Column, want: Column, have: Column) -> Column:
    """May a common prefix of n keywords count as a match?"""
    return ((n == want) & (n == have)) | ((n >= 2) & ((n == want) | (n == have)))


def commands_of(lines: Column) -> Column:
    """Commands of an entry from its ordered array<struct<field, line>> of syntax lines: continuations joined, `no` forms and repeats dropped.

    A line continues the command before it if it is indented deeper than the first real line of its field or doesn't begin with a lower-case letter.
    """
    real = F.filter(lines, lambda x: trim(x["line"]) != "")
    start = F.struct(F.lit(None).cast("int").alias("field"), F.lit(0).alias("base"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        t = trim(x["line"])
        base = F.when(s["field"].eqNullSafe(x["field"]), s["base"]).otherwise(indent(x["line"]))
        more = (indent(x["line"]) > base) | ~t.rlike("^[a-z]")
        n = F.size(s["out"])
        out = F.when(~more, F.concat(s["out"], F.array(t))).when(n == 0, s["out"]).otherwise(F.concat(F.slice(s["out"], F.lit(1), n - 1), F.array(F.concat_ws(" ", F.get(s["out"], n - 1), t))))
        return F.struct(x["field"].cast("int").alias("field"), base.alias("base"), out.alias("out"))

    return F.array_distinct(F.filter(F.aggregate(real, start, step)["out"], lambda c: ~F.startswith(c, F.lit("no "))))


def difference_kind(title: Column) -> Column:
    """Null where no word says."""
    return F.coalesce(*(F.when(F.contains(title, F.lit(w)), F.lit(k)) for w, k in DIFFERENCE_KINDS))


def open_alternatives(s: Column) -> Column:
    """All commands that the choices between keywords stand for, in order."""

    def once(c: Column) -> Column:
        whole, inner = F.regexp_extract(c, f"({ALTERNATIVES})", 1), F.regexp_extract(c, ALTERNATIVES, 1)
        at = F.instr(c, whole)
        return F.when(whole == "", F.array(c)).otherwise(F.transform(F.split(inner, r" \| "), lambda a: collapse(F.concat(F.substring(c, F.lit(1), at - 1), a, F.substring(c, at + F.length(whole), F.length(c))))))

    choices = F.length(s) - F.length(F.translate(s, "[{", ""))  # at most
    return F.aggregate(F.sequence(F.lit(1), F.greatest(choices, F.lit(1))), F.array(s), lambda out, _: F.flatten(F.transform(out, once)))


def cell_lines(s: Column) -> Column:
    return F.filter(F.transform(F.split(s, "\n"), trim), lambda x: x != "")


def quoted(s: Column) -> Column:
    """The text as a pattern that matches just it."""
    return F.regexp_replace(s, r"([\\.\[\]{}()*+?^$|\-])", r"\\$1")


def command_error(command: Column, output: Column) -> Column:
    """`% <the input> -- <anything>`, or a % line with a failure word. A bare % says nothing."""
    t = trim(command)
    echoed = F.when(t != "", F.rlike(output, F.concat(F.lit(r"(?im)^[ \t]*%[ \t]*"), quoted(t), F.lit(r"[ \t]+--[ \t]*\S"))))
    words = "|".join(FAILURE_WORDS)
    return F.coalesce(echoed, F.lit(False)) | output.rlike(rf"(?im)^[ \t]*%[^\r\n]*\b(?:{words})\b")


def output_status(command: Column, output: Column) -> Column:
    """occupied, failed or ok."""
    return F.when(output.rlike(r"(?im)^[ \t]*%[ \t]*CONFIG process is occupied\."), F.lit("occupied")).when(command_error(command, output), F.lit("failed")).otherwise(F.lit("ok"))


def is_show(command: Column) -> Column:
    """Printable throughout, and its first word is show."""
    return ~command.rlike(r"[\p{C}\p{Zl}\p{Zp}]|[\p{Zs}&&[^ ]]") & (F.lower(F.regexp_extract(trim(command), r"^([^ ]*)", 1)) == "show")


def config_lines(text: Column) -> Column:
    """Lines of a configuration file without blank ones and comments; indents stay."""
    lines = F.split(text, r"\r\n|[\n\r\x{0B}\x{0C}\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]")
    return F.transform(F.filter(lines, lambda x: ~trim(x).rlike("^#") & (trim(x) != "")), lambda x: F.regexp_replace(x, r"[\t-\r \x{1C}-\x{1F}\x{85}\x{A0}\x{3000}]+\z", ""))


def stopped_at(number: Column, total: Column) -> Column:
    return F.concat(F.lit("configuration stopped at config line "), number.cast("string"), F.lit(" of "), total.cast("string"))


def slug(alias: Column) -> Column:
    return F.regexp_replace(alias, "[^A-Za-z0-9._-]", "_")


def backup_path(alias: Column, at: Column) -> Column:
    return F.concat(F.lit("backups/"), slug(alias), F.lit("-"), F.date_format(at, "yyyyMMdd-HHmmss"), F.lit(".conf"))
