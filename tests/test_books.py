"""Books out of glyphs, and known answers of the queries that have no SQL."""

import pytest

from quire.operators import output, ruled
from quire.plans import books
from quire.plans import document_queries as Q
from quire.sources import readers, sinks

W, H = 516.0, 728.0


def row(page, y, text, x=50.0, size=10.0, seq=0):
    return [("d", page, int(y * 1000 + x) + i, c, x + i * size, x + i * size + size * 0.9, y + size / 2, y - size / 2, size, text[i - 1 : i] == " ", W, H) for i, c in enumerate(text) if c != " "]


SCHEMA = Q.GLYPHS.schema
PROFILE = readers.PROFILE | {"columns": 1, "chapterSep": "", "footerSection": True}


def test_a_section_book_out_of_glyphs(spark, tmp_path):
    xs, ys = (50.0, 150.0, 250.0), (520.0, 500.0, 480.0, 460.0)
    rules = [("d", p, True, x, ys[-1], ys[0]) for p in (1, 2) for x in xs] + [("d", p, False, y, xs[0], xs[-1]) for p in (1, 2) for y in ys]
    cells = lambda p, rows: [g for r, line in enumerate(rows) for c, t in enumerate(line) for g in row(p, 510 - 20 * r, t, 60.0 + 100 * c, 8.0)]
    glyphs = [
        *row(1, 650, "2. 設定編"), *row(1, 600, "2.1 概要", size=14.0), *row(1, 560, "本文の行であるからつづく。"), *cells(1, (("k", "v"), ("a", "1"), ("a", "2"))), *row(1, 20, "経路 2-1"),
        *cells(2, (("a", "3"), ("a", "4"), ("a", "5"))), *row(2, 400, "2.2 運用", size=14.0), *row(2, 380, "2.9 no heading"), *row(2, 360, "ab", x=50.0), *row(2, 360, "cd", x=300.0), *row(2, 345, "ef", x=50.0), *row(2, 345, "gh", x=300.0), *row(2, 20, "経路 2-2"),
    ]
    # the second page's table has the first one's body right above it
    df = spark.createDataFrame(glyphs, SCHEMA)
    got = books.convert_glyph_sections(df, spark.createDataFrame(rules, Q.RULES.schema), PROFILE | {"fieldLabels": []}, f"{tmp_path}/fd")
    assert got == {"items": 2, "files": 1, "rows": 2, "layout": 3, "tables": 2, "figures": 0, "pages": 2}
    index = [x.split("\t") for x in (tmp_path / "fd/sections.tsv").read_text().strip().split("\n")]
    assert [x[:2] + x[4:] for x in index[1:]] == [["2.1", "概要", "p1"], ["2.2", "運用", "p2"]]
    text = (tmp_path / "fd" / index[1][2]).read_text()
    assert index[1][2] == "ch02-設定編/経路.md"
    for x in index[1:]:
        assert x[1] in text.split("\n")[int(x[3]) - 1]
    assert "| k | v |\n|---|---|\n| a | 1 |\n| a | 2 |\n" in text
    assert "| k | v |\n|---|---|\n| a | 3 |\n| a | 4 |\n| a | 5 |\n" in text  # the header is carried over
    assert text.index("本文の行である") < text.index("| a | 1 |") < text.index("| a | 3 |") < text.index("2.2 運用") < text.index("```text") < text.index("2.9 no heading")


def test_a_command_book_out_of_glyphs(spark, tmp_path):
    glyphs = [*row(1, 650, "■経路"), *row(1, 620, "入力形式"), *row(1, 605, "ip route A"), *row(1, 590, "no ip route A"), *row(1, 560, "説明  経路を設定する。"), *row(1, 20, "経路 1-1"), *row(2, 650, "説明"), *row(2, 600, "■再起動"), *row(2, 580, "入力形式"), *row(2, 565, "reload"), *row(2, 20, "操作 1-2"), *row(3, 650, "索引")]
    sinks._put(f"{tmp_path}/x", b"")
    spark.createDataFrame(glyphs, SCHEMA).write.parquet(f"{tmp_path}/glyphs")
    got = books.convert_glyphs(spark, f"{tmp_path}/glyphs", None, PROFILE, f"{tmp_path}/crm")
    assert got["items"] == 2 and got["rows"] == 2 and got["pages"] == 3
    index = [x.split("\t") for x in (tmp_path / "crm/commands.tsv").read_text().strip().split("\n")[1:]]
    assert [(x[0], x[1], x[4]) for x in index] == [("ip route A", "経路", "p1"), ("reload", "再起動", "p2")]
    for _, title, file, line, _ in index:
        assert (tmp_path / "crm" / file).read_text().split("\n")[int(line) - 1] == f"## {title}"
    with pytest.raises(ValueError):
        books.convert_glyph_commands(spark.createDataFrame(row(1, 650, "索引"), SCHEMA), PROFILE, f"{tmp_path}/no")


def test_page_text(spark):
    got = {(r.doc, r.page): r.text for r in Q.glyph_text(spark, "").collect()}
    assert [x.strip() for x in got[("d", 1)].split("\n") if x] == ["頭", "２．１ 概要", "本文の行である", "続きの行"][-len([x for x in got[("d", 1)].split("\n") if x]) :]
    lines = got[("d", 2)].split("\n")
    assert lines[0].split() == ["abc", "right"] and lines[1] == "L2" and len(lines[0]) - len("right") > 20


def test_headings_by_size(spark):
    assert [tuple(r) for r in Q.glyph_headings(spark, "").collect()] == [("d", 1, "２．１概要")]


def test_headings_and_their_blocks(spark):
    import json

    got = sorted(Q.section_fold(spark, "").collect(), key=lambda r: r.ord)
    assert [(r.number, r.title, r.depth, r.page) for r in got] == [("2.1", "概要", 2, 1), ("2.2", "設定", 2, 2)]
    first = json.loads(got[0].blocks)
    assert [(b["kind"], [x for x in b["lines"] if x]) for b in first] == [("prose", ["本文です。"]), ("layout", ["a     b", "c     d"]), ("prose", ["one    line", "3.1 other chapter"])]
    assert ["a     b", "", "c     d"] in [b["lines"] for b in first]
    assert [b["kind"] for b in json.loads(got[1].blocks)] == ["prose"] and "3.1 other chapter" not in [r.title for r in got]


def test_carried_headers(spark):
    got = {r.page: r for r in Q.carried_headers(spark, "").collect()}
    assert got[1].header_page == 1 and got[2].header_page == 1 and got[2].rows.startswith('[["K","V","W"],["a","3","z"]')


def test_image_pages_and_figures(spark, tmp_path):
    import numpy as np

    img = np.full((40, 40), 255, np.uint8)
    df = spark.createDataFrame([("s", 40, 40, img.ravel().tolist())], "name string, w int, h int, pix array<int>")
    assert sinks.write_images(ruled.split_scans(df), f"file://{tmp_path}/pages") == 2
    assert (tmp_path / "pages/s-1.pgm").read_bytes().startswith(b"P5\n20 36\n255\n")
    (tmp_path / "src/a").mkdir(parents=True)
    (tmp_path / "src/a/x.png").write_bytes(b"1")
    (tmp_path / "src/X.png").write_bytes(b"2")
    names = output.figure_names(spark.createDataFrame([("b", 1, "a/x.png"), ("b", 2, "X.png"), ("b", 3, "a/x.png")], "book string, ord int, source string"))
    assert sinks.copy_figures(names, f"file://{tmp_path}/src", f"file://{tmp_path}/out") == 2
    assert {p.name: p.read_bytes() for p in (tmp_path / "out").iterdir()} == {"x.png": b"1", "X-2.png": b"2"}
    with pytest.raises(Exception, match="gone"):
        sinks.copy_figures(spark.createDataFrame([("gone.png", "g.png")], "source string, name string"), f"file://{tmp_path}/src", f"file://{tmp_path}/out")
    assert not list((tmp_path / "out").glob("*.part"))


def test_private_files(tmp_path):
    p = str(tmp_path / "b.conf")
    assert sinks.write_backup("x", p) and sinks.is_private(p)
    (tmp_path / "open").write_text("x")
    (tmp_path / "open").chmod(0o644)
    assert not sinks.is_private(str(tmp_path / "open")) and not sinks.is_private(str(tmp_path / "none"))


def test_tables_of_any_length_are_streamed(spark, tmp_path):
    rows = spark.range(2000).selectExpr("cast(id as string) a", "'x\ty' b")
    assert sinks.write_tsv(rows.orderBy("id"), f"{tmp_path}/t.tsv", ("a", "b"), folded=("b",)) == 2000
    lines = (tmp_path / "t.tsv").read_text().split("\n")
    assert lines[0] == "a\tb" and lines[1] == "0\tx y" and len(lines) == 2002


def test_command_line(spark, tmp_path, capsys):
    from quire import __main__ as cli

    for path, text in Q.SITE:
        (tmp_path / "in" / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / path).write_text(text)
    assert cli.main(["html", f"file://{tmp_path}/in", f"{tmp_path}/out"]) == 0
    assert capsys.readouterr().out.strip() == '{"items": 1, "files": 1, "rows": 1}'
    assert cli.main(["glyphs", f"{tmp_path}/none", f"{tmp_path}/out"]) == 1 and capsys.readouterr().err.startswith("quire: ")
    with pytest.raises(SystemExit):
        cli.main(["html"])
