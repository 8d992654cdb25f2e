"""Known answers for HTML, glyphs, rules, folds and files."""

import random

import numpy as np
import pytest

from quire.operators import dom, html, layout, output, ruled
from quire.plans import books, document_queries as Q
from quire.sources import readers, sinks


def test_left_out_end_tags():
    n = dom.parse("<ul><li>a<li>b</ul><p>one<p>two<div>x</div><script>var t='</p>'</script>")
    assert [k.text() for k in n.within() if k.tag == "li"] == ["a", "b"]
    assert [k.text() for k in n.within() if k.tag == "p"] == ["one", "two"]
    assert next(k for k in n.within() if k.tag == "script").kids == ["var t='</p>'"]
    assert dom.parse(None).kids == [] and dom.parse("<p" * 5000) is not None


def test_deep_nesting():
    assert dom.parse("<div>" * 20_000 + "x").text() == "x"


def test_spans():
    assert html.spread([[("a", 1, 2), ("b", 2, 1)], [("c", 1, 1), ("d", 1, 1)]]) == [["a", "b", "b"], ["a", "c", "d"]]
    assert html.spread([[("a", 1, 9)], []]) == [["a"], ["a"]]


@pytest.mark.parametrize("line, layout_", [("", False), ("• x", False), ("※1 脚注", True), ("a   b です。", False), ("日本語   表", True), ("show ip", True), ("短い行", True), ("この行は二十二文字より長い日本語の文なので地の文になるはず", False)])
def test_layout_lines(line, layout_):
    assert html.is_layout(line) is layout_


def test_svg_labels():
    svg = '<svg xmlns="http://www.w3.org/2000/svg"><text x="60" y="10">right</text><text x="10" y="10">le</text><text x="22" y="10">ft</text><text transform="matrix(1 0 0 1 10 40)">below</text></svg>'
    assert html.svg_labels(svg) == ["left  right", "below"] and html.svg_labels("<broken") == []


def test_markdown_rows_round_trip():
    g = random.Random(1)
    for _ in range(500):
        cells = ["".join(g.choice("|\\<>&b r\n;amp") for _ in range(g.randrange(8))).strip() for _ in range(3)]
        cells = ["\n".join(x.strip() for x in c.split("\n")).strip() for c in cells]
        assert output.decode_row(output.encode_row(cells, 3)) == cells


def test_generated_names_take_part(spark):
    rows = [("b", 1, "c", s, i) for i, s in enumerate(["x", "X", "x-2", "x"])]
    t = spark.createDataFrame(rows, "book string, chapter int, chapter_title string, section string, first_seen long")
    assert [r["file"] for r in output.file_names(t).orderBy("first_seen").collect()] == ["ch01-c/x.md", "ch01-c/X-2.md", "ch01-c/x-2-2.md", "ch01-c/x-3.md"]


def test_columns_keep_all_glyphs():
    g = random.Random(2)
    rows = []
    for i in range(400):
        x, y = g.uniform(0, 500), g.uniform(0, 700)
        rows.append({"seq": i, "r": chr(97 + i % 26), "left": x, "right": x + g.uniform(1, 20), "top": y + 10, "bottom": y, "width": 516.0, "space_before": False})
    a, b = layout.split_columns(rows, 516.0, 256, 262)
    assert sorted(x["seq"] for x in a + b) == list(range(400))


def _grid():
    return [r[2:] for r in Q._rules(1)]


def _glyphs(page=1):
    names = ["doc", "page", "seq", "r", "left", "right", "top", "bottom", "size", "space_before", "width", "height"]
    return [dict(zip(names, r, strict=True)) for r in Q.CELL_GLYPHS if r[1] == page]


def test_ruled_table():
    (t,) = ruled.tables_of(_grid(), _glyphs())
    assert t["rows"] == [["K", "V", "W"], ["a", "1", "x"], ["a", "2", "y"]] and t["header_rows"] == 1 and t["merged"] == [False] * 3


def test_merged_cells_repeat_their_text():
    rules = [r for r in _grid() if not (r[0] and r[1] == 50.0)] + [(True, 50.0, 40.0, 80.0)]
    (t,) = ruled.tables_of(rules, [g for g in _glyphs() if g["r"] != "V"])
    assert t["rows"][0] == ["K", "K", "W"] and t["header_rows"] == 2 and t["merged"][0]


@pytest.mark.parametrize("change", ["half an edge", "open border", "across", "few cells", "second table"])
def test_uncertain_tables_are_refused(change):
    rules, glyphs = _grid(), _glyphs()
    if change == "half an edge":
        rules = [r for r in rules if not (r[0] and r[1] == 50.0)] + [(True, 50.0, 40.0, 70.0)]
    elif change == "open border":
        rules = [r for r in rules if not (r[0] and r[1] == 0.0)] + [(True, 0.0, 60.0, 100.0)]
    elif change == "across":
        glyphs[0]["right"] = 70.0
    elif change == "few cells":
        glyphs = glyphs[:3]
    else:
        rules = [*rules, *[(v, p + 0.0 if not v else p + 5, lo + (5 if not v else 0), hi + (5 if not v else 0)) for v, p, lo, hi in rules]]
    assert ruled.tables_of(rules, glyphs) == []


def test_rules_out_of_pixels():
    px = np.full((200, 100), 255, np.uint8)
    px[50, 10:60] = 0
    px[20:120, 30] = 0
    px[70, 10:13] = 0
    got = ruled.image_rules(px, 100.0, 200.0)
    assert (False, 149.5, 10.0, 60.0) in got and (True, 30.5, 80.0, 180.0) in got and len(got) == 2
    rgb = np.random.default_rng(1).integers(0, 256, (5, 7, 3), dtype=np.uint8)
    y = rgb.astype(float) @ [0.299, 0.587, 0.114]
    assert np.abs(ruled.gray(rgb) - y).max() <= 1


def test_headers_carry_over_pages_and_stop():
    before = {"columns": [0.0, 50.0, 100.0], "left": 0.0, "rows": [["k", "v"], ["a", "1"], ["a", "2"]], "header_rows": 1, "nothing_below": True}
    now = {"columns": [5.0, 55.0, 105.0], "left": 5.0, "rows": [["a", "3"]], "merged": [False], "nothing_above": True}
    assert ruled.continues(before, now)
    for change in ({"merged": [True]}, {"nothing_above": False}, {"rows": [["k", "3"]]}, {"rows": [["b", "3"]]}, {"columns": [5.0, 60.0, 105.0]}, {"columns": [5.0, 105.0]}, {"rows": [["", "3"]]}):
        assert not ruled.continues(before, now | change)


def test_a_book_ends_up_as_files(spark, tmp_path):
    for path, text in Q.SITE:
        (tmp_path / "in" / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / path).write_text(text)
    (tmp_path / "in" / "x.HTML").write_text("not read")
    got = books.convert(spark, f"file://{tmp_path}/in", readers.PROFILE, f"{tmp_path}/crm")
    assert got == {"items": 1, "files": 1, "rows": 1}
    index = (tmp_path / "crm/commands.tsv").read_text().split("\n")
    command, entry, file, line, source = index[1].split("\t")
    assert entry == "ip route" and source == "a.html#route"
    assert (tmp_path / "crm" / file).read_text().split("\n")[int(line) - 1] == "## ip route"
    got = books.convert(spark, f"file://{tmp_path}/in", readers.PROFILE | {"fieldLabels": [], "webUnnumberedHeadings": True}, f"{tmp_path}/fd")
    assert got["items"] == 4
    for row in (tmp_path / "fd/sections.tsv").read_text().strip().split("\n")[1:]:
        section, title, file, line, _ = row.split("\t")
        assert title in (tmp_path / "fd" / file).read_text().split("\n")[int(line) - 1]
    with pytest.raises(ValueError):
        books.convert(spark, f"file://{tmp_path}/in", readers.PROFILE | {"fieldLabels": ["nothing"]}, f"{tmp_path}/no")


def test_difference_from_files(spark, tmp_path):
    d = str(tmp_path)
    sinks._put(f"{d}/l.tsv", "command\tentry\tfile\tline\tsource\nip route A\te\tf\t3\tp1\nip missing-example x\te\tf\t9\tp3\nshort\trow\n".encode())
    sinks._put(f"{d}/r.tsv", b"command\tentry\tfile\tline\tsource\nip route A\te\tf\t3\tw1\n")
    sinks._put(f"{d}/s.tsv", "section\ttitle\tfile\tline\tsource\n8\tIXシリーズとの差分\tc.md\t1\tp8\n8.3\t廃止\tc.md\t3\tp9\n".encode())
    sinks._put(f"{d}/c.md", "# 8\n\n## 8.3 廃止されたコマンド\n\n| 機能 | 設定コマンド | IXシリーズ | IX-Rシリーズ |\n|---|---|---|---|\n| f | ip route A | x | reloadコマンドに統一 |\n\n".encode())
    assert books.difference(spark, f"{d}/l.tsv", f"{d}/r.tsv", f"{d}/s.tsv", d, f"{d}/diff.tsv") == 2
    rows = [x.split("\t") for x in (tmp_path / "diff.tsv").read_text().strip().split("\n")]
    assert rows[0] == ["kind", "ix", "ix-r", "source", "ref_ix", "ref_ixr", "note"]
    assert rows[1][:6] == ["removed", "ip route A", "reload", "ch8", "crm:p1", "fd:p9"]
    assert rows[2][:5] == ["absent", "ip missing-example *", "", "setdiff", "crm:p3"]


@pytest.mark.parametrize("line", ["not-a-number", "0", "-1", "123456789012345678901234"])
def test_bad_section_lines_fail(spark, tmp_path, line):
    sinks._put(f"{tmp_path}/s.tsv", f"section\ttitle\tfile\tline\tsource\n1\tt\tf\t{line}\tp\n".encode())
    with pytest.raises(Exception, match="bad line"):
        readers.section_index(spark, f"{tmp_path}/s.tsv").collect()


def test_configuration_files(spark, tmp_path):
    sinks._put(f"{tmp_path}/i.json", '﻿{"devices": {"r1": {"host": "192.0.2.1"}, "_note": {"x": "y"}}}'.encode())
    assert [(r.name, r.entry) for r in readers.inventory(spark, f"{tmp_path}/i.json").collect()] == [("r1", {"host": "192.0.2.1"})]
    sinks._put(f"{tmp_path}/p.json", b'{"columns": 1, "fieldLabels": []}')
    p = readers.profile(spark, f"{tmp_path}/p.json")
    assert p["columns"] == 1 and p["fieldLabels"] == [] and p["entryMarker"] == "■"
    sinks._put(f"{tmp_path}/m.json", b'{"docs": [{"series": "ix", "book": "crm", "url": "http://h.example/?file=v1.2.pdf"}]}')
    m = readers.manifest(spark, f"{tmp_path}/m.json").first()
    assert (m.kind, m.version, m.name) == ("pdf", "1.2", "ix-crm-1.2")
    sinks._put(f"{tmp_path}/none.json", b'{"docs": []}')
    with pytest.raises(ValueError):
        readers.manifest(spark, f"{tmp_path}/none.json")
    sinks._put(f"{tmp_path}/ssh", b"Include more*\nHost a\n  HostName h1\n")
    sinks._put(f"{tmp_path}/more1", b"Host a\n  User u\n")
    assert [(r.patterns, r.key, r.value) for r in readers.ssh_directives(spark, f"{tmp_path}/ssh").orderBy("ord").collect()] == [(["a"], "user", "u"), (["a"], "hostname", "h1")]
    sinks._put(f"{tmp_path}/d.tsv", "﻿# c\nkind\tix\tix-r\tref_ix\tref_ixr\tnote\nlimit\ta\tb\tc\td\te\n".encode())
    assert readers.derived_rows(spark, f"{tmp_path}/d.tsv").first().note == "e"
    assert sinks.write_backup("a\n\n\n", f"{tmp_path}/b.conf") and (tmp_path / "b.conf").read_text() == "a\n"
    assert sinks.init_inventory(f"{tmp_path}/new.json") and not sinks.init_inventory(f"{tmp_path}/new.json")


def test_build_goes_on_after_a_failure(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "ord int, name string")

    def step(d):
        if d["name"] == "a":
            raise ValueError("lost")
        return {}

    assert [tuple(r) for r in books.build(spark, docs, step).orderBy("name").collect()] == [("a", False, "lost"), ("b", True, "")]
