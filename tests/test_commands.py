"""Known answers for lookups and the client's rules."""

import pytest
from pyspark.sql import functions as F

from quire.functions import commands as C
from quire.operators import device as D
from quire.operators import index as I
from quire.plans import command_queries as Q
from quire.sources import readers


def test_whole_part_index(spark, tmp_path):
    names = ["red green blue", "red green", "Red green", "red", "blue red green tan"] + [f"hot name {i}" for i in range(200)] + ["hot name"]
    spark.createDataFrame(list(enumerate(names, 1)), "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    got = {r.id: r.source for r in Q.part_lookup_top1(spark, str(tmp_path)).collect()}
    low = [n.lower() for n in names]
    want = {}
    df = spark.createDataFrame([(n,) for n in sorted(set(low))], "n string")
    words = {r.n: r.k for r in df.select("n", C.keywords(F.col("n")).alias("k")).collect()}
    for i, n in enumerate(low, 1):
        w, best = words[n], None
        for h in set(low):
            k, o = words[h], low.index(h) + 1
            m = min(len(w), len(k))
            if m and w[:m] == k[:m] and (m >= 2 or len(w) == len(k)):
                best = min(best or (-m, o), (-m, o))
        want[i] = f"p{best[1]}" if best else None
    assert got == want


def test_whole_line_index(spark, tmp_path):
    docs = [(1, "no\nthe one\n" + "x" * 60 + " the end\nno\nthe fifth"), (2, "nothing"), (3, "\n\nat the third")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.file, r.line, r.line_no) for r in Q.index_lookup_slice(spark, str(tmp_path)).collect())
    assert got == [(f"d{d}", i, i) for d, t in docs for i, x in enumerate(t.split("\n"), 1) if "the" in x]


def test_any_number_of_choices(spark):
    s = " ".join(["[ a | b ]"] * 6)
    (got,) = spark.createDataFrame([(s,)], "s string").select(C.open_alternatives(F.col("s"))).first()
    assert len(got) == 64 == len(set(got)) and not any("[" in x for x in got)


def test_prefix_lookup_equals_its_definition(spark):
    import random

    g = random.Random(5)
    word = lambda: g.choice(["ip", "show", "a", "b", "X", "[", "route"])
    index = [(i, " ".join(word() for _ in range(g.randint(0, 4))), f"p{i}") for i in range(60)]
    texts = [(i, " ".join(word() for _ in range(g.randint(0, 4)))) for i in range(200)]

    def kw(s):
        out = []
        for w in s.split():
            if w not in ("ip", "show", "a", "b", "route"):
                break
            out.append(w)
        return out

    want = {}
    for i, t in texts:
        best = (0, None)
        for _, c, p in index:
            a, b = kw(t), kw(c)
            n = 0
            while n < min(len(a), len(b)) and a[n] == b[n]:
                n += 1
            if n and ((n == len(a) == len(b)) or (n >= 2 and n in (len(a), len(b)))) and n > best[0]:
                best = (n, p)
        want[i] = best[1]
    got = I.lookup(spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame(index, "ord int, command string, source string"))
    assert {r.id: r.source for r in got.collect()} == want


@pytest.mark.parametrize("text, source", [("ip", None), ("ip route", "p1"), ("reload", "p2"), ("reload now", None), ("pki cert erase name NAME", "p3")])
def test_one_word_matches_itself_only(spark, text, source):
    t = spark.createDataFrame([(1, text)], "id int, text string")
    assert I.lookup(t, Q.INDEX.df(spark)).first().source == source


def test_diagnostics(spark):
    cases = [("x", "% Invalid input", True), ("x", "%saved", False), ("a.b", "% a.b -- まだ", True), ("a.b", "% axb -- y", False), ("", "% -- y", False), ("\\E", "% \\E -- y", True)]
    df = spark.createDataFrame(cases, "c string, o string, want boolean")
    assert all(r.want == r.got for r in df.select("want", C.command_error(F.col("c"), F.col("o")).alias("got")).collect())


def test_long_chains_of_jump_hosts(spark):
    hosts = spark.createDataFrame([(f"h{i}", f"h{i + 1}") for i in range(25)] + [("h25", "none")], "host string, proxyjump string")
    got = D.jump_routes(spark, hosts).where("host = 'h0'").orderBy("step").collect()
    assert [r.hop for r in got] == [f"h{i}" for i in range(25, 0, -1)]


def test_six_choices(spark):
    s = " ".join("[ a | b ]" for _ in range(6))
    got = spark.createDataFrame([(s,)], "s string").select(F.explode(C.open_alternatives(F.col("s")))).collect()
    assert len(got) == 64 and not any("[" in r.col for r in got)


def test_ssh_patterns(spark, tmp_path):
    (tmp_path / "more").write_text("Host *.lab !bad.lab\n\tHostName\t192.0.2.1\nHost=eq\n User = a=b\n")
    (tmp_path / "config").write_text('\ufeffPort 2022\nInclude "more"\n# c\nHost edge "two words"\n  ProxyJump me@x:22\nHost *\n Port 2222\n User all\nMatch host edge,x\n ProxyCommand nc\n')
    d = readers.ssh_directives(spark, str(tmp_path / "config"))
    hosts = spark.createDataFrame([(x,) for x in ("edge", "a.lab", "bad.lab", "eq", "x", "two words")], "alias string")
    got = {r.alias: tuple(r)[1:] for r in D.effective_ssh(d, hosts).collect()}
    assert got == {
        "edge": ("", "all", "2022", "me@x:22", None), "a.lab": ("192.0.2.1", "all", "2022", "", None), "bad.lab": ("", "all", "2022", "", None),
        "eq": ("", "a=b", "2022", "", None), "x": ("", "all", "2022", "", "ProxyCommand is unsupported"), "two words": ("", "all", "2022", "me@x:22", None),
    }
    (tmp_path / "bad").write_text("Match exec true\n")
    with pytest.raises(ValueError):
        readers.ssh_directives(spark, str(tmp_path / "bad"))
