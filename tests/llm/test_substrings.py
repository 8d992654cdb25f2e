import random
from hashlib import sha256

import pytest

from quire.llm import substrings as S


def brute(rows, w):
    first = {}
    for i, t in rows:
        x = (t or "").encode().split()
        for k in range(len(x) - w + 1 if i is not None else 0):
            key = tuple(x[k : k + w])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        x = (t or "").encode().split()
        gone = [False] * len(x)
        for k in range(len(x) - w + 1 if i is not None else 0):
            if first[tuple(x[k : k + w])] < i:
                gone[k : k + w] = [True] * w
        kept = [a for a, b in zip(x, gone, strict=True) if not b]
        out.append((i, len(x), len(x) - len(kept), sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=repr)


def rows(seed):
    g = random.Random(seed)
    pool = [[g.choice("abcdefghij") * g.randint(1, 2) for _ in range(g.randint(5, 80))] for _ in range(12)]
    out = []
    for i in range(70):
        t = []
        for _ in range(g.randint(0, 4)):
            p = g.choice(pool)
            a = g.randrange(len(p))
            t += p[a : g.randint(a, len(p))] if g.random() < 0.5 else p
            t += [g.choice("klmnop") for _ in range(g.randint(0, 6))]
        out.append((i if g.random() < 0.9 else g.choice([None, 3, 7]), " ".join(t) if g.random() < 0.97 else None))
    return out + out[:3] + [(80, "z " * 400), (81, "z " * 300), (82, ""), (83, "one")]


@pytest.mark.parametrize("window, seed", [(4, 1), (8, 2), (20, 3), (50, 4)])
def test_equals_brute_force(spark, window, seed):
    r = rows(seed)
    df = spark.createDataFrame([(*x, "clash") for x in r], "doc_id long, text string, anchor string")
    got = S.deduplicated(df, window).drop("kept").collect()
    assert sorted(map(tuple, got), key=repr) == brute(r, window)


def test_kept_text(spark):
    p = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, "a b " + p), (2, "x\n" + p + "\ty z"), (3, "q")], "doc_id long, text string")
    got = {r.doc_id: r for r in S.deduplicated(df).collect()}
    assert got[2].kept == "x y z" and got[2].n_removed == 60 and got[1].n_removed == 0 and got[1].kept is None


def test_paths_cover_all_windows():
    for n in (49, 50, 51, 200, 1000):
        data = " ".join(str(random.Random(n + i).randrange(50)) for i in range(n)).encode()
        words, first, edges, _, _ = S.paths(data)
        assert words == n and edges.sum() == max(0, n - 49)
        assert all(a + e == b for a, e, b in zip(first, edges, first[1:]))  # noqa: B905


def test_many_ids_are_joined(spark, monkeypatch):
    monkeypatch.setattr(S.common, "ID_BYTES", 1 << 40)
    r = rows(5)
    got = S.deduplicated(spark.createDataFrame(r, "doc_id long, text string"), 8).drop("kept").collect()
    assert sorted(map(tuple, got), key=repr) == brute(r, 8)


def test_nothing(spark):
    assert S.deduplicated(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_repeats_compact_to_few_paths(spark):
    g = random.Random(9)
    some = lambda n, a="": " ".join(a + str(g.randrange(10**6)) for _ in range(n))
    p, q = some(10_000), some(3_000)
    r = [(1, some(90) + " " + p), (2, some(70) + " " + p + " " + some(80)), (3, p + " " + q), (4, q + " " + q), (5, some(500))]
    docs = spark.createDataFrame(r, "doc_id long, text string")
    made, cuts = S.repeats(docs)
    paths = {(c.th, c.first, c.edges) for row in cuts.collect() for c in row.cuts}
    assert len(paths) < 80 and max(e for *_, e in paths) > 9_800
    assert sorted(map(tuple, S.deduplicated(docs).drop("kept").collect()), key=repr) == brute(r, 50)


def test_chains_stop_at_branches(spark):
    row = lambda doc, *anchors: [(doc, 0, 10 * i, a, a, 10, False) for i, a in enumerate(anchors)]
    found = row(1, 1, 2, 3, 4, 5) + row(2, 2, 3, 4, 6) + row(3, 9, 1, 2, 3, 4, 5, 6) + row(4, 7, 8) + row(5, 7, 8)
    df = spark.createDataFrame(found, "doc_id long, th long, first int, anchor long, whole long, edges int, branches boolean")
    got = {(r.anchor, r.edges) for r in S.compacted(df).collect()}
    assert got == {(1, 10), (2, 30), (5, 10), (6, 10), (7, 20), (9, 10)}
