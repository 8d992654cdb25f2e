import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from quire.llm import common, simhash as S


def reference(text, n=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


TEXTS = ["", None, "one", "One TWO three", "a b c d", "a b c d e a b c d", "É é \x0b x\ty", "w " * 500, " \n "] + [" ".join(random.Random(i).choices("abcdefgh", k=40)) for i in range(20)]


@pytest.mark.parametrize("n", [4, 5])
def test_fingerprints(n):
    for t in TEXTS:
        assert S.fingerprint(t, n) == reference(t, n)


def _components(fp, ids, most):
    uf, inv = np.unique(fp, return_inverse=True)
    up = list(range(len(uf)))

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for i in range(len(uf)):
        for j in np.flatnonzero(np.bitwise_count(uf[i + 1 :] ^ uf[i]) <= most):
            up[root(i + 1 + int(j))] = root(i)
    lab = [root(i) for i in inv]
    least = {}
    for k, i in zip(lab, ids, strict=True):
        least[k] = min(least.get(k, i), i)
    return [least[k] for k in lab]


@pytest.mark.parametrize("dense, budget", [(2, 1 << 26), (256, 1 << 26), (1, 0), (2, 3)])
def test_links_equal_brute_force(spark, monkeypatch, dense, budget):
    monkeypatch.setattr(S, "DENSE", dense)
    monkeypatch.setattr(S, "BUDGET", budget)
    g = np.random.default_rng(3)
    fp = g.integers(0, 2**64, 300, dtype=np.uint64)
    flips = np.array([[1 << int(b) for b in g.integers(0, 64, 8)] for _ in range(600)], np.uint64)
    near = fp[g.integers(0, 40, 600)].copy()
    for k in range(8):  # up to eight bits away, chains included
        use = g.random(600) < 0.5
        near[use] ^= flips[use, k]
    every = np.r_[fp, near, fp[:5]]
    ids = g.permutation(len(every))
    df = spark.createDataFrame([(int(i), int(f)) for i, f in zip(ids, every.view(np.int64), strict=True)], "doc_id long, fp long")
    got = {r.doc_id: r.component_id for r in S.groups(df).collect()}
    assert got == dict(zip(ids.tolist(), map(int, _components(every, ids.tolist(), 4)), strict=True))


def test_the_embedding_is_a_lower_bound():
    g = np.random.default_rng(4)
    a, b = (g.integers(0, 2**64, 2000, dtype=np.uint64) for _ in range(2))
    b[:500] = a[:500] ^ (np.uint64(1) << g.integers(0, 64, 500, dtype=np.uint64))
    assert (S.bound(a, b) <= np.bitwise_count(a ^ b)).all()
    bits = [np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").reshape(-1, 2, 32).astype(int) for x in (a, b)]
    counts = [x + np.roll(x, -1, axis=2) for x in bits]  # each segment's popcount
    assert (S.bound(a, b) == (np.abs(counts[0] - counts[1]).sum((1, 2)) + 1) // 2).all()


def test_fingerprints_four_bits_apart_share_a_cell():
    g = np.random.default_rng(6)
    for _ in range(200):
        a = g.integers(0, 2**64, 1, dtype=np.uint64)
        b = a.copy()
        for bit in g.choice(64, 4, replace=False):
            b ^= np.uint64(1) << np.uint64(bit)
        assert set(S.cells(a)[0].tolist()) & set(S.cells(b)[0].tolist())


def test_each_fingerprint_has_few_cells():
    key, index = S.cells(np.random.default_rng(5).integers(0, 2**64, 100, dtype=np.uint64))
    assert np.bincount(index).max() <= 66 and len(set(zip(key.tolist(), index.tolist(), strict=True))) == len(key)


def test_edge_cases(spark):
    rows = [(5, "same text here now"), (3, "same text here now"), (None, "same text here now"), (9, ""), (8, None), (3, "same text here now")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, fp int")
    got = sorted(((r.doc_id, r.component_id) for r in S.near_duplicates(df, 4).collect()), key=str)
    assert got == sorted([(5, 3), (3, 3), (3, 3), (None, None), (9, 8), (8, 8)], key=str)
    assert S.near_duplicates(df.limit(0)).count() == 0 and S.similar(df.limit(0)).count() == 0
    assert sorted(((r.doc_id, r.component_id) for r in S.similar(df).collect()), key=str) == got


def test_similar_texts(spark):
    g = random.Random(6)
    word = lambda: "".join(g.choices("abcdefghij", k=4))
    base = [[word() for _ in range(300)] for _ in range(40)]
    rows, kin = [], {}
    for i, b in enumerate(base):
        rows.append((10 * i, " ".join(b)))
        for k in range(1, 4):
            c = list(b)
            for at in g.sample(range(300), 4):  # at most 20 of 296 shingles change: a similarity over 0.87
                c[at] = word()
            rows.append((10 * i + k, " ".join(c)))
            kin[10 * i + k] = 10 * i
        c = list(b)
        c[100:] = [word() for _ in range(200)]
        rows.append((10 * i + 9, " ".join(c)))  # a similarity near 0.2
    got = {r.doc_id: r.component_id for r in S.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[k] == v for k, v in kin.items())
    assert all(got[10 * i + 9] == 10 * i + 9 for i in range(40))


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 200), (200, 150), (7, 7), (None, 3), (300, 301), (301, 300)] + [(1000, 1001 + i) for i in range(200)]
    got = {r.node: r.comp for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 150: 100, 200: 100, 300: 300, 301: 300} | {1000 + i: 1000 for i in range(201)}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("few", [0, 1 << 18])
@pytest.mark.parametrize("seed", range(2))
def test_components_by_stars_and_in_one_task(spark, monkeypatch, few, seed):
    monkeypatch.setattr(common, "FEW_EDGES", few)
    g = np.random.default_rng(seed)
    edges = (g.integers(0, 400, (230, 2)) * 7 - 900).tolist() + [[None, -900], [5, None], [3, 3], [-4, 2**60], [2**60, -4]]
    least = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}
    for _ in least:
        for a, b in (e for e in edges if None not in e and e[0] != e[1]):
            least[a] = least[b] = min(least[a], least[b])
    got = common.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(got) == len(least) and {r.node: r.comp for r in got} == least


def test_few_edges_take_one_table(spark, monkeypatch):
    """Rounds of stars take five tables for the edges and each round, each with stages that the driver has to hold."""
    names, written = [], common.written
    monkeypatch.setattr(common, "written", lambda df, name: names.append(name) or written(df, name))
    edges = [(i, i + 1) for i in range(60)]
    assert {r.comp for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()} == {0}
    assert names == ["edges"]


def test_the_driver_lets_go_between_steps(spark, monkeypatch):
    calls, give_back = [], common.give_back
    monkeypatch.setattr(common, "give_back", lambda s: calls.append(give_back(s)))
    docs = spark.createDataFrame([(i, f"some words of text {i % 3}") for i in range(9)], "doc_id long, text string")
    assert sorted(tuple(r) for r in S.similar(docs).collect()) == [(i, i % 3) for i in range(9)]
    assert len(calls) >= 5


def test_unsure_links_are_verified(spark):
    g = random.Random(8)
    word = lambda: "".join(g.choices("abcdefghij", k=4))
    rows, want = [], {}
    for i in range(60):
        b = [word() for _ in range(200)]
        c = list(b)
        for at in range(0, 200, 40 if i % 2 else 14):  # 5 or 15 words spread out: a similarity near 0.77 or 0.48
            c[at] = word()
        rows += [(2 * i, " ".join(b)), (2 * i + 1, " ".join(c))]
        want[2 * i + 1] = 2 * i if S.jaccard(rows[-2][1], rows[-1][1], 5) >= 0.8 else 2 * i + 1
    got = {r.doc_id: r.component_id for r in S.similar(spark.createDataFrame(rows, "doc_id long, text string"), similarity=0.8).collect()}
    apart = [k for k, v in want.items() if v == k]
    alike = [k for k, v in want.items() if v != k]
    assert apart and all(got[k] == k for k in apart)
    assert alike and sum(got[k] == k - 1 for k in alike) >= 0.85 * len(alike)  # right at the border
    loose = {r.doc_id: r.component_id for r in S.similar(spark.createDataFrame(rows, "doc_id long, text string"), similarity=0.75).collect()}
    assert sum(loose[2 * i + 1] == 2 * i for i in range(1, 60, 2)) > 25


def test_jaccard():
    assert S.jaccard("a b c", "A  b c", 5) == 1 and S.jaccard(None, "", 5) == 1 and S.jaccard("a b c d e f", "a b c d e g", 5) == 1 / 3


def test_rejected_links_hide_no_pair(spark):
    g = random.Random(11)
    word = lambda: "".join(g.choices("abcdefghij", k=4))
    rows, n = [], 0
    while n < 8:  # a-b and b-c at 0.77 are shorter than a-c at 0.81
        a = [word() for _ in range(200)]
        b, c = list(a), list(a)
        for at in (20, 60):
            b[at] = c[at] = word()
        for at in (100, 140):
            c[at] = word()
        for at in (40, 80, 120):
            b[at] = word()
        a, b, c = (" ".join(x) for x in (a, b, c))
        fa, fb, fc = (S.wide_fingerprint(x) for x in (a, b, c))
        bits = lambda x, y: int(np.bitwise_count(x ^ y).sum())
        if S.SURE < min(bits(fa, fb), bits(fb, fc)) and max(bits(fa, fb), bits(fb, fc)) < bits(fa, fc) <= 66:
            assert S.jaccard(a, c, 5) >= 0.8 > max(S.jaccard(a, b, 5), S.jaccard(b, c, 5))
            rows += [(3 * n, a), (3 * n + 1, b), (3 * n + 2, c)]
            n += 1
    got = {r.doc_id: r.component_id for r in S.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {3 * i + k: 3 * i + (k == 1) for i in range(8) for k in range(3)}


def test_across_gives_every_pair_of_components_once_a_cell():
    import pyarrow as pa

    g = np.random.default_rng(2)
    key, comp = np.sort(g.integers(0, 6, 90)), g.integers(0, 4, 90)
    comp[key == 5] = 7
    batches = [pa.RecordBatch.from_arrays([pa.array(x[k : k + 20]) for x in (key, np.arange(90), comp)], names=["cell", "rep", "comp"]) for k in range(0, 90, 20)]
    got = [tuple(r.values()) for b in S._across(lambda got, at, others: others[(got[1][others] + got[1][at]) % np.uint64(3) > 0])(batches) for r in b.to_pylist()]
    assert sorted(got) == [(a, b, comp[a], comp[b]) for a in range(90) for b in range(a + 1, 90) if key[a] == key[b] and comp[a] != comp[b] and (a + b) % 3]


def test_short_texts_are_joined_on_their_shingles(spark):
    g = random.Random(12)
    word = lambda: "".join(g.choices("abcdefghij", k=4))
    texts = []
    for i in range(120):
        b = [word() for _ in range((8, 8, 13, 20)[i % 4])]
        texts += [" ".join(b), " ".join(b + [word() for _ in range((1, 2, 2, 4)[i % 4])])]
    texts += [" ".join(["one phrase for all of them", word(), word(), word()]) for _ in range(60)]
    got = {r.doc_id: r.component_id for r in S.similar(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    want = [2 * (i // 2) if i < 240 and S.jaccard(texts[i - i % 2], texts[i - i % 2 + 1], 5) >= 0.8 else i for i in range(len(texts))]
    assert [got[i] for i in range(len(texts))] == want and 60 < sum(w != i for i, w in enumerate(want)) < 120


def test_few_pairs_at_the_border_are_passed_over():
    g = random.Random(13)
    word = lambda: "".join(g.choices("abcdefghij", k=4))
    bits = []
    while len(bits) < 300:
        b = [word() for _ in range(g.randint(30, 400))]
        c = list(b)
        for at in g.sample(range(len(b)), len(b) // 46 or 1):
            c[at] = word()
        if 0.8 <= S.jaccard(" ".join(b), " ".join(c), 5) < 0.85:
            bits.append(int(np.bitwise_count(S.wide_fingerprint(" ".join(b)) ^ S.wide_fingerprint(" ".join(c))).sum()))
    assert max(bits) <= S.most_bits(0.8)


def wide_pairs(g, n, similarity=0.8):
    """n pairs of wide fingerprints whose bits differ as those of texts of this similarity do."""
    p = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    a = g.integers(0, 2, (n, 64 * S.WIDE)).astype(np.uint8)
    b = a ^ (g.random(a.shape) < p)
    return [np.packbits(x, axis=1, bitorder="little").view(np.int64) for x in (a, b)]


def prints_df(spark, x):
    return spark.createDataFrame([(i, *v) for i, v in enumerate(x.tolist())], "rep long, " + ", ".join(f"{n} long" for n in S._NAMES))


@pytest.mark.parametrize("bits", [12, 18])
def test_wide_cells_are_those_of_segment_counts(bits):
    """The grid of similar(): a cell is given by the counts of a ring's neighbouring pairs, and alike counts share it whatever the bits."""
    x = np.stack(wide_pairs(np.random.default_rng(3), 50)[0], axis=1)
    order = S._choices(bits, 5, 17)
    one, two = np.zeros(64 * S.WIDE, np.uint8), np.zeros(64 * S.WIDE, np.uint8)
    one[order[0][::2]] = two[order[0][1::2]] = 1
    x = np.c_[x, np.packbits([one, two], axis=1, bitorder="little").view(np.int64).T]
    cell = S._spread(bits, 5)(pa.RecordBatch.from_arrays([pa.array(v) for v in x], names=S._NAMES))["cell"].reshape(5, -1)
    bit = np.unpackbits(np.ascontiguousarray(x.T).view(np.uint8), axis=1, bitorder="little").astype(int)
    for k, o in enumerate(order):
        want = [k * 3**bits + sum((int(r[o[i]]) + int(r[o[(i + 1) % bits]])) * 3**i for i in range(bits)) for r in bit]
        assert cell[k].tolist() == want
    assert cell[0, -1] == cell[0, -2]


def test_wide_pairs_are_verified_by_the_bound_first():
    a, b = (x.view(np.uint64) for x in wide_pairs(np.random.default_rng(5), 400))
    p, most = S._points(np.r_[a, b]), S.most_bits(0.8)
    bit = np.unpackbits(np.r_[a, b].view(np.uint8), axis=1, bitorder="little").reshape(800, -1, 32).astype(int)
    counts = (bit + np.roll(bit, -1, axis=2)).reshape(800, -1)
    i, j = np.r_[np.arange(400), np.zeros(799, int)], np.r_[np.arange(400, 800), np.arange(1, 800)]
    manhattan = np.abs(counts[i] - counts[j]).sum(1)
    assert np.bitwise_count(p[i, S.WIDE :] ^ p[j, S.WIDE :]).sum(1, dtype=int).tolist() == manhattan.tolist()
    exact = np.bitwise_count(p[i, : S.WIDE] ^ p[j, : S.WIDE]).sum(1, dtype=int)
    assert (manhattan <= 2 * exact).all() and (manhattan > 2 * most).sum() > 700
    assert S._wide_distance(p, i, j, most).tolist() == np.where(exact <= most, exact, -1).tolist()
    assert S._wide_distance(p, np.array([0]), np.arange(1, 800), most).tolist() == np.where(exact <= most, exact, -1)[400:].tolist()
    q = p.copy()
    q[:, : S.WIDE] = 0  # words that would agree: only the bound can tell the points apart
    assert (S._wide_distance(q, i, j, most) >= 0).tolist() == (manhattan <= 2 * most).tolist()


@pytest.mark.parametrize("bits", [12, 13, 15, 18])
def test_one_rule_for_bands_of_any_length(spark, bits):
    """The same recall whatever the number of fingerprints makes of the bands' length."""
    a, b = wide_pairs(np.random.default_rng(bits), 2000)
    got = {(r.a, r.b) for r in S.wide_links(prints_df(spark, np.r_[a, b]), bits, 0.8).collect()}
    found = sum((i, 2000 + i) in got for i in range(2000))
    print(bits, S.bands(bits, 0.8), found / 2000)
    assert found >= 0.975 * 2000


def test_a_cell_of_a_hundred_thousand(spark, monkeypatch):
    """Unlike fingerprints that all agree in one band: the budget ends, and finer cells over many tasks find the pairs."""
    monkeypatch.setattr(S, "BUDGET", 1 << 22)
    g = np.random.default_rng(1)
    a, b = wide_pairs(g, 300)
    x = np.r_[g.integers(-(2**63), 2**63 - 1, (99_400, S.WIDE)), a, b]
    bit = np.unpackbits(np.ascontiguousarray(x).view(np.uint8), axis=1, bitorder="little")
    bit[:, S._choices(12, S.bands(12, 0.8), 17)[0]] = 1
    x = np.packbits(bit, axis=1, bitorder="little").view(np.int64)
    schema = "rep long, " + ", ".join(f"{n} long" for n in S._NAMES)
    import pandas as pd

    df = spark.createDataFrame(pd.DataFrame({"rep": np.arange(len(x))} | {n: x[:, k] for k, n in enumerate(S._NAMES)}), schema)
    monkeypatch.setattr(S, "_spread", lambda bits, many: lambda batch: {"cell": np.zeros(batch.num_rows, np.int64)} | {n: batch.column(n).to_numpy() for n in batch.schema.names})  # the crowded cell only
    got = {(r.a, r.b) for r in S.wide_links(df, 12, 0.8).collect()}
    near = [i for i in range(300) if np.bitwise_count(x[99_400 + i] ^ x[99_700 + i]).sum() <= S.most_bits(0.8)]
    assert sum((99_400 + i, 99_700 + i) in got for i in near) >= 0.99 * len(near)


def exact_pairs(texts, similarity=0.8):
    """All pairs of texts of this similarity or more, by prefixes of rare shingles."""
    sets = [S.shingles(t) for t in texts]
    every, times = np.unique(np.concatenate(sets), return_counts=True)
    often = [times[np.searchsorted(every, x)] for x in sets]
    lists, out = {}, set()
    for i, (x, n) in enumerate(zip(sets, often, strict=True)):
        for h in x[np.lexsort((x, n))][: len(x) - int(np.ceil(similarity * len(x) - 1e-9)) + 1].tolist():
            for j in lists.setdefault(h, []):
                if (j, i) not in out and similarity <= len(sets[j]) / max(1, len(x)) <= 1 / similarity:
                    both = len(np.intersect1d(sets[j], x, assume_unique=True))
                    if both >= similarity * (len(sets[j]) + len(x) - both) - 1e-9:
                        out.add((j, i))
            lists[h].append(i)
    return out


def test_all_similar_pairs_of_the_supplied_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    ids: dict = {}
    for r in docs.orderBy("doc_id").collect():
        ids.setdefault(" ".join((r.text or "").lower().split()), []).append(r.doc_id)
    texts = [t for t in ids if t]
    pairs = exact_pairs(texts)
    got = {r.doc_id: r.component_id for r in S.similar(docs).collect()}
    found = sum(got[ids[texts[a]][0]] == got[ids[texts[b]][0]] for a, b in pairs)
    print("similar pairs of different texts:", len(pairs), "found:", found)
    assert found >= 0.98 * len(pairs)
    # no group but those that chains of such pairs make
    up = {t: t for t in range(len(texts))}

    def root(t):
        while up[t] != t:
            up[t] = up[up[t]]
            t = up[t]
        return t

    for a, b in pairs:
        up[root(a)] = root(b)
    by_group: dict = {}
    for t in range(len(texts)):
        by_group.setdefault(got[ids[texts[t]][0]], set()).add(root(t))
    wrong = sum(len(x) - 1 for x in by_group.values())
    print("groups joined without a similar pair:", wrong)
    assert wrong <= 0.02 * len(pairs)


def test_a_large_group_of_near_copies_gives_few_candidates(spark, monkeypatch):
    """Of 900 variants of one text, a fifth of whose pairs are similar: components equal brute force, and what is verified stays linear."""
    g = random.Random(21)
    word = lambda: "".join(g.choices("abcdefghij", k=4))
    base, texts = [word() for _ in range(150)], []
    for _ in range(900):
        c = list(base)
        for at in g.sample(range(150), g.randint(0, 7)):
            c[at] = word()
        texts.append(" ".join(c))
    asked = []
    real = S._verified
    monkeypatch.setattr(S, "_verified", lambda pairs, *a: asked.append(pairs.count()) or real(pairs, *a))
    got = {r.doc_id: r.component_id for r in S.similar(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    up = list(range(900))

    def root(t):
        while up[t] != t:
            up[t] = up[up[t]]
            t = up[t]
        return t

    for a, b in sorted(exact_pairs(texts)):
        x, y = sorted((root(a), root(b)))
        up[y] = x
    want = [root(i) for i in range(900)]
    same = sum(got[i] == want[i] for i in range(900))
    print("verified:", asked, "components:", len(set(want)), "alike:", same)
    assert same >= 895 and sum(asked) < 30 * 900


@pytest.mark.parametrize("alike", [0, 300, 1200])
def test_a_cell_is_sifted_in_blocks(alike):
    g = np.random.default_rng(alike)
    n, most, fp = 1200, S.most_bits(0.8), g.integers(0, 1 << 64, (1200, S.WIDE), dtype=np.uint64)
    for i in g.permutation(n)[:alike]:  # near copies in groups of about alike / 12
        fp[i] = fp[i % 12] ^ np.uint64(1 << int(g.integers(64)))
    points, asked = S._points(fp), []

    def near(f, a, b):
        asked.append(max(len(a), len(b)))
        return S._wide_distance(f, a, b, most)

    d = np.bitwise_count(fp[:, None] ^ fp[None]).sum(2, dtype=np.int64)
    pairs = S._sifted(points, most, n * n)
    a, b = np.nonzero(np.triu(d <= most, 1))
    assert {*zip(a.tolist(), b.tolist(), strict=True)} <= {*zip(*(x.tolist() for x in pairs), strict=True)} and len(pairs[0]) <= len(a) + n // 100
    links = S._links(np.zeros(n, np.int64), points, np.arange(n), near, S.SURE, S.BUDGET, lambda f, enough: S._sifted(f, most, enough))
    want, got = common.united(a, b), common.united(np.array(links[0], np.int64), np.array(links[1], np.int64))
    assert [x.tolist() for x in got] == [x.tolist() for x in want]
    if alike <= 300:  # unlike members: not a step each, and not a look at every pair
        assert len(asked) == (len(pairs[0]) > 0) and sum(asked) < n * S.SIFT_LINKS


def test_runs_after_sifted_ones_keep_their_places():
    g = np.random.default_rng(3)
    size = [1, 60, 3, 1, 400, 2, 30, 24]
    key = np.repeat(np.arange(len(size)), size)
    fp = g.integers(0, 1 << 64, (len(key), S.WIDE), dtype=np.uint64)
    for at in np.flatnonzero(key[1:] == key[:-1])[::3]:
        fp[at + 1] = fp[at] ^ np.uint64(5)
    points, most, rep = S._points(fp), S.most_bits(0.8), np.arange(len(key)) + 1000
    near = lambda f, a, b: S._wide_distance(f, a, b, most)
    got = S._links(key, points, rep, near, S.SURE, S.BUDGET, lambda f, enough: S._sifted(f, most, enough))
    old = S._links(key, points, rep, near, S.SURE, S.BUDGET)
    assert len(got[0]) > 100 and {*zip(*got, strict=True)} == {*zip(*old, strict=True)}
