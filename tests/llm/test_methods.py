"""The learned operators against plain versions of the same arithmetic, and their bounds on long texts."""

import itertools
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import langid, pii, quality, secrets


# ---- personal data ----


def segmentations(segs):
    """Every way to cut the tokens into outside tokens and entities: lists of (kind, features)."""
    if not segs:
        yield []
        return
    j = len(segs) - 1
    for before in segmentations(segs[:j]):
        yield [*before, (-1, (), None)]
    for i, a, b, f in segs[j]:
        for before in segmentations(segs[:i]):
            for k in range(len(pii.KINDS)):
                yield [*before, (k, f, (a, k, b))]


def weight(field, way):
    total, p = 0.0, -1
    for k, f, _ in way:
        total += field.w.get((p, k), 0.0) + (field.score(k, f) if k >= 0 else 0.0)
        p = k
    return total


@pytest.mark.parametrize("text", ["call 212-555-0182 now", "a (at) b.com 12", "4111 1111 1111", "x 10.0.0.1 y"])
def test_field_equals_all_segmentations(text):
    field = pii.trained()
    (row,) = pii.stretches(text)
    segs = field.segments(text, row)
    ways = list(segmentations(segs))
    weights = [weight(field, w) for w in ways]
    total = math.log(sum(math.exp(x - max(weights)) for x in weights)) + max(weights)
    assert field.sums(segs)[2] == pytest.approx(total, abs=1e-8)
    best = ways[int(np.argmax(weights))]
    assert [x[:3] for x in field.best(segs)] == [s for _, _, s in best if s]
    want: dict = {}
    for w, x in zip(ways, weights, strict=True):
        for s in {s for _, _, s in w if s}:
            want[s] = want.get(s, 0.0) + math.exp(x - total)
    got: dict = {}
    for _, k, p, s, _ in field.marginals(segs):
        if s is not None:
            got[s[1], k, s[2]] = got.get((s[1], k, s[2]), 0.0) + p
    assert {k: v for k, v in want.items() if v > 1e-6} == pytest.approx({k: v for k, v in got.items() if v > 1e-6}, abs=1e-6)


@pytest.mark.parametrize("entity", ["ann (at) host.example.com", "ann [at] host [dot] com", "(212) 555-0182"])
def test_entities_at_every_place_around_a_piece_border(entity):
    field = pii.trained()
    n = len(entity.split())
    for before in [*range(pii.PIECE - n - 3, pii.PIECE + 4), 2 * pii.PIECE - 1]:
        text = " ".join(["17"] * (before - 1)) + " call " + entity + " now " + " ".join(["18"] * 30)
        at = text.index(entity)
        found = field.find(text, [])
        assert any(a == at and b == at + len(entity) for a, _, b in found), before


@pytest.mark.parametrize("letters", [20, 50, 200, 500])
def test_long_addresses(letters):
    g = random.Random(1)
    name = "".join(g.choices("abcdefghijklmnopqrstuvwxyz", k=letters))
    text = f"write to {name} (at) example.com today"
    at = text.index(name)
    assert [x for x in pii.trained().find(text, []) if x[0] == at and text[x[0] : x[2]].endswith("example.com")]


def test_long_tokens_and_many_spans_take_linear_time():
    field = pii.trained()

    def seconds(text):
        start = time.time()
        pii.spans(text, field)
        return time.time() - start

    pairs = lambda n: "a.b@c.de 10.1.2.3 (212) 555-0182, " * n
    one = lambda n: ("x" * 70 + "7") * n
    for make, n in ((pairs, 1000), (one, 3000)):
        seconds(make(50))
        assert seconds(make(4 * n)) < 8 * max(seconds(make(n)), 0.05)


def test_cover():
    g = random.Random(2)
    spans = sorted((a, 0, a + g.randint(1, 9)) for a in (g.randrange(300) for _ in range(40)))
    cover = pii._cover(spans)
    for a, b in itertools.product(range(0, 310, 3), (1, 4, 11)):
        assert pii._meets(cover, a, a + b) == any(x < a + b and a < y for x, _, y in spans)


# ---- secrets ----


def test_markov_scores_equal_a_plain_count(spark):
    rows = [("aB3xK9qLmZ2", True), ("Zx81kQp0", True), ("user_name", False), ("get-value", False), ("é9", True), (None, True), ("x", False), ("same", None)]
    model = secrets.train(spark.createDataFrame(rows, "token string, random boolean"))
    at = lambda c: secrets.ALPHABET.find(c) + 1
    count = {True: np.full((secrets.STATES,) * 2, 0.5), False: np.full((secrets.STATES,) * 2, 0.5)}
    for t, y in rows:
        if t is not None and y is not None:
            for a, b in zip(t, t[1:]):  # noqa: B905
                count[y][at(a), at(b)] += 1
    log = {y: np.log(c / c.sum(1, keepdims=True)) for y, c in count.items()}
    ratio = log[True] - log[False]
    assert np.allclose(np.array(model.table).reshape(ratio.shape), ratio, atol=1e-9)
    mean = lambda t: np.mean([ratio[at(a), at(b)] for a, b in zip(t, t[1:])])  # noqa: B905, E731
    got = spark.createDataFrame([("q9Zk",), ("user",)], "t string").select("t", secrets._score(F.col("t"), model.column()).alias("s")).collect()
    assert all(abs(r.s - mean(r.t)) < 1e-5 for r in got)
    means = {y: np.mean([mean(t) for t, z in rows if t and len(t) > 1 and z is y]) for y in (True, False)}
    assert model.threshold == pytest.approx((means[True] + means[False]) / 2, abs=1e-5)


def test_spans_clear_of_base_ones(spark, monkeypatch):
    monkeypatch.setattr(secrets, "BLOCK", 4)
    g = random.Random(4)
    rows, want = [], []
    for i in range(60):
        base = sorted((a, g.randrange(3), a + g.randint(1, 8)) for a in (g.randrange(120) for _ in range(g.randint(0, 14))))
        more = sorted((a, 3, a + g.randint(1, 5)) for a in (g.randrange(120) for _ in range(g.randint(1, 14))))
        rows.append((i, base, more))
        want.append((i, sorted([*base, *(m for m in more if not any(x < m[2] and m[0] < y for x, _, y in base))])))
    kind = "array<struct<start: int, kind: int, end: int>>"
    got = spark.createDataFrame(rows, f"i int, b {kind}, m {kind}").select("i", secrets._clear(F.col("b"), F.col("m")).alias("x")).orderBy("i").collect()
    assert [(r.i, [tuple(x) for x in r.x]) for r in got] == want


def test_one_very_long_token(spark):
    text = "a1B2" * 60_000 + " password=hunter22 " + "0123456789abcdef" * 2
    model = secrets.Model([0.0] * secrets.STATES**2, 1.0)
    (r,) = secrets.find(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).collect()
    assert [x.kind for x in r.secrets] == [0, 2]


# ---- language ----


def test_language_scores_equal_a_dense_softmax():
    texts = ["el perro come pan", "the dog eats bread", "der hund frisst brot"] * 3
    docs = [(t, k % 3) for k, t in enumerate(texts)]
    rows, dense = [], []
    for t, y in docs:
        x = np.zeros(langid.BUCKETS)
        for b in langid.ngrams(t):
            np.add.at(x, b, 1)
        x /= x.sum()
        at = np.flatnonzero(x)
        rows.append((at, x[at] * langid.SCALE, y))
        dense.append(x)
    w = langid.ftrl(rows, 3, epochs=30)
    model = langid.Model(["es", "en", "de"], (w[:-1] * langid.SCALE).astype(np.float32), w[-1], 0.7)
    for (t, y), x in zip(docs, dense, strict=True):
        z = (x * langid.SCALE) @ w[:-1] + w[-1]
        p = np.exp(z / 0.7) / np.exp(z / 0.7).sum()
        lang, score = model.predict(t)
        assert lang == ["es", "en", "de"][int(p.argmax())] == ["es", "en", "de"][y] and score == pytest.approx(p.max(), abs=1e-4)


def test_ftrl_takes_the_published_steps():
    g = np.random.default_rng(0)
    rows = [(np.sort(g.choice(6, 3, replace=False)), g.random(3), int(g.integers(2))) for _ in range(9)]
    got = langid.ftrl(rows, 2, epochs=2, alpha=0.3, beta=0.7, l1=0.02, l2=0.05, size=6)
    z, n = np.zeros((7, 2)), np.zeros((7, 2))

    def w_of(i, c):
        if abs(z[i, c]) <= 0.02:
            return 0.0
        return -(z[i, c] - math.copysign(0.02, z[i, c])) / ((0.7 + math.sqrt(n[i, c])) / 0.3 + 0.05)

    order = np.random.default_rng(7)
    for _ in range(2):
        for k in order.permutation(9):
            at, x, y = rows[k]
            feats = [*zip(at.tolist(), x.tolist(), strict=True), (6, 1.0)]
            s = [sum(v * w_of(i, c) for i, v in feats) for c in range(2)]
            p = [math.exp(v - max(s)) for v in s]
            p = [v / sum(p) for v in p]
            steps = [(i, c, v * (p[c] - (c == y)), w_of(i, c)) for i, v in feats for c in range(2)]
            for i, c, d, w in steps:
                z[i, c] += d - (math.sqrt(n[i, c] + d * d) - math.sqrt(n[i, c])) / 0.3 * w
                n[i, c] += d * d
    assert np.allclose(got, [[w_of(i, c) for c in range(2)] for i in range(7)])


# ---- quality ----


def test_quality_scores_equal_a_plain_forward_pass():
    g = np.random.default_rng(5)
    x = g.normal(0, 1, (400, 6))
    y = (x[:, 0] + x[:, 1] ** 2 > 0.8).astype(float)
    net = quality.Network(x, y, hidden=5, epochs=40)
    net.temperature = 1.7
    for row, got in zip(x[:30], net.score(x[:30]), strict=True):
        s = [max(-8.0, min(8.0, (v - m) / d)) for v, m, d in zip(row, x.mean(0), x.std(0) + 1e-9, strict=True)]
        h = [math.tanh(sum(s[i] * net.p[0][i, j] for i in range(6)) + net.p[1][j]) for j in range(5)]
        z = sum(h[j] * net.p[2][j] for j in range(5)) + float(net.p[3])
        assert got == pytest.approx(1 / (1 + math.exp(-z / 1.7)), abs=1e-9)
    assert ((net.score(x) >= 0.5) == y).mean() > 0.8


def plain_context(texts):
    out = np.zeros((quality.WORDS, quality.DIMS + 1), np.int64)
    for t in texts:
        w = [int(x) for p in quality.places(t) for x in p]
        for i, x in enumerate(w):
            out[x, quality.DIMS] += 1
            for j in range(max(0, i - quality.WINDOW), min(len(w), i + quality.WINDOW + 1)):
                if j != i:
                    out[x, quality._PLUS[w[j]]] += 1
                    out[x, quality._MINUS[w[j]]] -= 1
    return out


@pytest.mark.parametrize("chunk", [1 << 22, 60, 7])
def test_word_vectors_equal_a_plain_count(spark, monkeypatch, chunk):
    monkeypatch.setattr(quality, "CHUNK", chunk)
    g = random.Random(7)
    texts = [" ".join(g.choices(["one", "two.", "três", "x-y", "4"], k=g.randint(0, 60))) for _ in range(30)] + [None, "", "one", "one", " \n"]
    got = quality.context(spark.createDataFrame([(t, 1) for t in texts], "text string, sums int").repartition(3))
    assert (got == plain_context(texts)).all()
    table = quality.vectors(got)
    monkeypatch.setattr(quality, "CHUNK", 1 << 22)
    whole = [quality.pooled(t, table) for t in texts]
    monkeypatch.setattr(quality, "CHUNK", chunk)
    assert np.allclose([quality.pooled(t, table) for t in texts], whole, atol=1e-6)


def test_repeated_rows_and_clashing_columns(spark):
    rows = [(i, ("good plain words here " if i % 2 else "zz!! qq?? ") * 8, 9, 9.0) for i in range(40)] + [(3, "good plain words here " * 8, 9, 9.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, place int, score double")
    labels = spark.createDataFrame([(i, i % 2, 5) for i in range(40)] + [(3, 1, 5)], "doc_id long, quality int, toxic int")
    out = quality.score(docs, quality.train(docs, labels))
    assert out.columns == ["doc_id", "text", "place", "score"] and out.count() == 41
    assert [r.n for r in out.where("doc_id = 3").groupBy("score").agg(F.count("*").alias("n")).collect()] == [2]
