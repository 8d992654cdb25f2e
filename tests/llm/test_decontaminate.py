import random

import numpy as np
import pytest

from quire.llm import decontaminate as D

G = random.Random(1)
WORDS = ["".join(G.choices("abcdefgh", k=5)) for _ in range(800)]
ITEMS = [(i, " ".join(G.choices(WORDS, k=G.randint(15, 60))).capitalize() + ". " + " ".join(G.choices(WORDS, k=6)) + ".") for i in range(30)] + [(30, None), (31, ""), (32, "tiny one"), (33, " ".join(G.choices(WORDS, k=400)))]


def filler(n):
    return " ".join(G.choices(WORDS, k=n))


def brute(docs, items):
    """All passages against all parts, by the definition."""
    parts = [(i, at, t[at : at + D.PART]) for i, s in items if s for t in (D.question_and_answer(s)[0],) for at in range(0, len(t), D.PART)]
    df = {}
    for _, _, t in parts:
        for x in set(t.tolist()):
            df[x] = df.get(x, 0) + 1
    mean = sum(len(t) for *_, t in parts) / len(parts)
    out = set()
    for d, s in docs:
        t = D.tokens(s)
        for at in range(0, len(t), D.PART):
            own = set(t[at : at + 2 * D.PART].tolist())
            for i, _, p in parts:
                w = {}
                for x in set(p.tolist()):
                    tf = (p == x).sum()
                    w[x] = np.log(1 + (len(parts) - df[x] + 0.5) / (df[x] + 0.5)) * tf * (D.K1 + 1) / (tf + D.K1 * (1 - D.B + D.B * len(p) / mean))
                if sum(v for x, v in w.items() if x in own) / sum(w.values()) >= D.THRESHOLD:
                    out.add((d, i))
    return out


DOCS = [(100 + k, f"{filler(G.randint(0, 300))} {ITEMS[k % 30][1].upper() if k % 3 == 0 else ITEMS[k % 30][1]} {filler(G.randint(0, 300))}") for k in range(25)] + [(200 + k, filler(G.randint(0, 500))) for k in range(25)] + [(300, None), (301, ""), (None, ITEMS[3][1]), (302, ITEMS[33][1] + " " + filler(20)), (303, "tiny one")]


@pytest.mark.parametrize("shard, index, block", [(16 << 20, 32 << 20, 4), (4000, 32 << 20, 1), (16 << 20, 40_000, 3)])
def test_retrieval_equals_brute_force(spark, monkeypatch, shard, index, block):
    monkeypatch.setattr(D, "SHARD_BYTES", shard)
    monkeypatch.setattr(D, "INDEX_BYTES", index)
    monkeypatch.setattr(D, "BLOCK", block)
    docs = spark.createDataFrame([(*d, 1) for d in DOCS], "doc_id long, text string, item_id int")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in D.matches(docs, items).collect()} == brute(DOCS, ITEMS)


def test_planted_items_are_found_and_clean_texts_stay(spark):
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS + ITEMS[:2], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in D.contaminated(docs, items).collect()}
    assert got == {(100 + k, k % 30) for k in range(25)} | {(None, 3), (302, 33), (303, 32)}


def test_long_texts_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(D, "PIECE", 3000)
    monkeypatch.setattr(D, "SLICE", 2 * D.PART)
    long = [(40, " ".join(G.choice("xyz") * 400 + str(G.random()) for _ in range(100)))]  # a part of 40,000 characters
    for places in range(0, 3 * D.PART, 37):
        text = filler(2000 + places) + " " + ITEMS[7][1] + " " + filler(300) + " " + long[0][1] + " " + filler(100)
        assert list("".join(D._pieces(text))) == list(text)
        index, facts = one_index(ITEMS[:30] + long)
        found: dict = {}
        for some in D._slices([D.tokens(text)]):
            for _, p, _, x in index.search([t for _, t in some]):
                found[p] = max(found.get(p, 0), sum(index.covered(p, x)))
        whole = {i: sum(n for p, n in found.items() if facts[index.item[p]] == i) for i in (7, 40)}
        assert whole == {7: len(D.tokens(ITEMS[7][1])), 40: len(D.tokens(long[0][1]))}
    got = D.contaminated(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")).collect()
    assert [(r.item_id, r.total_overlap) for r in got] == [(7, 1.0)]


def one_index(items, threshold=D.THRESHOLD):
    parts = D._split([(k, *D.question_and_answer(t)) for k, (_, t) in enumerate(items)])
    terms, df = np.unique(np.concatenate([np.unique(x[2]) for x in parts]), return_counts=True)
    return D.Index(parts, terms, df, len(parts), np.mean([len(x[2]) for x in parts]), threshold), [i for i, _ in items]


def test_large_benchmark_takes_several_measured_indexes(spark, monkeypatch):
    """20 MB of items: every index under the limit, and as one small benchmark finds them."""
    monkeypatch.setattr(D, "INDEX_BYTES", 24 << 20)
    g = random.Random(5)
    vocabulary = ["".join(g.choices("abcdefghijklmnop", k=8)) for _ in range(30_000)]
    items = [(i, " ".join(g.choices(vocabulary, k=900)) + ".") for i in range(2_500)]
    held = []
    real = D.common.bounded
    monkeypatch.setattr(D.common, "bounded", lambda x, what: held.append(len(x)) or real(x, what))
    docs = spark.createDataFrame([(i, " ".join(g.choices(vocabulary, k=50)) + " " + items[50 * i][1] + " end") for i in range(12)] + [(90 + i, " ".join(g.choices(vocabulary, k=2000))) for i in range(8)], "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in D.contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(i, 50 * i) for i in range(12)} and len(held) > 3 and max(held) <= 24 << 20


@pytest.mark.parametrize("table", [False, True])
def test_a_higher_threshold_reads_less(table):
    """Entries of block maxima and postings read, as the threshold rises; on the supplied tables and on these ones."""
    docs, items = DOCS, ITEMS[:30]
    if table:
        import pyarrow.parquet as pq

        t = pq.read_table("/root/testdata/sf0.01/documents.parquet").to_pydict()
        docs = list(zip(t["doc_id"], t["text"], strict=True))
        t = pq.read_table("/root/testdata/sf0.01/benchmark.parquet").to_pydict()
        items = [(i, x) for i, x in zip(t["item_id"], t["text"], strict=True) if x]
    read, scored = [], []
    for threshold in (0.3, 0.5, 0.7, 0.9):
        index, _ = one_index(items, threshold)
        found = sum(1 for some in D._slices([D.tokens(t) for _, t in docs]) for _ in index.search([t for _, t in some]))
        read.append(index.read)
        scored.append(index.scored)
    assert read == sorted(read, reverse=True) and scored == sorted(scored, reverse=True) and found
    assert read[3] < read[1] and scored[3] < 0.75 * scored[0]


def test_texts_of_one_item_id_and_repeats(spark):
    two = [(1, ITEMS[0][1]), (1, ITEMS[1][1]), (1, ITEMS[0][1]), (None, ITEMS[2][1])]
    docs = spark.createDataFrame([(5, ITEMS[0][1], 1), (5, ITEMS[0][1], 2), (6, ITEMS[1][1], 3), (7, ITEMS[2][1], 4)], "doc_id long, text string, th int")
    got = D.contaminated(docs, spark.createDataFrame(two, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id, r.total_overlap) for r in got) == [(5, 1, 1.0), (6, 1, 1.0)]


def test_nothing(spark):
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert D.matches(docs.limit(0), items).count() == 0 and D.matches(docs, items.limit(0)).count() == 0
