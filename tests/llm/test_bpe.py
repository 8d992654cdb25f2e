import random
from hashlib import sha256

import public_tokenizers as P
import pytest
import tiktoken

from quire.llm import bpe, common, pii

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def vocabulary():
    with open(PATH, "rb") as f:
        return bpe.Vocabulary.parse(f.read())


@pytest.fixture(scope="module")
def library(vocabulary):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})


def _texts():
    g = random.Random(1)
    out = ["", " ", "\n\n  \n", "a", "<|endoftext|>", "l'été d'hier we'll", "😀" * 50, "x" * 5000, " " * 3000, "1234567890" * 30, "Ünïcödé ß 漢字かな", "\x00\x01", "é"]
    return out + ["".join(g.choice("abc thneroif   éß,.'\n0漢😀") for _ in range(g.randrange(300))) for _ in range(300)]


def test_encoding_equals_the_library(vocabulary, library):
    e = bpe.Encoder(vocabulary, P.PATTERN)
    for _ in range(2):  # the second time from the cache
        for t in _texts():
            ids = e.encode(t)
            assert ids == library.encode_ordinary(t)
            assert vocabulary.decode(ids) == t.encode()


def test_small_caches_change_nothing(vocabulary, library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_PIECES", 3)
    e = bpe.Encoder(vocabulary, P.PATTERN)
    for t in _texts():
        assert e.encode(t) == library.encode_ordinary(t)


def test_appends_and_edits_are_exact(vocabulary):
    g = random.Random(2)
    for _ in range(400):
        data = "".join(g.choice("thenations éß漢 ing") for _ in range(g.randrange(60))).encode()
        p = bpe.Prefixes(vocabulary, data)
        more = "".join(g.choice("ing tion") for _ in range(g.randrange(6))).encode()
        p.append(more)
        data += more
        assert p.ids() == vocabulary.merged(data) if data else p.ids() == []
        a = g.randrange(len(data) + 1)
        b = min(len(data), a + g.randrange(5))
        new = b"the"[: g.randrange(4)]
        p.edit(a, b, new)
        data = data[:a] + new + data[b:]
        assert p.data == data and p.ids() == (vocabulary.merged(data) if data else [])
        assert p.last == bpe.Prefixes(vocabulary, data).last


def test_an_edit_computes_few_entries(vocabulary):
    p = bpe.Prefixes(vocabulary, b"the nation " * 2000)
    assert p.edit(5, 6, b"N") < 500


def test_a_missing_byte_is_an_error():
    v = bpe.Vocabulary({b"a": 0})
    with pytest.raises(ValueError):
        bpe.Prefixes(v, b"ab")


ROWS = [(1, "the end", "x"), (None, None, "y"), (2, "", None), (2, "", None), (3, "word " * 20_000, "z")]


def test_digests(spark, library):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, n_tokens string")
    got = bpe.digests(df, PATH, P.PATTERN)
    assert got.columns == ["doc_id", "text", "n_tokens", "ids_sha256", "decoded_sha256"]
    for r in got.collect():
        ids = library.encode_ordinary(r.text or "")
        assert r.n_tokens == len(ids) and r.ids_sha256 == sha256(",".join(map(str, ids)).encode()).hexdigest() and r.decoded_sha256 == sha256((r.text or "").encode()).hexdigest()


def test_round_trip_and_empty_tables(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, ids string")
    got = bpe.decode(bpe.encode(df, PATH, P.PATTERN), PATH).collect()
    assert sorted(bytes(r.decoded) for r in got) == sorted((r[1] or "").encode() for r in ROWS)
    assert bpe.digests(df.limit(0), PATH, P.PATTERN).count() == 0
    assert bpe.decode(spark.createDataFrame([(None,)], "ids array<int>"), PATH).first().decoded is None


def test_workers_let_go_of_caches(spark):
    """A worker that has encoded or looked for personal data is used again by other operators; nothing of these is held then."""
    docs = spark.createDataFrame([(i, f"text {i} call 555-{i:03}-0199") for i in range(400)], "doc_id long, text string").repartition(8)
    left = lambda b: {"n": [len(bpe._held) + pii._remembered.cache_info().currsize] * b.num_rows}
    for _ in range(2):
        bpe.encode(docs, PATH, P.PATTERN).write.format("noop").mode("overwrite").save()
        assert common.arrow_map(docs, left, "n int").where("n > 0").count() == 0
        pii.find(docs).write.format("noop").mode("overwrite").save()
        assert common.arrow_map(docs, left, "n int").where("n > 0").count() == 0


def test_a_worker_keeps_the_cache_of_its_own_operator():
    lines = open(PATH, "rb").read()
    common.let_go()
    e = bpe._encoder(lines, P.PATTERN)
    common.let_go("bpe")
    assert bpe._encoder(lines, P.PATTERN) is e
    common.let_go()
    assert not bpe._held
