"""Each stage against what it must keep and drop; the registered queries' schemas; the driver's contract."""

import os
import random

import public_tokenizers as P
import pytest
import tiktoken

import corpus_pipeline as C
from quire.llm import bpe, registry

DATA = os.environ.get("QUIRE_TEST_DATA", "/root/testdata/sf0.001")
G = random.Random(4)
LANGS = {"aa": ["tha", "ing", "er", "ound"], "bb": ["que", "eau", "é", "ou"]}


def prose(lang, n):
    return " ".join("".join(G.choices(LANGS[lang], k=G.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("corpus"))
    item = prose("aa", 40)
    rows = [(i, prose(lang, 120), lang) for i, lang in enumerate(["aa", "bb"] * 30)]
    rows += [(100, rows[0][1], "aa"), (101, rows[2][1].replace(rows[2][1].split()[60], "changed", 1), "aa"), (102, prose("aa", 50) + " " + item + " " + prose("aa", 50), "aa"), (103, "12 34 !!", "aa"), (104, None, "aa"), (105, prose("bb", 80) + " mail ann@host.example.com now", None), (106, "", "bb")]
    rows += [(107, prose("aa", 90), "aa")] * 2 + [(None, prose("bb", 90), "bb")]
    spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, ids = docs.columns, lambda df: sorted(str(r.doc_id) for r in df.select("doc_id").collect())
    want = set(ids(docs))
    for name, stage in C.STAGES:
        out = stage(spark, docs, folder)
        if name != "tokens":
            assert out.columns == columns and out.schema == docs.schema
        out = spark.createDataFrame(out.collect(), out.schema)
        got = ids(out)
        want -= {"language": {"103", "104", "106"}, "near_duplicates": {"100", "101"}, "decontamination": {"102"}}.get(name, set())
        assert set(got) == want
        assert got.count("107") == (2 if name == "language" else 1)
        if name == "language":
            assert {r.lang for r in out.where("doc_id = 105").collect()} == {"bb"}
        if name == "personal_data":
            r = out.where("doc_id = 105").first()
            assert r.text.endswith("mail [EMAIL] now") and r.n_chars == len(r.text)
        if name == "tokens":
            v = bpe.Vocabulary.parse(open(P.path("byte_bpe_multi_50k.tiktoken"), "rb").read())
            lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=v.ranks, special_tokens={})
            assert all(r.ids == lib.encode_ordinary(r.text) and r.n_tokens == len(r.ids) for r in out.collect())
        docs = out


def test_clashing_columns_pass_through(spark, folder):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = ["_lang", "_score", "masked", "spans", "n_email", "component_id", "place", "fp", "count"]
    docs = docs.withColumns({n: F.concat(F.lit(n), "doc_id") for n in names})
    for name, stage in C.STAGES:
        out = stage(spark, docs, folder)
        if name != "tokens":
            assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(r[n] == (None if r.doc_id is None else f"{n}{r.doc_id}") for r in rows for n in names)
        docs = spark.createDataFrame(rows, out.schema)


def test_texts_stay_where_few_documents_are_contaminated(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    least = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = C.drop_contaminated(spark, docs, folder)
        plan = out._jdf.queryExecution().executedPlan().toString()
        got = out.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", least)
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r.doc_id) for r in docs.collect() if r.doc_id != 102)


def test_run(spark, folder):
    assert {"doc_id", "text", "ids", "n_tokens"} <= set(C.run(spark, folder).columns)


def test_empty_corpus(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in C.STAGES:
        docs = stage(spark, docs, folder)
        assert docs.count() == 0


SCHEMAS = {
    "op1_": {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"},
    "op2_": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"},
    "op3_": {"doc_id": "bigint", "n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"},
    "op4_": {"doc_id": "bigint", "item_id": "bigint"},
    "op5_": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op6_": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op7_": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op8_": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op9_": {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"},
    "op10_": {"doc_id": "bigint", "n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint", "base_sha256": "string", "spans": "string"},
}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("prefix", SCHEMAS)
def test_registered_queries(spark, prefix):
    (name,) = [k for k in registry.queries() if k.startswith(prefix)]
    df = registry.queries()[name](spark, DATA)
    assert {k: v for k, v in df.dtypes if k in SCHEMAS[prefix]} == SCHEMAS[prefix]
    assert df.count() > 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "benchmark", "labels"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = registry.queries()[name](spark, DATA)
    r = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(repr, map(tuple, df.select(*names).collect()))) == sorted(map(repr, r.fetchall()))
