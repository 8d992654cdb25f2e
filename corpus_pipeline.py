"""The corpus pipeline: five stages over the table documents, each over all that the stage before it kept.

Rows in and rows out have the columns of `documents` (the last stage adds its own). Between stages the rows are written as
Parquet in the shared folder and read back. No stage holds more of the corpus than a batch in any process.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import bpe, common, decontaminate, langid, pii, simhash

#: Documents whose language is predicted with a lower calibrated probability are rejected.
LEAST_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter, with a null text, or whose language stays unsure; lang becomes the predicted one. The model learns from the given rows whose id may be learned from."""
    model = langid.train(docs.where(langid.may_learn()))
    lang, score = common.unused(docs.columns, "_lang"), common.unused(docs.columns, "_score")
    out = langid.predict(docs, model, lang=lang, score=score).where((F.col(lang) != langid.UND) & (F.col(score) >= LEAST_SCORE))
    return out.withColumn("lang", F.col(lang)).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Groups of texts that are alike, or whose five-word shingles overlap by an estimated 0.8 or more: the document with the smallest id stays. Rows with a null id stay.

    Of rows that share an id one stays, whatever their texts: that of the smallest text.
    """
    groups = simhash.similar(docs, shingle_words=5, similarity=0.8)
    stay = docs.join(groups.where("doc_id > component_id").select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)
    shared = common.written(docs.groupBy("doc_id").count().where("doc_id is not null and count > 1").select("doc_id"), "shared")
    if shared.isEmpty():
        return stay
    one = stay.join(shared, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct("text", *(c for c in docs.columns if c != "text"))).alias("r"))
    return stay.join(shared, "doc_id", "left_anti").select(docs.columns).unionByName(one.select("r.*").select(docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; rows with a null id stay."""
    found = decontaminate.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id").where("doc_id is not null").distinct()
    return common.with_ids(docs, common.written(found, "contaminated"), "left_anti").select(docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in the text, and n_chars follows. No document goes."""
    back = {c: common.unused(docs.columns, f"_{c}") for c in docs.columns if c.lower() in pii.ADDED}
    out = pii.find(docs.withColumnsRenamed(back)).withColumn("text", F.col("masked")).drop(*back).withColumnsRenamed({v: k for k, v in back.items()})
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the token ids of the whole text and their number; no document goes."""
    import public_tokenizers as p

    path = p.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode(docs, path, p.PATTERN).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", mask_personal_data),
    ("tokens", tokenize),
]

#: Learned models and fingerprints have no SQL: the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, common.written(stage(spark, docs, sf_dir), f"stage-{name}")
        common.drop_written(before)
    return docs
