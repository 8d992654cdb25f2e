"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

n-grams of one to ORDERS characters of the lower-cased text are hashed to BUCKETS; a feature is
the n-gram's share of the text's n-grams times its inverse document frequency. Document frequencies are counted over all
documents that may be learned from. The weights are trained by follow-the-regularised-leader with an elastic net, on a
sample of about SAMPLE_PER_LANG labelled documents a language (chosen by a hash of the id; a documented bound, the only one
whatever the number of languages, of which those with fewer documents give all), and a part of it that isn't trained on sets the temperature of the probabilities.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import common

BUCKETS, ORDERS = 1 << 16, 3
SAMPLE_PER_LANG = 600
#: Characters of a text that are turned into n-grams at a time.
CHUNK = 1 << 20
UND = "und"
_LETTER = regex.compile(r"\p{L}")
_MULTIPLY = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35)]


def ngrams(text: str) -> Iterator[np.ndarray]:
    """The buckets of all n-grams of the whole text, in bounded pieces."""
    text = text.lower()
    for at in range(0, len(text), CHUNK):
        c = np.frombuffer(text[at : at + CHUNK + ORDERS - 1].encode("utf-32-le", "surrogatepass"), np.uint32)
        own = min(CHUNK, len(text) - at)
        h = np.zeros(len(c), np.uint32)
        for n in range(ORDERS):
            if len(c) <= n:
                break
            h = (h[: len(c) - n] ^ c[n:]) * _MULTIPLY[n]
            h ^= h >> np.uint32(15)
            yield ((h[:own] * np.uint32(0x27D4EB2F)) >> np.uint32(16)).astype(np.intp)


def document_frequencies(docs: DataFrame) -> np.ndarray:
    """Per bucket the number of the texts of docs.text that hold it, over all of them, and in the last place their number. Each task gives out its sums."""

    def run(batches):
        common.let_go()
        seen, n = np.zeros(BUCKETS, np.int64), 0
        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    one = np.zeros(BUCKETS, bool)
                    for x in ngrams(t):
                        one[x] = True
                    seen += one
                    n += 1
        if n:
            at = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[at, BUCKETS], pa.int32()), pa.array(np.r_[seen[at], n], pa.int64())], names=["bucket", "n"])

    common.ready(docs.sparkSession)
    got = docs.select("text").mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS + 1, np.int64)
    out[got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    return out


class Model:
    """Weights with the inverse document frequencies in them, languages, temperature."""

    def __init__(self, langs: list[str], table: np.ndarray, bias: np.ndarray, temperature: float):
        self.langs, self.table, self.bias, self.temperature = langs, table, bias, temperature

    def logits(self, text: str) -> np.ndarray:
        s, n = np.zeros(len(self.langs)), 0
        for x in ngrams(text):
            s += self.table[x].sum(0, dtype=np.float64)
            n += len(x)
        return s / max(n, 1) + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs or not _LETTER.search(text):
            return UND, 0.0
        p = softmax(self.logits(text) / self.temperature)
        k = int(p.argmax())
        return self.langs[k], float(p[k])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def ftrl(examples: list[tuple[np.ndarray, np.ndarray, int]], classes: int, epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-3, size: int = BUCKETS) -> np.ndarray:
    """FTRL-Proximal on (places, values, class); the weights, size + 1 by classes, the last row being the bias."""
    z, n = np.zeros((size + 1, classes)), np.zeros((size + 1, classes))

    def weights(z, n):
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for k in order.permutation(len(examples)):
            at, x, y = examples[k]
            at, x = np.r_[at, size], np.r_[x, 1.0]
            w = weights(z[at], n[at])
            p = softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p
            grown = n[at] + g * g
            z[at] += g - (np.sqrt(grown) - np.sqrt(n[at])) / alpha * w
            n[at] = grown
    return weights(z, n)


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """That of least log-loss, by golden-section search over its logarithm."""
    if not len(y):
        return 1.0

    def loss(t: float) -> float:
        return -np.log(np.maximum(softmax(logits / np.exp(t))[np.arange(len(y)), y], 1e-300)).mean()

    lo, hi, r = -3.0, 3.0, (5**0.5 - 1) / 2
    a, b = hi - r * (hi - lo), lo + r * (hi - lo)
    for _ in range(40):
        if loss(a) < loss(b):
            hi = b
        else:
            lo = a
        a, b = hi - r * (hi - lo), lo + r * (hi - lo)
    return float(np.exp((lo + hi) / 2))


#: Feature values are shares, near 1e-4; so scaled they suit the learning rate.
SCALE = 100.0


def train(docs: DataFrame, per_lang: int = SAMPLE_PER_LANG) -> Model:
    """From rows (doc_id, text, lang). Rows with a null or empty text or a null lang teach nothing; without any, the model knows no language and predicts und."""
    spark = common.ready(docs.sparkSession)
    known = docs.where("text is not null and text <> ''").select("doc_id", "text", "lang")
    seen = document_frequencies(known)
    idf = (np.log((1 + seen[BUCKETS]) / (1 + seen[:BUCKETS])) + 1) * SCALE
    counts = {r["lang"]: r["n"] for r in known.where("lang is not null").groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0)
    langs = sorted(counts)
    share = spark.createDataFrame([(k, min(1.0, per_lang / n)) for k, n in counts.items()], "lang string, share double")
    place = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("langid"))
    chosen = known.join(F.broadcast(share), "lang").withColumn("place", place).where(F.pmod("place", F.lit(1 << 30)) < F.col("share") * (1 << 30))

    def features(b: pa.RecordBatch) -> dict:
        at, n = [], []
        for t in b.column(2).to_pylist():
            seen = np.zeros(BUCKETS, np.int64)  # whatever the length, bounded memory
            for x in ngrams(t):
                seen += np.bincount(x, minlength=BUCKETS)
            at.append(np.flatnonzero(seen))
            n.append(seen[at[-1]])
        return {"place": b.column(0), "lang": b.column(1), "at": at, "n": n}

    rows = common.arrow_map(chosen.select("place", "lang", "text"), features, "place bigint, lang string, at array<int>, n array<int>")
    # only ids that many rows share make the samples much larger; languages that give all go first
    few = F.col("lang").isin([k for k, n in counts.items() if n <= per_lang])
    rows = rows.orderBy(~few, "place").limit(2 * per_lang * len(langs)).toArrow().sort_by("place")
    examples, kept = [], []
    for place, lang, at, n in zip(*(rows.column(c) for c in ("place", "lang", "at", "n")), strict=True):
        at, n = at.values.to_numpy(), n.values.to_numpy()
        (kept if place.as_py() % 5 == 0 else examples).append((at, n / n.sum() * idf[at], langs.index(lang.as_py())))
    w = ftrl(examples, len(langs))
    y = np.array([e[2] for e in kept], int)
    z = np.array([x @ w[at] + w[-1] for at, x, _ in kept]) if kept else np.zeros((0, len(langs)))
    return Model(langs, (w[:-1] * idf[:, None]).astype(np.float32), w[-1], temperature(z, y))


def predict(docs: DataFrame, model: Model, text: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """Adds the predicted language, UND where the text is null or has no letter, and its calibrated probability (0 for UND). Existing columns of these names are replaced; all others, whatever their names, pass through."""
    spark = common.ready(docs.sparkSession)
    held = spark.sparkContext.broadcast(common.bounded(pickle.dumps(model), "the model"))
    keep = [c for c in docs.columns if c.lower() not in (lang.lower(), score.lower())]
    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    schema = StructType([*(docs.schema[c] for c in keep), StructField(lang, StringType()), StructField(score, DoubleType())])

    def run(batches):
        common.let_go()
        model = None
        for b in batches:
            model = model or pickle.loads(held.value)
            got = [model.predict(t) for t in b.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array([x for x, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())], names=[*keep, lang, score])

    return docs.select(*keep, *([text] if text not in keep else [])).mapInArrow(run, schema)


def may_learn(doc_id: str = "doc_id"):
    """Documents whose crc32 of the id as text, modulo 3, is not 1. A null id may be learned from by nobody."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 != 1, F.lit(False))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its predicted language; a null id counts as not held out and isn't learned from. Null, empty and letterless texts are und; repeated rows all come back; further columns are ignored."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.where(may_learn()))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


QUERIES = {"op7_langid": op7}
ORACLE_SQL: dict[str, str] = {}
