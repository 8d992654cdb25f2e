"""Document quality: random-indexing word vectors, pooled, and a two-layer network.

Words are runs of letters and digits or of other characters, hashed to WORDS places. Each place has
a sparse ternary index vector; a word's vector is the sum of the index vectors of its neighbours within WINDOW places,
over all words of all documents: whole-number sums, alike however the rows are dealt. A document is pooled to
the mean and spread of its words' vectors, rare words weighing more. The network (tanh, then a sigmoid) is fitted with
numpy on at most SAMPLE_MOST labelled documents, chosen by a hash of the id (a documented bound); a part of
these is kept from training to set the temperature of the probabilities.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import common, langid, words

WORDS, DIMS, WINDOW = 1 << 14, 32, 2
#: Parts of the table that are added apart, and groups of tasks whose sums are added first.
SLICES, GROUPS = 64, 16
SAMPLE_MOST = 8_000
#: Bytes of a text that are looked at at a time.
CHUNK = 1 << 22

_random = np.random.default_rng(11)
_PLUS = _random.integers(0, DIMS, WORDS)
_MINUS = (_PLUS + _random.integers(1, DIMS, WORDS)) % DIMS


_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def places(text: str | None) -> Iterator[np.ndarray]:
    """The places of the text's words, in order, in pieces of about CHUNK bytes."""
    data, at = (text or "").encode("utf-8", "surrogatepass"), 0
    while at < len(data):
        m = _SPACE.search(data, at + CHUNK) if at + CHUNK < len(data) else None
        piece = data[at : m.end() if m else len(data)]
        at += len(piece)
        starts, ends = words.spans(piece, words.CLASS)
        yield (words.hashes(piece, starts, ends) & np.uint64(WORDS - 1)).astype(np.intp)


def _count(total: np.ndarray, w: np.ndarray, known: int) -> None:
    """Adds the words and neighbours of w, but for what its first `known` places have among themselves; places of -1 are gaps."""
    new = w[known:]
    total += np.bincount(new[new >= 0] * (DIMS + 1) + DIMS, minlength=len(total))
    for step in range(1, WINDOW + 1):
        first = max(0, known - step)
        a, c = w[first : max(first, len(w) - step)], w[first + step :]
        both = (a >= 0) & (c >= 0)
        a, c = a[both], c[both]
        for x, y in ((a, c), (c, a)):
            total += np.bincount(x * (DIMS + 1) + _PLUS[y], minlength=len(total))
            total -= np.bincount(x * (DIMS + 1) + _MINUS[y], minlength=len(total))


def context(docs: DataFrame) -> np.ndarray:
    """WORDS by DIMS + 1 whole numbers over all of docs.text: context sums, and in the last column the words' counts. A task gives out one row a slice; sums are added in two steps, so that no task reads one of every other."""

    def run(batches):
        total = np.zeros(WORDS * (DIMS + 1), np.int64)
        held, known, size = [], 0, 0
        gap = np.full(WINDOW, -1)
        for b in batches:
            for t in b.column(0).to_pylist():
                for x in places(t):
                    held.append(x)
                    size += len(x)
                    if size >= CHUNK:
                        w = np.concatenate(held)
                        _count(total, w, known)
                        held, known, size = [w[-WINDOW:]], min(WINDOW, len(w)), 0
                held.append(gap)  # no window crosses it
        if held:
            _count(total, np.concatenate(held), known)
        if total.any():
            parts = total.reshape(SLICES, -1)
            group = TaskContext.get().partitionId() % GROUPS
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([group] * SLICES, pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["slice", "part", "sums"])

    def add(batches):
        sums: dict[tuple, np.ndarray] = {}
        for b in batches:
            for *k, x in zip(*(c.to_pylist() for c in b.columns), strict=True):
                got, k = np.frombuffer(x, np.int64), tuple(k)
                sums[k] = sums[k] + got if k in sums else got
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in sums], pa.int32()), pa.array([k[1] for k in sums], pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["slice", "part", "sums"])

    common.ready(docs.sparkSession)
    kind = "slice int, part int, sums binary"
    got = docs.select("text").mapInArrow(run, kind).repartition("slice", "part").mapInArrow(add, kind).withColumn("part", F.lit(0)).repartition("slice").mapInArrow(add, kind).toArrow()
    out = np.zeros((SLICES, WORDS * (DIMS + 1) // SLICES), np.int64)
    for k, x in zip(got.column(0).to_pylist(), got.column(2).to_pylist(), strict=True):
        out[k] += np.frombuffer(x, np.int64)
    return out.reshape(WORDS, DIMS + 1)


def vectors(sums: np.ndarray) -> np.ndarray:
    """Unit vectors, and in the last column the weight of each word in pooling."""
    count = sums[:, DIMS].astype(np.float64)
    v = sums[:, :DIMS] / np.maximum(np.sqrt((sums[:, :DIMS].astype(np.float64) ** 2).sum(1, keepdims=True)), 1)
    share = count / max(count.sum(), 1)
    return np.c_[v, 1e-3 / (1e-3 + share)].astype(np.float32)


def pooled(text: str | None, table: np.ndarray) -> np.ndarray:
    """Mean and spread of the weighted vectors, and the mean weight; zeros for a text without words."""
    s, q, weight, n = np.zeros(DIMS), np.zeros(DIMS), 0.0, 0
    for w in places(text):
        n += len(w)
        for at in range(0, len(w), 1 << 18):
            x = table[w[at : at + (1 << 18)]]
            v = x[:, :DIMS] * x[:, DIMS:]
            s += v.sum(0, dtype=np.float64)
            q += np.einsum("ij,ij->j", v, v, dtype=np.float64)
            weight += x[:, DIMS].sum(dtype=np.float64)
    n = max(n, 1)
    mean = s / n
    return np.r_[mean, np.sqrt(np.maximum(q / n - mean**2, 0)), weight / n]


class Network:
    """Two layers; inputs are standardised."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = 24, epochs: int = 60, rate: float = 0.01, decay: float = 1e-3):
        g = np.random.default_rng(3)
        self.mean, self.std = x.mean(0), x.std(0) + 1e-9
        x = (x - self.mean) / self.std
        p = self.p = [g.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), np.zeros(hidden), g.normal(0, hidden**-0.5, hidden), np.zeros(())]
        m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
        for _ in range(epochs):
            order = g.permutation(len(x))
            for at in range(0, len(x), 128):
                i = order[at : at + 128]
                h = np.tanh(x[i] @ p[0] + p[1])
                d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - y[i]) / len(i)
                dh = d[:, None] * p[2] * (1 - h * h)
                grads = [x[i].T @ dh + decay * p[0], dh.sum(0), h.T @ d + decay * p[2], d.sum()]
                step += 1
                for k, a in enumerate(grads):
                    m[k] = 0.9 * m[k] + 0.1 * a
                    v[k] = 0.999 * v[k] + 0.001 * a * a
                    p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        self.temperature = 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        h = np.tanh(np.clip((x - self.mean) / self.std, -8, 8) @ self.p[0] + self.p[1])
        return h @ self.p[2] + self.p[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -60, 60)))


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_MOST) -> tuple[np.ndarray, Network | None, float]:
    """(word vectors, network, share of label 1) from all texts of docs and the rows (doc_id, quality) of labels.

    Null labels, ids and unknown ids teach nothing; several labels of a document all count. Of one class only there is no network, and the share is every document's score (0.5 without labels).
    """
    spark = common.ready(docs.sparkSession)
    table = vectors(context(docs))
    place = F.xxhash64(F.col("doc_id").cast("string"), F.lit("quality"))
    use = labels.where("doc_id is not null and quality in (0, 1)").select("doc_id", F.col("quality").cast("int").alias("quality"))
    count = use.count()
    use = use.withColumn("place", place).where(F.pmod("place", F.lit(1 << 30)) < int(min(1.0, most / max(count, 1)) * (1 << 30))).orderBy("place").limit(most)
    held = spark.sparkContext.broadcast(common.bounded(table.tobytes(), "the word vectors"))
    few = spark.createDataFrame(use.toArrow())  # at most `most` rows, which bounds the broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").select("place", "quality", "text")

    def features(b: pa.RecordBatch) -> dict:
        t = np.frombuffer(held.value, np.float32).reshape(WORDS, DIMS + 1)
        return {"place": b.column(0), "quality": b.column(1), "x": [pooled(x, t) for x in b.column(2).to_pylist()]}

    got = common.arrow_map(rows, features, "place bigint, quality int, x array<double>").orderBy("place", "quality").limit(2 * most).toArrow()
    y = got.column("quality").to_numpy().astype(np.float64)
    if not len(y) or y.min() == y.max():
        return table, None, float(y.mean()) if len(y) else 0.5
    x = np.stack([v.values.to_numpy() for v in got.column("x")])
    kept = got.column("place").to_numpy() % 5 == 0
    if kept.all() or len(set(y[~kept])) < 2:
        kept[:] = False
    net = Network(x[~kept], y[~kept])
    if kept.any():
        z = net.logit(x[kept])
        net.temperature = langid.temperature(np.c_[np.zeros(len(z)), z], y[kept].astype(int))
    return table, net, float(y.mean())


def score(docs: DataFrame, model: tuple[np.ndarray, Network | None, float], text: str = "text", out: str = "score") -> DataFrame:
    """Adds the calibrated probability of label 1 for every row's whole text. A null text counts as empty; an existing column of the name is replaced, all others pass through."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    spark = common.ready(docs.sparkSession)
    held = spark.sparkContext.broadcast(common.bounded(pickle.dumps(model), "the model"))
    keep = [c for c in docs.columns if c.lower() != out.lower()]
    schema = StructType([*(docs.schema[c] for c in keep), StructField(out, DoubleType())])

    def run(batches):
        model = None
        for b in batches:
            table, net, share = model = model or pickle.loads(held.value)
            texts = b.column(text).to_pylist()
            got = net.score(np.stack([pooled(t, table) for t in texts])) if net and texts else np.full(len(texts), share)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(got, pa.float64())], names=[*keep, out])

    return docs.select(*keep, *([text] if text not in keep else [])).mapInArrow(run, schema)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its quality score; a null id counts as not held out and isn't learned from. Null texts count as empty and have a score; repeated rows all come back; further columns are ignored."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(langid.may_learn())
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    out = score(docs.select("doc_id", "text"), train(docs, labels))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op8_quality": op8}
ORACLE_SQL: dict[str, str] = {}
