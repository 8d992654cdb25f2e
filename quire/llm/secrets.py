"""Secret scans, in DataFrame functions only.

Base spans come from fixed patterns. Further spans come from two first-order Markov models of characters, one
of random strings and one of ordinary identifiers: a token of LEAST characters or more with letters and digits is
a secret if its mean log-likelihood ratio is nearer the random samples' mean than the identifiers'. Both models are
counted from labelled samples by aggregations; a model is a table of at most 68 * 68 numbers.

Places: a text is split at a pattern's matches, so lengths of what lies between and of the matches add up to
the places. Sums go over blocks of BLOCK matches, so that a text with very many of them takes no quadratic time.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import common

# Kinds and patterns of the base spans, in the order of their report.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "markov")

LEAST, BLOCK = 20, 128
TOKEN = rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{LEAST},}}"
ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-"
STATES = len(ALPHABET) + 1
#: Documents whose words are the sample of ordinary identifiers, and generated random strings.
SAMPLE_DOCS, SAMPLE_RANDOM = 400, 4_000


def let(x: Column, f) -> Column:
    """f(x) with x worked out once."""
    return F.element_at(F.transform(F.array(x), f), 1)


def _total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0), lambda a, b: a + b)


def located(text: Column, pattern: str, kind: int, group: int = 0, least: int = 0) -> Column:
    """array<struct<start, kind, end, token>> of the pattern's leftmost non-overlapping matches whose group has `least` characters or more; code points, end exclusive."""

    def of(t: Column) -> Column:
        return let(F.struct(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)).alias("m"), F.regexp_extract_all(t, F.lit(pattern), F.lit(group)).alias("g"), F.split(t, pattern, -1).alias("s")), lambda q: let(F.struct(q["m"].alias("m"), q["g"].alias("g"), F.transform(q["s"], F.length).alias("s"), F.transform(q["m"], F.length).alias("n")), placed))

    def placed(q: Column) -> Column:
        step = F.zip_with(F.slice(q["s"], 1, F.size(q["n"])), q["n"], lambda a, b: a + b)
        return let(step, lambda step: let(F.transform(F.sequence(F.lit(0), F.floor((F.size(step) - 1) / BLOCK).cast("int")), lambda b: _total(F.slice(step, b * BLOCK + 1, F.lit(BLOCK)))), lambda sums: let(F.transform(sums, lambda _, b: _total(F.slice(sums, F.lit(1), b))), lambda before: F.filter(F.transform(q["m"], lambda m, i: one(q, step, before, m, i)), lambda x: x["size"] >= least))))

    def one(q: Column, step: Column, before: Column, m: Column, i: Column) -> Column:
        block = F.floor(i / BLOCK).cast("int")
        start = F.get(before, block) + _total(F.slice(step, block * BLOCK + 1, i % BLOCK)) + F.get(q["s"], i)
        return let(start, lambda at: F.struct(at.alias("start"), F.lit(kind).alias("kind"), (at + F.get(q["n"], i)).alias("end"), m.alias("token"), F.length(F.get(q["g"], i)).alias("size")))

    return F.when(text.rlike(pattern), let(text, of))


def _states(token: Column) -> Column:
    return F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c))


def _score(token: Column, table: Column) -> Column:
    """Mean log-likelihood ratio of the token's steps."""
    return let(_states(token), lambda s: F.aggregate(F.sequence(F.lit(1), F.size(s) - 1), F.lit(0.0), lambda a, i: a + F.get(table, F.get(s, i - 1) * STATES + F.get(s, i))) / (F.size(s) - 1))


class Model:
    def __init__(self, table: list[float], threshold: float):
        self.table, self.threshold = table, threshold

    def column(self) -> Column:
        return F.from_json(F.lit(f"[{','.join(f'{x:.6f}' for x in self.table)}]"), "array<double>")


def train(samples: DataFrame) -> Model:
    """From rows (token string, random boolean). Null and one-character tokens teach nothing; without samples of both labels no token is ever a secret by the models."""
    use = samples.where("token is not null and random is not null and length(token) > 1").select("random", "token", _states(F.col("token")).alias("s"))
    steps = use.select("random", F.explode(F.expr("transform(sequence(1, size(s) - 1), i -> s[i - 1] * 1000 + s[i])")).alias("step"))
    count = {(r["random"], r["step"] // 1000, r["step"] % 1000): r["n"] for r in steps.groupBy("random", "step").agg(F.count("*").alias("n")).collect()}
    if len({k[0] for k in count}) < 2:
        return Model([0.0] * STATES**2, math.inf)
    log = {}
    for label in (True, False):
        for a in range(STATES):
            row = [count.get((label, a, b), 0) + 0.5 for b in range(STATES)]
            log[label, a] = [math.log(x / sum(row)) for x in row]
    model = Model([p - q for a in range(STATES) for p, q in zip(log[True, a], log[False, a], strict=True)], 0.0)
    means = {r["random"]: r["m"] for r in use.groupBy("random").agg(F.avg(_score(F.col("token"), model.column())).alias("m")).collect()}
    model.threshold = (means[True] + means[False]) / 2
    return model


def samples(docs: DataFrame) -> DataFrame:
    """Labelled tokens: generated random strings, and identifiers made of the words of SAMPLE_DOCS documents (by a hash of the id) with what base patterns match taken out."""
    spark = docs.sparkSession
    r = spark.range(SAMPLE_RANDOM).select("id", F.sha2(F.col("id").cast("string"), 512).alias("h"))
    b64 = "base64(unhex(h))"
    n = "cast(20 + id % 21 as int)"
    random = r.selectExpr(f"substr(case id % 4 when 0 then h when 1 then {b64} when 2 then regexp_replace({b64}, '[+/=]', '') else upper(regexp_replace({b64}, '[+/=]', '')) end, 1, {n}) token", "true random")
    place = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("secrets"))
    count = docs.count()
    few = docs.select("text", place.alias("place")).where(F.pmod("place", F.lit(1 << 30)) < int(min(1.0, SAMPLE_DOCS / max(count, 1)) * (1 << 30)))
    text = F.coalesce("text", F.lit(""))
    for pattern in (ASSIGN, ACCESS, HEX):
        text = F.regexp_replace(text, pattern, " ")
    words = few.select(F.explode(F.regexp_extract_all(text, F.lit("[A-Za-z]{3,}"), F.lit(0))).alias("w")).distinct()
    plain = words.selectExpr("explode(array(w, lower(w), upper(w), concat(w, '_', lower(w)), concat(initcap(w), initcap(w)), concat(lower(w), '-', lower(w)), concat(upper(w), '_', upper(w)), concat(lower(w), '_', length(w)))) token", "false random")
    return random.unionByName(plain)


def _clear(base: Column, more: Column) -> Column:
    """All of base, and of more what overlaps none of it, sorted. Bounds to both sides are taken over blocks of BLOCK spans, so very many spans take no quadratic time."""
    most = F.lit(2**31 - 1)

    def of(q: Column) -> Column:
        ends = F.transform(q, lambda x: F.when(x["kind"] < 3, x["end"]).otherwise(F.lit(0)))
        starts = F.transform(q, lambda x: F.when(x["kind"] < 3, x["start"]).otherwise(most))
        return let(F.struct(q.alias("q"), ends.alias("e"), starts.alias("s")), blocked)

    def blocked(q: Column) -> Column:
        many = F.floor((F.size(q["q"]) - 1) / BLOCK).cast("int")
        sides = F.transform(F.sequence(F.lit(0), many), lambda b: F.struct(F.array_max(F.slice(q["e"], b * BLOCK + 1, F.lit(BLOCK))).alias("e"), F.array_min(F.slice(q["s"], b * BLOCK + 1, F.lit(BLOCK))).alias("s")))
        around = lambda x: F.transform(x, lambda _, b: F.struct(F.coalesce(F.array_max(F.slice(x["e"], F.lit(1), b)), F.lit(0)).alias("e"), F.coalesce(F.array_min(F.slice(x["s"], b + 2, F.size(x))), most).alias("s")))
        return let(sides, lambda x: let(around(x), lambda far: F.filter(F.transform(q["q"], lambda y, i: F.when((y["kind"] < 3) | alone(q, far, y, i), y)), lambda y: y.isNotNull())))

    def alone(q: Column, far: Column, y: Column, i: Column) -> Column:
        b = F.floor(i / BLOCK).cast("int")
        ahead = F.greatest(F.get(far, b)["e"], F.coalesce(F.array_max(F.slice(q["e"], b * BLOCK + 1, i % BLOCK)), F.lit(0)))
        behind = F.least(F.get(far, b)["s"], F.coalesce(F.array_min(F.slice(q["s"], i + 2, BLOCK - 1 - i % BLOCK)), most))
        return (ahead <= y["start"]) & (behind >= y["end"])

    return let(F.array_sort(F.concat(base, more)), of)


def find(docs: DataFrame, model: Model, text: str = "text", out: str = "secrets") -> DataFrame:
    """Adds array<struct<start, kind, end>> (kind a place in KINDS), sorted. A null text has none; an existing column of that name is replaced, other columns pass through.

    Spans of the models that overlap base spans are left out.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    b_, m_ = common.unused(docs.columns, "_base"), common.unused(docs.columns, "_more")
    none = F.expr("cast(array() as array<struct<start: int, kind: int, end: int, token: string, size: int>>)")
    base = F.array_sort(F.concat(*(F.coalesce(x, none) for x in (located(t, ASSIGN, 0, 2, 6), located(t, ACCESS, 1), located(t, HEX, 2)))))
    tokens = F.coalesce(F.filter(located(t, TOKEN, 3), lambda x: x["token"].rlike("[0-9]") & x["token"].rlike("[A-Za-z]") & (_score(x["token"], model.column()) > model.threshold)), none)
    bare = lambda a: F.transform(a, lambda x: F.struct(x["start"], x["kind"], x["end"]))
    spans = F.when(F.size(b_) + F.size(m_) == 0, bare(none)).when(F.size(m_) == 0, bare(F.col(b_))).otherwise(_clear(bare(F.col(b_)), bare(F.col(m_))))
    return docs.withColumns({b_: base, m_: tokens}).withColumn(out, spans).drop(b_, m_)


def listed(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def _many(spans: Column, kind: int) -> Column:
    """How many spans are of that kind. The function has one parameter: a second one would get the place in the array."""
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the numbers of base spans, their digest, and all spans; documents whose text is null or empty have none. Repeated rows all come back; further columns are ignored."""
    common.ready(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find(docs, train(samples(docs))).select("doc_id", "secrets", F.filter("secrets", lambda x: x["kind"] < 3).alias("base"))
    many = [_many(F.col("base"), k).alias(f"n_{KINDS[k]}") for k in range(3)]
    return found.select("doc_id", *many, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("secrets")).alias("spans"))


QUERIES = {"op9_secrets": op9}
ORACLE_SQL: dict[str, str] = {}
