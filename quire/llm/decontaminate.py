"""Benchmark decontamination: a BM25 inverted index of test items, searched with block-max WAND by every passage.

Index. Items are cut into parts of at most PART words; each part is a document of the index. A posting's impact is its
BM25 weight divided by the part's own total, so a passage's score against a part is the share, by weight, of
the part that it holds. Parts lie in blocks of BLOCK; each term keeps its postings, its largest impact, and that in each block.

Search. A passage is two neighbouring runs of PART words, so any part that a text holds lies whole in some passage. A passage's
terms are put in order of their largest impacts, and the pivot is the term at which the sum of these, from the smallest
on, reaches the threshold. A part without a term from the pivot on can't reach it, so only blocks with such a term are looked at.
In these the sum of block maxima is taken: first of the terms from the pivot on, with the others' largest impacts as
their bound, then of all. The cursors of all terms skip a block whose sum stays under the threshold, and none of its
postings are read. What is left is scored exactly. All parts above the threshold are kept, whatever their
number. The threshold is fixed, so passages don't wait for each other: those of a batch move through these steps together, in arrays.

Verification. Of what is retrieved, the shares of the words of the question (all but the item's last sentence) and of the
answer (its last sentence) that lie in three-word sequences of the passage are taken.

Size. The benchmark's distinct words pass through the driver, and its items a shard at a time. An index is measured
before it is sent out, and cut in two as often as it is over the limit; each takes a pass over the documents.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import common, words

PART, BLOCK, K1, B = 128, 4, 1.2, 0.75
#: Share of a part's weight that a passage must hold to be retrieved; shares of words that verify.
THRESHOLD, BOTH, TOTAL, SHORT = 0.5, 0.5, 0.8, 8
GRAM = 3
#: Bytes of item text that one index is built of, and of a built index; what is larger takes several indexes and passes.
SHARD_BYTES, INDEX_BYTES = 8 << 20, 32 << 20
#: Characters that are split into words at a time; words of texts that are searched at a time; places of passages times blocks.
PIECE, SLICE, CELLS = 1 << 20, 1 << 18, 1 << 22
_EPS = 1e-9


def tokens(text: str | None) -> np.ndarray:
    """Hashes of the words: runs of letters and digits of the lower-cased text."""
    out = []
    for piece in _pieces(text or ""):
        data = piece.lower().encode("utf-8", "surrogatepass")
        starts, ends = words.spans(data, np.where(words.CLASS == 1, 1, 0))
        out.append(words.hashes(data, starts, ends))
    return np.concatenate(out)


_SPACE = re.compile(r"[\x20\x09-\x0D]")


def _pieces(text: str) -> Iterator[str]:
    """The text, cut at white space, so no word is cut."""
    at = 0
    while at == 0 or at < len(text):
        m = _SPACE.search(text, at + PIECE) if at + PIECE < len(text) else None
        stop = m.end() if m else len(text)
        yield text[at:stop]
        at = max(stop, 1)


_LAST = re.compile(r"(?s)(.*[.!?\n])\s*(\S.*)")


def question_and_answer(text: str | None) -> tuple[np.ndarray, int]:
    """The item's words, and how many of them are the question's. An item of one sentence is all question."""
    text = (text or "").strip()
    if m := _LAST.match(text):
        q, a = tokens(m[1]), tokens(m[2])
        if len(q) and len(a):
            return np.concatenate((q, a)), len(q)
    t = tokens(text)
    return t, len(t)


class Index:
    """Of parts (number of the item, place of the first word, words, question words). terms and df: the distinct words of all parts of all items, sorted, and how many parts have each; parts and mean: their number and mean length."""

    def __init__(self, items: list[tuple[int, int, np.ndarray, int]], terms: np.ndarray, df: np.ndarray, parts: int, mean: float, threshold: float = THRESHOLD):
        self.threshold, self.read, self.scored = threshold, 0, 0
        self.item, self.at, self.questions = (np.array([x[k] for x in items], np.int64) for k in (0, 1, 3))
        self.words = np.concatenate([x[2] for x in items]) if items else np.zeros(0, np.uint64)
        size = np.array([len(x[2]) for x in items], np.int64)
        self.end = np.cumsum(size)
        many, blocks = len(items), -(-len(items) // BLOCK)
        self.blocks = blocks
        self.terms, term = np.unique(self.words, return_inverse=True)
        key, tf = np.unique(term * max(many, 1) + np.repeat(np.arange(many), size), return_counts=True)
        term, part = key // max(many, 1), key % max(many, 1)
        n = df[np.searchsorted(terms, self.terms)][term] if len(key) else tf
        weight = np.log(1 + (parts - n + 0.5) / (n + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[part] / mean))
        self.impact = weight / np.bincount(part, weights=weight, minlength=many)[part] if len(key) else weight
        self.part = part.astype(np.int32)
        # entries: the blocks of each term, where their postings begin, and the largest impact of each
        cell = term * max(blocks, 1) + part // BLOCK
        first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else np.zeros(0, np.int64)
        self.block, self.posting = (part[first] // BLOCK).astype(np.int32), np.r_[first, len(part)]
        self.most = np.maximum.reduceat(self.impact, first) if len(first) else self.impact
        self.entry = np.searchsorted(term[first], np.arange(len(self.terms) + 1))
        self.bound = np.maximum.reduceat(self.most, self.entry[:-1]) if len(first) else self.most

    def __len__(self) -> int:
        return len(self.item)

    def own(self, part: int) -> np.ndarray:
        return self.words[(self.end[part - 1] if part else 0) : self.end[part]]

    def search(self, texts: list[np.ndarray]) -> Iterator[tuple[int, int, float, np.ndarray]]:
        """(text, part, score, the passage's words) of every passage and part that reach the threshold."""
        size = np.array([len(t) for t in texts], np.int64)
        every = np.concatenate(texts) if texts else np.zeros(0, np.uint64)
        if not len(every) or not len(self.terms):
            return
        runs = -(-size // PART)
        base = np.cumsum(runs) - runs
        inside = np.arange(len(every)) - np.repeat(np.cumsum(size) - size, size)
        run = np.repeat(base, size) + inside // PART
        k = np.searchsorted(self.terms, every)
        k[k == len(self.terms)] = 0
        hit = self.terms[k] == every
        pair = np.unique(run[hit] * len(self.terms) + k[hit])
        if not len(pair):
            return
        run_of, term, total = pair // len(self.terms), pair % len(self.terms), int(runs.sum())
        owner = np.repeat(np.arange(len(texts)), runs)
        follows = np.r_[False, owner[1:] == owner[:-1]]  # the run before is the same text's
        before = np.searchsorted(pair, pair - len(self.terms))
        again = (pair[np.minimum(before, len(pair) - 1)] == pair - len(self.terms)) & follows[run_of]
        fresh = follows[run_of] & ~again  # a term that a passage has from its second run only
        # rows of (passage, term): those of a run, and the fresh ones of the run behind it
        passage, term = np.r_[run_of, run_of[fresh] - 1], np.r_[term, term[fresh]]
        order = np.lexsort((self.bound[term], passage))
        passage, term = passage[order], term[order]
        step = max(1, CELLS // self.blocks)
        for low in range(0, total, step):
            a, b = np.searchsorted(passage, (low, low + step))
            for r, p, score in zip(*self._reached(passage[a:b] - low, term[a:b], min(step, total - low)), strict=True):
                text = int(owner[low + r])
                start = (low + r - int(base[text])) * PART
                yield text, p, score, texts[text][start : start + 2 * PART]

    def _reached(self, passage: np.ndarray, term: np.ndarray, n: int) -> tuple[list, list, list]:
        """(passage, part, score) over the threshold. Rows are sorted by passage, then by the term's bound."""
        if not len(term):
            return [], [], []
        least, bound = self.threshold - _EPS, self.bound[term]
        running = np.cumsum(bound)
        start = np.flatnonzero(np.r_[True, passage[1:] != passage[:-1]])
        running -= np.repeat((running - bound)[start], np.diff(np.r_[start, len(term)]))
        ahead = running >= least  # the pivot and the terms behind it
        rest = np.bincount(passage, weights=np.where(ahead, 0, bound), minlength=n)
        cell, entry = self._cells(passage[ahead], term[ahead])
        sums = np.bincount(cell, weights=self.most[entry], minlength=n * self.blocks)
        live = (sums > 0) & (sums + np.repeat(rest, self.blocks) >= least)
        others = ~ahead & live.reshape(n, self.blocks).any(1)[passage]
        cell, entry = self._cells(passage[others], term[others])
        keep = live[cell]
        sums += np.bincount(cell[keep], weights=self.most[entry[keep]], minlength=n * self.blocks)
        live &= sums >= least
        use = live.reshape(n, self.blocks).any(1)[passage]
        cell, entry = self._cells(passage[use], term[use])
        keep = live[cell]
        at, many = _ranges(self.posting, entry[keep])
        self.scored += len(at)
        key = np.repeat(cell[keep] // self.blocks, many) * len(self) + self.part[at]
        key, inverse = np.unique(key, return_inverse=True)
        score = np.bincount(inverse, weights=self.impact[at], minlength=len(key))
        good = score >= self.threshold
        return (key[good] // len(self)).tolist(), (key[good] % len(self)).tolist(), score[good].tolist()

    def _cells(self, passage: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The blocks of the terms: (passage * blocks + block, entry)."""
        entry, many = _ranges(self.entry, term)
        self.read += len(entry)
        return np.repeat(passage, many) * self.blocks + self.block[entry], entry

    def covered(self, part: int, passage: np.ndarray) -> tuple[int, int]:
        """How many words of the part's question and answer lie in sequences that the passage holds."""
        t = self.own(part)
        n = min(GRAM, len(t))
        there = np.isin(_grams(t, n), _grams(passage, n))
        mark = np.zeros(len(t), bool)
        for k in range(n):
            mark[k : k + len(there)] |= there
        q = int(self.questions[part])
        return int(mark[:q].sum()), int(mark[q:].sum())


def _ranges(start: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places from start[k] to start[k + 1] for each k, and their number."""
    n = start[k + 1] - start[k]
    return np.repeat(start[k] - (np.cumsum(n) - n), n) + np.arange(n.sum()), n


def _grams(t: np.ndarray, n: int) -> np.ndarray:
    """A hash of each sequence of n words."""
    m = max(0, len(t) - n + 1)
    h = np.zeros(m, np.uint64)
    for k in range(n):
        h = words.mix(h + t[k : k + m])
    return h


def _split(items: list[tuple[int, np.ndarray, int]]) -> list[tuple[int, int, np.ndarray, int]]:
    return [(i, at, t[at : at + PART], max(0, min(q - at, PART))) for i, t, q in items for at in range(0, len(t), PART)]


def _slices(texts: list[np.ndarray]) -> Iterator[list[tuple[int, np.ndarray]]]:
    """(number of the text, words) in lists of SLICE words or a little more. Slices of a longer text share a run, so every passage is in one."""
    some, size = [], 0
    for i, t in enumerate(texts):
        for at in range(0, len(t), SLICE):
            some.append((i, t[at : at + SLICE + PART]))
            size += len(some[-1][1])
            if size >= SLICE:
                yield some
                some, size = [], 0
    if some:
        yield some


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, item_id, score, question_overlap, answer_overlap, total_overlap, item_words) of documents and items with a part over the threshold.

    score is the largest of the item's parts; the overlaps are shares of all the item's words. A null text or item has no
    words and matches nothing; rows with a null id match under the null id; documents that share an id are taken together;
    different texts under one item id are items of their own, equal ones are one.
    """
    spark = common.ready(docs.sparkSession)
    items = benchmark.where("text is not null and item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    size = items.selectExpr("coalesce(sum(octet_length(text)), 0)").first()[0]
    shards = max(1, -(-int(size) // SHARD_BYTES))
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def count(batches):
        common.let_go()
        for b in batches:
            for t in b.column(0).to_pylist():
                t = question_and_answer(t)[0]
                for at in range(0, len(t), PART):
                    own = np.unique(t[at : at + PART])
                    yield pa.RecordBatch.from_arrays([pa.array(np.r_[own.view(np.int64), 0]), pa.array(np.r_[np.ones(len(own), bool), False]), pa.array(np.full(len(own) + 1, min(PART, len(t) - at), np.int64))], names=["term", "real", "words"])

    got = items.select("text").mapInArrow(count, "term bigint, real boolean, words bigint").groupBy("term", "real").agg(F.count("*").alias("n"), F.sum("words").alias("words")).collect()
    df = {r["term"] & (1 << 64) - 1: r["n"] for r in got if r["real"]}
    terms = np.array(sorted(df), np.uint64)
    often = np.array([df[x] for x in terms.tolist()], np.int64)
    parts, total = next(((r["n"], r["words"]) for r in got if not r["real"]), (0, 0))

    def indexes(own: list) -> Iterator[bytes]:
        """Each with the items' ids, hashes and numbers of words, under INDEX_BYTES or of a single part."""
        facts = [(r["item_id"], r["th"], q, len(t) - q) for r, (t, q) in own]
        todo = [_split([(k, t, q) for k, (_, (t, q)) in enumerate(own)])]
        while todo:
            some = todo.pop()
            if some:
                held = pickle.dumps((Index(some, terms, often, parts, total / max(parts, 1)), {k: facts[k] for k in {x[0] for x in some}}))
                if len(held) <= INDEX_BYTES or len(some) == 1:
                    yield common.bounded(held, "the index")
                else:
                    todo += [some[len(some) // 2 :], some[: len(some) // 2]]

    schema = "doc_id bigint, item_id bigint, th bigint, part bigint, score double, question bigint, answer bigint, questions bigint, answers bigint"
    names = [x.split()[0] for x in schema.split(", ")]
    found = spark.createDataFrame([], schema)
    keyed = items.withColumn("th", F.xxhash64("text"))
    for shard in range(shards):
        own = keyed if shards == 1 else keyed.where(F.pmod(F.xxhash64("item_id", "th"), F.lit(shards)) == shard)
        rows = [(r, question_and_answer(r["text"])) for r in sorted(own.collect(), key=lambda r: (r["item_id"], r["text"]))]
        for payload in indexes(rows):
            held = spark.sparkContext.broadcast(payload)

            def search(batches, held=held):
                common.let_go()
                index = facts = None
                for b in batches:
                    if index is None:
                        index, facts = pickle.loads(held.value)
                    out: dict[tuple, tuple] = {}
                    ids = b.column(0).to_pylist()
                    for some in _slices([tokens(t) for t in b.column(1).to_pylist()]):
                        for k, p, s, passage in index.search([t for _, t in some]):
                            q, a = index.covered(p, passage)
                            key = ids[some[k][0]], int(index.item[p]), int(index.at[p])
                            old = out.get(key, (0.0, 0, 0))
                            out[key] = (max(old[0], s), *max(old[1:], (q, a), key=sum))
                    if out:
                        rows = [(i, *facts[k][:2], at, *v, *facts[k][2:]) for (i, k, at), v in out.items()]
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64() if n == "score" else pa.int64()) for n, c in zip(names, zip(*rows, strict=True), strict=True)], names=names)

            found = found.unionByName(source.mapInArrow(search, schema))
    item = ["doc_id", "item_id", "th", "questions", "answers"]
    by_part = found.groupBy(*item, "part").agg(F.max("score").alias("score"), F.max(F.struct(F.expr("question + answer").alias("n"), "question", "answer")).alias("x"))
    by_item = by_part.groupBy(*item).agg(F.max("score").alias("score"), F.sum("x.question").alias("q"), F.sum("x.answer").alias("a"))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return by_item.select("doc_id", "item_id", "score", share("q", "questions").alias("question_overlap"), F.coalesce(share("a", "answers"), share("q", "questions")).alias("answer_overlap"), ((F.col("q") + F.col("a")) / (F.col("questions") + F.col("answers"))).alias("total_overlap"), (F.col("questions") + F.col("answers")).alias("item_words"))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of matches() that verify: question and answer each hold BOTH of their words in common with the passage, or TOTAL of all words; items of fewer than SHORT words must be there whole."""
    ok = F.when(F.col("item_words") < SHORT, F.col("total_overlap") == 1).otherwise((F.least("question_overlap", "answer_overlap") >= BOTH) | (F.col("total_overlap") >= TOTAL))
    return matches(docs, benchmark).where(ok)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and the benchmark items that it holds. Null and empty texts hold none, repeated documents give one row an item, further columns are ignored."""
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("item_words")


QUERIES = {"op4_decontaminate": op4}
ORACLE_SQL: dict[str, str] = {}
