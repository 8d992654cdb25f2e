"""Substring dedup over a compacted de Bruijn graph of words.

Edges are windows of `window` consecutive words, nodes the sequences of window - 1 words between neighbouring ones.
Neighbouring windows that share their least k-word sequence, the anchor, are dealt as one row, as the published builders of
such graphs do it: anchor, hash of the words, document, place. Equal windows have equal anchors. So an
anchor all of whose rows are alike is a path without branches, at most window - k + 1 edges long; where they
differ the graph branches, and the edges of one copy of each differing row are compared by themselves.

1. One pass writes each document's paths. An aggregation finds the anchors of several documents; a join keeps their paths.
2. Compaction: path a goes on in path b without a branch if all occurrences of a are followed by b and all of b preceded by a. The
   edges out of and into each path are counted by a join and an aggregation, and pointer doubling by joins
   gives every path of such a chain the chain's head. A chain of any length is one path from then on.
3. Of equal paths the one in the smallest document is the source. A pass over the sources' texts takes the digest of
   each path's words at its source's coordinates and, where the anchor branches, of each edge's.
4. A copy in a larger document loses all edges of the path. The source itself loses the edges that a path
   in a still smaller document has too. A pass over the texts concerned compares the digests of the very words
   before it takes them out, so no word goes on a hash's account alone.

All groupings are partial aggregations, and all joins are ones that adaptive execution splits, so a passage
in a third of all documents meets no single task.
"""

from __future__ import annotations

from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import common, words

WINDOW = 50

_MASK = (1 << 64) - 1
_BASES = (0xD1342543DE82EF95, 0xF1357AEA2E62A9C5)


class _Powers:
    """Powers of an odd number and of its inverse, as far as needed."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.r_[self.up, self.up * np.uint64(pow(self.base, k, 1 << 64))]
            self.down = np.r_[self.down, self.down * np.uint64(pow(self.inverse, k, 1 << 64))]
        return self.up[:n], self.down[:n]


_powers = [_Powers(b) for b in _BASES]


def _sums(h: np.ndarray, which: int) -> np.ndarray:
    return np.r_[np.zeros(1, np.uint64), np.cumsum(h * _powers[which].to(len(h))[0])]


def paths(data: bytes, window: int = WINDOW) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(number of words, and of each path the first word, number of edges, anchor, hash of all words) of a text's bytes."""
    starts, ends = words.spans(data)
    h = words.hashes(data, starts, ends)
    n, k = len(h), max(1, window // 4)
    if n < window:
        none = np.zeros(0, np.int64)
        return n, none, none, none, none
    sums = _sums(h, 0)
    kmer = words.mix((sums[k:] - sums[:-k]) * _powers[0].to(n)[1][: n - k + 1])
    # the least upper half of a hash, then the leftmost: one number for both
    least = (kmer & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(kmer), dtype=np.uint64)
    wide, want = 1, window - k + 1
    while 2 * wide <= want:
        least = np.minimum(least[:-wide], least[wide:])
        wide *= 2
    if want > wide:
        least = np.minimum(least[: len(least) - (want - wide)], least[want - wide :])
    at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    edges = np.diff(np.r_[first, len(at)])
    sums = _sums(words.mix(h ^ np.uint64(0xA5A5A5A5DEADBEEF)), 1)
    whole = (sums[first + edges + window - 1] - sums[first]) * _powers[1].to(n)[1][first]
    return n, first, edges, kmer[at[first]].view(np.int64), words.mix(whole + edges.astype(np.uint64)).view(np.int64)


def digest(some: list[bytes]) -> bytes:
    return blake2b(b" ".join(some), digest_size=16).digest()


def compacted(found: DataFrame) -> DataFrame:
    """The occurrences (doc_id, th, first, anchor, whole, edges, branches) of paths with chains of them compacted: of a chain only the head's occurrences are left, with all its edges.

    Occurrences are distinct. Rounds of pointer doubling: as many as the longest chain's length has binary digits.
    """
    plain = found.where("not branches")
    ahead = plain.select("doc_id", "th", (F.col("first") + F.col("edges")).alias("first"), F.col("anchor").alias("a"))
    step = ahead.join(plain.select("doc_id", "th", "first", F.col("anchor").alias("b")), ["doc_id", "th", "first"]).groupBy("a", "b").agg(F.count("*").alias("n"))
    nodes = common.written(plain.groupBy("anchor").agg(F.count("*").alias("n"), F.max("edges").cast("long").alias("own")), "nodes")
    # as many steps as occurrences of either end: no other edge leaves a or enters b
    step = step.join(nodes.select(F.col("anchor").alias("a"), "n"), ["a", "n"]).join(nodes.select(F.col("anchor").alias("b"), "n", "own"), ["b", "n"])
    links = common.written(step.select(F.col("b").alias("node"), F.col("a").alias("head"), "own", F.lit(False).alias("done")), "links")
    while not links.where("not done").isEmpty():
        jump = links.select(F.col("node").alias("head"), F.col("head").alias("next"))
        last, links = links, common.written(links.join(jump, "head", "left").select("node", F.coalesce("next", "head").alias("head"), "own", F.col("next").isNull().alias("done")), "links")
        common.drop_written(last)
    role = links.groupBy("head").agg(F.sum("own").alias("more")).select(F.col("head").alias("anchor"), "more").unionByName(links.select(F.col("node").alias("anchor"), F.lit(-1).cast("long").alias("more")))
    role = common.written(role, "roles")
    out = found.join(role, "anchor", "left").where("more is null or more >= 0")
    return out.select("doc_id", "th", "first", "anchor", "whole", (F.col("edges") + F.coalesce("more", F.lit(0))).cast("int").alias("edges"), "branches")


def repeats(docs: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(per row of docs: doc_id, th, n_words, kept_sha256 of all words; per doc_id with anything to remove: doc_id, cuts).

    cuts: array<struct<th, first, edges, digest, hits>>: of the text whose hash is th, a path's place, the digest of its
    words, and which of its edges go (null: all). Only documents with an id are compared.
    """
    common.ready(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("th"))

    def scan(b: pa.RecordBatch) -> dict:
        cols: dict[str, list] = {k: [] for k in ("n_words", "kept_sha256", "first", "edges", "anchor", "whole")}
        for t in b.column(1).to_pylist():
            data = (t or "").encode("utf-8", "surrogatepass")
            for c, x in zip(("n_words", "first", "edges", "anchor", "whole"), paths(data, window), strict=True):
                cols[c].append(x)
            cols["kept_sha256"].append(sha256(b" ".join(data.split())).hexdigest())
        return {"doc_id": b.column(0), "th": b.column(2), **cols}

    made = common.written(common.arrow_map(docs, scan, "doc_id bigint, th bigint, n_words bigint, kept_sha256 string, first array<int>, edges array<int>, anchor array<bigint>, whole array<bigint>"), "paths")
    every = made.where("doc_id is not null").select("doc_id", "th", F.explode(F.arrays_zip("anchor", "whole", "first", "edges")).alias("p")).select("doc_id", "th", "p.*")
    several = every.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.min("whole").alias("x"), F.max("whole").alias("y")).where("a < b").select("anchor", F.expr("x <> y").alias("branches"))
    several = common.written(several, "several")  # so the join shuffles both its sides, and a common anchor's rows can be split
    found = common.written(every.join(several, "anchor").dropDuplicates(["doc_id", "th", "first"]), "repeated")
    occurrences = common.written(compacted(found), "compacted")

    key = ["anchor", "whole", "edges"]
    source = occurrences.groupBy(*key, "branches").agg(F.min(F.struct("doc_id", "th", "first")).alias("s"), F.max("doc_id").alias("last")).where("branches or last > s.doc_id")
    asked = source.groupBy(F.col("s.doc_id").alias("doc_id")).agg(F.collect_list(F.struct("s.th", "s.first", *key, "branches")).alias("asked"))
    asked = common.written(asked, "sources")

    def read(batches):
        for b in batches:
            out: list[tuple] = []
            for doc_id, text, th, asked in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "th", "asked")), strict=True):
                own = (text or "").encode("utf-8", "surrogatepass").split()
                for x in asked:
                    if x["th"] == th:
                        some = own[x["first"] : x["first"] + x["edges"] + window - 1]
                        each = [digest(some[i : i + window]) for i in range(x["edges"])] if x["branches"] else None
                        out.append((x["anchor"], x["whole"], x["edges"], doc_id, digest(some), each))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.binary()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[*key, "source", "digest", "each"])

    known = common.with_ids(docs, asked.select("doc_id")).join(asked, "doc_id").mapInArrow(read, "anchor bigint, whole bigint, edges int, source bigint, digest binary, each array<binary>")
    known = common.written(known.dropDuplicates([*key, "source"]), "known")

    edge = known.where("each is not null").select(*key, "source", F.posexplode("each").alias("i", "edge"))
    least = common.written(edge.groupBy("edge").agg(F.min("source").alias("least"), F.max("source").alias("most")).where("least < most").select("edge", "least"), "edges")
    hits = edge.join(least, "edge").where("least < source").groupBy(*key).agg(F.collect_list("i").alias("hits"))
    known = common.written(known.drop("each").join(hits, key, "left"), "answers")
    cut = occurrences.select("doc_id", "th", "first", *key).join(known, key).where("doc_id > source or hits is not null")
    cut = cut.select("doc_id", F.struct("th", "first", "edges", "digest", F.when(F.col("doc_id") == F.col("source"), F.col("hits")).alias("hits")).alias("c"))
    return made.select("doc_id", "th", "n_words", "kept_sha256"), common.written(cut.groupBy("doc_id").agg(F.collect_list("c").alias("cuts")), "cuts")


def _kept(text: str | None, th: int, cuts: list[dict], window: int) -> tuple[list[bytes], int]:
    own = (text or "").encode("utf-8", "surrogatepass").split()
    mark = np.zeros(len(own) + 1, np.int64)
    for c in cuts:
        if c["th"] == th and digest(own[c["first"] : c["first"] + c["edges"] + window - 1]) == c["digest"]:
            if c["hits"] is None:
                mark[c["first"]] += 1
                mark[c["first"] + c["edges"] + window - 1] -= 1
            else:
                for i in c["hits"]:
                    mark[c["first"] + i] += 1
                    mark[c["first"] + i + window] -= 1
    gone = np.cumsum(mark[:-1]) > 0
    return [w for w, g in zip(own, gone.tolist(), strict=True) if not g], len(own)


def deduplicated(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_words, n_removed, kept (the kept words joined by one space; null where nothing is removed), kept_sha256.

    A word goes if a window over it has a word sequence that also starts in a document with a smaller doc_id. A null text
    has no words; a row with a null id loses nothing and takes nothing away; rows that share an id don't take from each other.
    """
    whole, cuts = repeats(docs, window)

    def cut(batches):
        for b in batches:
            out = []
            for doc_id, text, th, cuts in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "th", "cuts")), strict=True):
                kept, n = _kept(text, th, cuts, window)
                data = b" ".join(kept)
                out.append((doc_id, n, n - len(kept), data.decode("utf-8", "surrogatepass"), sha256(data).hexdigest()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["doc_id", "n_words", "n_removed", "kept", "kept_sha256"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("th"))
    some = common.with_ids(docs, cuts.select("doc_id")).join(cuts, "doc_id").mapInArrow(cut, "doc_id bigint, n_words bigint, n_removed bigint, kept string, kept_sha256 string")
    rest = common.with_ids(whole, cuts.select("doc_id"), "left_anti")
    return some.unionByName(rest.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.lit(None).cast("string").alias("kept"), "kept_sha256"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its words, those removed, and the digest of the others."""
    return deduplicated(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept")


QUERIES = {"op3_substring_dedup": op3}
ORACLE_SQL = {
    "op3_substring_dedup": r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') ws from documents),
x as (select doc_id, ws, unnest(generate_series(1, len(ws) - 49)) i from w where len(ws) >= 50),
h as (select doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) h from x),
f as (select h, min(doc_id) least from h group by h having min(doc_id) < max(doc_id)),
c as (select distinct doc_id, unnest(generate_series(i, i + 49)) p from h join f using (h) where doc_id > least),
o as (select doc_id, unnest(ws) word, generate_subscripts(ws, 1) p from w),
k as (select o.doc_id, string_agg(word, ' ' order by o.p) filter (c.p is null) kept, count(c.p) gone from o left join c on c.doc_id = o.doc_id and c.p = o.p group by o.doc_id)
select w.doc_id, len(ws)::bigint n_words, coalesce(gone, 0)::bigint n_removed, sha256(coalesce(kept, '')) kept_sha256 from w left join k using (doc_id)"""
}
