"""SimHash near-dedup: fingerprints, a grid join in segment-popcount space, components.

Embedding. The 64 bits lie on two rings of 32; segments are the 32 pairs of neighbours on each ring, and a fingerprint's point
holds the number of set bits of each segment, 0 to 2. A differing bit lies in two segments and moves each by one, so half the
Manhattan distance of two points is a lower bound of the Hamming distance of their fingerprints.

Grid range join. Each ring is a half of the coordinates. Fingerprints at Hamming distance 4 or less differ in at most two bits
of one half, and then some point is one bit from both. So each distinct fingerprint is put into its own cell and
the 32 cells one bit away, in each half: 66 rows, however many others there are, and every pair to
be found shares a cell. A cell holds what agrees in a half but for two bits, about 3e-7 of all
pairs. Cells are dealt by hash and sorted; a cell's members are read as one run.
In a run a pair is verified first by the bound, then by the exact distance. Runs give out a
spanning forest of their links and never all pairs, so large groups of near copies stay linear.

Large cells. A run over DENSE members is searched breadth first: what a link reaches leaves the search. What BUDGET comparisons
leave undone (members not linked to each other, in a crowded cell) goes to a second round, dealt anew by finer cells over many tasks.

Fingerprints and not documents are joined: copies count once. A cell in memory takes 16 bytes a
distinct fingerprint.

Similar texts. Texts whose shingle sets overlap by 0.8 differ in about a seventh of their bits, ten of 64; no grid of segment
counts of 64 bits tells such pairs from others. similar() takes the same steps with fingerprints of WIDE words of 64 bits: their places are
dealt over many rings, a fingerprint's point holds the counts of each ring's segments, and its cell in a ring's grid is given by these
counts. Pairs that meet in one grid are sifted by the differing bits
of their first four words, in blocks of a cell's square, as at some GB a cell has hundreds of members and nearly all pairs are unlike. What is left is verified first by half the Manhattan distance of their points, over all segments of the
words' own rings, then by the exact distance, which estimates the angle, so the similarity. One rule holds
at every size: rings of log2 of the number of fingerprints less 12 bits, BAND_BITS at least, so that cells stay small, and so many rings
that of a hundred pairs at a similarity of 0.8 one meets in none. While the rings share no place (32 of 12 bits do not),
pairs of fewer differing bits than rings meet for certain. Links of SURE bits or fewer stand; the others that join
what these leave apart are verified on the texts' shingle sets: first a spanning forest of them, then, among the fingerprints that
a rejected one had joined, each one's nearest in other components, and where several components are left, all pairs of a cell
that may still be similar. For these two steps a set has a mark of MARK parities, which bounds the number of shingles by which two sets
differ from below, closely up to some hundreds: so what is left of a large group of near copies gives few candidates, and none is
passed over. Distances say little of texts of few shingles; these meet on shared shingles, the rare ones first, and none of their pairs is passed over.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import common
from quire.llm.words import mix

SEED = 42
#: Runs of more members are searched breadth first, so that linked members leave the search at once.
DENSE = 256
#: Comparisons in one run; what they leave undone is dealt anew.
BUDGET = 1 << 26
#: Runs of wide fingerprints of more members are sifted in blocks of so many pairs; one with more links a member is searched as a dense one.
SIFTED, SIFT_PAIRS, SIFT_LINKS = 24, 1 << 15, 32


def fingerprint(text: str | None, shingle_words: int = 4) -> int:
    """The 64-bit SimHash of one text: lower-cased A-Z, words split at ASCII white space, every shingle with its repeats. No words: zero."""
    words = (text or "").encode().lower().split()
    n = len(words)
    if not n:
        return 0
    whole = b" ".join(words)
    if n <= shingle_words:
        return xxhash.xxh64_intdigest(whole, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[: n - shingle_words] + 1)).tolist()
    one = xxhash.xxh64_intdigest
    h = np.array([one(whole[a:b], SEED) for a, b in zip(starts, ends[shingle_words - 1 :].tolist(), strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):  # whatever the length, bounded memory
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle_words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, fp): the fingerprint as a signed long, for every row of docs. A null text has no words."""
    common.ready(docs.sparkSession)

    def run(b: pa.RecordBatch) -> dict:
        h = np.array([fingerprint(t, shingle_words) for t in b.column(1).to_pylist()], np.uint64)
        return {"doc_id": b.column(0), "fp": h.view(np.int64)}

    return common.arrow_map(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, "doc_id bigint, fp bigint")


#: 64-bit words of a wide fingerprint; fewest bits of a ring; share of pairs at the similarity that may meet in no ring's grid.
WIDE, BAND_BITS, MISSED = 6, 12, 0.0085
#: A crowded cell is dealt by so many further rings of so many bits; one pair in a thousand of the cell then meets in none.
SUB_BITS, SUB_BANDS = 10, 32
#: Wide fingerprints of so few differing bits are links without a look at the texts: 0.88 is expected there, 0.8 is 2.6 deviations away.
SURE = 40

#: Each member of a part with a rejected link has so many candidates of other components verified in each cell, the nearest ones.
NEAREST = 3
#: Texts of so few distinct shingles and all that may be similar to them are joined on their shingles.
FEW = 20


def shingles(text: str | None, shingle_words: int = 5) -> np.ndarray:
    """Hashes of the set of shingles, sorted; none for a text without words."""
    words = (text or "").encode().lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    whole = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    last = min(n, shingle_words) - 1
    starts = np.concatenate(([0], ends[: n - last - 1] + 1)).tolist()
    one = xxhash.xxh64_intdigest
    return np.unique(np.array([one(whole[a:b], SEED) for a, b in zip(starts, ends[last:].tolist(), strict=True)], np.uint64))


def wide_fingerprint(text: str | None, shingle_words: int = 5) -> np.ndarray:
    """WIDE words over the set of shingles, so that the angle follows the sets' overlap; zeros for a text without words."""
    return _wide(shingles(text, shingle_words))


def _wide(h: np.ndarray) -> np.ndarray:
    out = np.zeros(WIDE, np.uint64)
    if not len(h):
        return out
    for k in range(WIDE):
        ones = np.zeros(64, np.int64)
        for at in range(0, len(h), 1 << 16):
            ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
        out[k] = np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0]
        h = mix(h + np.uint64(0x9E3779B97F4A7C15))
    return out


def most_bits(similarity: float, sigmas: float = 4) -> int:
    """Differing bits of a wide fingerprint up to which texts count as similar: those expected at this Jaccard similarity, and some standard deviations."""
    p = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    n = 64 * WIDE
    return int(n * p + sigmas * np.sqrt(n * p * (1 - p)))


def similar(docs: DataFrame, shingle_words: int = 5, similarity: float = 0.8) -> DataFrame:
    """Rows (doc_id, component_id) for every row of docs: components of the links between texts that are alike or whose shingle sets' similarity is `similarity` or more.

    A row with a null id links nothing and has a null component; texts without words are alike.
    """
    common.ready(docs.sparkSession)
    few = int(FEW / similarity)

    def prints(b: pa.RecordBatch) -> dict:
        sets = [shingles(t, shingle_words) for t in b.column(1).to_pylist()]
        x = np.stack([_wide(h) for h in sets]).view(np.int64)
        return {"doc_id": b.column(0), "few": [0 < len(h) <= few for h in sets], **{n: x[:, k] for k, n in enumerate(_NAMES)}}

    names = list(_NAMES)
    words = ", ".join(f"{n} bigint" for n in names)
    made = common.arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), prints, f"doc_id bigint, few boolean, {words}")
    made = common.written(made, "wide")
    distinct = common.written(made.where("doc_id is not null").groupBy(*names).agg(F.min("doc_id").alias("rep"), F.max("few").alias("few")), "distinct")
    common.give_back(docs.sparkSession)
    bits = band_bits(distinct.count())
    most = most_bits(similarity)
    spread = _spread(bits, bands(bits, similarity))
    edges = wide_links(distinct.select("rep", *names), bits, similarity)
    sure = edges.where(F.col("d") <= SURE).select("a", "b")
    common.give_back(docs.sparkSession)
    part = common.written(common.components(sure), "parts")
    maybe = edges.where(F.col("d") > SURE).join(part.toDF("a", "ca"), "a", "left").join(part.toDF("b", "cb"), "b", "left")
    maybe = common.written(maybe.select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb")).where("ca <> cb"), "unsure")
    right = common.written(_verified(maybe.select("a", "b"), docs, shingle_words, similarity), "verified")
    joined = common.written(common.components(sure.unionByName(right)), "joined")
    common.give_back(docs.sparkSession)

    # the forest left out pairs whose ends a rejected link had joined: these parts are looked at again, first for each member's nearest
    # in other components, then, where several components are left, for every pair that may be similar
    wrong = common.written(maybe.join(right, ["a", "b"], "left_anti").select("a", "b", "ca"), "rejected")
    near = common.written(common.components(maybe.selectExpr("ca a", "cb b")), "near")
    torn = near.join(near.join(wrong.selectExpr("ca node").distinct(), "node", "left_semi").select("comp").distinct(), "comp", "left_semi")
    again = distinct.join(part.toDF("rep", "part"), "rep", "left").join(torn.withColumnRenamed("comp", "whole"), F.coalesce("part", "rep") == F.col("node"))
    again = common.written(_marked(again.select("rep", "whole", *names), docs, shingle_words), "torn")
    tried = wrong.select("a", "b")
    for most_each in (NEAREST, None):
        common.give_back(docs.sparkSession)
        parts = common.written(_named(again.select("rep", "whole"), joined), "torn-parts")
        several = parts.groupBy("whole").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("whole")
        several = again.join(parts.join(several, "whole", "left_semi").select("rep", "comp"), "rep")
        put = common.arrow_map(several.select("rep", "comp", "n", "mark", *names), spread, "cell bigint, rep bigint, comp bigint, n bigint, mark binary")
        pairs = put.repartition("cell").sortWithinPartitions("cell").mapInArrow(_across(_may_reach(similarity, most_each)), _PAIR)
        if most_each is None:
            pairs = pairs.unionByName(_few_pairs(docs, _named(distinct.where("few").select("rep"), joined), shingle_words, similarity))
        pairs = common.written(pairs.distinct().join(tried, ["a", "b"], "left_anti"), "apart")
        joined = _merged(joined, pairs.join(_verified(pairs.select("a", "b"), docs, shingle_words, similarity), ["a", "b"], "left_semi"))
        tried = tried.unionByName(pairs.select("a", "b"))
    common.give_back(docs.sparkSession)
    known = common.written(distinct.join(joined, distinct.rep == joined.node, "left").select(*names, F.coalesce("comp", "rep").alias("comp")), "known")
    return made.join(known, names, "left").select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("comp")).alias("component_id"))


#: Bits of a set's mark.
MARK = 4096


def mark(h: np.ndarray) -> bytes:
    """Each bit is the parity of the shingles that fall on it. Two sets' marks differ in no more bits than the sets differ in members, and in hardly fewer while these are some hundreds."""
    return np.packbits(np.bincount((mix(h) % np.uint64(MARK)).astype(np.int64), minlength=MARK).astype(np.uint8) & 1).tobytes()


def _marked(reps: DataFrame, docs: DataFrame, shingle_words: int) -> DataFrame:
    """The rows (rep, ...) with the number of their texts' shingles and the set's mark."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ids = common.written(reps.selectExpr("rep doc_id"), "torn-ids")
    texts = common.with_ids(texts, ids).groupBy(F.col("doc_id").alias("rep")).agg(F.min("text").alias("text"))

    names = list(reps.columns)

    def run(b: pa.RecordBatch) -> dict:
        sets = [shingles(t, shingle_words) for t in b.column("text").to_pylist()]
        return {n: b.column(n) for n in names} | {"n": [len(h) for h in sets], "mark": [mark(h) for h in sets]}

    fields = ", ".join(f"{n} bigint" for n in names)
    return common.arrow_map(reps.join(texts, "rep").select(*names, "text"), run, f"{fields}, n bigint, mark binary")


def _may_reach(similarity: float, most: int | None):
    """Chooses, for _across over (cell, rep, comp, n, mark), those whose marks allow this similarity; with `most` the nearest so many."""

    def chosen(got: list[np.ndarray], at: int, others: np.ndarray) -> np.ndarray:
        n, marks = got[3].view(np.int64), got[4]
        total = n[at] + n[others]
        fits = np.flatnonzero(np.minimum(n[at], n[others]) >= similarity * np.maximum(n[at], n[others]) - 1e-9)
        apart = np.bitwise_count(marks[others[fits]] ^ marks[at]).sum(1, dtype=np.int64)
        ok = (total[fits] - apart) * (1 + similarity) >= 2 * similarity * total[fits] - 1e-9
        fits, apart = fits[ok], apart[ok]
        if most is not None and len(fits) > most:
            fits = fits[np.argpartition(apart / total[fits], most)[:most]]
        return others[fits]

    return chosen


def _named(df: DataFrame, joined: DataFrame) -> DataFrame:
    """Rows (rep, ...) with their component, which is the rep's own where nothing joins it."""
    return df.join(joined.toDF("rep", "comp"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))


def _merged(joined: DataFrame, links: DataFrame) -> DataFrame:
    """The components (node, comp) after links (ca, cb) between them."""
    last = common.written(common.components(links.selectExpr("ca a", "cb b")), "last")
    out = joined.join(last.toDF("comp", "first"), "comp", "left").select("node", F.coalesce("first", "comp").alias("comp"))
    return common.written(out.unionByName(last.join(joined, "node", "left_anti")), "joined")


_NAMES = tuple(f"f{k}" for k in range(WIDE))


def band_bits(n: int) -> int:
    """Bits of a ring for n fingerprints: so many that a cell of unlike ones holds a few thousand at most."""
    return max(BAND_BITS, n.bit_length() - 12)


def bands(bits: int, similarity: float) -> int:
    """So many rings that a share of MISSED of the pairs at this similarity agrees in none."""
    differ = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(np.ceil(np.log(MISSED) / np.log1p(-((1 - differ) ** bits))))


def _bits(b: pa.RecordBatch) -> np.ndarray:
    x = np.stack([b.column(n).to_numpy() for n in _NAMES], axis=1)
    return np.unpackbits(np.ascontiguousarray(x).view(np.uint8), axis=1, bitorder="little").astype(np.int64)


def _choices(bits: int, many: int, seed: int) -> np.ndarray:
    """`many` rows of `bits` places of a wide fingerprint; each place is used before any is used again."""
    g = np.random.default_rng(seed)
    order = np.concatenate([g.permutation(64 * WIDE) for _ in range(-(-many * bits // (64 * WIDE)))])
    return order[: many * bits].reshape(many, bits)


def _spread(bits: int, many: int):
    """For arrow_map: a row for each ring with the cell of its segments' counts, `cell` first, with all columns of the batch."""
    order = _choices(bits, many, 17)

    def spread(b: pa.RecordBatch) -> dict:
        bit = _bits(b)
        cell = np.concatenate([_counted(bit[:, o]) + k * 3**bits for k, o in enumerate(order)])
        rows = np.tile(np.arange(len(bit)), many)
        return {"cell": cell} | {n: b.column(n).take(pa.array(rows)) for n in b.schema.names}

    return spread


def _spread_again(b: pa.RecordBatch) -> dict:
    """Rows of crowded cells, by cell and further rings."""
    bit, cell = _bits(b), b.column("cell").to_numpy().view(np.uint64)
    order = _choices(SUB_BITS, SUB_BANDS, 23)
    keys = np.concatenate([mix(cell * np.uint64(0x9E3779B97F4A7C15) + (k * 3**SUB_BITS + _counted(bit[:, o])).astype(np.uint64)) for k, o in enumerate(order)])
    rows = np.tile(np.arange(len(cell)), len(order))
    return {n: b.column(n).to_numpy()[rows] for n in b.schema.names} | {"cell": keys.view(np.int64)}


def wide_links(distinct: DataFrame, bits: int, similarity: float) -> DataFrame:
    """Edges (a, b, d), a < b, between the rows (rep, words) of distinct wide fingerprints that meet in a ring's grid and may be that similar: all that is needed to join what all of them join, sure links apart from others. Written."""
    words = ", ".join(f"{n} bigint" for n in _NAMES)
    most = most_bits(similarity)
    near = lambda fp, a, b: _wide_distance(fp, a, b, most)
    put = common.arrow_map(distinct, _spread(bits, bands(bits, similarity)), f"cell bigint, rep bigint, {words}")
    return _joined(put, distinct, _spread_again, near, range(2, 2 + WIDE), SURE, words, _points, lambda fp, enough: _sifted(fp, most, enough))


def _joined(put: DataFrame, distinct: DataFrame, again, near, prints: range, sure: int | None, words: str, points=lambda fp: fp, sift=None) -> DataFrame:
    """The links of cells, by near() on what points() makes of the words; members of crowded ones that the budget leaves are dealt by `again`, and searched to the end."""
    scan = lambda df, budget: df.repartition("cell").sortWithinPartitions("cell").mapInArrow(_scan(near, prints, sure, budget, points, sift), "a bigint, b bigint, d bigint")
    found = common.written(scan(put, BUDGET), "cells")
    links, rest = found.where("d >= 0"), found.where("d < 0").selectExpr("a rep", "b cell")
    if not rest.isEmpty():
        finer = common.arrow_map(rest.join(distinct, "rep").select("cell", *distinct.columns), again, f"cell bigint, rep bigint, {words}")
        links = links.unionByName(scan(finer, None))
    return common.written(links.selectExpr("least(a, b) a", "greatest(a, b) b", "d").distinct(), "links")


def _points(fp: np.ndarray) -> np.ndarray:
    """The words of wide fingerprints, and behind them their points: of each place whether the count of its segment reaches one, and whether it reaches two. Two points' Manhattan distance is the number of these bits in which they differ."""
    turned = _turned(fp)
    return np.asfortranarray(np.concatenate([fp, fp | turned, fp & turned], axis=1))


def _wide_distance(points: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Exact distances up to `most`, -1 for more; the bound goes first: a differing bit moves two segments by one."""
    n = max(len(a), len(b))
    far, left = np.zeros(n, np.int64), np.arange(n)

    def apart(k: int) -> np.ndarray:
        x, y = (points[i if len(i) < n else i[left], k] for i in (a, b))
        return np.bitwise_count(x ^ y)

    for k in range(0, WIDE, 2):  # most pairs are over the limit after four words
        for j in range(k, min(k + 2, WIDE)):
            far[left] += apart(WIDE + j)
            far[left] += apart(2 * WIDE + j)
        left = left[far[left] <= 2 * most]
    d = np.zeros(len(left), np.int64)
    for k in range(WIDE):
        d += apart(k)
    out = np.full(n, -1, np.int64)
    out[left] = np.where(d <= most, d, -1)
    return out


def _sifted(points: np.ndarray, most: int, enough: int) -> tuple[np.ndarray, np.ndarray] | None:
    """All pairs (a, b), a < b, of a run that differ in `most` bits or fewer of their first words, and hardly any other; None where these are more than `enough`.

    Whole blocks of the run's square are worked out at once: a pair takes some nanoseconds, and so many words leave next to none of the unlike ones.
    """
    n, found, many, at = len(points), [], 0, 0
    while at < n - 1:
        end = min(n - 1, at + max(1, SIFT_PAIRS // (n - at)))
        differ = np.zeros((end - at, n - at), np.uint8)  # of 256 bits all may differ, which counts as none and is seen in the exact distance
        for k in range(_SIFT_WORDS):
            differ += np.bitwise_count(points[at:end, k, None] ^ points[None, at:, k])
        a, b = np.nonzero(differ <= most)
        ahead = a < b
        found.append((a[ahead] + at, b[ahead] + at))
        many += len(found[-1][0])
        if many > enough:
            return None
        at = end
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


_SIFT_WORDS = 4


def jaccard(a: str | None, b: str | None, shingle_words: int) -> float:
    """Exact similarity of two texts' shingle sets; 1 for two without words."""

    def grams(t: str | None) -> set:
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + shingle_words]) for i in range(max(1, len(w) - shingle_words + 1))}

    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y)


def _verified(pairs: DataFrame, docs: DataFrame, shingle_words: int, similarity: float) -> DataFrame:
    """The rows (a, b) of pairs whose documents' texts are as similar as that. Only the texts that pairs name are moved."""
    ids = common.written(pairs.selectExpr("explode(array(a, b)) doc_id").distinct(), "ids")
    texts = common.with_ids(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), ids)
    both = pairs.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b").select("a", "b", "ta", "tb")

    def run(batches):
        common.let_go()
        for b in batches:
            keep = pa.array([jaccard(x, y, shingle_words) >= similarity for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)], pa.bool_())
            yield b.select(["a", "b"]).filter(keep)

    return both.mapInArrow(run, "a bigint, b bigint")


_PAIR = "a bigint, b bigint, ca bigint, cb bigint"


def _few_pairs(docs: DataFrame, reps: DataFrame, shingle_words: int, similarity: float) -> DataFrame:
    """Of the texts of the rows (rep, comp): all pairs (a, b, ca, cb) of different components that may be that similar.

    Two such sets share a shingle among the first n - similarity * n + 1 of their n in any order that holds for all sets; the rare ones come first.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string").alias("text"))

    def grams(b: pa.RecordBatch) -> dict:
        sets = [shingles(t, shingle_words) for t in b.column(2).to_pylist()]
        rows = np.repeat(np.arange(len(sets)), [len(h) for h in sets])
        return {"rep": b.column(0).to_numpy()[rows], "comp": b.column(1).to_numpy()[rows], "gram": np.concatenate(sets).view(np.int64)}

    each = common.written(common.arrow_map(reps.join(texts, "rep").select("rep", "comp", "text"), grams, "rep bigint, comp bigint, gram bigint").distinct(), "grams")
    times = common.written(each.groupBy("gram").agg(F.count("*").alias("times")).where("times > 1"), "times")
    sets = each.join(times, "gram", "left").groupBy("rep", "comp").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("times", F.lit(1)).alias("times"), "gram"))).alias("x"))
    n = F.size("x")
    sets = sets.select("rep", "comp", n.cast("long").alias("n"), F.posexplode(F.slice("x", F.lit(1), n - F.ceil(similarity * n - 1e-9).cast("int") + 1)).alias("place", "x"))
    put = sets.where("x.times > 1").select(F.col("x.gram").alias("gram"), "rep", "comp", "n", F.col("place").cast("long").alias("place"))

    def close(got: list[np.ndarray], at: int, others: np.ndarray) -> np.ndarray:
        n, place = got[3].view(np.int64), got[4].view(np.int64)
        both = np.minimum(n[at] - place[at], n[others] - place[others]) + np.minimum(place[at], place[others])  # at most so many are shared
        return others[both * (1 + similarity) >= similarity * (n[at] + n[others]) - 1e-9]

    return put.repartition("gram").sortWithinPartitions("gram").mapInArrow(_across(close), _PAIR)


#: Half the coordinates: one ring's segments, as digits of a number to the base 3.
_PLACES = 3 ** np.arange(32, dtype=np.int64)
_HALF = 3**32


def cells(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cell, index into fp): each fingerprint's own cell and those one bit away, in both halves."""
    bits = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int64)
    keys = [_ring(bits[:, 32 * half : 32 * half + 32]) + half * _HALF for half in range(2)]
    every = np.concatenate([x.ravel() for x in keys])
    return every, np.tile(np.repeat(np.arange(len(fp)), 33), 2)


def _counted(bits: np.ndarray) -> np.ndarray:
    """The cells of rows of bits on a ring: the counts of its segments, the pairs of neighbours, as digits."""
    return (bits + np.roll(bits, -1, axis=1)) @ _PLACES[: bits.shape[1]]


def _ring(bits: np.ndarray) -> np.ndarray:
    """The cells of rows of bits: of their segments' counts, and with each bit turned, which moves two segments by one."""
    places = _PLACES[: bits.shape[1]]
    own = _counted(bits)
    return np.c_[own, own[:, None] + (1 - 2 * bits) * (places + np.roll(places, 1))]


def _cells_again(b: pa.RecordBatch) -> dict:
    """Rows of crowded cells (cell, rep, fp): pairs differ in four bits of the other half at most, so in two of one of its quarters."""
    cell, fp = b.column("cell").to_numpy(), np.ascontiguousarray(b.column("fp").to_numpy()).view(np.uint8).reshape(-1, 8)
    bits = np.unpackbits(fp, axis=1, bitorder="little").astype(np.int64)
    other = np.where((cell >= _HALF)[:, None], bits[:, :32], bits[:, 32:])
    keys = np.concatenate([(_ring(other[:, 16 * q : 16 * q + 16]) + q * 3**16).ravel() for q in range(2)]).view(np.uint64)
    rows = np.tile(np.repeat(np.arange(len(cell)), 17), 2)
    return {n: b.column(n).to_numpy()[rows] for n in b.schema.names} | {"cell": mix(mix(cell[rows].view(np.uint64)) + keys).view(np.int64)}


_FIRST = np.uint64(0x0000000100000001)


def _turned(x: np.ndarray) -> np.ndarray:
    """Both rings turned by one place."""
    return ((x & ~_FIRST) >> np.uint64(1)) | ((x & _FIRST) << np.uint64(31))


def bound(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Half the Manhattan distance of the segment counts, rounded up: a segment moves by two where both its bits turn alike, by one where one turns."""
    x, up, down = a ^ b, a & ~b, b & ~a
    two = (up & _turned(up)) | (down & _turned(down))
    return (np.bitwise_count(x ^ _turned(x)).astype(np.int64) + 2 * np.bitwise_count(two) + 1) // 2


def distances(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Exact distances up to `most`, -1 for more; the bound goes first, on the pairs that the cheap total of set bits leaves."""
    near = np.abs(np.bitwise_count(a).astype(np.int8) - np.bitwise_count(b).astype(np.int8)) <= most
    a, b = np.broadcast_arrays(a, b)
    near[near] = bound(a[near], b[near]) <= most
    out = np.full(near.shape, -1, np.int64)
    d = np.bitwise_count(a[near] ^ b[near]).astype(np.int64)
    out[near] = np.where(d <= most, d, -1)
    return out


def _forest(a: np.ndarray, b: np.ndarray, d: np.ndarray) -> tuple[list, list, list]:
    """A spanning forest of the edges, short ones first."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    out: tuple[list, list, list] = ([], [], [])
    order = np.argsort(d, kind="stable")
    for x, y, n in zip(a[order].tolist(), b[order].tolist(), d[order].tolist(), strict=True):
        if (r := root(x)) != (s := root(y)):
            up[max(r, s)] = min(r, s)
            for o, v in zip(out, (x, y, n), strict=True):
                o.append(v)
    return out


def _dense(fp: np.ndarray, rep: np.ndarray, near, sure: int | None, budget: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links of one large run that connect what its links connect, and the places whose pairs among each other the budget left untried.

    Members reached by a sure link leave the search at once (without `sure` every link is); then each of the parts so made takes in others by its shortest links to them.
    """
    out: list[tuple] = []
    part, parts, spent = np.full(len(rep), -1), 0, 0
    left, rest = np.arange(len(rep)), np.zeros(0, np.int64)
    while len(left) and not len(rest):
        front, part[left[0]], left = [left[0]], parts, left[1:]
        while front and len(left):
            if budget is not None and spent > budget:
                # members done with have met all others; but not for unsure links
                rest = np.r_[front, left] if sure is None else np.arange(len(rep))
                break
            at = front.pop()
            spent += len(left)
            d = near(fp, np.array([at]), left)
            hit = d >= 0 if sure is None else (d >= 0) & (d <= sure)
            if hit.any():
                out.append((np.full(hit.sum(), rep[at]), rep[left[hit]], d[hit]))
                part[left[hit]] = parts
                front += left[hit].tolist()
                left = left[~hit]
        parts += 1
    left = np.arange(len(rep) if sure is not None and not len(rest) else 0)
    while len(left) and not len(rest):
        own = part[left] == part[left[0]]
        front, left = left[own].tolist(), left[~own]
        while front and len(left):
            if budget is not None and spent > budget:
                rest = np.r_[front, left]
                break
            at = front.pop()
            spent += len(left)
            d = near(fp, np.array([at]), left)
            hit = np.flatnonzero(d > sure)
            if len(hit):
                hit = hit[np.argsort(d[hit], kind="stable")]
                hit = hit[np.unique(part[left[hit]], return_index=True)[1]]  # the shortest to each part
                out.append((np.full(len(hit), rep[at]), rep[left[hit]], d[hit]))
                took = np.isin(part[left], part[left[hit]])
                front += left[took].tolist()
                left = left[~took]
    return *(np.concatenate(x) for x in zip((rep[:0],) * 3, *out, strict=True)), rest


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of runs."""
    return np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)


def _links(key: np.ndarray, fp: np.ndarray, rep: np.ndarray, near, sure: int | None, budget: int | None, sift=None) -> tuple[list, list, list]:
    """Of whole sorted runs; what a run's budget leaves comes as (rep, cell, -1). near(fp, a, b): the distances of pairs of places that are links, else -1. sift(fp, enough): the pairs of a run among which all its links are, or None for more than enough."""
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[start, len(key)])
    found, undone = [(rep[:0],) * 3], ([], [], [])
    tried = np.zeros(len(size), bool)
    if sift is not None:
        for r in np.flatnonzero((size > SIFTED) & (True if budget is None else size * (size - 1) // 2 <= budget)).tolist():
            s, n = int(start[r]), int(size[r])
            if (pairs := sift(fp[s : s + n], SIFT_LINKS * n)) is not None:
                tried[r] = True
                if len(pairs[0]):
                    d = near(fp, pairs[0] + s, pairs[1] + s)
                    hit = d >= 0
                    found.append((rep[pairs[0][hit] + s], rep[pairs[1][hit] + s], d[hit]))
    start, size = start[~tried], size[~tried]
    for s, n in zip(start[size > DENSE], size[size > DENSE], strict=True):
        *links, rest = _dense(fp[s : s + n], rep[s : s + n], near, sure, budget)
        found.append(tuple(links))
        undone[0].extend(rep[s : s + n][rest].tolist())
        undone[1].extend([int(key[s])] * len(rest))
        undone[2].extend([-1] * len(rest))
    few = (size <= DENSE) & (size > 1)
    start, size = start[few], size[few]
    at, end = _ranges(start, size), np.repeat(start + size, size)
    step = 1
    while (more := at + step < end).any():
        at, end = at[more], end[more]
        d = near(fp, at, at + step)
        hit = d >= 0
        found.append((rep[at[hit]], rep[at[hit] + step], d[hit]))
        step += 1
    links = _forest(*(np.concatenate(x) for x in zip(*found, strict=True)))
    return tuple(x + y for x, y in zip(links, undone, strict=True))


def _scan(near, prints: range, sure: int | None, budget: int | None, points=lambda fp: fp, sift=None):
    """Reads sorted rows (cell, rep, ..., fingerprint words ...); gives out the links' forest of each batch of whole cells, with their distances, and what the budget left."""

    def edge(got: list[np.ndarray]):
        fp = points(np.stack([got[k] for k in prints], axis=1).view(np.uint64))
        found = _links(got[0], fp, got[1], near, sure, budget, sift)
        if found[0]:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["a", "b", "d"])

    return _whole_cells(edge)


def _across(chosen):
    """Reads sorted rows (cell, rep, component, ...); gives out pairs of a cell's members in different components: of each place those that chosen(columns, place, places) takes of the others.

    A cell's largest component comes last, so that no step is spent within one.
    """

    def batch(found: list) -> pa.RecordBatch:
        a, b, ca, cb = (np.concatenate(x) for x in zip(*found, strict=True))
        turn = a > b
        out = np.where(turn, b, a), np.where(turn, a, b), np.where(turn, cb, ca), np.where(turn, ca, cb)
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["a", "b", "ca", "cb"])

    def pairs(got: list[np.ndarray]):
        key, rep, comp = got[:3]
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        mixed = np.minimum.reduceat(comp, start) != np.maximum.reduceat(comp, start)
        got, found, held = [x.view(np.uint64) for x in got], [], 0
        for s, e in zip(start[mixed].tolist(), np.r_[start[1:], len(key)][mixed].tolist(), strict=True):
            _, inv, size = np.unique(comp[s:e], return_inverse=True, return_counts=True)
            order = np.lexsort((inv, size[inv]))
            inv = inv[order]
            last = np.flatnonzero(np.r_[inv[1:] != inv[:-1], True])
            ends = last[np.searchsorted(last, np.arange(e - s))] + 1
            order += s
            for i in range(e - s):
                others = order[ends[i] :]
                if not len(others):
                    break
                others = chosen(got, order[i], others)
                if len(others):
                    found.append((np.full(len(others), rep[order[i]]), rep[others], np.full(len(others), comp[order[i]]), comp[others]))
                    held += len(others)
                if held > 1 << 16:
                    yield batch(found)
                    found, held = [], 0
        if found:
            yield batch(found)

    return _whole_cells(pairs)


def _array(c: pa.Array) -> np.ndarray:
    """A column's values; marks as rows of words."""
    return np.frombuffer(b"".join(c.to_pylist()), np.uint64).reshape(len(c), -1) if pa.types.is_binary(c.type) else c.to_numpy()


def _whole_cells(edge):
    """mapInArrow function that calls edge(columns) with whole cells of sorted rows."""

    def scan(batches):
        common.let_go()
        held: list = []
        for b in batches:
            held.append([_array(c) for c in b.columns])
            # joined only where a cell ends, so that a very large cell is copied once
            if b.num_rows and held[-1][0][-1] != held[0][0][0]:
                got = [np.concatenate(x) for x in zip(*held, strict=True)]
                cut = int(np.searchsorted(got[0], got[0][-1]))
                held = [[x[cut:] for x in got]]
                yield from edge([x[:cut] for x in got])
        if held and len(held[0][0]):
            yield from edge([np.concatenate(x) for x in zip(*held, strict=True)])

    return scan


def links(distinct: DataFrame, most: int = 4) -> DataFrame:
    """Edges (a, b) between the rows (fp, rep) of distinct fingerprints that connect the same ones as all pairs at Hamming distance `most` or less would.

    most is at most 4: see the module's grid. Each edge is such a pair.
    """
    if not 0 <= most <= 4:
        raise ValueError("the grid finds distances of 0 to 4")

    def spread(b: pa.RecordBatch) -> dict:
        fp, rep = b.column(0).to_numpy(), b.column(1).to_numpy()
        key, i = cells(np.ascontiguousarray(fp).view(np.uint64))
        return {"cell": key, "fp": fp[i], "rep": rep[i]}

    put = common.arrow_map(distinct.select("fp", "rep"), spread, "cell bigint, rep bigint, fp bigint")
    near = lambda fp, a, b: distances(fp[a, 0], fp[b, 0], most)
    return _joined(put, distinct.select("rep", "fp"), _cells_again, near, range(2, 3), None, "fp bigint").select("a", "b")


def groups(prints: DataFrame, most: int = 4) -> DataFrame:
    """Rows (doc_id, fp) to (doc_id, fp, component_id): the smallest doc_id reachable over links of `most` differing bits or fewer, the own one included.

    Every row comes back. A row whose doc_id is null links nothing and has a null component. Repeated rows are all returned.
    """
    common.ready(prints.sparkSession)
    distinct = common.written(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), "prints")
    joined = common.components(links(distinct, most))
    known = common.written(distinct.join(joined, distinct.rep == joined.node, "left").select("fp", F.coalesce("comp", "rep").alias("comp")), "known")
    out = prints.join(known, "fp", "left")
    return out.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("comp")).alias("component_id"))


def near_duplicates(docs: DataFrame, shingle_words: int = 5, most: int = 4) -> DataFrame:
    """Rows (doc_id, fp, component_id) for every row of docs; see fingerprints() and groups()."""
    return groups(common.written(fingerprints(docs, shingle_words), "fps"), most)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its fingerprint over 4-word shingles and its component. Empty texts share the fingerprint zero."""
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), 4, 4)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op6_simhash": op6}
ORACLE_SQL: dict[str, str] = {}
