"""Exact top-k inner-product search with M-trees.

Largest inner products become nearest neighbours when each vector x gets one more coordinate,
sqrt(M^2 - |x|^2), and each query a zero, M being the largest norm of all. Trees hold pages: a
page's entries have an object, its distance to the page's own routing object, and, above the leaves, a covering
radius and a child page. A search takes pages in order of their least possible distance. Before the
distance to an entry's object is computed, the stored distance to the parent bounds it by the triangle
inequality, and entries that can't reach the k-th best so far are passed over.

Forest. A sample of vectors are routing objects, and each vector goes to the tree of the nearest, so a tree covers a region; a region
of many vectors is dealt over several trees by id. Pages are promoted for small covering radii: the next routing object is the entry farthest
from those chosen. A tree holds at most TREE_BYTES of vectors and is one row, so a task's memory is bounded.

Search. Each query first asks the trees of its own region; the k-th best score found there is where all other trees
start from, so where vectors lie in clusters most are left at their root. Answers are merged by exact integer scores. Where they don't (random directions in
64 dimensions: the tenth nearest lies at 0.83 of the mean distance) no metric bound rules anything out, and each distance is computed once.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm import common

LEAF, FANOUT = 256, 16
#: Bytes of vectors in a tree; routing objects at most, a sample that only says which tree a vector goes to.
TREE_BYTES, REGIONS = 8 << 20, 256
#: Queries go to the executors in blocks of at most so many bytes.
QUERY_BYTES = 8 << 20
_TREE = "tree long, region int, dims int, norm double, pages array<struct<leaf: boolean, objects: binary, to_parent: binary, radius: binary, child: binary>>"


def quantized(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """Rows (vec_id, v array<long>): floor(scale * x) of each component x as a double. Null ids, null vectors and vectors with null or non-finite components are left out, as are empty ones."""
    v = F.col(vector_col)
    ok = F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return vectors.where(ok).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))


def _distances(a: np.ndarray, extra: np.ndarray, b: np.ndarray, b_extra: float) -> np.ndarray:
    return np.sqrt(((a - b) ** 2).sum(1) + (extra - b_extra) ** 2)


def build(x: np.ndarray, norm: float, leaf: int = LEAF, fanout: int = FANOUT) -> list[dict]:
    """Pages of one tree over the rows of x (floats); page 0 is the root. Leaf entries' children are row numbers."""
    extra = np.sqrt(np.maximum(norm**2 - (x**2).sum(1), 0))
    pages: list[dict] = []

    def make(rows: np.ndarray, parent: int | None) -> int:
        pages.append({})
        me = len(pages) - 1
        to = lambda i, r: _distances(x[r], extra[r], x[i], extra[i])
        if len(rows) <= leaf and parent is not None:  # the root routes, so that a tree can be passed over at the cost of one distance
            pages[me] = {"leaf": True, "rows": rows, "to_parent": to(parent, rows) if parent is not None else np.zeros(len(rows)), "radius": np.zeros(len(rows)), "child": rows.astype(np.int64)}
            return me
        held = [int(rows[0] if parent is None else parent)]
        near = [to(held[0], rows)]
        least = near[0]
        while len(held) < min(fanout, -(-len(rows) // leaf)) and least.max() > 0:
            held.append(int(rows[least.argmax()]))
            near.append(to(held[-1], rows))
            least = np.minimum(least, near[-1])
        which = np.stack(near).argmin(0)
        if len(held) == 1:  # all alike: cut evenly
            many = min(fanout, -(-len(rows) // leaf))
            which = np.arange(len(rows)) * many // len(rows)
            held = [int(rows[which.searchsorted(k)]) for k in range(many)]
            near = near * many
        entries = []
        for k, p in enumerate(held):
            own = which == k
            if own.any():
                entries.append((p, near[k][own].max(), make(rows[own], p)))
        held = np.array([e[0] for e in entries])
        pages[me] = {"leaf": False, "rows": held, "to_parent": to(parent, held) if parent is not None else np.zeros(len(held)), "radius": np.array([e[1] for e in entries]), "child": np.array([e[2] for e in entries], np.int64)}
        return me

    make(np.arange(len(x)), None)
    return pages


def regions(vectors: DataFrame, n: int) -> dict[int, np.ndarray]:
    """By length, routing objects: n of the vectors by the order of a hash of their ids."""
    some = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(n).collect()
    out: dict[int, list] = {}
    for r in some:
        out.setdefault(len(r["v"]), []).append(r["v"])
    return {k: np.unique(np.array(x, np.int64), axis=0) for k, x in out.items()}


def _region(v: np.ndarray, routing: dict[int, np.ndarray]) -> np.ndarray:
    """The nearest routing object of each row of v; where none has the length, all are of one region."""
    to = routing.get(v.shape[1])
    if to is None:
        return np.zeros(len(v), np.int32)
    v, to = v.astype(np.float64), to.astype(np.float64)
    return np.concatenate([((to**2).sum(1) - 2 * v[at : at + 4096] @ to.T).argmin(1) for at in range(0, len(v), 4096)]).astype(np.int32)


def _by_length(b: pa.RecordBatch, column: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their vectors as a matrix) of a batch, by the vectors' length."""
    lists = b.column(column)
    size, flat = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy(zero_copy_only=False)
    start = np.cumsum(size) - size
    for n in np.unique(size):
        rows = np.flatnonzero(size == n)
        yield rows, flat[start[rows][:, None] + np.arange(n)]


def forest(vectors: DataFrame, tree_bytes: int = TREE_BYTES, most_regions: int = REGIONS) -> DataFrame:
    """Trees (rows of _TREE) over the rows (vec_id, v), written. Vectors of different lengths never share a tree."""
    spark = common.ready(vectors.sparkSession)
    n, norm = vectors.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))).first()
    norm = float(np.sqrt(norm or 0.0)) * (1 + 1e-12)
    many = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    routing = regions(vectors, int(min(most_regions, max(1, n // 200), many)))

    def route(b: pa.RecordBatch) -> dict:
        region = np.zeros(b.num_rows, np.int32)
        for rows, v in _by_length(b, "v"):
            region[rows] = _region(v, routing)
        return {"vec_id": b.column(0), "v": b.column(1), "region": region}

    routed = common.written(common.arrow_map(vectors.select("vec_id", "v"), route, "vec_id bigint, v array<bigint>, region int"), "routed")
    # a hot region is dealt over so many trees that none is over the limit
    sizes = routed.groupBy(F.size("v").alias("dims"), "region").agg(F.count("*").alias("n"))
    sizes = sizes.select("dims", "region", F.ceil(F.col("n") * 8 * F.col("dims") / tree_bytes).alias("trees"))
    dealt = routed.withColumn("dims", F.size("v")).join(F.broadcast(sizes) if sizes.count() <= 100_000 else sizes, ["dims", "region"])
    dealt = dealt.select(F.xxhash64("dims", "region", F.expr("pmod(xxhash64(vec_id), trees)")).alias("tree"), "region", "dims", "vec_id", "v")
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.list_(pa.struct([("leaf", pa.bool_()), *((c, pa.binary()) for c in ("objects", "to_parent", "radius", "child"))])))

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held = None, []

        def grown() -> pa.RecordBatch:
            tree, region, dims = name
            t = pa.Table.from_batches(held)
            ids, flat = t.column("vec_id").to_numpy(), np.concatenate([c.flatten().to_numpy() for c in t.column("v").chunks])
            x = flat.reshape(len(ids), dims)
            order = np.argsort(ids, kind="stable")
            ids, x = ids[order], x[order]
            pages = [{"leaf": p["leaf"], "objects": x[p["rows"]].tobytes(), "to_parent": p["to_parent"].tobytes(), "radius": p["radius"].tobytes(), "child": (ids[p["child"]] if p["leaf"] else p["child"]).tobytes()} for p in build(x.astype(np.float64), norm)]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(([tree], [region], [dims], [norm], [pages]), kinds, strict=True)], names=["tree", "region", "dims", "norm", "pages"])

        for b in batches:
            trees = b.column("tree").to_numpy()
            cut = [0, *(np.flatnonzero(trees[1:] != trees[:-1]) + 1).tolist(), b.num_rows]
            for at, stop in zip(cut, cut[1:]):  # noqa: B905
                if stop == at:
                    continue
                own = (int(trees[at]), b.column("region")[at].as_py(), b.column("dims")[at].as_py())
                if held and own != name:
                    yield grown()
                    held = []
                name = own
                held.append(b.slice(at, stop - at).select(["vec_id", "v"]))
        if held:
            yield grown()

    return common.written(dealt.repartition(many, "tree").sortWithinPartitions("tree", "dims", "region").mapInArrow(plant, _TREE), "mtree")


class Tree:
    """One tree, ready for searches."""

    def __init__(self, norm: float, dims: int, pages: list[dict]):
        self.norm, self.computed, self.size = norm, 0, 0
        self.pages = []
        for p in pages:
            x = np.frombuffer(p["objects"], np.int64).reshape(-1, dims)
            self.pages.append((p["leaf"], x, np.abs(x).max(initial=0), x.astype(np.float64), np.frombuffer(p["to_parent"]), np.frombuffer(p["radius"]), np.frombuffer(p["child"], np.int64)))
            self.size += len(x) * p["leaf"]

    def scores(self, page: tuple, keep: np.ndarray, q: np.ndarray, most: int):
        """Exact inner products: in doubles where all sums fit, else in whole numbers of any size."""
        if int(page[2]) * most * len(q) < 1 << 53:
            return page[3][keep] @ q
        return (page[1][keep].astype(object) * q.astype(np.int64).astype(object)).sum(1)

    def search(self, own: int | None, q: np.ndarray, k: int, floor: int | None = None) -> list[tuple[int, int]]:
        """The k best (score, -vec_id), best first, but for vec_id == own. With `floor`, scores below it may be left out."""
        real, most = q.astype(np.float64), int(np.abs(q).max(initial=0))
        base = float(real @ real) + self.norm**2
        slack = 1e-7 * (1 + np.sqrt(base))
        best: list[tuple] = []  # a heap, the worst on top
        reach = np.inf if floor is None else float(np.sqrt(max(base - 2 * float(floor), 0)))
        heap: list[tuple] = [(0.0, 0, None, None)]
        while heap:
            least, at, d_parent, s_parent = heapq.heappop(heap)
            if least > reach + slack:
                break
            page = self.pages[at]
            leaf, _, _, _, to_parent, radius, child = page
            if d_parent is None or reach == np.inf:
                keep = np.arange(len(child))
            else:
                keep = np.flatnonzero(np.abs(d_parent - to_parent) - radius <= reach + slack)
                if not len(keep):
                    continue
            new = np.ones(len(keep), bool) if d_parent is None else to_parent[keep] > 0  # else the parent itself, whose score is known
            self.computed += int(new.sum())
            some = self.scores(page, keep[new], real if int(page[2]) * most * len(q) < 1 << 53 else q, most)
            s = np.full(len(keep), s_parent, some.dtype)
            s[new] = some
            if leaf:
                order = np.argsort(-s.astype(np.float64), kind="stable")
                for j in order.tolist():
                    one = (int(s[j]), -int(child[keep[j]]))
                    if -one[1] == own:
                        continue
                    if len(best) < k:
                        heapq.heappush(best, one)
                    elif one > best[0]:
                        heapq.heapreplace(best, one)
                    elif float(s[j]) < best[0][0]:
                        break
                if len(best) == k:
                    reach = min(reach, float(np.sqrt(max(base - 2 * float(best[0][0]), 0))))
            else:
                d = np.sqrt(np.maximum(base - 2 * s.astype(np.float64), 0))
                lower = np.maximum(d - radius[keep], 0)
                for j in np.flatnonzero(lower <= reach + slack).tolist():
                    heapq.heappush(heap, (float(lower[j]), int(child[keep[j]]), float(d[j]), s[j]))
        return sorted(best, reverse=True)


_FOUND = "query_id bigint, vec_id bigint, score bigint"
_LONG = (1 << 63) - 1


def search(trees: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """The k best rows of the forest for each row (vec_id, v) of queries but itself: query_id, rank, vec_id, score.

    Ties go to the smaller vec_id. Only vectors of the query's length are candidates. Queries pass through the driver in blocks of
    QUERY_BYTES, each against all trees; of several blocks each one's answers are written before the next is taken. A score beyond a long is held at its limit.
    """
    spark = common.ready(trees.sparkSession)
    size = queries.selectExpr("coalesce(sum(8 * size(v) + 16), 0) b").first()["b"]
    blocks = max(1, -(-int(size) // (QUERY_BYTES // 2)))
    found = None
    for block in range(blocks):
        part = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block)
        held = [(r["vec_id"], np.array(r["v"], np.int64)) for r in part.distinct().collect()]
        got = _searched(trees, held, k)
        if blocks > 1:
            got = common.written(got, "answers")
        found = got if found is None else found.unionByName(got)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _searched(trees: DataFrame, queries: list[tuple[int, np.ndarray]], k: int) -> DataFrame:
    """Each query asks its own region's trees, then, from the k-th best score on, all others."""
    spark = trees.sparkSession
    # a query's region is that of the tree with the nearest object in its root
    roots = trees.select("dims", "region", F.expr("pages[0].objects").alias("x"))
    held = spark.sparkContext.broadcast(queries)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple] = {}
        for b in batches:
            for dims, region, x in zip(*(c.to_pylist() for c in b.columns), strict=True):
                x = np.frombuffer(x, np.int64).reshape(-1, dims).astype(np.float64)
                norms = (x**2).sum(1)
                for own, q in held.value:
                    if len(q) == dims:
                        best[own] = min(best.get(own, (np.inf, 0)), (float((norms - 2 * (x @ q)).min()), region))
        if best:
            yield pa.RecordBatch.from_arrays([pa.array(best, pa.int64()), pa.array([d for d, _ in best.values()]), pa.array([r for _, r in best.values()], pa.int32())], names=["query_id", "d", "region"])

    home = roots.mapInArrow(nearest, "query_id bigint, d double, region int").groupBy("query_id").agg(F.min(F.struct("d", "region")).alias("x")).select("query_id", "x.region")
    home = {r["query_id"]: r["region"] for r in home.collect()}
    placed = spark.sparkContext.broadcast([(own, q, home.get(own), None) for own, q in queries])
    first = common.written(trees.mapInArrow(_asked(placed, k, True), _FOUND), "home")
    floors = first.groupBy("query_id").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s")).where(F.size("s") >= k)
    floors = {r["query_id"]: r["floor"] for r in floors.select("query_id", F.get("s", F.lit(k - 1)).alias("floor")).collect()}
    placed = spark.sparkContext.broadcast([(own, q, home.get(own), floors.get(own)) for own, q in queries])
    return first.unionByName(trees.mapInArrow(_asked(placed, k, False), _FOUND))


def _asked(held, k: int, at_home: bool):
    """Searches trees of the queries' own regions, or all others. A task's answers raise the floor for its next tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list] = {}
        for b in batches:
            for i in range(b.num_rows):
                region, dims = b.column("region")[i].as_py(), b.column("dims")[i].as_py()
                some = [x for x in held.value if len(x[1]) == dims and (x[2] == region) == at_home]
                if not some:
                    continue
                tree = Tree(b.column("norm")[i].as_py(), dims, b.column("pages")[i].as_py())
                for own, q, _, floor in some:
                    old = best.get(own, [])
                    if len(old) == k:
                        floor = old[-1][0] if floor is None else max(floor, old[-1][0])
                    best[own] = heapq.nlargest(k, old + tree.search(own, q, k, floor))
        rows = [(own, -i, max(-_LONG - 1, min(_LONG, s))) for own, found in best.items() for s, i in found]
        for at in range(0, len(rows), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[at : at + 50_000], strict=True)], names=["query_id", "vec_id", "score"])

    return run


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best rows for each row whose vec_id is divisible by 100, against all rows. Null vectors and those with null or non-finite components take no part; equal vectors are all candidates."""
    vectors = common.written(quantized(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), "vectors")
    return search(forest(vectors), vectors.where("vec_id % 100 = 0"), 10)


QUERIES = {"op2_mtree_topk": op2}
ORACLE_SQL = {
    "op2_mtree_topk": """
with e as (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) v from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::bigint score
  from e q join e c on q.vec_id % 100 = 0 and c.vec_id <> q.vec_id and len(c.v) = len(q.v)),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) n from s)
select query_id, n::int rank, vec_id, score from r where n <= 10"""
}
