"""What the operators share: the shared folder, tables written to cut lineage, batches, column hygiene."""

from __future__ import annotations

import gc
import os
import posixpath
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest object the operators broadcast to executors, in bytes. Every broadcast is checked against it.
BROADCAST_LIMIT = 64 << 20
#: Bytes of one id in a broadcast table, its share of empty places included.
ID_BYTES = 64
#: Arrow batches to Python workers hold at most so many rows and bytes.
BATCH_ROWS, BATCH_BYTES = 2_000, 8 << 20

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def ready(spark: SparkSession) -> SparkSession:
    """Bounded Arrow batches, a checkpoint folder, and this package on the workers' path."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    sc = spark.sparkContext
    path = sc.environment.get("PYTHONPATH", "")
    if _ROOT not in path.split(os.pathsep):
        sc.environment["PYTHONPATH"] = os.pathsep.join(x for x in (_ROOT, path) if x)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or where that is unset and all runs on one machine one of our own. With its scheme, so that Spark and Arrow mean the same place."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set; it must name a folder that the driver and all executors share")
        folder = f"file:///tmp/checkpoints/quire-{uuid.uuid4().hex}"
        spark.sparkContext.setCheckpointDir(folder)
    if "://" not in folder and not folder.startswith("file:"):
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        folder = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toString()
    return folder.rstrip("/")


def _own_dir(spark: SparkSession) -> str:
    return posixpath.join(shared_dir(spark), f"quire-{spark.sparkContext.applicationId}")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in this application's part of the shared folder; clean() removes that part."""
    return posixpath.join(_own_dir(spark), f"{name}-{uuid.uuid4().hex}")


def clean(spark: SparkSession) -> None:
    """Deletes all that the operators have written to the shared folder in this application. Results that aren't yet written elsewhere are lost."""
    _delete(spark, _own_dir(spark))


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def unused(columns: list[str], name: str) -> str:
    """name, or with underscores before it until no column is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read back: lineage ends there, and no executor holds the only copy."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quire_path = path
    return out


def drop_written(df: DataFrame | None) -> None:
    """Deletes the folder of a table from written() that nothing reads any more."""
    if path := getattr(df, "_quire_path", None):
        _delete(df.sparkSession, path)


#: What outlives a task in this process, by operator: how to let go of it.
_held: dict[str, Callable[[], None]] = {}


def holds(operator: str, drop: Callable[[], None]) -> None:
    """To be called by a task that keeps something for later tasks of its operator in the same Python worker; drop() lets go of it."""
    _held[operator] = drop


def let_go(operator: str = "") -> None:
    """To be called where a task begins: what other operators keep in this Python worker is dropped, and its memory given back. Spark uses a worker again for whatever comes next, and an executor's memory holds them all."""
    if others := [k for k in _held if k != operator]:
        for k in others:
            _held.pop(k)()
        gc.collect()
    pa.default_memory_pool().release_unused()


def give_back(spark: SparkSession) -> None:
    """To be called between steps of many stages: the driver lets go of plans and tasks that are done with. Else its heap grows to its limit before it is tidied up. Shuffle files that nothing reads any more go as well."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def bounded(payload: bytes, what: str) -> bytes:
    if len(payload) > BROADCAST_LIMIT:
        raise ValueError(f"{what} has {len(payload)} bytes; at most {BROADCAST_LIMIT} are broadcast")
    return payload


def with_ids(df: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows of df whose doc_id is in ids (or isn't: left_anti). So few ids are broadcast as their table stays under BROADCAST_LIMIT; more are joined by a shuffle."""
    return df.join(F.broadcast(ids) if ids.count() <= BROADCAST_LIMIT // ID_BYTES else ids, "doc_id", how)


def arrow_map(df: DataFrame, f, schema: str) -> DataFrame:
    """mapInArrow with f(batch: RecordBatch) -> dict of columns, list of dicts' columns or None."""
    from pyspark.sql.types import _parse_datatype_string

    try:
        from pyspark.sql.pandas.types import to_arrow_schema
    except ImportError:  # the helper moved between releases
        from pyspark.sql.types import to_arrow_schema
    kind = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for b in batches:
            if b.num_rows and (out := f(b)) is not None:
                yield pa.RecordBatch.from_arrays([pa.array(out[x.name], type=x.type) for x in kind], schema=kind)

    return df.mapInArrow(run, schema)


#: So many edges, 4 MB of ids, are joined in one task: a round of stars is some twenty stages, whose plans, tasks and metrics the driver has to hold however few the edges are.
FEW_EDGES = 1 << 18


def united(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of these edges, sorted, and the smallest node that each reaches. A part's root takes the least root beside it until no edge leaves a part; two steps halve the roots at least."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = place[: len(a)], place[len(a) :]
    root = np.arange(len(nodes))
    while len(a):
        a, b = root[a], root[b]
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while ((up := root[root]) != root).any():
            root = up
    return nodes, nodes[root]


def _united(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    let_go()
    got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if got:
        node, comp = united(*(np.concatenate(x) for x in zip(*got, strict=True)))
        for k in range(0, len(node), BATCH_ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(x[k : k + BATCH_ROWS]) for x in (node, comp)], names=["node", "comp"])


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the undirected edges (a long, b long): rows (node, comp), comp the smallest node.

    FEW_EDGES edges or fewer are joined in one task. More take alternating large-star and small-star
    rounds (Kiveris et al., 2014). Each round is one
    partial aggregation and one equi-join per star, which adaptive execution splits where a
    node is hot; its table is written to the shared folder. Nodes without an edge have no row.
    Nulls and loops are ignored. Nothing is gathered on the driver but a count and a checksum.
    """
    now, mark = written(edges.where("a is not null and b is not null and a <> b").selectExpr("greatest(a, b) a", "least(a, b) b"), "edges"), None
    if now.count() <= FEW_EDGES:
        return now.coalesce(1).mapInArrow(_united, "node bigint, comp bigint")
    every, now = now, written(now.distinct(), "edges")
    drop_written(every)

    def stars(e: DataFrame) -> DataFrame:
        # the least neighbours are written, so that each join shuffles both its sides and a hot node's rows can be split
        both = e.unionByName(e.selectExpr("b a", "a b"))
        least = written(both.groupBy("a").agg(F.min("b").alias("m")).selectExpr("a", "least(a, m) m"), "least")
        large = written(both.join(least, "a").where("b > a").selectExpr("b a", "m b").distinct(), "large")
        drop_written(least)
        least = written(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        out = written(large.join(least, "a").selectExpr("explode(array(struct(a, m b), struct(b a, m b))) x").select("x.*").where("a <> b").distinct(), "stars")
        drop_written(large)
        drop_written(least)
        return out

    while True:
        last, now = now, stars(now)
        at = now.selectExpr("count(1) n", "bit_xor(xxhash64(a, b)) x").first()
        drop_written(last)
        if at == mark or at["n"] == 0:
            break
        mark = at
    # now every edge is (node, root)
    return now.selectExpr("a node", "b comp").unionByName(now.selectExpr("b node", "b comp").distinct())
