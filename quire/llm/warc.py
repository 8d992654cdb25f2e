"""WARC archives with a two-level capture index.

Archives: each task writes its rows as gzip members, one a record, into files of its own in the shared
folder. Index: captures sorted by reversed-host URL key are cut into compressed blocks, held in one file a task; a
directory has a row for each block with its first key. A lookup binary-searches the directory, reads and unpacks
just the blocks that may hold the key, binary-searches these, and then reads the records' byte ranges.
"""

from __future__ import annotations

import bisect
import io
import json
import uuid
import zlib
from collections.abc import Iterator
from hashlib import sha256
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import common

#: Payloads of fewer bytes are never revisits.
LEAST_REVISIT = 100
#: Captures in a block of the index; bytes after which a task begins another archive file.
BLOCK_LINES, FILE_BYTES = 1_000, 1 << 30
LEVEL = 4
_INDEX = "key string, page_id bigint, file string, at bigint, length bigint"
_DIRECTORY = "first string, last string, file string, at bigint, length bigint, lines bigint"


def url_key(url: str | None) -> str:
    """`http://m.Example.com:80/a?b#c` to `com,example,m)/a?b`. Null gives the empty key; what can't be split is its own key."""
    if not url:
        return ""
    try:
        x = urlsplit(url.strip())
        host, port = (x.hostname or ""), x.port
    except ValueError:
        return url
    if not host:
        return url
    at = "" if port in (None, {"http": 80, "https": 443}.get(x.scheme)) else f":{port}"
    return f"{','.join(reversed(host.lower().split('.')))}{at}){x.path or '/'}" + (f"?{x.query}" if x.query else "")


def _fs(path: str):
    """Arrow's file system of a path with a scheme; `s3a` is its `s3`, `abfss` its own. One that Arrow can't open is an error at once, never another place."""
    from pyarrow import fs

    if "://" not in path and not path.startswith(("file:", "/")):
        raise ValueError(f"{path}: a path with a scheme is needed")
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1) if path.startswith("s3a://") else path)


class _Out:
    """A new file in a folder. Its name is its attempt's own, so an attempt repeated elsewhere disturbs nothing."""

    def __init__(self, folder: str, ending: str):
        self.path, self.at = f"{folder}/{uuid.uuid4().hex}{ending}", 0
        fs, where = _fs(self.path)
        fs.create_dir(where.rpartition("/")[0], recursive=True)
        self.out = fs.open_output_stream(where, compression=None)

    def write(self, data: bytes) -> int:
        at, self.at = self.at, self.at + len(data)
        self.out.write(data)
        return at

    def close(self) -> None:
        self.out.close()


class _In:
    """Range reads; the last file stays open."""

    def __init__(self):
        self.path, self.file = None, None

    def read(self, path: str, at: int, length: int) -> bytes:
        if path != self.path:
            self.close()
            fs, where = _fs(path)
            self.path, self.file = path, fs.open_input_file(where)
        return self.file.read_at(length, at)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            self.path = self.file = None


def _header(x: str) -> str:
    """One line, whatever the value holds."""
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in x)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One gzip member."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = ["WARC/1.0", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_header(url)}")
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Payload-Length: {len(payload)}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """The headers, lower-cased, and the payload."""
    data = io.BytesIO(zlib.decompress(member, 31))
    head: dict[str, str] = {}
    if not (first := data.readline()).startswith(b"WARC/1."):
        raise ValueError(f"no WARC record: {first[:20]!r}")
    while (line := data.readline()) not in (b"\r\n", b""):
        name, _, value = line.decode().partition(":")
        head[name.strip().lower()] = value.strip()
    block = data.read(int(head["content-length"]))
    return head, block.partition(b"\r\n\r\n")[2]


def _page(urn: str | None) -> int | None:
    tail = (urn or "").strip("<>").rpartition(":")[2]
    return int(tail) if tail else None


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Archives every row of pages (page_id, url, html) under `folder`. Rows of _INDEX, one a record, written.

    Payload: html in UTF-8, a null one empty. Of rows with equal payloads of LEAST_REVISIT bytes or more those with the
    smallest page_id are responses (one, unless rows repeat) and the others revisit it; null ids count as largest, and where
    all are null all are responses. Groups of equal payloads are found by their digest: an aggregation, then a join that
    adaptive execution splits where one payload is very common.
    """
    common.ready(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.encode("html", "utf-8"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("large", F.length("payload") >= LEAST_REVISIT)
    many = rows.where("large").groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null").select("digest", "refers_to", F.lit(True).alias("large"))
    rows = rows.join(many, ["digest", "large"], "left").select("page_id", "url", "payload", "digest", F.expr("if(page_id = refers_to, null, refers_to)").alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        try:
            for b in batches:
                got = []
                for i in range(b.num_rows):
                    page_id, url, payload, digest, refers_to = (b.column(k)[i].as_py() for k in range(5))
                    out = out or _Out(f"{folder}/warc", ".warc.gz")
                    data = record(page_id, url, payload, digest, refers_to, refers_to is not None)
                    got.append((url_key(url), page_id, out.path, out.write(data), len(data)))
                    if out.at >= FILE_BYTES:
                        out.close()
                        out = None
                yield _batch(got, _INDEX)
        finally:
            if out is not None:
                out.close()

    return common.written(rows.mapInArrow(run, _INDEX), "captures")


_KINDS = {"string": pa.string(), "bigint": pa.int64()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    cols = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, (_, k) in zip(cols, fields, strict=True)], names=[n for n, _ in fields])


def build_index(captures: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Sorts captures by key into compressed blocks under `folder`; returns the directory, written. A very common key spreads over ranges and blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, lines, made = None, [], []

        def put() -> None:
            nonlocal out, lines
            out = out or _Out(f"{folder}/index", ".cdx")
            data = zlib.compress(json.dumps(lines, ensure_ascii=False, separators=(",", ":")).encode(), 6)
            made.append((lines[0][0], lines[-1][0], out.path, out.write(data), len(data), len(lines)))
            lines = []

        try:
            for b in batches:
                for x in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    lines.append(x)
                    if len(lines) == block_lines:
                        put()
                if made:
                    yield _batch(made, _DIRECTORY)
                    made = []
            if lines:
                put()
            if made:
                yield _batch(made, _DIRECTORY)
        finally:
            if out is not None:
                out.close()

    order = ["key", "page_id", "file", "at"]
    return common.written(captures.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, _DIRECTORY), "directory")


def lookup(directory: DataFrame, keys: DataFrame) -> DataFrame:
    """All captures (rows of _INDEX) of the keys in keys.key, each capture once; null keys find nothing.

    The directory goes to the executors in slices of at most common.BROADCAST_LIMIT, in order of its keys, one search a
    slice; one slice holds about 80 million captures. A key's blocks are listed first and dealt
    by block, so a key with very many captures is read by many tasks.
    """
    spark = common.ready(directory.sparkSession)
    keys = keys.select(F.col("key").cast("string").alias("key")).where("key is not null").distinct()
    size = directory.selectExpr("coalesce(sum(length(first) + length(last) + 150), 0) b").first()["b"]
    slices = max(1, -(-int(size) // (common.BROADCAST_LIMIT // 4)))
    order = ["first", "file", "at"]
    if slices == 1:
        parts = [directory]
    else:
        cuts = directory.selectExpr(f"approx_percentile(xxhash64(file, at), array({','.join(str(i / slices) for i in range(1, slices))})) c").first()["c"]
        parts = [directory.where((F.xxhash64("file", "at") > lo if lo is not None else F.lit(True)) & (F.xxhash64("file", "at") <= hi if hi is not None else F.lit(True))) for lo, hi in zip([None, *cuts], [*cuts, None], strict=True)]
    found = [_search(spark, p.orderBy(*order).toArrow() if slices > 1 else p.toArrow(), keys) for p in parts]
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def _search(spark: SparkSession, directory: pa.Table, keys: DataFrame) -> DataFrame:
    rows = sorted(zip(*(directory.column(c).to_pylist() for c in ("first", "last", "file", "at", "length")), strict=True))
    held = spark.sparkContext.broadcast(rows)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = held.value
        firsts = [x[0] for x in rows]
        lasts = [x[1] for x in rows]  # sorted as well: blocks follow one another
        for b in batches:
            got = []
            for key in b.column(0).to_pylist():
                for i in range(bisect.bisect_left(lasts, key), bisect.bisect_right(firsts, key)):
                    got.append((key, *rows[i][2:]))
            yield _batch(got, "key string, file string, at bigint, length bigint")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, where, lines, firsts = _In(), None, [], []
        for b in batches:
            got = []
            for key, file, at, length in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (file, at) != where:
                    where, lines = (file, at), json.loads(zlib.decompress(source.read(file, at, length)))
                    firsts = [x[0] for x in lines]
                got += map(tuple, lines[bisect.bisect_left(firsts, key) : bisect.bisect_right(firsts, key)])
            yield _batch(got, _INDEX)
        source.close()

    blocks = keys.mapInArrow(place, "key string, file string, at bigint, length bigint").repartition("file", "at").sortWithinPartitions("file", "at", "key")
    return blocks.mapInArrow(read, _INDEX)


def read(captures: DataFrame) -> DataFrame:
    """Reads the captures' records by range: key, page_id, url, payload (null for a revisit), payload_bytes, payload_digest, record_type, refers_to. A payload that isn't what its digest says is an error."""
    common.ready(captures.sparkSession)
    schema = "key string, page_id bigint, url string, payload binary, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
    kinds = [_KINDS.get(x.split()[1], pa.binary()) for x in schema.split(", ")]
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source = _In()
        for b in batches:
            got, held = [], 0
            for key, file, at, length in zip(*(b.column(c).to_pylist() for c in ("key", "file", "at", "length")), strict=True):
                head, payload = parse(source.read(file, at, length))
                kind, digest = head["warc-type"], head["warc-payload-digest"].partition(":")[2]
                if kind == "response" and (sha256(payload).hexdigest() != digest or len(payload) != int(head["warc-payload-length"])):
                    raise ValueError(f"the record at {at} of {file} is damaged")
                got.append((key, _page(head["warc-record-id"]), head.get("warc-target-uri"), payload if kind == "response" else None, int(head["warc-payload-length"]), digest, kind, _page(head.get("warc-refers-to"))))
                held += len(payload)
                if held > common.BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*got), kinds)], names=names)
                    got, held = [], 0
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*got), kinds)], names=names)
        source.close()

    return captures.repartitionByRange("file", "at").sortWithinPartitions("file", "at").mapInArrow(run, schema)


def keyed(pages: DataFrame) -> DataFrame:
    """The pages' URL keys, in a column key."""
    common.ready(pages.sparkSession)
    return common.arrow_map(pages.select("url"), lambda b: {"key": [url_key(x) for x in b.column(0).to_pylist()]}, "key string")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives the pages, indexes the captures, looks all pages' URLs up and reads the records. Repeated rows are each archived and returned."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    folder = common.fresh_path(spark, "archive")
    directory = build_index(write(pages, folder), folder)
    out = read(lookup(directory, keyed(pages)))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op1_warc": op1}
ORACLE_SQL = {
    "op1_warc": """
with p as (select page_id, encode(coalesce(html, '')) payload from pages),
q as (select page_id, octet_length(payload) n, sha256(payload) digest from p),
r as (select *, min(page_id) over (partition by digest) least from q)
select page_id, n::bigint payload_bytes, digest payload_digest,
  case when n >= 100 and page_id <> least then 'revisit' else 'response' end record_type,
  case when n >= 100 and page_id <> least then least end refers_to
from r"""
}
