"""Python over Arrow batches, where a parser or a sequential fold is needed."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string


#: Arrow batches to Python workers hold at most so many rows and bytes.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2_000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}


def _bounded(df: DataFrame) -> None:
    conf = df.sparkSession.conf
    for key, most in BATCH.items():
        now = int("".join(c for c in conf.get(key) if c.isdigit()) or 0)
        if not 0 < now <= most:
            conf.set(key, str(most))


def mapped(df: DataFrame, f: Callable[[dict], list[dict]], schema: str) -> DataFrame:
    """f(row) -> rows, for every row; a batch at a time goes to Python and back."""
    _bounded(df)
    kind = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        for b in batches:
            out = [x for row in b.to_pylist() for x in f(row)]
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=kind)

    return df.mapInArrow(run, schema)


def grouped(df: DataFrame, keys: list[str], f: Callable[[list[dict]], list[dict]], schema: str) -> DataFrame:
    """f(rows of a group) -> rows. For groups of bounded size: a page, a book's tables, a session."""
    kind = to_arrow_schema(_parse_datatype_string(schema))
    return df.groupBy(*keys).applyInArrow(lambda t: pa.Table.from_pylist(f(t.to_pylist()), schema=kind), schema)
