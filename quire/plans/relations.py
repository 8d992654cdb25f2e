"""Small relations that a query and its SQL share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class Relation:
    """Rows given once: a DataFrame on one side, a VALUES list on the other. `more` adds rows of a table of the test data to both: (name, Spark expressions, what SQL selects after it)."""

    def __init__(self, schema: str, rows: list[tuple], more: tuple[str, list[str], str] | None = None):
        self.schema, self.rows, self.more = schema, rows, more

    def df(self, spark: SparkSession, sf_dir: str | None = None) -> DataFrame:
        own = spark.createDataFrame(self.rows, self.schema)
        if not self.more or sf_dir is None:  # without a folder the rows given only
            return own
        name, columns, _ = self.more
        return own.union(_source(spark, sf_dir, name).selectExpr(*columns).toDF(*own.columns))

    def sql(self, name: str = "t") -> str:
        if not self.more:
            return self._values(name)
        return f"(select * from {self._values('v')} union all {self.more[2]}) {name}"

    def _values(self, name: str) -> str:
        names = ", ".join(f'"{c.split()[0]}"' for c in self._columns())
        kinds = [c.split(None, 1)[1] for c in self._columns()]
        rows = ", ".join("(" + ", ".join(_literal(v, k) for v, k in zip(r, kinds, strict=True)) + ")" for r in self.rows)
        return f"(values {rows}) {name}({names})"

    def _columns(self) -> list[str]:
        return [c.strip() for c in self.schema.split(",")]


def _literal(v, kind: str) -> str:
    if v is None:
        return f"cast(null as {_duck(kind)})"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    if isinstance(v, (list, tuple)):
        inner = kind[kind.index("<") + 1 : -1]
        return f"cast([{', '.join(_literal(x, inner) for x in v)}] as {_duck(kind)})"
    return f"cast({v} as {_duck(kind)})"


def _duck(kind: str) -> str:
    if kind.startswith("array<"):
        return _duck(kind[6:-1]) + "[]"
    return {"string": "varchar", "int": "integer", "long": "bigint", "bigint": "bigint", "double": "double", "boolean": "boolean", "timestamp": "timestamp"}[kind]


#: Lines of all documents, for `more`.
DOCUMENT_LINES = "select unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) line_no, doc_id from documents where text is not null"


def _source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name != "lines":
        return table(spark, sf_dir, name)
    from quire.operators.lines import exploded

    return exploded(table(spark, sf_dir, "documents"), "doc_id")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
