"""Tables of a record store: SQLite as a source, and upserts and deletions as whole states.

Defined results: a key that is written twice in one batch keeps the last by ``order``; deleting what isn't there changes
nothing.
"""

import html
import sqlite3

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_TYPES = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}


def read_sqlite(spark: SparkSession, path: str, table: str, schema: str, key: str = "id", parts: int = 8) -> DataFrame:
    """The rows of a SQLite table, read in ``parts`` ranges of its integer key by as many tasks.

    The file must be readable for every executor. ``schema`` as 'name type, ...' with bigint, int, string or double.
    """
    fields = [tuple(f.split()) for f in schema.split(", ")]
    for name in (table, key, *(n for n, _ in fields)):
        if not name.replace("_", "").isalnum():
            raise ValueError(f"not a name: {name!r}")
    con = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    low, high = con.execute(f"select min({key}), max({key}) from {table}").fetchone()
    con.close()
    if low is None:
        return spark.createDataFrame([], schema)
    step = (high - low) // parts + 1
    ranges = spark.createDataFrame([(low + i * step, low + (i + 1) * step) for i in range(parts)], "a bigint, b bigint").repartition(parts, "a")
    arrow = pa.schema([(n, _TYPES[t]) for n, t in fields])

    def run(batches):
        con = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                cursor = con.execute(f"select {', '.join(n for n, _ in fields)} from {table} where {key} >= ? and {key} < ?", (a, b))
                while rows := cursor.fetchmany(10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)
        con.close()

    return ranges.mapInArrow(run, schema)


def upsert(state: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """The state after inserting or replacing rows by key."""
    cols = state.columns
    last = changes.groupBy(key).agg(F.max_by(F.struct(*cols), order).alias("x")).select(*[F.col(f"x.{c}").alias(c) for c in cols])
    return state.join(last.select(key), key, "left_anti").select(*cols).unionByName(last)


def delete(state: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return state.join(keys.select(key).distinct(), key, "left_anti").select(*state.columns)


def escape_html(c: Column) -> Column:
    """Text that is safe between tags and inside attributes."""
    for plain, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", html.escape("'"))):
        c = F.replace(c, F.lit(plain), F.lit(safe))
    return c


def print_view(questions: DataFrame, with_key: bool = False) -> DataFrame:
    """(id, html): each question (id, stem, options array<struct<key,text>>, answer array) as a fragment for printing."""
    item = lambda o: F.concat(F.lit("<li>"), escape_html(o["key"]), F.lit(". "), escape_html(F.coalesce(o["text"], F.lit(""))), F.lit("</li>"))
    body = F.concat(F.lit("<p>"), escape_html(F.coalesce("stem", F.lit(""))), F.lit("</p><ol>"), F.array_join(F.transform("options", item), ""), F.lit("</ol>"))
    key = F.concat(F.lit("<p>"), escape_html(F.array_join("answer", ", ")), F.lit("</p>")) if with_key else F.lit("")
    return questions.select("id", F.concat(body, key).alias("html"))


def rows_where(df: DataFrame, where: str | None = None, values: dict | None = None, order: list[Column] | None = None) -> DataFrame:
    """The rows that meet a condition with named values (':name'), by descending id unless another order is given."""
    if where:
        df = df.sparkSession.sql(f"select * from {{rows}} where {where}", args=values or {}, rows=df)
    return df.orderBy(*(order or [F.desc("id")]))


def lookup(df: DataFrame, **equal) -> dict | None:
    """The first row, by ``id`` where there is one, whose columns have the given values (None: are null); None without one."""
    for name, value in equal.items():
        df = df.where(F.col(name).eqNullSafe(F.lit(value)))
    rows = (df.orderBy("id") if "id" in df.columns else df).limit(1).collect()
    return rows[0].asDict(recursive=True) if rows else None


def append_log(entries: DataFrame, path: str, checkpoint: str | None = None):
    """Appends entries to a Parquet log: a batch at once, a stream as long as it runs (``checkpoint`` on shared storage)."""
    if not entries.isStreaming:
        entries.write.mode("append").parquet(path)
        return None
    if not checkpoint:
        raise ValueError("a stream needs a folder for its checkpoint")
    return entries.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
