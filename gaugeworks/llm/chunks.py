"""Streaming access to the chunks inside ``projects.chunks_json``.

A chunk is read by one Arrow-batched Python pass over (id, chunks_json); the text never enters a shuffle.
"""

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from gaugeworks.functions.jsonio import Unreadable, decode
from gaugeworks.functions.spread import spread

#: Characters of JSON text that are worked on at once, so that memory doesn't depend on the rows of an Arrow batch.
BLOCK_CHARS = 8_000_000


def text_of(value) -> str:
    return value if isinstance(value, str) else ""


def chunks_of(chunks_json: str | None) -> list[dict]:
    """The chunk objects of one project; none for null, blank, cut-off or otherwise shaped text."""
    try:
        value = decode(chunks_json)
    except Unreadable:
        return []
    if isinstance(value, dict):
        value = [value]
    return [c for c in value if isinstance(c, dict)] if isinstance(value, list) else []


def blocks(batches: Iterable[pa.RecordBatch], limit: int = BLOCK_CHARS) -> Iterator[list[tuple]]:
    """The rows of the batches as tuples, in lists of about ``limit`` characters of text."""
    rows, size = [], 0
    for batch in batches:
        columns = batch.columns
        for i in range(batch.num_rows):
            row = tuple(c[i].as_py() for c in columns)
            rows.append(row)
            size += sum(len(v) for v in row if isinstance(v, str))
            if size >= limit:
                yield rows
                rows, size = [], 0
    if rows:
        yield rows


def arrow_schema(schema: str) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "string": pa.string(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "array<bigint>": pa.list_(pa.int64())}
    return pa.schema([(n, kinds[k]) for n, k in (f.split() for f in schema.split(", "))])


def map_blocks(df: DataFrame, work, schema: str) -> DataFrame:
    """``work(rows) -> list of columns`` over blocks of the rows of ``df``; ``schema`` as 'name type, name type'."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = arrow_schema(schema)
        for rows in blocks(batches):
            columns = work(rows)
            if columns and len(columns[0]):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields)], schema=fields)

    return spread(df).mapInArrow(run, schema)
