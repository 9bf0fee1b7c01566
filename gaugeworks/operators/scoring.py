"""Responses of attempts and answers of questions as rows, from the shapes in which they are stored."""

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions.jsonio import Unreadable, decode, plain_number
from gaugeworks.operators.nested import _letters


def _value(text):
    try:
        return decode(text)
    except Unreadable:
        return None


def _selected(text):
    """(question id, letters) of the responses of one attempt."""
    v = _value(text)
    if isinstance(v, dict):
        items = list(v.items())
    else:
        items = [(x.get("question_id"), x.get("selected")) for x in v if isinstance(x, dict)] if isinstance(v, list) else []
    for key, x in items:
        n = plain_number(key)
        if n is not None:
            yield n, _letters(x.get("keys") if isinstance(x, dict) else x)


def _rows(df: DataFrame, column: str, read, names: tuple[str, str, str]) -> DataFrame:
    schema = pa.schema([(names[0], pa.int64()), (names[1], pa.int64()), (names[2], pa.list_(pa.string()))])

    def run(batches):
        for batch in batches:
            out = [(i, n, x) for i, text in zip(batch.column(0).to_pylist(), batch.column(1)) for n, x in read(i, text.as_py())]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    # exact repeats of a row are one
    cols = df.select(F.col("id").cast("bigint").alias("id"), F.col(column).cast("string").alias("j")).where("id is not null and j is not null")
    return cols.mapInArrow(run, f"{names[0]} bigint, {names[1]} bigint, {names[2]} array<string>").distinct()


def responses(attempts: DataFrame) -> DataFrame:
    """(attempt_id, question_id, selected)"""
    return _rows(attempts, "responses_json", lambda i, t: _selected(t), ("attempt_id", "question_id", "selected"))


def answer_keys(questions: DataFrame) -> DataFrame:
    """(question_id, answer), one row a question."""

    def read(i, text):
        v = _value(text)
        if isinstance(v, (list, str)):
            yield i, _letters(v)

    keys = _rows(questions, "answer_json", read, ("question_id", "q", "answer"))
    return keys.groupBy("question_id").agg(F.min("answer").alias("answer"))
