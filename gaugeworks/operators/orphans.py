"""References to records that do not exist, are deleted, or came later than the reference.

A Bloom filter of the parents' keys proves definite orphans. It is sized by the counted keys up to 64 MB, which serves 53
million of them; beyond that the exact join does without one. References are parsed and tested once and kept; only those
that pass the filter are verified by an exact join, whose hot keys are split. What is left without a parent is told apart
by the log of deletions.

Defined results: null, blank and cut-off values hold no references; a reference that a row holds twice counts once; a
reference without a row id is skipped; a null project in a question means that its evidence has no parent (missing); a
target that is present several times counts from its first time; a null time is never late.
"""

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions.bloom import bloom_filter
from gaugeworks.functions.jsonio import Unreadable, decode, plain_number
from gaugeworks.functions.materialise import materialise
from gaugeworks.functions.skew import salted_join
from gaugeworks.functions.spread import spread


def _value(text):
    try:
        return decode(text)
    except Unreadable:
        return None


def question_ids(text) -> list[int]:
    """The question ids in assessments.question_ids_json: an array (or one) of numbers or texts."""
    v = _value(text)
    if isinstance(v, dict):
        v = v.get("question_ids", v.get("ids"))
    found = [plain_number(x.get("question_id", x.get("id")) if isinstance(x, dict) else x) for x in (v if isinstance(v, list) else [v])]
    return list(dict.fromkeys(n for n in found if n is not None))


def response_ids(text) -> list[int]:
    """The question ids in attempts.responses_json: keys of an object, or question_id of the objects in an array."""
    v = _value(text)
    if isinstance(v, dict) and len(v) <= 3 and isinstance(v.get("responses"), (dict, list)):
        v = v["responses"]
    if isinstance(v, dict):
        found = [plain_number(v["question_id"])] if "question_id" in v else [plain_number(k) for k in v]
    elif isinstance(v, list):
        found = [plain_number(x.get("question_id", x.get("id")) if isinstance(x, dict) else x) for x in v]
    else:
        found = []
    return list(dict.fromkeys(n for n in found if n is not None))


def chunk_numbers(text) -> list[int]:
    """The numbers of the chunks in questions.evidence_json: objects with chunk_id, or ids alone."""
    v = _value(text)
    if isinstance(v, dict) and isinstance(v.get("evidence"), (list, dict)):
        v = v["evidence"]
    found = [plain_number(x.get("chunk_id", x.get("id")) if isinstance(x, dict) else x) for x in (v if isinstance(v, list) else [v])]
    return list(dict.fromkeys(n for n in found if n is not None))


def _references(df: DataFrame, table: str, column: str, time: str, read, parent: str | None = None) -> DataFrame:
    """(ref_table, ref_id, ref_time, parent_id, target) of the references in a column; times in microseconds."""
    schema = pa.schema([("ref_id", pa.int64()), ("ref_time", pa.int64()), ("parent_id", pa.int64()), ("target", pa.int64())])

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for ref, at, p, text in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3)):
                out += [(ref, at, p, n) for n in read(text.as_py())]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=schema)

    cols = df.select(
        F.col("id").cast("bigint").alias("ref_id"), F.unix_micros(F.to_timestamp(F.col(time))).alias("ref_time"),
        (F.col(parent).cast("bigint") if parent else F.lit(None).cast("bigint")).alias("parent_id"), F.col(column).cast("string").alias("j"),
    )
    refs = spread(cols.where("ref_id is not null and j is not null")).mapInArrow(run, "ref_id bigint, ref_time bigint, parent_id bigint, target bigint")
    return refs.select(F.lit(table).alias("ref_table"), "*")


def _deleted(tombstones: DataFrame, table: str) -> DataFrame:
    return tombstones.where(F.col("record_table") == table).select(F.col("record_id").cast("bigint").alias("key")).where("key is not null").distinct().withColumn("gone", F.lit(True))


def _times(df: DataFrame) -> DataFrame:
    """(key, since): the ids of a table and when each first came."""
    return df.where("id is not null").groupBy(F.col("id").cast("bigint").alias("key")).agg(F.min(F.unix_micros(F.to_timestamp("created_at"))).alias("since")).withColumn("there", F.lit(True))


def chunk_keys(projects: DataFrame) -> DataFrame:
    """(parent_id, target) of the chunks of each project, read in the JVM from their ids alone."""
    ids = F.from_json(F.col("chunks_json").cast("string"), "array<struct<id:string>>")["id"]
    number = F.regexp_extract(F.col("c"), r"^\s*[A-Za-z]?(\d{1,18})\s*$", 1)
    c = projects.where("id is not null").select(F.col("id").cast("bigint").alias("parent_id"), F.explode(ids).alias("c"))
    return c.where(number != "").select("parent_id", number.cast("bigint").alias("target")).distinct()


def _row():
    """A hash that spreads the references of one key."""
    return F.xxhash64("ref_table", "ref_id")


def orphan_references(assessments: DataFrame, attempts: DataFrame, questions: DataFrame, projects: DataFrame, tombstones: DataFrame) -> DataFrame:
    """(ref_table, ref_id, ref_time, target_key, reason) of the references without a parent at their time."""
    to_questions = _references(assessments, "assessments", "question_ids_json", "created_at", question_ids).unionByName(
        _references(attempts, "attempts", "responses_json", "submitted_at", response_ids)
    )
    to_chunks = _references(questions, "questions", "evidence_json", "created_at", chunk_numbers, "project_id")
    return _to_questions(to_questions, questions, tombstones).unionByName(_to_chunks(to_chunks, projects, tombstones))


def _tested(refs: DataFrame, keys: DataFrame, h, known: str = "true") -> DataFrame:
    """The references with ``maybe``: whether their key may be among ``keys`` (``h``: its hash), kept for both ways they go."""
    might = bloom_filter(keys, h)
    return materialise(refs.withColumn("maybe", F.expr(known) & (might(h) if might else F.lit(True))))


def _to_questions(refs: DataFrame, questions: DataFrame, tombstones: DataFrame) -> DataFrame:
    refs = refs.withColumnRenamed("target", "key").drop("parent_id")
    parents = materialise(_times(questions))
    tested = _tested(refs, parents.select("key"), F.xxhash64("key"))
    certain = tested.where("not maybe").drop("maybe")
    checked = salted_join(tested.where("maybe").drop("maybe"), parents, ["key"], _row())
    late = checked.where("there and since > ref_time").select("ref_table", "ref_id", "ref_time", F.col("key").cast("string").alias("target_key"), F.lit("late").alias("reason"))
    absent = certain.unionByName(checked.where("there is null").select(*certain.columns))
    told = absent.join(_deleted(tombstones, "questions"), "key", "left")
    gone = told.select("ref_table", "ref_id", "ref_time", F.col("key").cast("string").alias("target_key"), F.when(F.col("gone"), "deleted").otherwise("missing").alias("reason"))
    return gone.unionByName(late)


def _to_chunks(refs: DataFrame, projects: DataFrame, tombstones: DataFrame) -> DataFrame:
    keys = materialise(chunk_keys(projects))
    tested = _tested(refs, keys, F.xxhash64("parent_id", "target"), "parent_id is not null")
    certain = tested.where("not maybe").drop("maybe")
    checked = salted_join(tested.where("maybe").drop("maybe"), keys.withColumn("there", F.lit(True)), ["parent_id", "target"], _row())
    # what has its chunk may still be late, what hasn't may have lost its project: both ask for the project
    asked = certain.withColumn("there", F.lit(False)).unionByName(checked.withColumn("there", F.coalesce("there", F.lit(False))).select(*certain.columns, "there"))
    asked = asked.withColumnRenamed("parent_id", "key").withColumnRenamed("there", "chunk")
    known = salted_join(asked, _times(projects), ["key"], _row())
    open_ = known.where("there is null or not chunk or since > ref_time")
    told = open_.join(_deleted(tombstones, "projects"), "key", "left")
    reason = F.when(F.col("there").isNull() & F.col("gone"), "deleted").when(F.col("there").isNull() | ~F.col("chunk"), "missing").otherwise("late")
    return told.select("ref_table", "ref_id", "ref_time", F.concat(F.lit("c"), F.col("target").cast("string")).alias("target_key"), reason.alias("reason"))


def by_month(orphans: DataFrame) -> DataFrame:
    """(ref_table, month, reason, n_refs, n_rows): orphan references counted per referring table and month."""
    unique = orphans.distinct()
    month = F.date_format(F.timestamp_micros("ref_time"), "yyyy-MM")
    # rows are counted in two steps, so that no month has to fit one task
    per_row = unique.groupBy("ref_table", month.alias("month"), "reason", "ref_id").agg(F.count(F.lit(1)).alias("n"))
    return per_row.groupBy("ref_table", "month", "reason").agg(F.sum("n").alias("n_refs"), F.count(F.lit(1)).alias("n_rows"))
