"""Records as they are kept and shown: projections, merges, lists of ids, states, and what a change undoes.

Defined results: a list that can't be read is empty; a null state stays null; a merge with null gives the other side.
"""

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions.spread import spread
from gaugeworks.operators.orphans import question_ids

LETTERS = "ABCDEFGHIJ"


def question_lists(assessments: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, keep, position, question_id): the ids that each assessment lists, in their order, repeated ones once."""
    df = assessments.select(F.col("id").cast("bigint").alias("id"), *keep, F.col("question_ids_json").cast("string").alias("_j")).where("id is not null and _j is not null")

    def run(batches):
        for batch in batches:
            at, position, ids = [], [], []
            for i, text in enumerate(batch.column("_j")):
                for p, n in enumerate(question_ids(text.as_py())):
                    at.append(i)
                    position.append(p)
                    ids.append(n)
            kept = [c.take(pa.array(at, pa.int64())) for c in batch.columns[:-1]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(position, pa.int32()), pa.array(ids, pa.int64())], names=[*batch.schema.names[:-1], "position", "question_id"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields[:-1])
    return spread(df).mapInArrow(run, f"{kinds}, position int, question_id bigint")


def publish_gate(lists: DataFrame, questions: DataFrame) -> DataFrame:
    """(id, n_listed, passes): whether every listed question exists, belongs to the project and is approved.

    ``lists``: id, project_id, question_id; ``questions``: question_id, project, status (one row a question).
    """
    fine = F.coalesce((F.col("project") == F.col("project_id")) & (F.col("status") == "approved"), F.lit(False))
    return lists.join(questions, "question_id", "left").groupBy("id").agg(F.count(F.lit(1)).alias("n_listed"), F.bool_and(fine).alias("passes"))


def taker_view(structured: DataFrame, show_count: Column) -> DataFrame:
    """(id, stem, options, single, n_correct): what a taker may see; never the answer, its reasons or the evidence."""
    n = F.size(F.array_distinct("answer"))
    return structured.select("id", "stem", "options", (n == 1).alias("single"), F.when(show_count, n).alias("n_correct"))


def fail_stale(state: Column) -> Column:
    """The state of a run after a restart: what was waiting for the machine has failed, what waits for a client stays."""
    return F.when(state.isin("queued", "running"), "failed").otherwise(state)


def hashed_order(seed: Column, text: Column) -> Column:
    """A key that orders equal seeds alike on every engine."""
    return F.md5(F.concat_ws(":", seed.cast("string"), text))


def correct_count(mode: Column, exact: Column, n_options: Column, seed: Column) -> Column:
    """How many options are to be correct: as asked, or drawn by a hash; always 1 to all but one."""
    most = F.greatest(n_options - 1, F.lit(1))
    drawn = F.pmod(F.conv(F.substring(F.md5(seed.cast("string")), 1, 8), 16, 10).cast("bigint"), most.cast("bigint")).cast("int") + 1
    return F.when(mode == "exact", F.least(F.greatest(exact, F.lit(1)), most)).otherwise(drawn).cast("int")


def normalised(options: Column, answer: Column, seed: Column, explanation: Column) -> Column:
    """struct<options, answer, explanation>: options (array<struct<key,text>>) in the order of a hash with new letters, the
    answer and the letters that the explanation names ('option B') written anew."""
    letters = F.array(*[F.lit(x) for x in LETTERS])
    order = F.array_sort(F.transform(options, lambda o: F.struct(hashed_order(seed, F.coalesce(o["text"], F.lit(""))).alias("h"), o["key"].alias("old"), o["text"].alias("text"))))
    new = F.transform(order, lambda x, i: F.struct(F.get(letters, i).alias("key"), x["text"].alias("text"), x["old"].alias("old")))
    right = F.array_sort(F.array_distinct(F.transform(F.filter(new, lambda x: F.array_contains(answer, x["old"])), lambda x: x["key"])))
    # all letters at once: pieces between the names, and the names with their letters replaced
    named = r"(?i)(^|[^A-Za-z0-9_])(option|choice|answer) [A-J]([^A-Za-z0-9_]|$)"
    pieces = F.split(F.regexp_replace(explanation, r"(?i)\b(option|choice|answer) ([A-J])\b", "$1 \u0001$2\u0002"), "[\u0001\u0002]")
    swap = lambda p: F.coalesce(F.filter(new, lambda x: x["old"] == F.upper(p))[0]["key"], p)
    words = F.array_join(F.transform(pieces, lambda p, i: F.when(i % 2 == 1, swap(p)).otherwise(p)), "")
    return F.struct(
        F.transform(new, lambda x: F.struct(x["key"].alias("key"), x["text"].alias("text"))).alias("options"), right.alias("answer"), F.when(explanation.rlike(named), words).otherwise(explanation).alias("explanation")
    )


def after_edit(old: DataFrame, new: DataFrame, key: str, content: list[str], other: list[str], judged: list[str]) -> DataFrame:
    """(key, content_changed, other_changed, judged...): two states compared without regard to nulls; a change of content
    takes back what was judged of it, a change of the rest doesn't."""
    a, b = old.alias("a"), new.alias("b")
    differs = lambda cs: F.array_max(F.array(*[~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in cs]))
    out = a.join(b, key).select(key, differs(content).alias("content_changed"), differs(other).alias("other_changed"), *[F.col(f"b.{c}").alias(c) for c in judged])
    return out.select(key, "content_changed", "other_changed", *[F.when(~F.col("content_changed"), F.col(c)).alias(c) for c in judged])


def refresh(df: DataFrame, version: str, wanted: int, renew) -> DataFrame:
    """The rows whose ``version`` is ``wanted`` or later as they are, the others (and those without one) by ``renew(df)``."""
    old = F.coalesce(F.col(version).try_cast("int"), F.lit(0)) < wanted
    return df.where(~old).unionByName(renew(df.where(old)))


def first_of(df: DataFrame, by: list[str], order: Column, value: str, most: int, sep: str = "; ") -> DataFrame:
    """(by, summary): the first ``most`` values of each group in their order, joined; no group is gathered beyond them."""
    from gaugeworks.operators.review import newest

    few = newest(df.where(F.col(value).isNotNull()).withColumn("_o", order), by, [F.col("_o"), F.col(value)], most)
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_o", F.col(value).alias("v")))), lambda x: x["v"]), sep)
    return few.groupBy(*by).agg(joined.alias("summary"))
