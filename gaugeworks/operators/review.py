"""Review analytics, ordered lookups and retention.

Defined results: a rate without a denominator is null; ids that point to nothing are dropped from ordered lookups; ties
go to the smaller id.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.functions.materialise import materialise


def rate(part: Column, whole: Column, digits: int = 3) -> Column:
    return F.round(F.try_divide(part.cast("double"), whole.cast("double")), digits)


def review_metrics(events: DataFrame, by: str, kind: str, approved: str, rejected: str, edited: str) -> DataFrame:
    """(by, n, approved, rejected, approval_rate, edit_rate) of review events."""
    n = lambda k: F.count_if(F.col(kind) == k)
    g = events.groupBy(by).agg(F.count(F.lit(1)).alias("n"), n(approved).alias("approved"), n(rejected).alias("rejected"), n(edited).alias("edited"))
    return g.withColumn("approval_rate", rate(F.col("approved"), F.col("approved") + F.col("rejected"))).withColumn("edit_rate", rate(F.col("edited"), F.col("n")))


def counts_with_zeros(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str) -> DataFrame:
    """(parent_key, n): children of each parent, those without any too; children are counted before they are joined."""
    n = children.groupBy(F.col(child_key).alias(parent_key)).agg(F.count(F.lit(1)).alias("n"))
    return parents.select(parent_key).distinct().join(n, parent_key, "left").na.fill({"n": 0})


def ordered_lookup(lists: DataFrame, list_key: str, ids: str, items: DataFrame, item_key: str) -> DataFrame:
    """(list_key, position, item_key, ...): the items of each list in its order, without those that are missing."""
    e = lists.select(list_key, F.posexplode(ids).alias("position", item_key))
    return e.join(items, item_key)


def newest(df: DataFrame, by: list[str], order: list[Column], k: int = 1) -> DataFrame:
    """The first k rows of each group in the given order."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def adaptive_next(items: DataFrame, answered: DataFrame, item: str, difficulty: str, person: str, last: str, last_correct: str) -> DataFrame:
    """(person, item): the unanswered item nearest to the wanted difficulty.

    Wanted is 3 without a last answer, else one step up or down from it, within 1 to 5. ``answered`` holds person, item,
    and (the same in all rows of a person) the last difficulty and whether it was correct. Difficulties are 1 to 5.

    Of each difficulty the items are ranked by id, one more than anybody has answered; the first gap in the ranks that a
    person has answered is the first item left, so people and items meet by equal keys only.
    """
    target = F.when(F.col(last).isNull(), 3).otherwise(F.least(F.greatest(F.col(last) + F.when(F.col(last_correct), 1).otherwise(-1), F.lit(1)), F.lit(5)))
    done = materialise(answered.groupBy(person, item).agg(F.max(target).alias("target")))
    wanted = done.groupBy(person).agg(F.max("target").alias("target"), F.count(F.lit(1)).alias("n"))
    most = wanted.agg(F.max("n")).first()[0] or 0
    by_id = Window.partitionBy(difficulty).orderBy(item)
    ladder = materialise(items.select(item, difficulty).withColumn("rank", F.row_number().over(by_id)).where(F.col("rank") <= most + 1))
    ranks = done.join(ladder, item).select(person, difficulty, "rank", F.row_number().over(Window.partitionBy(person, difficulty).orderBy("rank")).alias("place"))
    full = ranks.where("rank = place").groupBy(person, difficulty).agg(F.max("rank").alias("full"))
    levels = wanted.select(person, "target", F.explode(F.sequence(F.lit(1), F.lit(5))).alias(difficulty))
    next_ = levels.join(full, [person, difficulty], "left").withColumn("rank", F.coalesce("full", F.lit(0)) + 1).join(ladder, [difficulty, "rank"])
    return next_.groupBy(person, "target").agg(F.min_by(item, F.struct(F.abs(F.col(difficulty) - F.col("target")).alias("gap"), item)).alias(item))


def relevant_justifications(justifications: Column, answer: Column, selected: Column) -> Column:
    """Of a map letter -> text the entries that belong to the answer or the selection and have a text."""
    keep = F.array_union(answer, selected)
    return F.map_filter(justifications, lambda k, v: F.array_contains(keep, k) & v.isNotNull() & (F.trim(v) != ""))


def merge_payload(old: Column, new: Column) -> Column:
    """Two maps in one, later keys win."""
    return F.map_from_entries(F.concat(F.filter(F.map_entries(old), lambda e: ~F.array_contains(F.map_keys(new), e["key"])), F.map_entries(new)))
