"""Exact repeats of rows, without a shuffle of what the rows hold."""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions.materialise import materialise
from gaugeworks.functions.spread import spread

#: Keys up to which those that come more than once are broadcast (8 bytes each if they are numbers).
MOST_REPEATED = 2_000_000


def _repeated(df: DataFrame, key: str) -> DataFrame | None:
    """The keys that come more than once, marked for broadcast; None if they are too many for that."""
    twice = materialise(df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).select(key))
    return F.broadcast(twice) if twice.limit(MOST_REPEATED + 1).count() <= MOST_REPEATED else None


def once_per_key(df: DataFrame, key: str, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The distinct rows of ``work(df)``, of which only those of keys that come more than once are shuffled.

    ``work`` gives distinct rows for one row of ``df``, and no row for two different keys. Keys alone are read to find the
    repeated ones; if those are more than ``MOST_REPEATED``, all rows are made distinct in the general way. Rows without a
    key are left out.
    """
    df = df.where(F.col(key).isNotNull())
    few = _repeated(df.select(key), key)
    if few is None:
        return work(df).distinct()
    return work(spread(df.join(few, key, "left_anti"), like=df)).unionByName(work(df.join(few, key, "left_semi")).distinct())


def without_repeats(df: DataFrame, key: str) -> DataFrame:
    """``df`` without exact repeats of rows and rows without a key; only rows of keys that come more than once are shuffled."""
    return once_per_key(df, key, lambda x: x)
