"""Joins whose keys may be held by a third of all rows."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts that the rows of a hot key are split into.
SALTS = 16
#: A key is hot if it holds more than one row in so many; so many keys at most can be.
HOT_PARTS = 200


def hot_keys(df: DataFrame, keys: list[str], n_rows: int | None = None, least: int = 10_000) -> DataFrame:
    """The keys that hold more than a ``HOT_PARTS``-th of the rows, and ``least`` rows: never more than ``HOT_PARTS`` keys."""
    n = df.count() if n_rows is None else n_rows
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > max(least, n // HOT_PARTS)).select(*keys)


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], spread: Column, how: str = "left", hot: DataFrame | None = None) -> DataFrame:
    """``left`` joined to ``right`` (one row a key) on ``keys``; rows of hot keys are split by ``spread`` (a hash of the row).

    The rows of ``right`` of a hot key are repeated once a part; all others stay single. The list of hot keys is counted
    once and broadcast: it has ``HOT_PARTS`` rows at most. Without any, it is a plain join.
    """
    hot = hot_keys(left, keys) if hot is None else hot
    listed = hot.select(*keys).collect()
    if not listed:
        return left.join(right, keys, how)
    marked = F.broadcast(left.sparkSession.createDataFrame(listed, hot.select(*keys).schema).withColumn("_hot", F.lit(True)))
    salt = F.when(F.col("_hot"), F.pmod(spread, F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    a = left.join(marked, keys, "left").withColumn("_salt", salt).drop("_hot")
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    b = right.join(marked, keys, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return a.join(b, [*keys, "_salt"], how).drop("_salt")
