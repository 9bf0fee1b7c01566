"""Spreading a small input over the cores before costly work on each row."""

from pyspark.sql import DataFrame


def spread(df: DataFrame, like: DataFrame | None = None) -> DataFrame:
    """``df`` dealt out to as many partitions as there are cores, if it is read in fewer; else as it is.

    Large inputs are read in many partitions and stay where they are, and so do inputs that were shuffled or joined
    before. The plan alone is asked, nothing runs; ``like``: the input that gave ``df`` its partitions, to be asked instead.
    """
    execution = (df if like is None else like)._jdf.queryExecution()
    if "Exchange" in execution.executedPlan().toString():
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if execution.toRdd().getNumPartitions() >= cores else df.repartition(cores)
