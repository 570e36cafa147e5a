"""Equi-joins that stay balanced when one key holds a large part of the rows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def heavy_keys(df: DataFrame, key: str, share: float = 0.001, least: int = 100_000) -> DataFrame:
    """Keys with more than max(least, share of all rows) rows: at most 1 / share of them, whatever the input.

    One aggregate, combined on the map side, so a heavy key costs one row a task. The number of rows comes from the file
    footers where df is a stored table, as it should be.
    """
    counts = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    return counts.filter(F.col("__n") > max(least, int(share * df.count()))).select(key)


#: A table of fewer bytes fits a task whatever its keys, so no count of its keys is needed.
SMALL_BYTES = 64 << 20


def lookup_join(big: DataFrame, small: DataFrame, key: str, how: str = "left", share: float = 0.001, least: int = 100_000, big_bytes: int | None = None, small_bytes: int = SMALL_BYTES) -> DataFrame:
    """big joined with small, whose key is unique. Rows of heavy keys never meet in one task.

    heavy_keys() bounds the heavy part of small by 1 / share rows, so it may be broadcast; the rest is
    an ordinary shuffled join. Null keys match nothing. big_bytes: the stored size of big, where it is known; up to small_bytes
    the join is left to the optimiser. big should be a stored table, since its keys are counted first.
    """
    if big_bytes is not None and big_bytes <= small_bytes:
        return big.join(small, key, how)
    heavy = [r[0] for r in heavy_keys(big, key, share, least).collect()]
    if not heavy:
        return big.join(small, key, how)
    is_heavy = F.coalesce(F.col(key).isin(heavy), F.lit(False))
    hot = big.filter(is_heavy).join(F.broadcast(small.filter(F.col(key).isin(heavy))), key, how)
    return hot.unionByName(big.filter(~is_heavy).join(small.filter(~F.col(key).isin(heavy)), key, how))


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, if its input comes in fewer partitions than there are cores (a small table in one file); else df itself.

    For costly work on each row. A large table has partitions enough and is not moved; nor is a plan with exchanges, whose
    partitions are known only once it runs.
    """
    if df._jdf.queryExecution().executedPlan().nodeName() == "AdaptiveSparkPlan":
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
