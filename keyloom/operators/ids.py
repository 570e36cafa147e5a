"""Order-preserving 64-bit numbers for keys of any type, so that what follows compares and hashes longs."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.store import written


def numbered(values: DataFrame, column: str, as_: str = "i", by: Column | None = None) -> DataFrame:
    """(column, as_): each distinct non-null value with a bigint; numbers ascend as the values (or `by`) do, with gaps.

    A range-partitioned sort, whose partitions number their rows on their own: no task sees all values. Stored, so that every
    reader sees the same numbers.
    """
    rows = values.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column if by is None else by)
    return written(rows.select(column, F.monotonically_increasing_id().alias(as_)), "numbers")
