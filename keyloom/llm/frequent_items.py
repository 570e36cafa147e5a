"""Problem 7: the most frequent values of a huge column, by external sort and run-length counting.

Each task turns bounded chunks of its rows into sorted runs of (value, count); the runs are range-partitioned by
value and sorted (an external sort that spills); a streaming merge adds the counts of equal neighbours and keeps a
bounded heap for each range. Counts are exact: a value's runs all meet in one range, and a heap of k entries holds every
value that can be among the k most frequent, or reach a share of 1 / k of all rows.
"""

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.store import written

CHUNK_ROWS = 500_000


def _sorted_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(value, n) of chunks of CHUNK_ROWS rows, each sorted by value; null values count under a null."""

    def flush(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        column = pa.chunked_array([b.column(0) for b in held]).combine_chunks()
        counted = pc.value_counts(column)
        values, n = counted.field(0), counted.field(1)
        order = pc.sort_indices(values)
        return pa.RecordBatch.from_arrays([values.take(order), n.take(order)], ["value", "n"])

    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= CHUNK_ROWS:
            yield flush(held)
            held, rows = [], 0
    if rows:
        yield flush(held)


def _merge(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heap: list[tuple[int, object]] = []  # (count, value), the smallest first, at most k
        last, pending, kind = None, 0, None

        def offer(n: int, value: object) -> None:
            if len(heap) < k:
                heapq.heappush(heap, (n, value))
            elif (n, value) > heap[0]:
                heapq.heapreplace(heap, (n, value))

        for batch in batches:
            if not batch.num_rows:
                continue
            values, n = batch.column(0), batch.column(1).to_numpy()
            kind = values.type
            change = np.ones(len(values), bool)
            change[1:] = pc.not_equal(values.slice(1), values.slice(0, len(values) - 1)).to_numpy(zero_copy_only=False)
            first = np.flatnonzero(change)
            total = np.add.reduceat(n, first)
            head = values[0].as_py()
            if pending and head == last:
                total[0] += pending
            elif pending:
                offer(pending, last)
            # the last run may go on in the next batch; of the others only those that can enter the heap become objects
            done = total[:-1]
            able = np.flatnonzero(done >= heap[0][0]) if len(heap) == k else np.arange(len(done))
            if len(able) > k:
                able = able[np.argpartition(done[able], len(able) - k)[-k:]] if _strictly(done[able], k) else able
            for value, count in zip(values.take(pa.array(first[able])).to_pylist(), done[able].tolist()):
                offer(count, value)
            last, pending = values[len(values) - 1].as_py(), int(total[-1])
        if pending:
            offer(pending, last)
        if heap:
            yield pa.RecordBatch.from_arrays([pa.array([v for _, v in heap], kind), pa.array([n for n, _ in heap], pa.int64())], ["value", "n"])

    return run


def _strictly(counts: np.ndarray, k: int) -> bool:
    """Whether the k largest counts are told apart from the rest (no tie at the edge)."""
    edge = np.partition(counts, len(counts) - k)[len(counts) - k]
    return int((counts >= edge).sum()) == k


def _runs(df: DataFrame, column: str) -> DataFrame:
    """The sorted runs, stored: they are read to draw the ranges, to sum all rows, and to be merged."""
    kind = df.schema[column].dataType.simpleString()
    return written(df.select(F.col(column).alias("value")).mapInArrow(_sorted_runs, f"value {kind}, n bigint"), "runs")


def _candidates(runs: DataFrame, k: int) -> DataFrame:
    kind = runs.schema["value"].dataType.simpleString()
    # ranges are drawn by sampling the runs, which hold each value at most once a chunk: a hot value weighs no more than others
    ordered = runs.filter("value is not null").repartitionByRange("value").sortWithinPartitions("value")
    return ordered.mapInArrow(_merge(k), f"value {kind}, n bigint")


def most_frequent(df: DataFrame, column: str, k: int) -> DataFrame:
    """(value, n): the k most frequent non-null values with their counts; ties go to the larger value. Fewer if there are fewer values."""
    return _candidates(_runs(df, column), k).orderBy(F.desc("n"), F.desc("value")).limit(k)


def at_least_share(df: DataFrame, column: str, share: float) -> DataFrame:
    """(value, n): every non-null value that makes up at least `share` of all rows, null values and repeated rows counted among all.

    At most 1 / share values can; the heaps hold that many. An empty table gives no rows.
    """
    runs = _runs(df, column)
    least = share * (runs.agg(F.sum("n")).first()[0] or 0)
    return _candidates(runs, int(1 / share + 1e-9) + 1).filter(F.col("n") >= least)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """snippet_hash: each hash with at least 0.24 % of all rows."""
    found = at_least_share(spark.read.parquet(f"{d}/snippets.parquet"), "hash", 0.0024)
    return found.select(F.lower(F.hex("value")).alias("snippet_hash"))


def p7_top(spark: SparkSession, d: str) -> DataFrame:
    """snippet_hash, n: the 100 most frequent hashes."""
    found = most_frequent(spark.read.parquet(f"{d}/snippets.parquet"), "hash", 100)
    return found.select(F.lower(F.hex("value")).alias("snippet_hash"), "n")


QUERIES = {"p7_found": p7_found, "p7_top": p7_top}
SQL = {
    "p7_found": "SELECT lower(hex(hash)) AS snippet_hash FROM snippets WHERE hash IS NOT NULL GROUP BY hash HAVING count(*) >= 0.0024 * (SELECT count(*) FROM snippets)",
    "p7_top": "SELECT lower(hex(hash)) AS snippet_hash, count(*)::BIGINT AS n FROM snippets WHERE hash IS NOT NULL GROUP BY hash ORDER BY n DESC, hash DESC LIMIT 100",
}
