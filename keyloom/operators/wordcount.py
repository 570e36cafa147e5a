"""Word counts over texts, and the statistics of timings."""

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def words_by_doc(docs: DataFrame, key: str, text: str, keep_empty: bool = False) -> DataFrame:
    """(word, key, n): words between white space, counted for each text; combined on the map side. keep_empty counts empty pieces too. Null texts have none."""
    words = docs.select(key, F.explode(F.split(text, r"\s+", -1)).alias("word"))
    return (words if keep_empty else words.filter("word <> ''")).groupBy("word", key).agg(F.count(F.lit(1)).alias("n"))


def word_totals(counts: DataFrame, key: str) -> DataFrame:
    """(word, n, first_key): the sum of a word's counts and its smallest key."""
    return counts.groupBy("word").agg(F.sum("n").alias("n"), F.min(key).alias("first_key"))


def latin1_words(files: DataFrame, content: str) -> DataFrame:
    """(word, n): the words of binary contents read as ISO-8859-1, whatever they are; n is a long sum. Null contents have none."""
    words = files.select(F.explode(F.split(F.decode(content, "ISO-8859-1"), r"\s+", -1)).alias("word")).filter("word <> ''")
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def output_size(df: DataFrame) -> DataFrame:
    """(n_rows, n_bytes): rows and the bytes of their text form, as one row; no rows give zeros."""
    size = F.length(F.to_json(F.struct("*")).cast("binary"))
    return df.select(size.alias("b")).agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum("b"), F.lit(0)).cast("bigint").alias("n_bytes"))


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, start, words = [], [], []
        for i, text in enumerate(batch.column(1).to_pylist()):
            for m in WORD.finditer(text):
                at.append(i)
                start.append(m.start())
                words.append(m.group())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(words, pa.string()), pa.array(start, pa.int32())], ["key", "word", "start"])


WORD = re.compile(r"\w+", re.ASCII)


def word_occurrences(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, word, start): every run of word characters with the code point at which it begins; null texts have none. Starts keep the occurrences apart, so none is lost."""
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).filter(F.col(text).isNotNull()).mapInArrow(_occurrences, f"key {kind}, word string, start int").withColumnRenamed("key", key)


def median_and_minimum(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, least, median): the minimum and the upper of the two middle values of each group, exact, for groups of any size.

    Equal values are counted on the map side; a running count over a group's distinct values, which streams, finds the middle. Null values are left out.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("__n"))
    total = counts.groupBy(group).agg(F.sum("__n").alias("__all"), F.min(value).alias("least"))
    w = Window.partitionBy(group).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    both = counts.withColumn("__upto", F.sum("__n").over(w)).join(total, group)
    middle = F.floor(F.col("__all") / 2) + 1
    return both.filter((F.col("__upto") >= middle) & (F.col("__upto") - F.col("__n") < middle)).select(group, "least", F.col(value).alias("median"))
