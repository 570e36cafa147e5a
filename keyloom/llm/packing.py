"""Problem 8: texts packed into containers of fixed capacity, by best-two-fit."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm.hashing import U, mix
from keyloom.operators.skew import spread
from keyloom.store import written

#: Pieces of a shard: what one task packs on its own. Per piece some 100 bytes.
SHARD_PIECES = 20_000


def best_two_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins as lists of indices into sizes (each 1..capacity).

    A bin takes the largest unpacked item that fits, again and again. Then its smallest item is replaced by
    two unpacked ones if these fit the gap it leaves more tightly, until no pair does. The unpacked sizes are a bit set, so
    the largest size up to a bound, and a pair of a given sum, are found by a few word operations.
    """
    stock: dict[int, list[int]] = {}
    for i, s in enumerate(sizes):
        if not 0 < s <= capacity:
            raise ValueError(s)
        stock.setdefault(s, []).append(i)
    bits = sum(1 << s for s in stock)
    mirror = sum(1 << (capacity - s) for s in stock)

    def take(s: int) -> int:
        nonlocal bits, mirror
        held = stock[s]
        i = held.pop()
        if not held:
            del stock[s]
            bits ^= 1 << s
            mirror ^= 1 << (capacity - s)
        return i

    def put(s: int, i: int) -> None:
        nonlocal bits, mirror
        if s not in stock:
            stock[s] = []
            bits |= 1 << s
            mirror |= 1 << (capacity - s)
        stock[s].append(i)

    def pair(total: int) -> tuple[int, int] | None:
        """Two unpacked sizes with this sum."""
        both = bits & (mirror >> (capacity - total)) & ((1 << (total // 2 + 1)) - 1)
        while both:
            a = both.bit_length() - 1
            if a * 2 != total or len(stock[a]) > 1:
                return a, total - a
            both ^= 1 << a
        return None

    bins = []
    while bits:
        inside, gap = [], capacity
        while gap and (low := bits & ((1 << (gap + 1)) - 1)):
            s = low.bit_length() - 1
            inside.append((s, take(s)))
            gap -= s
        while gap and bits:
            s, i = inside[-1]  # taken in descending order until a pair comes in; kept sorted below
            for total in range(s + gap, s, -1):
                if found := pair(total):
                    inside.pop()
                    for x in found:
                        inside.append((x, take(x)))
                    put(s, i)
                    inside.sort(reverse=True)
                    gap -= total - s
                    break
            else:
                break
        bins.append([i for _, i in inside])
    return bins


#: Fixed value: how the public byte-level vocabularies of 50,000 ranks split a text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def token_counter(vocabulary: str | None = None, pattern: str | None = None):
    """A function text -> number of tokens of a byte-level BPE given as a file of ranks; by default the installed public one, with its pattern."""
    import base64

    import tiktoken

    if vocabulary is None:
        import public_tokenizers

        vocabulary, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("own", pat_str=pattern or PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda text: len(encoding.encode_ordinary(text))


def _pieces(capacity: int, vocabulary: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        count, context, done = token_counter(vocabulary), TaskContext.get(), 0
        part = context.partitionId() if context else 0
        for batch in batches:
            n = np.array([count(t) for t in batch.column(1).to_pylist()], np.int64)
            pieces = -(-n // capacity)
            at = np.repeat(np.arange(len(n)), pieces)
            nth = np.arange(len(at)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            slot = mix((np.arange(len(at), dtype=U) + U(done)) ^ (U(part) << U(40)))
            done += len(at)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(nth.astype(np.int32)), pa.array(np.minimum(capacity, n[at] - nth * capacity).astype(np.int32)), pa.array((slot >> U(1)).view(np.int64))], ["id", "piece", "n_tokens", "slot"])

    return run


def _pack(capacity: int, stage: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "slot"], kind="stable").reset_index(drop=True)
        sizes = pdf["n_tokens"].tolist()
        bins = best_two_fit(sizes, capacity)
        order = [i for b in bins for i in b]
        out = pdf.loc[order, ["id", "piece", "n_tokens", "slot"]]
        lens = [len(b) for b in bins]
        out["container"] = np.repeat([f"{stage}-{key[0]}-{k}" for k in range(len(bins))], lens) if bins else []
        out["filled"] = np.repeat([sum(sizes[i] for i in b) for b in bins], lens).astype(np.int32)
        return out

    return run


def pack(texts: DataFrame, key: str, text: str, capacity: int = 2048, vocabulary: str | None = None, well_filled: float = 0.99) -> DataFrame:
    """(id, piece, n_tokens, container): every row's text assigned whole to one container of `capacity` tokens.

    A longer text is cut into pieces of capacity tokens, numbered from 0, and a rest. Each row is an item, a repeated row
    too; a null text, or one without tokens, needs no room and has no row; a null key is kept. Other columns are not read.

    Items are spread by a hash of their place in the input (no key can be hot) over shards of about SHARD_PIECES, each
    packed by one task; containers of the first stage below `well_filled` are opened and their items packed once
    more together, in as few shards. Containers have unique names, not numbers in a row.
    """
    kind = texts.schema[key].dataType.simpleString()
    rows = texts.select(F.col(key).alias("id"), F.col(text).alias("text")).filter("text is not null")
    pieces = written(spread(rows).mapInArrow(_pieces(capacity, vocabulary), f"id {kind}, piece int, n_tokens int, slot bigint"), "pieces")
    schema = f"id {kind}, piece int, n_tokens int, slot bigint, container string, filled int"

    def stage(df: DataFrame, n: int) -> DataFrame:
        shards = max(1, -(-df.count() // SHARD_PIECES))
        return df.select("id", "piece", "n_tokens", "slot", F.pmod(F.col("slot"), F.lit(shards)).alias("shard")).groupBy("shard").applyInPandas(_pack(capacity, n), schema)

    first = written(stage(pieces, 1), "packed")
    good = F.col("filled") >= int(well_filled * capacity)
    second = stage(first.filter(~good), 2)
    return first.filter(good).unionByName(second).select("id", "piece", "n_tokens", "container")


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, piece, n_tokens, container: all documents in containers of 2048 tokens."""
    return pack(spark.read.parquet(f"{d}/documents.parquet"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def p8_fit(spark: SparkSession, d: str) -> DataFrame:
    """fits, filled: whether no container holds more than 2048 tokens, and all but 1 % of their room is used (one container may be open)."""
    sums = p8_packed(spark, d).groupBy("container").agg(F.sum("n_tokens").alias("n"))
    one = sums.agg(F.max("n").alias("most"), F.sum("n").alias("used"), F.count(F.lit(1)).alias("n"))
    return one.select((F.col("most") <= 2048).alias("fits"), (F.col("used") >= 0.99 * 2048 * (F.col("n") - 1)).alias("filled"))


def p8_whole(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, n_rows, whole: every document with text, how often it is listed, and whether its pieces are all there, each as often, all but the last of 2048 tokens and in one container each."""
    parts = p8_packed(spark, d).filter("doc_id is not null")
    by = parts.groupBy("doc_id", "piece").agg(F.count(F.lit(1)).alias("n"), F.min("n_tokens").alias("least"), F.max("n_tokens").alias("most"))
    of = by.groupBy("doc_id").agg(F.max("n").alias("n_rows"), F.min("n").alias("fewest"), F.max("piece").alias("last"), F.count(F.lit(1)).alias("n_pieces"), F.sum((F.col("least") < 2048).cast("int")).alias("short"), F.max("most").alias("most"))
    return of.select("doc_id", "n_rows", ((F.col("n_rows") == F.col("fewest")) & (F.col("last") + 1 == F.col("n_pieces")) & (F.col("short") <= 1) & (F.col("most") <= 2048)).alias("whole"))


QUERIES = {"p8_packed": p8_packed, "p8_fit": p8_fit, "p8_whole": p8_whole}
SQL = {
    "p8_fit": "SELECT true AS fits, true AS filled",
    "p8_whole": "SELECT doc_id, count(*)::BIGINT AS n_rows, true AS whole FROM documents WHERE doc_id IS NOT NULL AND text <> '' GROUP BY doc_id",
}
