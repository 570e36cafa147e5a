"""Problem 4: long exact spans shared between texts, by difference-cover anchors.

Lines are hashed once. Windows of `anchor` lines are taken only at positions whose residue modulo `period`
lies in a difference cover: for any two positions i and j some shift below the period brings both into the cover, so two
equal spans of anchor + period - 1 lines or more share an anchor at the same offset. Only windows of `least` lines
around an anchor that two texts share are hashed in full (the extension), and those found in two texts are shared.
"""

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm.hashing import Memo, U, blocks, flat_hashes, windows
from keyloom.operators.ids import numbered
from keyloom.store import discard, written


def difference_cover(period: int) -> list[int]:
    """A smallest set of residues whose differences are all residues, found by search (small periods)."""
    for size in range(1, period + 1):
        for rest in combinations(range(1, period), size - 1):
            cover = (0, *rest)
            if len({(a - b) % period for a in cover for b in cover}) == period:
                return list(cover)
    raise ValueError(period)


def split_lines(text: str | None) -> list[str]:
    """Pieces at newlines; an empty last piece is no line, a null text has none."""
    lines = text.split("\n") if text else []
    if lines and not lines[-1]:
        lines.pop()
    return lines


def _anchors(anchor: int, period: int):
    cover = np.isin(np.arange(period), difference_cover(period))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo()
        for batch in batches:
            texts, keys = batch.column(1).to_pylist(), batch.column(0)
            for i, j in blocks(texts):
                name, own, pos = windows(*flat_hashes([split_lines(t) for t in texts[i:j]], memo), anchor)
                at = np.flatnonzero(cover[pos % period])
                yield pa.RecordBatch.from_arrays([pa.array(name[at].view(np.int64)), keys.slice(i, j - i).take(pa.array(own[at])), pa.array(pos[at].astype(np.int32))], ["anchor", "k", "position"])

    return run


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's lines as two independent hashes of 64 bits each."""
    memos = Memo(), Memo(seed=1)
    for batch in batches:
        texts = batch.column(1).to_pylist()
        for i, j in blocks(texts):
            pieces = [split_lines(t) for t in texts[i:j]]
            (h1, sizes), (h2, _) = (flat_hashes(pieces, m) for m in memos)
            raw, ends = np.stack([h1, h2], 1).astype("<u8").tobytes(), np.cumsum(sizes) * 16
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([raw[e - 16 * n : e] for e, n in zip(ends, sizes)], pa.binary())], ["k", "lines"])


def _spans(anchor: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lines, hits = batch.column("lines").to_pylist(), batch.column("hits").to_pylist()
            sizes = np.fromiter(map(len, lines), np.int64, len(lines)) // 16
            both, starts = np.frombuffer(b"".join(lines), "<u8").astype(U).reshape(-1, 2), np.cumsum(sizes) - sizes
            h = np.ascontiguousarray(both[:, 0])
            marks = np.zeros(len(h) + 1, np.int64)
            at = np.repeat(starts, [len(x) for x in hits]) + np.fromiter((p for x in hits for p in x), np.int64)
            marks[at + 1] = 1
            marks = np.cumsum(marks)
            s1, own, pos = windows(h, sizes, least, 1)
            s2, _, _ = windows(np.ascontiguousarray(both[:, 1]), sizes, least, 2)
            at = starts[own] + pos
            near = np.flatnonzero(marks[at + least - anchor + 1] > marks[at])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (s1[near].view(np.int64), s2[near].view(np.int64))] + [batch.column("k").take(pa.array(own[near])), pa.array(pos[near].astype(np.int32))], ["s1", "s2", "k", "position"])

    return run


def _runs(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1).to_pylist()
            own = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
            flat = np.fromiter((p for x in lists for p in x), np.int64, len(own))
            new = np.ones(len(flat), bool)
            new[1:] = (own[1:] != own[:-1]) | (flat[1:] > flat[:-1] + least)
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(flat)) - 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(own[first])), pa.array(flat[first].astype(np.int32)), pa.array((flat[last] + least - flat[first]).astype(np.int32))], ["k", "first_line", "n_lines"]
            )

    return run


def shared_regions(texts: DataFrame, key: str, text: str, least: int = 10, anchor: int = 4, period: int = 7) -> DataFrame:
    """(key, first_line, n_lines): each maximal run of lines of a text that lie in `least` or more successive lines found in another key's text.

    Byte for byte; lines count from 0. anchor + period - 1 <= least makes the anchors complete. Null keys and texts have no
    regions, repeated rows of a key count once, texts of one key do not share with each other, other columns are not read.
    A span is shared if the smallest and the largest key that hold it differ: an aggregate combined on the map
    side, so however often a span occurs, no pairs are formed and no group is gathered; the joins back are semi-joins
    against unique spans, which adaptive execution splits where one is hot.

    Texts are de-duplicated by key once and stored under numbers of their keys. Only the lines of texts with a shared anchor are
    hashed, and spans are compared by 128 bits from two independent hashes of their lines.
    """
    if anchor + period - 1 > least:
        raise ValueError("the anchors would miss spans of the least length")
    named = texts.select(F.col(key).alias("key"), F.col(text).alias("text")).filter("key is not null and text is not null")
    # one exchange: the join keeps the partitioning by key
    single = named.dropDuplicates(["key"])
    names = numbered(named, "key", "k")
    rows = written(single.join(names.hint("merge"), "key").select("k", "text"), "texts")

    def held_twice(df: DataFrame, *by: str) -> DataFrame:
        return df.groupBy(*by).agg(F.min("k").alias("lo"), F.max("k").alias("hi")).filter("lo < hi").select(*by)

    anchors = written(rows.mapInArrow(_anchors(anchor, period), "anchor bigint, k bigint, position int"), "anchors")
    hits = written(anchors.join(held_twice(anchors, "anchor").hint("merge"), "anchor", "left_semi").groupBy("k").agg(F.collect_set("position").alias("hits")), "hits")
    discard(anchors)
    lines = rows.join(hits.select("k").hint("merge"), "k", "left_semi").mapInArrow(_lines, "k bigint, lines binary")
    spans = written(lines.join(hits.hint("merge"), "k").mapInArrow(_spans(anchor, least), "s1 bigint, s2 bigint, k bigint, position int"), "spans")
    for done in (rows, hits):
        discard(done)
    common = spans.join(held_twice(spans, "s1", "s2").hint("merge"), ["s1", "s2"], "left_semi")
    positions = common.groupBy("k").agg(F.sort_array(F.collect_set("position")).alias("p"))  # as many as the text has lines at most
    found = positions.mapInArrow(_runs(least), "k bigint, first_line int, n_lines int")
    return names.hint("merge").join(found, "k").select("key", "first_line", "n_lines")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """fn, first_line, n_lines: the shared regions of each function."""
    found = shared_regions(spark.read.parquet(f"{d}/code_functions.parquet"), "hash", "contents")
    return found.select(F.lower(F.hex("key")).alias("fn"), "first_line", "n_lines")


def p4_shares(spark: SparkSession, d: str) -> DataFrame:
    """fn, n_shared, n_lines: shared lines and all lines of each function (0 shared if it has none)."""
    fns = spark.read.parquet(f"{d}/code_functions.parquet").filter("hash is not null and contents is not null")
    pieces = F.split("contents", "\n")
    total = fns.groupBy(F.lower(F.hex("hash")).alias("fn")).agg(F.max(F.size(pieces) - F.when(F.element_at(pieces, -1) == "", 1).otherwise(0)).cast("bigint").alias("n_lines"))
    got = p4_found(spark, d).groupBy("fn").agg(F.sum("n_lines").alias("n_shared"))
    return total.join(got, "fn", "left").select("fn", F.coalesce("n_shared", F.lit(0)).cast("bigint").alias("n_shared"), "n_lines")


_REGIONS = r"""
WITH f AS (SELECT lower(hex(hash)) AS fn, any_value(contents) AS c FROM code_functions WHERE hash IS NOT NULL AND contents IS NOT NULL GROUP BY 1),
s AS (SELECT fn, CASE WHEN p[-1] = '' THEN p[:-2] ELSE p END AS p FROM (SELECT fn, string_split(c, chr(10)) AS p FROM f)),
w AS (SELECT fn, i - 1 AS i, sha1(array_to_string(p[i : i + 9], chr(10))) AS w FROM (SELECT fn, p, unnest(range(1, len(p) - 8)) AS i FROM s)),
g AS (SELECT w FROM w GROUP BY w HAVING min(fn) < max(fn)),
h AS (SELECT DISTINCT fn, i FROM w SEMI JOIN g USING (w)),
l AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY fn ORDER BY i) <= 10 THEN 0 ELSE 1 END AS new FROM h),
r AS (SELECT *, sum(new) OVER (PARTITION BY fn ORDER BY i) AS r FROM l),
regions AS (SELECT fn, min(i)::INTEGER AS first_line, (max(i) + 10 - min(i))::INTEGER AS n_lines FROM r GROUP BY fn, r.r)
"""
QUERIES = {"p4_found": p4_found, "p4_shares": p4_shares}
SQL = {
    "p4_found": _REGIONS + "SELECT fn, first_line, n_lines FROM regions",
    "p4_shares": _REGIONS + "SELECT s.fn, coalesce(sum(n_lines), 0)::BIGINT AS n_shared, any_value(len(s.p))::BIGINT AS n_lines FROM s LEFT JOIN regions r ON s.fn = r.fn GROUP BY s.fn",
}
