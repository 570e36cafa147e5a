"""Problem 3: near-duplicate texts by BagMinHash signatures, banding and exact verification.

A text is the bag of its runs of `w` successive tokens. Each element carries a Poisson process over
(weight, time); a register's value is the earliest point that falls on it below the element's weight, so
two texts agree in a register with the probability of their weighted Jaccard index. The weight axis is
discretised in octaves (0,1], (1,2], (2,4] ...: one process an octave, whose points carry a level and count
only up to the weight. Points are drawn in ascending time and only as far as a register can still take
them, so a signature costs n + m log m points instead of n m.
"""

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm.hashing import Memo, U, blocks, flat_hashes, mix, windows
from keyloom.operators.skew import spread
from keyloom.store import discard, written

TOKEN = re.compile(r"[A-Za-z0-9_]+")
ELEMENT_BITS, ELEMENT_BYTES, MASK = 48, 6, (1 << 64) - 1


def bags(texts: list, memo: Memo, w: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(element, text, count): the distinct runs of w tokens of each text, ordered by text and element. A null text has none."""
    h, sizes = flat_hashes([TOKEN.findall(t) if t else [] for t in texts], memo)
    run, owner, _ = windows(h, sizes, w)
    key = np.sort((owner.astype(U) << U(ELEMENT_BITS)) | (run >> U(64 - ELEMENT_BITS)))
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    count = np.diff(np.append(first, len(key)))
    key = key[first]
    return key & U((1 << ELEMENT_BITS) - 1), (key >> U(ELEMENT_BITS)).astype(np.int64), count


def bagminhash(element: np.ndarray, owner: np.ndarray, weight: np.ndarray, n_owners: int, m: int) -> np.ndarray:
    """Signatures (n_owners, m) of uint64; rows of owners without elements are 0."""
    ids, who, rate, cut = [], [], [], []
    top = float(weight.max(initial=0))
    low, high, octave = 0.0, 1.0, 0
    while low < top:
        at = np.flatnonzero(weight > low)
        ids.append(mix(element[at] ^ U((octave + 1) * 0x9E3779B97F4A7C15 & MASK)))
        who.append(owner[at])
        rate.append(np.full(len(at), high - low))
        cut.append(np.minimum(1.0, (weight[at] - low) / (high - low)))
        low, high, octave = high, high * 2, octave + 1
    sig, best = np.zeros(n_owners * m, U), np.full(n_owners * m, np.inf)
    if not ids:
        return sig.reshape(n_owners, m)
    ids, who, rate, cut = map(np.concatenate, (ids, who, rate, cut))
    mass = np.bincount(who, rate * cut, n_owners)
    margin = np.full(n_owners, 3.0)
    todo = mass > 0
    while todo.any():
        limit = np.where(todo, (np.log(m) + margin) / np.maximum(mass, 1e-300), -1.0)
        act = np.flatnonzero(todo[who])
        time, k = np.zeros(len(act)), 0
        slots, times, marks = [], [], []
        while len(act):
            u = mix(ids[act] + U((k + 1) * 0xD1342543DE82EF95 & MASK))
            time = time - np.log(((u >> U(11)).astype(np.float64) + 1.0) * 2.0**-53) / (rate[act] * m)
            live = time <= limit[who[act]]
            act, time, u = act[live], time[live], u[live]
            v = mix(u ^ U(0xA0761D6478BD642F))
            take = (v >> U(32)).astype(np.float64) * 2.0**-32 < cut[act] if (cut[act] < 1).any() else slice(None)
            slots.append((who[act] * m + ((v & U(0xFFFFFFFF)) * U(m) >> U(32)).astype(np.int64))[take])
            times.append(time[take])
            marks.append(u[take])
            k += 1
        slots, times, marks = map(np.concatenate, (slots, times, marks))
        np.minimum.at(best, slots, times)
        won = best[slots] == times
        sig[slots[won]] = marks[won]
        # an owner with an empty register looks further; its earlier points come again and change nothing
        todo &= np.isinf(best.reshape(n_owners, m)).any(axis=1)
        margin[todo] += 6.0
    return sig.reshape(n_owners, m)


def fingerprints(element: np.ndarray, owner: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """A name of 128 bits (two columns) of each owner's bag: equal bags, equal names."""
    fp = np.zeros((n, 2), U)
    for k, odd in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)):
        part = np.zeros(n, U)
        np.add.at(part, owner, mix(mix(element * U(2 * k + 3)) + weight.astype(U) * U(odd)))
        fp[:, k] = mix(part)
    return fp


def names(fp: np.ndarray) -> pa.Array:
    """The fingerprints as binaries of 16 bytes."""
    return pa.Array.from_buffers(pa.binary(16), len(fp), [None, pa.py_buffer(np.ascontiguousarray(fp).tobytes())]).cast(pa.binary())


def packed(element: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(element.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :ELEMENT_BYTES]


def unpacked(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // ELEMENT_BYTES, 8), np.uint8)
    out[:, :ELEMENT_BYTES] = np.frombuffer(raw, np.uint8).reshape(-1, ELEMENT_BYTES)
    return out.view("<u8").ravel()


def bag_bytes(element: np.ndarray, owner: np.ndarray, count: np.ndarray, n: int, weighted: bool) -> list[bytes]:
    """Each text's sorted elements; a repeat of an element is a further element of its own if weighted."""
    if weighted:
        nth = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        element, owner = np.repeat(element, count), np.repeat(owner, count)
        element = np.where(nth > 0, mix(element + nth.astype(U) * U(0x9E3779B97F4A7C15)) >> U(64 - ELEMENT_BITS), element)
        order = np.argsort((owner.astype(U) << U(ELEMENT_BITS)) | element)
        element, owner = element[order], owner[order]
    raw, ends = packed(element), np.cumsum(np.bincount(owner, minlength=n))
    return [raw[a:b].tobytes() for a, b in zip(ends - np.bincount(owner, minlength=n), ends)]


def _sketches(w: int, m: int, rows: int, weighted: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, bands = Memo(), m // rows
        for batch in batches:
            texts, keys = batch.column(1).to_pylist(), batch.column(0)
            for i, j in blocks(texts, 1_000_000, 1024):
                el, own, cnt = bags(texts[i:j], memo, w)
                weight = cnt.astype(float) if weighted else np.ones(len(el))
                size = np.bincount(own, weight, j - i).astype(np.int64)
                fp = fingerprints(el, own, weight, j - i)
                # equal bags of a block are sketched once: copies add neither points nor bucket rows
                has = np.flatnonzero(size > 0)
                lead = has[np.unique(fp[has], axis=0, return_index=True)[1]]
                slot = np.full(j - i, -1)
                slot[lead] = np.arange(len(lead))
                keep = slot[own] >= 0
                sig = bagminhash(el[keep], slot[own][keep], weight[keep], len(lead), m)
                bucket = np.full((len(lead), bands), U(7))
                for k in range(rows):
                    bucket = mix(bucket + sig[:, k::rows][:, :bands])
                bucket = mix(bucket + np.arange(bands, dtype=U) * U(0xD6E8FEB86659FD93))
                short = (sig & U(15)).astype(np.uint8)
                short = (short[:, 0::2] << 4) | short[:, 1::2]
                low = [None] * (j - i)
                wide = [None] * (j - i)
                for x, at in enumerate(lead):
                    low[at], wide[at] = bucket[x].view(np.int64), short[x].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(i, j - i), names(fp), pa.array(size.astype(np.int32)), pa.array(low, pa.list_(pa.int64())), pa.array(wide, pa.binary())],
                    ["key", "bag", "size", "buckets", "short"],
                )

    return run


def sketches(texts: DataFrame, key: str, text: str, w: int = 3, m: int = 200, rows: int = 5, weighted: bool = False) -> DataFrame:
    """(key, bag, size, buckets, short) of each row; bag names the bag of the text, buckets and short are set for one row of each bag in a batch."""
    return spread(texts.select(F.col(key).alias("key"), F.col(text).alias("text"))).mapInArrow(_sketches(w, m, rows, weighted), f"key {texts.schema[key].dataType.simpleString()}, bag binary, size int, buckets array<bigint>, short binary")


def _agreement(m: int, least: float):
    """Pairs whose 4-bit registers agree as a similarity of `least` or more would, up to 4.5 standard deviations below."""
    p = least + (1 - least) / 16
    bound = m * p - 4.5 * np.sqrt(m * p * (1 - p))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, m // 2) for c in ("short_a", "short_b"))
                x = a ^ b
                same = ((x & 15) == 0).sum(axis=1) + ((x >> 4) == 0).sum(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(same >= bound))

    return run


def _bag_sets(w: int, weighted: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for i, j in blocks(texts, 1_000_000, 1024):
                el, own, cnt = bags(texts[i:j], memo, w)
                fp = fingerprints(el, own, cnt if weighted else np.ones(len(el)), j - i)
                raw = bag_bytes(el, own, cnt, j - i, weighted)
                yield pa.RecordBatch.from_arrays([names(fp), pa.array(raw, pa.binary())], ["bag", "items"])

    return run


def _verify(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sim = np.zeros(batch.num_rows)
            for k, (x, y) in enumerate(zip(batch.column("items_a").to_pylist(), batch.column("items_b").to_pylist())):
                x, y = unpacked(x), unpacked(y)
                both = len(np.intersect1d(x, y, assume_unique=True))
                sim[k] = both / (len(x) + len(y) - both)
            out = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(sim)], ["a", "b", "similarity"])
            yield out.filter(pa.array(sim >= least))

    return run


def near_duplicates(texts: DataFrame, key: str, text: str, least: float = 0.7, w: int = 3, m: int = 200, rows: int = 5, weighted: bool = False) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): key and bag of each distinct key with at least w tokens; pairs (a, b, similarity) of bags, a < b.

    Similarity is the Jaccard index of the bags (multisets if weighted, else sets); pairs have at least `least`.
    Texts with equal bags share one bag, similarity 1, and are never expanded into pairs. Null keys, null texts and texts
    of less than w tokens have no similarity and no row. Other columns, whatever their names, are not read.

    m registers in m / rows bands: at similarity 0.7 a pair is missed with probability (1 - 0.7^5)^40 = 0.0006, at 0.75
    with 0.00002. Candidates are only those whose sizes allow the similarity; 4-bit registers then drop what is 4.5
    standard deviations too different, and the elements themselves decide. No bucket is capped: the bucket join is a
    sort-merge join without further demands on its order, which adaptive execution splits where a bucket is hot, and
    copies were reduced to one row a batch before it. Bags go by names of 128 bits, elements by hashes of 48.
    """
    spark = texts.sparkSession
    base = written(sketches(texts, key, text, w, m, rows, weighted).filter("key is not null and size > 0"), "sketch")
    lead = base.filter("buckets is not null")
    rows_ = lead.select("bag", "size", F.explode("buckets").alias("bucket"))
    x = rows_.select(F.col("bag").alias("a"), F.col("size").alias("na"), "bucket")
    y = rows_.select(F.col("bag").alias("b"), F.col("size").alias("nb"), "bucket")
    fits = (F.col("a") < F.col("b")) & (F.least("na", "nb") >= F.greatest("na", "nb") * F.lit(least - 1e-9))
    candidates = x.hint("merge").join(y, "bucket").filter(fits).select("a", "b").distinct()
    shorts = lead.select("bag", "short").dropDuplicates(["bag"])
    near = (
        candidates.join(shorts.toDF("a", "short_a"), "a")
        .join(shorts.toDF("b", "short_b"), "b")
        .select("a", "b", "short_a", "short_b")
        .mapInArrow(_agreement(m, least), "a binary, b binary")
    )
    near = written(near, "near")
    wanted = near.select(F.explode(F.array("a", "b")).alias("bag")).distinct()
    # one text of each bag that is in a candidate pair; its elements are made again rather than kept for all texts
    holders = base.join(wanted, "bag", "left_semi").groupBy("bag").agg(F.min("key").alias("key"))
    again = texts.select(F.col(key).alias("key"), F.col(text).alias("text")).join(holders.select("key").distinct(), "key", "left_semi").filter("text is not null")
    items = again.mapInArrow(_bag_sets(w, weighted), "bag binary, items binary").dropDuplicates(["bag"])
    pairs = (
        near.join(items.toDF("a", "items_a"), "a")
        .join(items.toDF("b", "items_b"), "b")
        .select("a", "b", "items_a", "items_b")
        .mapInArrow(_verify(least - 1e-12), "a binary, b binary, similarity double")
    )
    out = written(pairs, "pairs")
    discard(near)
    return base.select("key", "bag").distinct(), out


def key_pairs(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(key_a, key_b, similarity), key_a < key_b: bag pairs expanded to their keys, and the keys of one bag among themselves."""
    a, b = members.toDF("ka", "a"), members.toDF("kb", "b")
    across = pairs.join(a, "a").join(b, "b").select("ka", "kb", "similarity")
    within = a.join(b, F.col("a") == F.col("b")).filter("ka < kb").select("ka", "kb", F.lit(1.0).alias("similarity"))
    return across.unionByName(within).select(F.least("ka", "kb").alias("key_a"), F.greatest("ka", "kb").alias("key_b"), "similarity")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """fn_a, fn_b: functions with different hashes and a similarity of at least 0.7."""
    found = key_pairs(*near_duplicates(spark.read.parquet(f"{d}/code_functions.parquet"), "hash", "contents"))
    return found.select(F.lower(F.hex("key_a")).alias("fn_a"), F.lower(F.hex("key_b")).alias("fn_b"))


def p3_classes(spark: SparkSession, d: str) -> DataFrame:
    """fn, class_fn, n_links: for each function the smallest function of its bag and the number of other bags similar as multisets (0.8)."""
    members, pairs = near_duplicates(spark.read.parquet(f"{d}/code_functions.parquet"), "hash", "contents", 0.8, weighted=True)
    links = pairs.select(F.explode(F.array("a", "b")).alias("bag")).groupBy("bag").agg(F.count(F.lit(1)).alias("n_links"))
    heads = members.groupBy("bag").agg(F.min("key").alias("head")).join(links, "bag", "left")
    out = members.join(heads, "bag")
    return out.select(F.lower(F.hex("key")).alias("fn"), F.lower(F.hex("head")).alias("class_fn"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))


QUERIES = {"p3_found": p3_found, "p3_classes": p3_classes}
SQL = {
    "p3_classes": r"""
WITH f AS (SELECT lower(hex(hash)) AS fn, any_value(contents) AS c FROM code_functions WHERE hash IS NOT NULL AND contents IS NOT NULL GROUP BY 1),
t AS (SELECT fn, regexp_extract_all(c, '[A-Za-z0-9_]+') AS t FROM f),
e AS (SELECT fn, e, count(*) AS k FROM (SELECT fn, t[i] || ' ' || t[i + 1] || ' ' || t[i + 2] AS e FROM (SELECT fn, t, unnest(range(1, len(t) - 1)) AS i FROM t)) GROUP BY fn, e),
bags AS (SELECT fn, md5(string_agg(e || ' ' || k, '|' ORDER BY e)) AS bag, sum(k) AS n FROM e GROUP BY fn),
heads AS (SELECT bag, min(fn) AS class_fn, any_value(n) AS n FROM bags GROUP BY bag),
h AS (SELECT e.* FROM e JOIN heads ON fn = class_fn),
p AS (SELECT x.fn AS a, y.fn AS b, sum(least(x.k, y.k)) AS k FROM h x JOIN h y ON x.e = y.e AND x.fn <> y.fn GROUP BY 1, 2),
links AS (SELECT a, count(*) AS n_links FROM p JOIN heads u ON u.class_fn = a JOIN heads v ON v.class_fn = b WHERE k >= 0.8 * (u.n + v.n - k) GROUP BY a)
SELECT fn, class_fn, coalesce(n_links, 0)::BIGINT AS n_links FROM bags JOIN heads USING (bag) LEFT JOIN links ON a = class_fn""",
    "p3_found": r"""
WITH f AS (SELECT lower(hex(hash)) AS fn, any_value(contents) AS c FROM code_functions WHERE hash IS NOT NULL AND contents IS NOT NULL GROUP BY 1),
t AS (SELECT fn, regexp_extract_all(c, '[A-Za-z0-9_]+') AS t FROM f),
e AS (SELECT DISTINCT fn, t[i] || ' ' || t[i + 1] || ' ' || t[i + 2] AS e FROM (SELECT fn, t, unnest(range(1, len(t) - 1)) AS i FROM t)),
n AS (SELECT fn, count(*) AS n FROM e GROUP BY fn),
p AS (SELECT x.fn AS fn_a, y.fn AS fn_b, count(*) AS k FROM e x JOIN e y ON x.e = y.e AND x.fn < y.fn GROUP BY 1, 2)
SELECT fn_a, fn_b FROM p JOIN n a ON a.fn = fn_a JOIN n b ON b.fn = fn_b WHERE k >= 0.7 * (a.n + b.n - k)"""
}
