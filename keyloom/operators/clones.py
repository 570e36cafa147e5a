"""Colliding snippets to clones: pairs, popular hashes, stitching, filtering, occurrences, groups."""

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.functions import text as T
from keyloom.operators.ids import numbered
from keyloom.operators.skew import SMALL_BYTES, lookup_join
from keyloom.store import discard, stored_bytes, written

POPULAR = 500
MAX_GAP = 10


def _rank() -> Column:
    """Clone type and position of a snippet in one long; what is null comes last."""
    return F.shiftleft(F.coalesce("clone_type", F.lit((1 << 31) - 1)).cast("bigint"), 32) + F.coalesce("position", F.lit((1 << 31) - 1))


def collisions(snippets: DataFrame) -> DataFrame:
    """One snippet for each (hash, function), the lowest by clone type and position, with n, the functions that share its hash (two or more).

    De-duplicated once, by a hash aggregate over one long, and stored. The count is an aggregate of the distinct (hash, function)
    pairs and joins back as a lookup, so a hash that a third of all rows carry is never gathered. Null hashes and functions
    collide with nothing; a null type or position comes last.
    """
    kept = snippets.filter("hash is not null and function is not null")
    one = written(kept.groupBy("hash", "function").agg(F.min(_rank()).alias("rank")), "one")
    parts = one.select("hash", "function", F.shiftright("rank", 32).cast("int").alias("clone_type"), F.col("rank").bitwiseAND((1 << 32) - 1).cast("int").alias("position"))
    counts = one.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return lookup_join(parts, counts, "hash", "inner", big_bytes=stored_bytes(one))


def coded(colliding: DataFrame, signed: bool = False) -> tuple[DataFrame, DataFrame]:
    """(colliding with numbers for hashes and functions, names): what follows compares longs. names: (function, i).

    Numbers ascend as the keys do, so all orders stay what they are; signed numbers functions in the order of signed bytes.
    """
    colliding = written(colliding, "colliding")
    size = stored_bytes(colliding)
    names = numbered(colliding, "function", by=T.signed_order(F.col("function")) if signed else None)
    hashes = numbered(colliding, "hash", "h")
    out = lookup_join(colliding, names, "function", "inner", big_bytes=size).select("hash", F.col("i").alias("function"), "position", "n")
    return lookup_join(out, hashes, "hash", "inner", big_bytes=size).select(F.col("h").alias("hash"), "function", "position", "n"), names


def named(clones: DataFrame, names: DataFrame, *sides: str) -> DataFrame:
    """Numbers of functions turned back into their keys."""
    for side in sides or ("this_function", "that_function"):
        clones = clones.join(names.toDF("__key", side), side).withColumn(side, F.col("__key")).drop("__key")
    return clones


def popular_snippets(colliding: DataFrame, threshold: int = POPULAR) -> DataFrame:
    """Snippets whose hash is shared by `threshold` functions or more: they do not enter the quadratic join."""
    return colliding.filter(F.col("n") >= threshold)


def _ordered(df: DataFrame, signed: bool) -> DataFrame:
    """A column o by which functions are compared, made before the join and not for each pair."""
    return df.withColumn("o", T.signed_order(F.col("function")) if signed else F.col("function"))


def rough_pairs(colliding: DataFrame, threshold: int = POPULAR, signed: bool = False) -> DataFrame:
    """(this_function, that_function, this_position, that_position, hash): matches of rare hashes, this before that.

    A hash has fewer than `threshold` functions here, so no key is hot. One match is kept for each (this, that,
    this_position): that of the lowest hash. signed orders functions by signed bytes.
    """
    rare = _ordered(colliding.filter(F.col("n") < threshold).select("hash", "function", "position"), signed)
    a, b = rare.toDF("hash", "this_function", "this_position", "this_o"), rare.toDF("hash", "that_function", "that_position", "that_o")
    pairs = a.join(b, "hash").filter("this_o < that_o")
    keep = pairs.groupBy("this_function", "that_function", "this_position").agg(F.min_by("that_position", "hash").alias("that_position"), F.min("hash").alias("hash"))
    return keep.select("this_function", "that_function", "this_position", "that_position", "hash")


def woven_pairs(rough: DataFrame, popular: DataFrame, signed: bool = False) -> DataFrame:
    """Matches over popular hashes, for functions that have a rough match as `this` already.

    The matches of the reference, all of them: their number is the product of the two sides of a popular hash, so the
    functions with rough matches come first (a semi-join), and the join is salted over the other side by the
    optimiser's skew handling.
    """
    mine = popular.join(rough.select(F.col("this_function").alias("function")).distinct(), "function", "left_semi")
    a = _ordered(mine, signed).select("hash", F.col("function").alias("this_function"), F.col("position").alias("this_position"), F.col("o").alias("this_o"))
    b = _ordered(popular, signed).select("hash", F.col("function").alias("that_function"), F.col("position").alias("that_position"), F.col("o").alias("that_o"))
    return a.join(b, "hash").filter("this_o < that_o").select("this_function", "that_function", "this_position", "that_position", "hash")


def all_matches(colliding: DataFrame, threshold: int = POPULAR, signed: bool = False) -> DataFrame:
    """The matches of rare hashes and, woven in, those of popular ones, with woven: 0 for the latter and 1 for the former.

    The reference weaves them in before it stitches: at one (that_function, this_position) a woven match comes first. The
    number of woven matches grows as the square of a popular hash's functions; none is left out.
    """
    colliding = written(colliding, "colliding")
    rough = written(rough_pairs(colliding, threshold, signed), "rough")
    woven = woven_pairs(rough, popular_snippets(colliding, threshold), signed)
    return rough.withColumn("woven", F.lit(1)).unionByName(woven.withColumn("woven", F.lit(0)))


def passes(matches: list[tuple]) -> Iterator[tuple]:
    """(that_function, this_position, this_length, that_position, that_length, ended) of each clone of one function's matches.

    matches: (that_function, this_position, that_position) in the order of function and position. A pass opens a clone at the first
    match left and takes in what follows within MAX_GAP on both sides; a match within the gap on this side only is left for
    a later pass, though the gap is then measured from it; a larger gap ends the pass (ended); another function opens the next
    clone.
    """
    left, grown = list(matches), T.MINIMUM_LINES - 1
    while left:
        rest, clone, last, ended = [], None, None, False
        for k, cur in enumerate(left):
            if clone is None or cur[0] != last[0]:
                if clone is not None:
                    yield clone[0], clone[1], clone[2] + grown, clone[3], clone[4] + grown, False
                clone, last = [cur[0], cur[1], 1, cur[2], 1], cur
                continue
            if cur[1] - last[1] > MAX_GAP:
                rest += left[k:]
                ended = True
                break
            if abs(cur[2] - last[2]) <= MAX_GAP:
                clone[2] = cur[1] - clone[1] + 1
                clone[3] = min(clone[3], cur[2])
                clone[4] = max(clone[4], cur[2] - clone[3] + 1)
            else:
                rest.append(cur)
            last = cur
        yield clone[0], clone[1], clone[2] + grown, clone[3], clone[4] + grown, ended
        left = rest


def stitch(matches: list[tuple]) -> list[tuple]:
    """The clones of passes(), in order, without what ended them."""
    return [c[:5] for c in passes(matches)]


def _groups(this: pa.Array, that: pa.Array) -> np.ndarray:
    """Whether each row begins another pair of functions."""
    new = np.ones(len(this), bool)
    for c in (this, that):
        part = pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
        new[1:] = part if c is this else new[1:] | part
    return new


def _stitched(this: pa.Array, that: pa.Array, p: np.ndarray, q: np.ndarray) -> pa.RecordBatch:
    """The clones of whole pairs of functions, from their sorted matches.

    Runs of matches that are near each other on both sides are clones as they are, by array operations; only pairs in which a match is
    near on one side alone go through the rule step by step.
    """
    n = len(p)
    new = _groups(this, that)
    group = np.cumsum(new) - 1
    far, off = np.zeros(n, bool), np.zeros(n, bool)
    far[1:] = ~new[1:] & (p[1:] - p[:-1] > MAX_GAP)
    off[1:] = ~new[1:] & ~far[1:] & (np.abs(q[1:] - q[:-1]) > MAX_GAP)
    hard = np.bincount(group, off, group[-1] + 1) > 0
    run = np.cumsum(new | far) - 1
    first = np.flatnonzero(new | far)
    last = np.append(first[1:], n) - 1
    step = np.int64(1) << 33
    low = np.minimum.accumulate(q - run * step) + run * step  # begins anew with each run
    reach = np.maximum.reduceat(q - low, first) + 1
    easy = ~hard[group[first]]
    grown = T.MINIMUM_LINES - 1
    nth = np.arange(len(first)) - np.flatnonzero(new[first])[group[first]]
    ended = np.append(far[first[1:]], False)
    parts = [(first[easy], nth[easy], p[first][easy], (p[last] - p[first])[easy] + 1 + grown, low[last][easy], reach[easy] + grown, ended[easy])]
    starts = np.append(np.flatnonzero(new), n)
    rows = []
    for g in np.flatnonzero(hard).tolist():
        a, b = int(starts[g]), int(starts[g + 1])
        rows += [(a, k, *c[1:]) for k, c in enumerate(passes(list(zip([0] * (b - a), p[a:b].tolist(), q[a:b].tolist()))))]
    if rows:
        parts.append(tuple(np.array(x, np.int64) for x in zip(*rows)))
    at, *rest, ended = (np.concatenate(x) for x in zip(*parts))
    pick = pa.array(at)
    return pa.RecordBatch.from_arrays([this.take(pick), that.take(pick), *(pa.array(x.astype(np.int32)) for x in rest), pa.array(ended.astype(bool))], ["this_function", "that_function", "nth", "this_position", "this_length", "that_position", "that_length", "ended"])


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted matches, batch by batch; the last pair of a batch waits for the next one."""
    held: list[pa.RecordBatch] = []

    def stitched(parts: list[pa.RecordBatch], end: int | None = None) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        t = t.slice(0, end) if end is not None else t
        return _stitched(t.column(0), t.column(1), *(t.column(k).to_numpy().astype(np.int64) for k in (2, 3)))

    for batch in batches:
        if not batch.num_rows:
            continue
        begins = np.flatnonzero(_groups(batch.column(0), batch.column(1)))
        same = held and all(held[-1].column(k)[held[-1].num_rows - 1] == batch.column(k)[0] for k in (0, 1))
        if same and len(begins) == 1:
            held.append(batch)
            continue
        cut = int(begins[-1])
        ready = [*held, batch.slice(0, cut)] if cut else held
        if ready:
            yield stitched(ready)
        held = [batch.slice(cut)]
    if held:
        yield stitched(held)


def expand(matches: DataFrame) -> DataFrame:
    """Matches stitched to clones, numbered (nth) within each pair of functions; ended tells whether a gap ended the pass there.

    The rule never carries anything from one that_function to the next, so pairs of functions are kept whole by one exchange, sorted
    (which spills), and streamed through arrays in batches of many pairs: a function that matches very many others is
    spread over all tasks. In memory at once: the matches of one pair.
    """
    kind = matches.schema["this_function"].dataType.simpleString()
    order = ["this_function", "that_function", "this_position", *(["woven"] if "woven" in matches.columns else []), "hash"]
    ordered = matches.repartition("this_function", "that_function").sortWithinPartitions(*order).select("this_function", "that_function", "this_position", "that_position")
    return ordered.mapInArrow(_expand, f"this_function {kind}, that_function {kind}, nth int, this_position int, this_length int, that_position int, that_length int, ended boolean")


@dataclass(frozen=True)
class CloneClasses:
    """All clones in a form whose size does not grow with the functions of a popular hash.

    Functions with the same popular snippets (hash and position) are a class. members: (function, class, first), first telling whether the function
    may be the first of a pair (it has a rough match as such). of_classes: the clones of pairs of classes, columns as in expand(). of_pairs: the
    clones of pairs of functions that have a rough match with each other, which are no case for their classes; pairs: these pairs. The clones
    of two functions that are no pair are those of their classes.
    """

    members: DataFrame
    of_classes: DataFrame
    of_pairs: DataFrame
    pairs: DataFrame

    def expanded(self) -> DataFrame:
        """Every clone of every two functions, this before that: as many rows as there are."""
        this = self.members.filter("first").select(F.col("function").alias("f"), F.col("class").alias("this_function"))
        that = self.members.select(F.col("function").alias("g"), F.col("class").alias("that_function"))
        each = self.of_classes.join(this, "this_function").join(that, "that_function").filter("f < g").withColumn("this_function", F.col("f")).withColumn("that_function", F.col("g")).select(*self.of_pairs.columns)
        return self.of_pairs.unionByName(each.join(self.pairs, ["this_function", "that_function"], "left_anti"))


def class_members(snippets: DataFrame, threshold: int = POPULAR) -> DataFrame:
    """(function, class_function, first): the members of clone_classes() by the smallest function of their class, from the snippets alone.

    No match is made, so the work is in proportion to the snippets. A function may come first if a later one shares a rare hash with it: if it has
    more rare hashes than those whose last function it is. That needs three counts, which one exchange of the distinct (hash, function) serves,
    and no join. Popular snippets are then read once more, by their hashes.
    """
    threshold = max(threshold, 2)  # a hash of one function collides with nothing
    kept = snippets.filter("hash is not null and function is not null")
    one = kept.select("hash", "function").distinct()
    counts = one.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.max("function").alias("last"))
    none = F.lit(None).cast(kept.schema["hash"].dataType).alias("hash")
    hot = counts.filter(F.col("n") >= threshold).select("hash", F.col("last").alias("function"), "n")
    lasts = counts.filter(F.col("n") < threshold).groupBy("last").agg((-F.count(F.lit(1))).alias("n")).select(none, F.col("last").alias("function"), "n")
    held = one.groupBy("function").agg(F.count(F.lit(1)).alias("n")).select(none, "function", "n")
    sums = written(hot.unionByName(lasts).unionByName(held), "sums")
    hot = sums.filter("hash is not null").select("hash")
    popular = kept.join(F.broadcast(hot) if stored_bytes(sums) <= SMALL_BYTES // 8 else hot, "hash")
    one = popular.groupBy("hash", "function").agg(F.min(_rank()).alias("rank"))
    # a function has one snippet for each of its hashes, so a profile is no longer than its text
    profile = F.sort_array(F.collect_list(F.struct("hash", F.col("rank").bitwiseAND((1 << 32) - 1).alias("position")))).alias("profile")
    profiles = written(one.groupBy("function").agg(profile), "profiles")
    heads = profiles.groupBy("profile").agg(F.min("function").alias("class_function"))
    rare = sums.filter("hash is null").groupBy("function").agg(F.sum("n").alias("rest"))
    first = (F.col("rest") > F.size("profile")).alias("first")
    return profiles.join(rare, "function").join(heads, "profile").select("function", "class_function", first)


def clone_classes(colliding: DataFrame, threshold: int = POPULAR) -> CloneClasses:
    """The clones of all_matches(), stitched once for each pair of classes instead of each pair of functions.

    A pair of functions without a rough match has only woven ones, and these follow from the popular snippets of both, so from their classes. Hashes,
    functions of `colliding` as coded() gives them.
    """
    colliding = written(colliding, "colliding")
    rough = written(rough_pairs(colliding, threshold), "rough")
    popular = popular_snippets(colliding, threshold).select("function", "hash", "position")
    # a function has one snippet for each of its hashes, so a profile is no longer than its text
    profiles = written(popular.groupBy("function").agg(F.sort_array(F.collect_list(F.struct("hash", "position"))).alias("profile")), "profiles")
    names = numbered(profiles, "profile", "class")
    starts = rough.select(F.col("this_function").alias("function"), F.lit(True).alias("first")).distinct()
    members = profiles.join(names, "profile").select("function", "class").join(starts, "function", "left").withColumn("first", F.coalesce("first", F.lit(False)))
    members = written(members, "members")
    discard(profiles)
    reach = members.groupBy("class").agg(F.min(F.when(F.col("first"), F.col("function"))).alias("low"), F.max("function").alias("high"))
    held = names.select("class", F.explode("profile").alias("s")).select("class", "s.hash", "s.position").join(reach, "class")
    a = held.filter("low is not null").select("hash", F.col("class").alias("this_function"), F.col("position").alias("this_position"), "low")
    b = held.select("hash", F.col("class").alias("that_function"), F.col("position").alias("that_position"), "high")
    between = a.join(b, "hash").filter("low < high").select("this_function", "that_function", "this_position", "that_position", "hash")
    of_classes = expand(between.withColumn("woven", F.lit(0)))
    pairs = written(rough.select("this_function", "that_function").distinct(), "pairs")
    both = pairs.join(members.select(F.col("function").alias("this_function"), F.col("class").alias("x")), "this_function").join(members.select(F.col("function").alias("that_function"), F.col("class").alias("y")), "that_function")
    mine, yours = (names.select(F.col("class").alias(c), F.col("profile").alias(f"p{c}")) for c in ("x", "y"))
    # the woven matches of a pair: the hashes that both profiles hold, by two maps no larger than the profiles
    met = both.select("x", "y").distinct().join(mine, "x").join(yours, "y")
    at = F.map_from_entries("py")
    shared = met.select("x", "y", F.filter(F.transform("px", lambda s: F.struct(s["hash"].alias("hash"), s["position"].alias("p"), F.element_at(at, s["hash"]).alias("q"))), lambda s: s["q"].isNotNull()).alias("m")).filter(F.size("m") > 0)
    woven = both.join(shared, ["x", "y"]).select("this_function", "that_function", F.explode("m").alias("m")).select("this_function", "that_function", F.col("m.p").alias("this_position"), F.col("m.q").alias("that_position"), F.col("m.hash").alias("hash"))
    of_pairs = expand(rough.withColumn("woven", F.lit(1)).unionByName(woven.withColumn("woven", F.lit(0))))
    return CloneClasses(members, written(of_classes, "class_clones"), written(of_pairs, "pair_clones"), pairs)


def _sequence(pdf: pd.DataFrame) -> pd.DataFrame:
    """seq: the order in which the reference's passes over one function emit its clones."""
    ended = pdf["ended"].to_dict()
    queues = [list(g.index) for _, g in pdf.sort_values(["that_function", "nth"]).groupby("that_function", sort=True)]
    order: list[int] = []
    while queues:
        rest = []
        for k, queue in enumerate(queues):
            order.append(queue[0])
            rest.append(queue[1:])
            if ended[queue[0]]:
                rest += queues[k + 1 :]
                break
        queues = [q for q in rest if q]
    out = pdf.loc[order].reset_index(drop=True)
    out["seq"] = np.arange(len(out), dtype=np.int32)
    return out


def window_vocabularies(windows: DataFrame, strings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((function, position, length, v), (v, words)): the vocabulary of each window of lines, cut from the raw text, and each vocabulary once.

    The windows are cut by the positions in the normal form, clamped to the text's end. Windows of unknown functions have none.
    """
    parts = strings.filter("hash is not null and contents is not null").groupBy("hash").agg(F.min("contents").alias("contents")).select(F.col("hash").alias("function"), T.lines(F.col("contents")).alias("lines"))
    text = F.array_join(F.slice("lines", F.col("position") + 1, F.col("length")), "\n")
    cut = written(windows.join(parts, "function").select("function", "position", "length", F.array_sort(T.vocabulary(text)).alias("words")), "windows")
    words = numbered(cut, "words", "v")
    return cut.join(words, "words").select("function", "position", "length", "v"), words.select("v", "words")


def fine_clones(clones: DataFrame, strings: DataFrame, strict: bool = False) -> DataFrame:
    """Clones whose two texts share enough of their vocabulary.

    strings: (hash, contents), hash as in clones. Each window's vocabulary is made once, however many clones it is in, and each pair of
    vocabularies is judged once. strict drops, as the reference does, all later clones of a function once one fails.
    """
    clones = written(clones, "clones")
    sides = [clones.select(F.col(f"{s}_function").alias("function"), F.col(f"{s}_position").alias("position"), F.col(f"{s}_length").alias("length")) for s in ("this", "that")]
    windows, words = window_vocabularies(sides[0].unionByName(sides[1]).distinct(), strings)
    windows = written(windows, "vocabularies")
    both = clones
    for s in ("this", "that"):
        both = both.join(windows.toDF(f"{s}_function", f"{s}_position", f"{s}_length", f"{s}_v"), [f"{s}_function", f"{s}_position", f"{s}_length"])
    both = written(both, "clones")
    pairs = both.filter("this_v <> that_v").select(F.least("this_v", "that_v").alias("x"), F.greatest("this_v", "that_v").alias("y")).distinct()
    judged = pairs.join(words.toDF("x", "a"), "x").join(words.toDF("y", "b"), "y")
    spam = judged.filter(F.coalesce(T.vocabulary_similarity(F.col("a"), F.col("b")) < T.SPAM_BELOW, F.lit(False))).select("x", "y", F.lit(True).alias("spam"))
    keyed = both.withColumn("x", F.least("this_v", "that_v")).withColumn("y", F.greatest("this_v", "that_v")).drop("this_v", "that_v")
    if not strict:
        return keyed.join(spam, ["x", "y"], "left_anti").select(*clones.columns)
    marked = keyed.join(spam, ["x", "y"], "left").select(*clones.columns, F.coalesce("spam", F.lit(False)).alias("spam"))
    # the reference cannot go on where a text is missing; here such clones are left out before
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in marked.schema)
    numbered_ = marked.groupBy("this_function").applyInPandas(_sequence, f"{fields}, seq int")
    w = Window.partitionBy("this_function").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return numbered_.withColumn("spam", F.max("spam").over(w)).filter(~F.col("spam")).select(*clones.columns)


def occurrences(functions: DataFrame, files: DataFrame, versions: DataFrame, projects: DataFrame) -> DataFrame:
    """(function, code_file, version, project): where each function occurs, without repeats.

    functions: hash, code_file; files: hash, version; versions: hash, project; projects: hash. A missing link is no occurrence.
    """
    f = functions.select(F.col("hash").alias("function"), "code_file").distinct()
    c = files.select(F.col("hash").alias("code_file"), "version").distinct()
    v = versions.select(F.col("hash").alias("version"), "project").distinct()
    p = projects.select(F.col("hash").alias("project")).distinct()
    return f.join(c, "code_file").join(v, "version").join(p, "project").select("function", "code_file", "version", "project").filter("function is not null").distinct()


def missing_links(functions: DataFrame, files: DataFrame) -> DataFrame:
    """Functions whose file is unknown: where the reference stops with an error."""
    return functions.select("hash", "code_file").join(files.select(F.col("hash").alias("code_file")), "code_file", "left_anti")


def clone_groups(clones: DataFrame) -> DataFrame:
    """(function, grp): connected functions share the smallest one's key. Null sides link nothing.

    Functions are numbered in their order, so all rounds work on longs. Labels sink along the links and, by pointer jumping,
    along the labels themselves, so a chain of n functions takes some log n rounds; each lowers a label or is the last.
    """
    links = clones.select(F.col("this_function").alias("a"), F.col("that_function").alias("b")).filter("a is not null and b is not null").distinct()
    links = written(links, "links")
    names = numbered(links.select(F.explode(F.array("a", "b")).alias("function")), "function")
    size = stored_bytes(links)
    coded = lookup_join(links, names.toDF("a", "x"), "a", "inner", big_bytes=size)
    coded = lookup_join(coded, names.toDF("b", "y"), "b", "inner", big_bytes=size).filter("x <> y").select("x", "y")
    both = coded.unionByName(coded.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct()
    both, raw = written(both, "links"), links
    discard(raw)
    size = stored_bytes(both)
    labels = names.select("i", F.col("i").alias("g"))
    while True:
        near = lookup_join(both, labels.toDF("y", "g"), "y", "inner", big_bytes=size).groupBy("x").agg(F.min("g").alias("near"))
        sunk = labels.join(near.withColumnRenamed("x", "i"), "i", "left").select("i", "g", F.least("g", "near").alias("low"))
        jump = labels.select(F.col("i").alias("low"), F.col("g").alias("lower"))
        new = written(lookup_join(sunk, jump, "low", "left", big_bytes=size).select("i", F.least("low", "lower").alias("new"), "g"), "labels")
        changed = not new.filter("new <> g").isEmpty()
        if hasattr(labels, "stored_at"):
            discard(labels)
        labels = new.select("i", F.col("new").alias("g"))
        labels.stored_at = new.stored_at
        if not changed:
            break
    discard(both)
    of = labels.join(names, "i").select("function", "g")
    return lookup_join(of, names.toDF("grp", "g"), "g", "inner", big_bytes=size).select("function", "grp")


def group_texts(clones: DataFrame, groups: DataFrame, strings: DataFrame, strict: bool = False) -> DataFrame:
    """(grp, hash, text): the text of a group is that of its first clone's this side, named by its SHA-1.

    strict cuts it, as the reference does, with the length of the other side.
    """
    first = F.min(F.struct("this_function", "that_function", "this_position", "this_length", "that_length")).alias("c")
    heads = clones.join(groups.withColumnRenamed("function", "this_function"), "this_function").groupBy("grp").agg(first)
    texts = strings.filter("hash is not null").groupBy("hash").agg(F.min("contents").alias("contents")).select(F.col("hash").alias("this_function"), T.lines(F.col("contents")).alias("lines"))
    n = F.col("c.that_length") if strict else F.col("c.this_length")
    out = heads.withColumn("this_function", F.col("c.this_function")).join(texts, "this_function").withColumn("text", F.array_join(F.slice("lines", F.col("c.this_position") + 1, n), "\n"))
    return out.select("grp", F.sha1(F.col("text").cast("binary")).alias("hash"), "text")


def groups_by_text(texts: DataFrame) -> DataFrame:
    """(hash, text, n_groups, grp) of (grp, text): groups with equal texts are one, named by the text's SHA-1, as in the reference's store; grp is the smallest. Null texts have none."""
    return texts.filter("text is not null").groupBy(F.sha1(F.col("text").cast("binary")).alias("hash"), "text").agg(F.count(F.lit(1)).alias("n_groups"), F.min("grp").alias("grp"))


def group_occurrences(groups: DataFrame, found: DataFrame) -> DataFrame:
    """(grp, function, code_file, version, project) rows: kept long, since a group may occur more often than fits a row."""
    return groups.join(found, "function").select("grp", "function", "code_file", "version", "project")


#: Functions of one block: the marks of pairs within two blocks take FUNCTIONS_A_BLOCK ** 2 bytes at most.
FUNCTIONS_A_BLOCK, LEAST_BLOCKS, ROWS_AT_ONCE = 8_000, 8, 200_000


def _spans(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, at): for each row its places starts, starts + 1 and so on."""
    row = np.repeat(np.arange(len(counts)), counts)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts - starts, counts)


def _pieces(counts: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of rows whose counts come to about `most` each."""
    sums, a = np.cumsum(counts), 0
    while a < len(counts):
        b = max(a + 1, int(np.searchsorted(sums, (sums[a - 1] if a else 0) + most, "right")))
        yield slice(a, b)
        a = b


class _Block:
    """Functions by rank, their rare snippets and their classes: those with the same popular snippets."""

    def __init__(self, rank: np.ndarray, rows: pa.Table, by_class: bool):
        order = np.argsort(rank)
        self.rank, rows = rank[order], rows.take(pa.array(order))
        self.first = rows["first"].to_numpy()
        rare, popular = (rows[c].combine_chunks() for c in ("rare", "popular"))
        self.rare = self._flat(rare)
        self.classes, heads, members = np.empty(len(rank), np.int64), [], {}
        offsets, flat = popular.offsets.to_numpy(), popular.values
        h, p = (flat.field(k).to_numpy().astype(np.int64) for k in (0, 1))
        for i in range(len(rank)):
            a, b = offsets[i], offsets[i + 1]
            c = members.setdefault(h[a:b].tobytes() + p[a:b].tobytes() if by_class else i, len(members))
            if c == len(heads):
                heads.append(i)
            self.classes[i] = c
        heads = np.array(heads, np.int64)
        row, at = _spans(offsets[heads].astype(np.int64), (offsets[heads + 1] - offsets[heads]).astype(np.int64))
        by = np.lexsort((h[at], p[at], row))
        self.entries = row[by], h[at][by], p[at][by]  # class, hash, position, in the order of class and position
        self.n = len(heads)
        self.members = np.argsort(self.classes, kind="stable")  # by class and rank
        self.bounds = np.searchsorted(self.classes[self.members], np.arange(self.n + 1))

    @staticmethod
    def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(function, hash, position) of each snippet."""
        o = lists.offsets.to_numpy().astype(np.int64)
        f, at = _spans(o[:-1], o[1:] - o[:-1])
        return f, lists.values.field(0).to_numpy().astype(np.int64)[at], lists.values.field(1).to_numpy().astype(np.int64)[at]


def _met(h: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(by, starts, counts): where, among others put in the order `by`, each of h is."""
    by = np.argsort(others, kind="stable")
    starts = np.searchsorted(others[by], h, "left")
    return by, starts, np.searchsorted(others[by], h, "right") - starts


def _between(a: _Block, b: _Block, keys: pa.Array) -> Iterator[pa.RecordBatch]:
    """The clones of each function of a with each later one of b."""
    nb = len(b.rank)

    def rows(f, g, nth, p, n, q, k, ended) -> pa.RecordBatch:
        ints = [pa.array(x.astype(np.int32)) for x in (nth, p, n, q, k)]
        return pa.RecordBatch.from_arrays([keys.take(pa.array(a.rank[f])), keys.take(pa.array(b.rank[g])), *ints, pa.array(ended)], ["this_function", "that_function", "nth", "this_position", "this_length", "that_position", "that_length", "ended"])

    # the rough matches, of which the lowest hash stays at a place, and the pairs that have some
    f, h, p = a.rare
    g, other, q = b.rare
    by, starts, counts = _met(h, other)
    row, at = _spans(starts, counts)
    at = by[at]
    ahead = a.rank[f[row]] < b.rank[g[at]]
    row, at = row[ahead], at[ahead]
    pair, p, q, h = f[row] * nb + g[at], p[row], q[at], h[row]
    order = np.lexsort((h, p, pair))
    pair, p, q, h = (x[order] for x in (pair, p, q, h))
    keep = np.ones(len(pair), bool)
    keep[1:] = (pair[1:] != pair[:-1]) | (p[1:] != p[:-1])
    rough = tuple(x[keep] for x in (pair, p, q, h))
    pairs = np.unique(rough[0])
    marked = np.zeros(len(a.rank) * nb, bool)
    marked[pairs] = True
    # the matches of classes
    x, h, p = a.entries
    y, other, q = b.entries
    by, starts, counts = _met(h, other)
    low = np.full(a.n, np.iinfo(np.int64).max)
    np.minimum.at(low, a.classes[a.first], a.rank[a.first])
    high = np.full(b.n, -1)
    np.maximum.at(high, b.classes, b.rank)
    met = a.classes[pairs // nb] * b.n + b.classes[pairs % nb]
    order = np.argsort(met, kind="stable")
    pairs, met = pairs[order], met[order]
    ends = np.searchsorted(x, np.arange(a.n + 1))
    firsts = a.members[a.first[a.members]]
    of_firsts = np.searchsorted(a.classes[firsts], np.arange(a.n + 1))
    held, place = b.classes[b.members] * len(keys) + b.rank[b.members], b.members
    per_class = np.add.reduceat(np.append(counts, 0), ends[:-1]) * (ends[1:] > ends[:-1]) if a.n else np.zeros(0, np.int64)
    for part in _pieces(per_class, 10 * ROWS_AT_ONCE):
        e = slice(ends[part.start], ends[min(part.stop, a.n)])
        row, at = _spans(starts[e], counts[e])
        row, at = row + e.start, by[at]
        some = low[x[row]] < high[y[at]]
        row, at = row[some], at[some]
        both = x[row] * b.n + y[at]
        order = np.argsort(both, kind="stable")
        both, row, at = both[order], row[order], at[order]
        # the pairs with rough matches, each on its own
        mine = slice(*np.searchsorted(met, [part.start * b.n, part.stop * b.n]))
        for own in _pieces(np.ones(mine.stop - mine.start, np.int64), ROWS_AT_ONCE):
            some = np.arange(mine.start, mine.stop)[own]
            s = np.searchsorted(both, met[some], "left")
            r, z = _spans(s, np.searchsorted(both, met[some], "right") - s)
            which = np.sort(pairs[some])
            in_rough = np.searchsorted(rough[0], which, "left")
            r2, z2 = _spans(in_rough, np.searchsorted(rough[0], which, "right") - in_rough)
            parts = [np.concatenate(c) for c in ((pairs[some][r], rough[0][z2]), (p[row[z]], rough[1][z2]), (q[at[z]], rough[2][z2]), (np.zeros(len(z), np.int8), np.ones(len(z2), np.int8)), (h[row[z]], rough[3][z2]))]
            order = np.lexsort((parts[4], parts[3], parts[1], parts[0]))
            pr, pp, pq = (c[order] for c in parts[:3])
            c = _stitched(pa.array(pr), pa.array(pr), pp, pq)
            one, *rest, ended = (c.column(k).to_numpy(zero_copy_only=False) for k in (0, 2, 3, 4, 5, 6, 7))
            yield rows(one // nb, one % nb, *rest, ended)
        if not len(both):
            continue
        # every other pair of their functions
        c = _stitched(pa.array(both), pa.array(both), p[row], q[at])
        one, *rest, ended = (c.column(k).to_numpy(zero_copy_only=False) for k in (0, 2, 3, 4, 5, 6, 7))
        cx, cy = one // b.n, one % b.n
        for some in _pieces(of_firsts[cx + 1] - of_firsts[cx], 4 * ROWS_AT_ONCE):
            clone, at = _spans(of_firsts[cx[some]], of_firsts[cx[some] + 1] - of_firsts[cx[some]])
            clone, f = clone + some.start, firsts[at]
            begin = np.searchsorted(held, cy[clone] * len(keys) + a.rank[f], "right")
            count = b.bounds[cy[clone] + 1] - begin
            for out in _pieces(count, ROWS_AT_ONCE):
                r, at = _spans(begin[out], count[out])
                r = r + out.start
                ff, gg = f[r], place[at]
                new = ~marked[ff * nb + gg]
                of = clone[r[new]]
                if len(of):
                    yield rows(ff[new], gg[new], *(z[of] for z in rest), ended[of])


def _blocks(batches: Iterator[pa.RecordBatch], by_class: bool) -> Iterator[pa.RecordBatch]:
    """The clones of two blocks, one of them this or the other; of one block with itself."""
    got = [x for x in batches if x.num_rows]
    if not got:
        return
    t = pa.Table.from_batches(got).combine_chunks()
    keys = t["function"].combine_chunks()
    order = pc.sort_indices(keys)
    rank = np.empty(len(keys), np.int64)
    rank[order.to_numpy()] = np.arange(len(keys))
    keys, side = keys.take(order), t["block"].to_numpy()
    blocks = [_Block(rank[side == k], t.filter(pa.array(side == k)), by_class) for k in np.unique(side)]
    alone = t["alone"][0].as_py()
    for a, b in [(blocks[0], blocks[0])] if alone else [(blocks[0], blocks[1]), (blocks[1], blocks[0])] if len(blocks) == 2 else []:
        yield from _between(a, b, keys)


def block_clones(snippets: DataFrame, threshold: int = POPULAR, key: Callable[[Column], Column] = lambda c: c, by_class: bool = True) -> DataFrame:
    """The clones of every two functions, as expand(all_matches(collisions(snippets))) has them, without a row for any match.

    Functions go to blocks, each function with its snippets as one row; a task gets two blocks, so all that is exchanged or stored is the snippets,
    once for each block. The task makes the matches in arrays, those of popular hashes once for every two classes, stitches them, and gives the
    clones out as it goes. key: a form of the functions' keys that keeps their order, made once for each function. by_class=False makes and
    stitches the matches of every two functions on their own.
    """
    threshold = max(threshold, 2)
    kept = snippets.filter("hash is not null and function is not null")
    one = written(kept.groupBy("hash", "function").agg(F.min(_rank()).alias("rank")), "one")
    counts = one.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.max("function").alias("last")).filter("n > 1")
    counts = written(counts.orderBy("hash").withColumn("h", F.monotonically_increasing_id()), "counts")
    place = F.struct("h", F.col("rank").bitwiseAND((1 << 32) - 1).cast("int").alias("p"))
    found = lookup_join(one, counts.select("hash", "h", "n"), "hash", "inner", big_bytes=stored_bytes(one))
    lists = found.groupBy("function").agg(*[F.sort_array(F.collect_list(F.when(F.col("n") < threshold if c == "rare" else F.col("n") >= threshold, place))).alias(c) for c in ("rare", "popular")])
    lasts = counts.filter(F.col("n") < threshold).groupBy(F.col("last").alias("function")).agg(F.count(F.lit(1)).alias("lasts"))
    # a function that has more rare hashes than those it is the last of has a rough match as `this`
    lists = written(lists.join(lasts, "function", "left").select(key(F.col("function")).alias("function"), (F.size("rare") > F.coalesce("lasts", F.lit(0))).alias("first"), "rare", "popular"), "lists")
    discard(one)
    total = lists.count()
    n = max(LEAST_BLOCKS, -(-total // FUNCTIONS_A_BLOCK))
    # classes stay whole, unless they are too large for one block
    profile = F.xxhash64("popular")
    large = [r[0] for r in lists.groupBy(profile.alias("c")).count().filter(F.col("count") > total / (4 * n)).select("c").collect()]
    block = F.pmod(F.when(profile.isin(large), F.xxhash64("function")).otherwise(profile), F.lit(n)).cast("int")
    each = lists.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    task = (F.expr("greatest(block, other) * (greatest(block, other) + 1) div 2") + low).cast("int")
    ready = each.select("function", "first", "rare", "popular", "block", (low == high).alias("alone"), task.alias("task")).repartitionById(n * (n + 1) // 2, F.col("task"))
    kind = lists.schema["function"].dataType.simpleString()
    return ready.mapInArrow(partial(_blocks, by_class=by_class), f"this_function {kind}, that_function {kind}, nth int, this_position int, this_length int, that_position int, that_length int, ended boolean")
