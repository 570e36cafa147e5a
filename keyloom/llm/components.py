"""Problem 1: connected groups of pairwise matches by randomised contraction."""

import random
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.operators.ids import numbered
from keyloom.operators.skew import SMALL_BYTES, lookup_join
from keyloom.store import discard, stored_bytes, written


def match_edges(clones: DataFrame, clone_groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vertices v; edges a, b) of two match tables.

    A clones row links this.function and that.function if neither is null; a list links each of its
    functions to its smallest one, a star instead of all pairs, which connects the same functions. Null
    sides, functions, lists and occurrences link nothing. A self match or a list of one gives a vertex.
    """
    pairs = clones.select(F.col("this.function").alias("a"), F.col("that.function").alias("b")).filter("a is not null and b is not null")
    members = F.filter(F.transform("occurrences", lambda o: o["function"]), lambda f: f.isNotNull())
    lists = clone_groups.select(members.alias("m")).filter(F.size("m") > 0)
    stars = lists.select(F.array_min("m").alias("a"), F.explode("m").alias("b"))
    links = pairs.unionByName(stars)
    vertices = links.select(F.explode(F.array("a", "b")).alias("v")).distinct()
    return vertices, links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def connected_groups(vertices: DataFrame, edges: DataFrame, seed: int = 1, share: float = 0.001, least: int = 100_000, small_bytes: int = SMALL_BYTES) -> DataFrame:
    """(v, group): group is the smallest vertex in the component of v.

    Vertices are numbered once in their order, so all rounds work on longs. Each round draws a fresh hash order, lets every
    vertex hook to the least vertex of its closed neighbourhood in that order, relabels both ends of each edge and removes
    repeats and loops. A round removes a constant share of the vertices in expectation, whatever the shape of the
    graph, so chains of any length need O(log n) rounds, and the loop ends when no edge is left. The rounds' mappings are then
    applied backwards. Vertices without edges are their own group; an empty table gives an empty result; edges with a null
    end are ignored, ends that are no vertices join their groups but have no row.

    Hubs: the choice of a neighbour is an aggregate with map-side combining, and the relabelling joins go through
    lookup_join (share, least, small_bytes are its), so no vertex or component ever gathers in one task.
    """
    rng = random.Random(seed)
    join = partial(lookup_join, share=share, least=least, small_bytes=small_bytes)
    ends = edges.select("a", "b").filter("a is not null and b is not null and a <> b")
    names = numbered(vertices.select("v").unionByName(ends.select(F.explode(F.array("a", "b")).alias("v"))), "v")
    ends = written(ends, "ends")
    size = stored_bytes(ends)
    first = join(ends, names.toDF("a", "x"), "a", "inner", big_bytes=size).select("b", "x")
    if size > small_bytes:
        first = written(first, "ends")
    first = join(first, names.toDF("b", "y"), "b", "inner", big_bytes=size)
    current = written(first.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    discard(ends)
    mappings = []
    while not current.isEmpty():
        key = F.lit(rng.getrandbits(62))

        def order(c: str, key=key):
            return F.xxhash64(key, F.col(c))

        both = current.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("x")), F.struct(F.col("b").alias("v"), F.col("a").alias("x")))).alias("e")).select("e.*")
        least_of = both.select("v", "x", order("x").alias("h")).groupBy("v").agg(F.min_by("x", "h").alias("x"), F.min("h").alias("h"))
        hook = written(least_of.select("v", F.when(order("v") <= F.col("h"), F.col("v")).otherwise(F.col("x")).alias("r")), "hook")
        mappings.append(hook)
        size = stored_bytes(current)
        step = join(current, hook.toDF("a", "ra"), "a", "inner", big_bytes=size)
        if size > small_bytes:
            step = written(step, "step")
        step = join(step, hook.toDF("b", "rb"), "b", "inner", big_bytes=size)
        relabelled = step.filter("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        old, current = current, written(relabelled, "edges")
        discard(old)
    label = names.select(F.col("i").alias("v"), F.col("i").alias("root")).limit(0)
    for hook in reversed(mappings):
        # vertices that stay are keys of the later mapping; those which hooked get the label of their neighbour
        size = stored_bytes(hook)
        outer = join(hook.withColumnRenamed("r", "k"), label.select(F.col("v").alias("k"), "root"), "k", "left", big_bytes=size)
        label = outer.select("v", F.coalesce("root", "k").alias("root"))
        if size > small_bytes:
            label = written(label, "label")
    wanted = names.join(vertices.select("v").distinct(), "v", "left_semi")
    linked = written(wanted.join(label.withColumnRenamed("v", "i"), "i", "left").select("v", "i", F.coalesce("root", "i").alias("root")), "root")
    for hook in mappings:
        discard(hook)
    size = stored_bytes(linked)
    smallest = linked.groupBy("root").agg(F.min("i").alias("g"))
    smallest = smallest.join(linked.select(F.col("i").alias("g"), F.col("v").alias("group")), "g").select("root", "group")
    return join(linked, smallest, "root", "inner", big_bytes=size).select("v", "group")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """fn, group_fn: the group of every function in at least one match."""
    vertices, edges = match_edges(spark.read.parquet(f"{d}/clones.parquet"), spark.read.parquet(f"{d}/clone_groups.parquet"))
    groups = connected_groups(vertices, edges)
    return groups.select(F.lower(F.hex("v")).alias("fn"), F.lower(F.hex("group")).alias("group_fn"))


def p1_hubs(spark: SparkSession, d: str) -> DataFrame:
    """The rows of p1_found with every join on the path for hubs: functions with more than 8 links count as such."""
    vertices, edges = match_edges(spark.read.parquet(f"{d}/clones.parquet"), spark.read.parquet(f"{d}/clone_groups.parquet"))
    groups = connected_groups(vertices, edges, share=0.0001, least=8, small_bytes=-1)
    return groups.select(F.lower(F.hex("v")).alias("fn"), F.lower(F.hex("group")).alias("group_fn"))


def p1_group_sizes(spark: SparkSession, d: str) -> DataFrame:
    """group_fn, n: functions of each group."""
    return p1_found(spark, d).groupBy("group_fn").agg(F.count(F.lit(1)).alias("n"))


_LINKS = """
WITH RECURSIVE pairs AS (
  SELECT lower(hex(this.function)) AS a, lower(hex(that.function)) AS b FROM clones WHERE this.function IS NOT NULL AND that.function IS NOT NULL
), lists AS (SELECT row_number() OVER () AS k, occurrences FROM clone_groups),
members AS (SELECT k, lower(hex(o.function)) AS f FROM (SELECT k, unnest(occurrences) AS o FROM lists) WHERE o.function IS NOT NULL),
stars AS (SELECT m.f AS a, s.f AS b FROM members m JOIN (SELECT k, min(f) AS f FROM members GROUP BY k) s USING (k)),
links AS (SELECT a, b FROM pairs UNION SELECT a, b FROM stars),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a AS v, a AS w FROM both_ways UNION SELECT r.v, e.b FROM reach r JOIN both_ways e ON r.w = e.a),
groups AS (SELECT v AS fn, min(w) AS group_fn FROM reach GROUP BY v)
"""
QUERIES = {"p1_found": p1_found, "p1_hubs": p1_hubs, "p1_group_sizes": p1_group_sizes}
SQL = {
    "p1_found": _LINKS + "SELECT fn, group_fn FROM groups",
    "p1_hubs": _LINKS + "SELECT fn, group_fn FROM groups",
    "p1_group_sizes": _LINKS + "SELECT group_fn, count(*)::BIGINT AS n FROM groups GROUP BY group_fn",
}
