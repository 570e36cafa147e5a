"""Components, near duplicates, shared spans and frequent items against plain versions."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from keyloom.llm import components, frequent_items, near_duplicates, shared_spans


def plain_groups(vertices, edges):
    parent = {v: v for v in vertices}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {v: root(v) for v in vertices}


@pytest.mark.parametrize("shape", ["random", "chain", "star", "none"])
def test_connected_groups(spark, shape):
    rng = random.Random(shape)
    n = 300
    edges = {
        "random": [(rng.randrange(n), rng.randrange(n)) for _ in range(200)],
        "chain": [(i, i + 1) for i in range(n - 1)],
        "star": [(0, i) for i in range(1, n)] * 2,
        "none": [],
    }[shape]
    v = spark.createDataFrame([(i, "x") for i in range(n)], "v int, r string")
    e = spark.createDataFrame([(a, b, 1) for a, b in edges] + [(None, 1, 1), (2, None, 1), (3, 3, 1)], "a int, b int, h int")
    got = {r["v"]: r["group"] for r in components.connected_groups(v, e).collect()}
    assert got == plain_groups(range(n), edges)


def test_match_edges_of_dirty_rows(spark):
    side = "struct<function binary, position int, length int>"
    f = lambda *x: tuple(bytes([i]) if i else None for i in x)
    a, b, c, d, e, g = f(1, 2, 3, 4, 5, 6)
    clones = spark.createDataFrame([((a, 1, 5), (b, 1, 5)), ((b, 1, 5), (a, 2, 5)), (None, (c, 1, 5)), ((None, 1, 1), (c, 1, 5)), ((d, 1, 1), (d, 1, 1))], f"this {side}, that {side}")
    groups = spark.createDataFrame([("x", [(b"p", b"v", b"f", e), None, (None, None, None, None), (b"p", b"v", b"f", g)]), ("y", []), ("z", None)], "text string, occurrences array<struct<project binary, version binary, code_file binary, function binary>>")
    vertices, edges = components.match_edges(clones, groups)
    got = {bytes(r["v"])[0]: bytes(r["group"])[0] for r in components.connected_groups(vertices, edges).collect()}
    assert got == {1: 1, 2: 1, 4: 4, 5: 5, 6: 5}
    vertices, edges = components.match_edges(clones.limit(0), groups.limit(0))
    assert components.connected_groups(vertices, edges).count() == 0


def trigrams(text):
    t = re.findall(r"[A-Za-z0-9_]+", text)
    return set(zip(t, t[1:], t[2:]))


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"w{rng.randrange(5000)}"
    return out


def test_near_duplicates_find_all_pairs(spark):
    rng = random.Random(3)
    texts = []
    for _ in range(60):
        base = [f"w{rng.randrange(5000)}" for _ in range(80)]
        texts += [" ".join(edited(rng, base, k)) for k in (0, 1, 2, 5)]
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)]
    rows += [(1000, texts[0].replace(" ", "  ; "), "x", 1), (1001, "too short", "x", 1), (1002, "", "x", 1), (1003, None, "x", 1), (None, texts[1], "x", 1), rows[5]]
    df = spark.createDataFrame(rows, "id int, text string, bag string, size int")
    members, pairs = near_duplicates.near_duplicates(df, "id", "text", 0.7)
    got = {(r["key_a"], r["key_b"]) for r in near_duplicates.key_pairs(members, pairs).collect()}
    sets = {i: trigrams(t) for i, t, *_ in rows if i is not None and t and trigrams(t)}
    ids = sorted(sets)
    want = {(a, b) for a in ids for b in ids if a < b and len(sets[a] & sets[b]) >= 0.7 * len(sets[a] | sets[b])}
    assert got <= want and len(got) >= 0.98 * len(want) and (0, 1000) in got
    empty = near_duplicates.near_duplicates(df.limit(0), "id", "text")
    assert empty[0].count() == empty[1].count() == 0


def test_bagminhash_estimates_weighted_jaccard():
    rng = np.random.default_rng(1)
    n, m = 400, 4096
    el = rng.integers(0, 1 << 48, n).astype(np.uint64)
    wa, wb = rng.integers(0, 6, n).astype(float), rng.integers(0, 6, n).astype(float)
    own = np.repeat([0, 1], n)
    weight = np.concatenate([wa, wb])
    keep = weight > 0
    sig = near_duplicates.bagminhash(np.concatenate([el, el])[keep], own[keep], weight[keep], 2, m)
    want = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    assert abs((sig[0] == sig[1]).mean() - want) < 0.04
    assert (near_duplicates.bagminhash(el[:0], own[:0], weight[:0], 2, 8) == 0).all()


def test_weighted_verification_counts_repeats(spark):
    a = "x y z " * 8
    df = spark.createDataFrame([(1, a + "q"), (2, a + "r"), (3, "x y z q " * 2)], "id int, text string")
    members, pairs = near_duplicates.near_duplicates(df, "id", "text", 0.8, weighted=True)
    assert {(r["key_a"], r["key_b"]) for r in near_duplicates.key_pairs(members, pairs).collect()} == {(1, 2)}


def plain_regions(texts, least=10):
    lines = {k: shared_spans.split_lines(t) for k, t in texts.items()}
    seen = defaultdict(set)
    for k, x in lines.items():
        for i in range(len(x) - least + 1):
            seen[tuple(x[i : i + least])].add(k)
    out = set()
    for k, x in lines.items():
        marks = [False] * len(x)
        for i in range(len(x) - least + 1):
            if len(seen[tuple(x[i : i + least])]) > 1:
                marks[i : i + least] = [True] * least
        i = 0
        while i < len(x):
            j = i
            while j < len(x) and marks[j]:
                j += 1
            if j > i:
                out.add((k, i, j - i))
            i = max(j, i + 1)
    return out


def test_shared_regions(spark):
    rng = random.Random(5)
    pool = [[f"line {rng.randrange(10**6)}" for _ in range(rng.randrange(8, 30))] for _ in range(12)]
    texts = {}
    for k in range(60):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            parts += [f"own {rng.random()}" for _ in range(rng.randrange(0, 7))] + rng.choice(pool)
        texts[k] = "\n".join(parts) + ("\n" if k % 2 else "")
    texts[100] = "\n".join(["same"] * 25)
    texts[101] = "\n".join(["same"] * 12)
    texts[102] = ""
    rows = [(k, t, 7) for k, t in texts.items()] + [(0, texts[0], 7), (None, texts[1], 7), (200, None, 7)]
    df = spark.createDataFrame(rows, "k int, text string, position int")
    got = {tuple(r) for r in shared_spans.shared_regions(df, "k", "text").collect()}
    assert got == plain_regions(texts)
    assert shared_spans.shared_regions(df.limit(0), "k", "text").count() == 0
    with pytest.raises(ValueError):
        shared_spans.shared_regions(df, "k", "text", least=8)


def test_difference_covers():
    for period in range(1, 14):
        cover = shared_spans.difference_cover(period)
        assert all(any((i + s) % period in cover and (j + s) % period in cover for s in range(period)) for i in range(period) for j in range(period))
    assert len(shared_spans.difference_cover(7)) == 3


def test_frequent_items(spark, monkeypatch):
    rng = random.Random(2)
    values = [bytes([min(int(rng.expovariate(0.2)), 40), 0]) for _ in range(3000)] + [b"hot"] * 1500 + [None] * 500 + [b""] * 20
    rng.shuffle(values)
    df = spark.createDataFrame([(v, 1) for v in values], "value binary, n int").repartition(5)
    count = Counter(v for v in values if v is not None)
    got = {bytes(r["value"]): r["n"] for r in frequent_items.at_least_share(df, "value", 0.02).collect()}
    assert got == {v: n for v, n in count.items() if n >= 0.02 * len(values)}
    top = [(bytes(r["value"]), r["n"]) for r in frequent_items.most_frequent(df, "value", 7).collect()]
    assert top == [(v, n) for v, n in sorted(count.items(), key=lambda x: (x[1], x[0]), reverse=True)[:7]]
    assert frequent_items.most_frequent(df, "value", 1000).count() == len(count)
    assert frequent_items.at_least_share(df.limit(0), "value", 0.1).count() == 0
