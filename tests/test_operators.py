"""Keyed rows, clones, word counts, classifier, rankings, sources and streams."""

import os
import random
import subprocess

import numpy as np
import pytest
from pyspark.sql import functions as F

from keyloom import store
from keyloom.operators import clones as C
from keyloom.operators import etl, keyed, linear, skew, snippets, wordcount
from keyloom.sources import files
from keyloom.streaming import counts

CELLS = [(bytes.fromhex(r), bytes([c]), v) for r, c, v in [("aa0b", 1, "a"), ("aaab", 1, "b"), ("aaac", 2, "c"), ("aaac", 1, "d"), ("aaad", 0, "e"), ("ff6164", 0, "f"), ("ffff", 5, "g"), ("01ff", 7, "h"), ("0200", 7, "i")]]
SPEC = keyed.KeySpec(("row",), ("col",), ("nth",))


@pytest.fixture
def cells(spark):
    return spark.createDataFrame([(*c, i) for i, c in enumerate([*CELLS, CELLS[0][:2] + ("later",), (None, b"x", "n"), (b"x", None, "n")])], "row binary, col binary, value string, nth int")


def test_first_wins_and_rows(spark, cells):
    got = {(bytes(r["row"]), bytes(r["col"])): r["value"] for r in keyed.first_wins(cells, SPEC).collect()}
    assert got == {(r, c): v for r, c, v in CELLS}
    rows = {bytes(r["row"]): [bytes(x["col"]) for x in r["cells"]] for r in keyed.rows(cells, SPEC, "value").collect()}
    assert rows[bytes.fromhex("aaac")] == [b"\x01", b"\x02"] and len(rows) == 8
    assert keyed.first_wins(cells.limit(0), SPEC).count() == 0
    made = keyed.from_objects(spark, [c for c in CELLS] + [CELLS[0][:2] + ("later",)], "row binary, col binary, value string", SPEC)
    assert made.count() == len(CELLS) and made.filter("value = 'later'").count() == 0


def test_shuffle_keeps_rows_whole_and_sorted(cells):
    parts = [p for p in keyed.shuffle(cells, SPEC, 3).rdd.glom().collect() if p]
    keys = [[(bytes(r["row"]), bytes(r["col"])) for r in p] for p in parts]
    assert all(k == sorted(k) for k in keys)
    assert all(a[-1][0] < b[0][0] for a, b in zip(keys, keys[1:]))


@pytest.mark.parametrize("prefix", ["", "aa", "aaa", "aaac", "ff", "ffff", "01ff", "7f", "00"])
def test_prefix_lookups(cells, prefix):
    p = bytes.fromhex(prefix + ("0" if len(prefix) % 2 else ""))
    want = sorted((r, c) for r, c, _ in CELLS if r.startswith(p))
    got = sorted({(bytes(r["row"]), bytes(r["col"])) for r in keyed.read_row(cells.filter("row is not null and col is not null"), "row", p).collect()})
    assert got == want
    columns = keyed.read_column(keyed.first_wins(cells, SPEC), SPEC, b"\x00").collect()
    assert [bytes(r["row"]).hex() for r in columns] == ["aaad", "ff6164"]


def test_pipeline_counters_and_registry(spark, cells, tmp_path):
    counters = keyed.Counters()
    flow = keyed.Pipeline.influx(cells, SPEC, counters).map(keyed.identity, "one").map(lambda df: df.filter("value <> 'a'"), "two").shuffle(SPEC)
    out = flow.map_and_efflux(keyed.identity, str(tmp_path / "out"))
    assert out.count() == len(CELLS)
    assert [(s, c["rows"]) for s, c in counters.report()] == [("one", 10), ("two", 9)]
    assert flow.side(lambda df: df.filter("value = 'b'")).count() == 1
    tables = keyed.Tables(spark)
    tables.install("cells_table", out, SPEC)
    assert spark.sql("select count(*) n from cells_table").first()["n"] == tables.source("cells_table").count()
    assert tables.read_row("cells_table", b"\xaa\xad").count() == 1 and tables.read_column("cells_table", b"\x07").count() == 2
    kept = tables.temporary(out)
    assert kept.count() == len(CELLS) and store.stored_bytes(kept) > 0
    path = kept.stored_at.removeprefix("file:")
    tables.close()
    assert not os.path.exists(path)
    stored = tables.create("made", cells, SPEC, str(tmp_path))
    assert tables.open("made", SPEC, str(tmp_path)).read_row(b"\xaa\xac").count() == 2 and tables.source("made").count() == len(CELLS)
    assert sorted(bytes(r["row"]).hex() for r in stored.read_column(b"\x00").collect()) == ["aaad", "ff6164"]
    tables.drop("made", str(tmp_path))
    tables.drop("never made")
    assert not (tmp_path / "made").exists() and "made" not in tables.held


def test_stored_sources_prune_by_file(spark, tmp_path):
    df = spark.createDataFrame([(bytes([i]), bytes([255 - i]), i) for i in range(250)], "row binary, col binary, n int")
    stored = keyed.write_sharded(df, str(tmp_path / "s"), keyed.KeySpec(("row",), ("col",)), 5)
    shards = sorted((bytes(r["first"]), bytes(r["last"])) for r in stored.shards().collect())
    assert len(shards) == 5 and all(a[1] < b[0] for a, b in zip(shards, shards[1:]))
    columns = sorted((bytes(r["a"]), bytes(r["b"])) for r in spark.read.parquet(str(tmp_path / "s" / "columns")).groupBy(F.input_file_name()).agg(F.min("col").alias("a"), F.max("col").alias("b")).collect())
    assert all(a[1] < b[0] for a, b in zip(columns, columns[1:]))
    assert [r["n"] for r in stored.read_row(b"\x07").collect()] == [7] and [r["n"] for r in stored.read_column(b"\x07").collect()] == [248]
    empty = keyed.write_sharded(df.limit(0), str(tmp_path / "e"), keyed.KeySpec(("row",), ("col",)))
    assert empty.read_row(b"").count() == 0 and empty.shards().count() == 0


def test_last_wins(cells):
    got = {(bytes(r["row"]), bytes(r["col"])): r["value"] for r in keyed.last_wins(cells, SPEC).collect()}
    assert got == {(r, c): v for r, c, v in CELLS} | {CELLS[0][:2]: "later"}
    assert keyed.last_wins(cells.limit(0), SPEC).count() == 0


def test_encoded_cells(spark):
    spec = keyed.KeySpec(("a",), ("b", "c"))
    df = spark.createDataFrame([("x", b"\x00\xff", 1, None), ("y", b"", 2, 1.5), (None, b"z", 3, 1.0)], "a string, b binary, c int, d double")
    cells = keyed.encoded(df, spec)
    assert {bytes(r["row"]) for r in cells.collect()} == {b"x", b"y"}
    assert sorted(map(str, keyed.decoded(cells, "a string, b binary, c int, d double").collect())) == sorted(map(str, df.filter("a is not null").collect()))
    with pytest.raises(Exception):
        keyed.decoded(cells.withColumn("contents", F.lit(b"no json")), "a string").collect()


def test_mapper_lifecycle_and_sides(spark, tmp_path):
    class Opened:
        """Writes to a folder what happens to it."""

        def __init__(self, folder):
            self.folder, self.n = folder, 0

        def map(self, pdf):
            self.n += len(pdf)
            if (pdf["v"] < 0).any():
                raise ValueError("negative")
            return pdf

        def close(self):
            import uuid

            open(f"{self.folder}/{uuid.uuid4().hex}", "w").write(str(self.n))

    folder = str(tmp_path)
    df = spark.range(100, numPartitions=3).selectExpr("id as v")
    assert keyed.per_partition(lambda: Opened(folder), "v bigint")(df).count() == 100
    assert sum(int(p.read_text()) for p in tmp_path.iterdir()) == 100 and len(list(tmp_path.iterdir())) == 3
    with pytest.raises(Exception, match="negative"):
        keyed.per_partition(lambda: Opened(folder), "v bigint")(df.selectExpr("v - 99 as v")).count()
    assert len(list(tmp_path.iterdir())) > 3
    ran = spark.sparkContext.accumulator(0)

    def counted(batches):
        for pdf in batches:
            ran.add(len(pdf))
            yield pdf.assign(t=["even" if v % 2 == 0 else "odd" for v in pdf["v"]])

    main, sides = keyed.with_sides(df.mapInPandas(counted, "v bigint, t string"), "t", ["odd", "none"], "even")
    assert (main.count(), sides["odd"].count(), sides["none"].count(), ran.value) == (50, 50, 0, 100)


def test_offline_stage_and_last_efflux(cells):
    flow = keyed.Pipeline.influx(cells, SPEC).run(lambda df: df.filter("value <> 'a'")).shuffle(SPEC, 3)
    stored = flow.last_efflux(keyed.identity)
    assert stored.cells().count() == len(CELLS) and stored.read_row(b"\xaa\xad").count() == 1


def test_shared_folder_is_asked_for_on_a_cluster(monkeypatch):
    class Nowhere:
        class sparkContext:
            master = "spark://host:7077"

            class _jsc:
                @staticmethod
                def sc():
                    class C:
                        @staticmethod
                        def getCheckpointDir():
                            class D:
                                isDefined = staticmethod(lambda: False)

                            return D

                    return C

            @staticmethod
            def getConf():
                return {}

        class conf:
            get = staticmethod(lambda *a: None)

    with pytest.raises(ValueError):
        store.shared_dir(Nowhere)


def test_lookup_join_with_a_hot_key(spark):
    big = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(3000)] + [(None, 1)], "k int, v int")
    small = spark.createDataFrame([(i, i * 2) for i in range(0, 3000, 2)] + [(1, 7)], "k int, w int")
    plain = sorted(map(str, big.join(small, "k", "left").select("k", "v", "w").collect()))
    assert sorted(map(str, skew.lookup_join(big, small, "k", "left", 0.1, 10).select("k", "v", "w").collect())) == plain
    assert [r["k"] for r in skew.heavy_keys(big, "k", 0.1, 10).collect()] == [1]


def test_spread_moves_small_scans_only(spark, tmp_path):
    spark.range(10).coalesce(1).write.parquet(str(tmp_path / "t"))
    small = spark.read.parquet(str(tmp_path / "t"))
    cores = spark.sparkContext.defaultParallelism
    assert skew.spread(small).rdd.getNumPartitions() == cores and skew.spread(small).count() == 10
    shuffled = small.groupBy("id").count()
    assert skew.spread(shuffled) is shuffled
    wide = spark.range(10, numPartitions=cores + 1)
    assert skew.spread(wide) is wide


def test_stitch_golden():
    """The matches of one function: two in fun2 joined by a popular one, two in fun3."""
    found = C.stitch([("fun2", 1, 6), ("fun2", 2, 2), ("fun2", 5, 5), ("fun3", 1, 1), ("fun3", 7, 7)])
    assert found == [("fun2", 1, 9, 2, 8), ("fun3", 1, 11, 1, 11)]


def test_stitch_rules():
    assert C.stitch([]) == []
    assert C.stitch([("f", 0, 0), ("f", 11, 11)]) == [("f", 0, 5, 0, 5), ("f", 11, 5, 11, 5)]
    # too far on the other side only: left for a later pass
    # the gap is measured from the last match looked at, so (2, 52) is taken in though (1, 50) was left
    assert C.stitch([("f", 0, 0), ("f", 1, 50), ("f", 2, 52)]) == [("f", 0, 7, 0, 57), ("f", 1, 5, 50, 5)]
    assert C.stitch([("f", 0, 5), ("f", 3, 2), ("g", 0, 0)]) == [("f", 0, 8, 2, 5), ("g", 0, 5, 0, 5)]


def test_collisions_pairs_and_popular(spark):
    rows = [("h1", f"f{i}", 1, i) for i in range(4)] + [("h1", "f0", 2, 0), ("h2", "f0", 1, 9), ("h2", "f1", 1, 8), ("h3", "f9", 1, 1), (None, "f0", 1, 1), ("h2", None, 1, 1)]
    df = spark.createDataFrame([(*r, 5) for r in rows], "hash string, function string, clone_type int, position int, length int")
    found = C.collisions(df)
    assert {(r["hash"], r["function"], r["n"]) for r in found.collect()} == {("h1", f"f{i}", 4) for i in range(4)} | {("h2", "f0", 2), ("h2", "f1", 2)}
    rough, popular = C.rough_pairs(found, 3), C.popular_snippets(found, 3)
    assert [tuple(r) for r in rough.collect()] == [("f0", "f1", 9, 8, "h2")] and popular.count() == 4
    assert {(r["this_function"], r["that_function"]) for r in C.woven_pairs(rough, popular).collect()} == {("f0", "f1"), ("f0", "f2"), ("f0", "f3")}
    assert C.expand(C.rough_pairs(found)).count() == 6
    assert C.rough_pairs(C.collisions(df.limit(0))).count() == 0


def test_expand_streams_whole_pairs(spark):
    rng = random.Random(9)
    rows = [(f"f{rng.randrange(6)}", f"g{rng.randrange(3)}", rng.randrange(60), rng.randrange(60), f"h{i}") for i in range(900)]
    rows += [("hot", f"g{i}", p, p + rng.randrange(3), f"x{i}-{p}") for i in range(200) for p in range(0, 30, 4)]
    df = spark.createDataFrame(rows, "this_function string, that_function string, this_position int, that_position int, hash string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = C.expand(df).toPandas()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    columns = ["this_function", "that_function", "this_position", "this_length", "that_position", "that_length"]
    want = []
    for f in sorted({r[0] for r in rows}):
        mine = sorted((r[1], r[2], r[4], r[3]) for r in rows if r[0] == f)
        want += [(f, i, *c) for i, c in enumerate(C.stitch([(t, p, q) for t, p, _, q in mine]))]
    assert sorted(got[columns].itertuples(index=False, name=None)) == sorted((f, *c) for f, _, *c in want)
    # the order of the passes over a function comes back from the clones of its pairs
    for f, rows_of in got.groupby("this_function"):
        ordered = C._sequence(rows_of)
        assert list(ordered[columns].itertuples(index=False, name=None)) == [(g, *c) for g, _, *c in want if g == f]
    assert C.expand(df.limit(0)).count() == 0


def test_fine_clones(spark):
    text = "\n".join(f"w{i} a{i}" for i in range(20))
    strings = spark.createDataFrame([("f", text), ("g", text), ("h", "\n".join(f"q{i}" for i in range(20))), (None, text), ("i", None)], "hash string, contents string")
    schema = "this_function string, that_function string, nth int, this_position int, this_length int, that_position int, that_length int, ended boolean"
    clones = spark.createDataFrame([("f", "g", 0, 0, 5, 0, 5, True), ("f", "g", 1, 30, 5, 30, 90, False), ("f", "h", 0, 0, 5, 0, 5, False), ("f", "i", 0, 0, 5, 0, 5, False)], schema)
    assert sorted((r["that_function"], r["nth"]) for r in C.fine_clones(clones, strings).collect()) == [("g", 0), ("g", 1)]
    # the pass ends after the first clone; h fails in the second pass, after g's second clone
    assert sorted((r["that_function"], r["nth"]) for r in C.fine_clones(clones, strings, strict=True).collect()) == [("g", 0), ("g", 1)]
    later = clones.withColumn("ended", F.lit(False))
    assert sorted((r["that_function"], r["nth"]) for r in C.fine_clones(later, strings, strict=True).collect()) == [("g", 0)]
    assert C.fine_clones(clones.limit(0), strings).count() == 0


def test_clone_groups(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (None, 1), (200, 200)]
    got = {r["function"]: r["grp"] for r in C.clone_groups(spark.createDataFrame(links, "this_function int, that_function int")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 103: 100, 200: 200}
    clones = spark.createDataFrame([("a", "b", 1, 2, 0, 3)], "this_function string, that_function string, this_position int, this_length int, that_position int, that_length int")
    strings = spark.createDataFrame([("a", "l0\nl1\nl2\nl3\n"), ("b", "x")], "hash string, contents string")
    assert C.group_texts(clones, C.clone_groups(clones), strings).first()["text"] == "l1\nl2"
    assert C.group_texts(clones, C.clone_groups(clones), strings, strict=True).first()["text"] == "l1\nl2\nl3"


def test_populated_and_snippets(spark):
    rows = spark.createDataFrame([("p", "v1", "a", "x"), ("p", "v1", "b", "y"), ("p", "v2", "a", "x"), ("p", "v1", "c", "x"), ("q", "v", "a", None)], "project_name string, version_name string, path string, contents string")
    made = snippets.populated(rows)
    assert made["projects"].count() == 1 and made["versions"].count() == 2 and made["code_files"].count() == 4
    fns = spark.createDataFrame([("f", "a b c d e\n" * 6), ("g", "short"), ("h", None)], "hash string, contents string")
    got = {(r["clone_type"], r["position"]) for r in snippets.snippets(fns).collect()}
    assert got == {(k, p) for k in (1, 2, 3) for p in (0, 1)}


def test_registered_functions(spark):
    method = "  int f(int a) {\n    b();\n    c();\n    d();\n    e();\n    return 1;\n  }\n"
    text = "package a;\n\nclass A {\n" + method + "}\n"
    rows = spark.createDataFrame([("p", "v1", "A.java", text), ("p", "v2", "A.java", text), ("p", "v2", "B.java", None)], "project_name string, version_name string, path string, contents string")
    made = snippets.populated(rows, with_functions=True)
    assert made["code_files"].count() == 1 and [r["base_line"] for r in made["functions"].collect()] == [3] and made["strings"].count() == 1
    assert {r["clone_type"] for r in made["snippets"].collect()} >= {1, 2}


def test_groups_of_equal_texts_are_one(spark):
    df = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, None)], "grp int, text string")
    assert sorted((r["text"], r["n_groups"], r["grp"]) for r in C.groups_by_text(df).collect()) == [("x", 2, 1), ("y", 1, 3)]


def test_word_counts(spark):
    docs = spark.createDataFrame([(1, "a b  a\n"), (2, "b"), (3, None), (4, "")], "id int, t string")
    by = wordcount.words_by_doc(docs, "id", "t")
    assert {tuple(r) for r in by.collect()} == {("a", 1, 2), ("b", 1, 1), ("b", 2, 1)}
    assert {tuple(r) for r in wordcount.word_totals(by, "id").collect()} == {("a", 2, 1), ("b", 2, 1)}
    assert wordcount.words_by_doc(docs, "id", "t", keep_empty=True).filter("word = ''").count() == 2
    values = spark.createDataFrame([("a", v) for v in (5, 1, 1, 9)] + [("b", 2), ("b", None), ("c", None)], "g string, v int")
    assert sorted(map(tuple, wordcount.median_and_minimum(values, "g", "v").collect())) == [("a", 1, 5), ("b", 2, 2)]
    assert sorted(map(tuple, wordcount.word_occurrences(spark.createDataFrame([(1, "ab, cé_1 ab"), (2, None), (3, "")], "id int, t string"), "id", "t").collect())) == [(1, "_1", 6), (1, "ab", 0), (1, "ab", 9), (1, "c", 4)]
    raw = spark.createDataFrame([("é a\n".encode(),), (None,), (b"",), (b"a",)], "c binary")
    assert sorted(map(tuple, wordcount.latin1_words(raw, "c").collect())) == [("a", 2), ("Ã©", 1)]
    assert tuple(wordcount.output_size(docs.limit(0)).first()) == (0, 0) and wordcount.output_size(docs).first()["n_rows"] == 4


def test_classifier(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 3))
    lines = "\n".join(" ".join(f"{v:.4f}" for v in row) + (" 1" if row[0] > 0.2 * row[1] else " 0") for row in x) + "\n\nnot a number 3\n"
    shards = linear.line_shards(spark.createDataFrame([("f", lines)], "f string, t string"), "f", "t", 4)
    features, label = linear.parse_instance(F.col("line"))
    rows = shards.select("shard", features.alias("features"), label.alias("label"))
    assert rows.filter("label is null").count() == 1
    models = linear.train(rows.filter("size(features) = 3"), 300, share=1.0)
    assert models.count() == 4 and sorted(map(str, models.collect())) == sorted(map(str, linear.train(rows.filter("size(features) = 3").repartition(7), 300, share=1.0).collect()))
    mean = [r["weight"] for r in linear.model_average(models).orderBy("i").collect()]
    w = F.array(*[F.lit(v) for v in mean])
    scored = rows.filter("size(features) = 3").withColumn("predicted", linear.classify(w, F.col("features")))
    assert scored.filter("predicted = label").count() > 0.9 * 400
    assert linear.misclassified(scored).count() <= 40
    assert linear.train(rows.limit(0)).count() == 0
    v = spark.range(1).select(linear.norm(F.array(F.lit(3.0), F.lit(4.0))).alias("n"), linear.model_text(F.array(F.lit(1.5), F.lit(2.0))).alias("t"), linear.scale(linear.subtract(linear.add(w, w), w), 2.0).alias("s")).first()
    assert v["n"] == 5 and v["t"] == "1.5 2.0 " and np.allclose(v["s"], np.array(mean) * 2)


def test_rankings(spark):
    lines = spark.createDataFrame([("alpha git http://x/alpha/src (via y)", 1), ("alpha svn http://x/alpha/docs", 2), ("beta svn http://y/b", 3), ("beta svn http://y/b", 4), ("", 5)], "value string, n int")
    repos = etl.repository_lines(lines).withColumn("n", F.monotonically_increasing_id())
    best = {r["name"]: (r["type"], r["url"]) for r in etl.best_repositories(repos, "n").collect()}
    assert best == {"alpha": ("git", "http://x/alpha/src"), "beta": ("svn", "http://y/b")}
    report = '{"job": {"name": "j", "startTime": 1000, "finishTime": 9999, "avgMapTime": 2500, "state": "OK"}}'
    row = etl.job_statistics(spark.createDataFrame([(report,), ("x",), (None,)], "j string"), "j").collect()
    assert (row[0]["name"], row[0]["duration"], row[0]["avgMapTime"], row[0]["state"]) == ("j", "8", "2", "OK") and row[1]["name"] is None


def test_sources(spark, tmp_path):
    for name, text in (("a.txt", "one\ntwo\n"), ("b.txt", "ACT I x ACT II y")):
        (tmp_path / name).write_text(text)
    path = str(tmp_path)
    assert {r["file_name"] for r in files.whole_texts(spark, path).collect()} == {"a.txt", "b.txt"}
    assert files.whole_files(spark, path).count() == 2 and files.text_lines(spark, path).count() == 3
    assert [r["content"] for r in files.acts(files.whole_texts(spark, path).filter("file_name = 'b.txt'"), "content").orderBy("number").collect()] == ["", " x ", " y"]
    sha = "0" * 40
    refs = spark.createDataFrame([("r", f"# c\n{sha} refs/heads/main\n^{sha}\n{sha} refs/remotes/o/x\n{sha} refs/tags/v1\n")], "r string, t string")
    assert [(r["sha"], r["name"]) for r in files.packed_refs(refs, "r", "t").orderBy("name").collect()] == [(sha, "main"), (sha, "v1")]
    names = spark.createDataFrame([("a/b/c/.git/x",), ("a/repo/objects/pack/p",), ("plain",)], "p string").select(files.project_name(F.col("p")).alias("n"))
    assert [r["n"] for r in names.collect()] == ["c", "repo", "plain"]


def test_offsets(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("é\nb\n\nc".encode())
    assert sorted(map(tuple, files.lines_with_offsets(spark, str(tmp_path)).collect())) == [(0, "é"), (3, "b"), (5, ""), (6, "c")]
    cells = files.keyed_records(files.lines_with_offsets(spark, str(tmp_path))).collect()
    assert {(bytes(r["row"]), bytes(r["col"]), bytes(r["contents"])) for r in cells} >= {(b"3", b"3", b"b")}
    texts = spark.createDataFrame([(1, "é\nb\n\nc"), (2, "x\n"), (3, ""), (4, None)], "k int, t string")
    assert sorted(map(tuple, files.text_line_offsets(texts, "k", "t").collect())) == [(1, 0, "é"), (1, 3, "b"), (1, 5, ""), (1, 6, "c"), (2, 0, "x")]


def test_git(spark, tmp_path):
    work, bare = tmp_path / "w", tmp_path / "all" / "r.git"
    git = lambda *a, at=work: subprocess.run(["git", "-C", str(at), "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    work.mkdir()
    git("init", "-q", "-b", "main", ".")
    (work / "A.java").write_text("class A {}")
    (work / "b.txt").write_text("x")
    git("add", ".")
    git("commit", "-qm", "x")
    git("tag", "v1")
    (work / "A.java").write_text("class A { int x; }")
    git("commit", "-qam", "y")
    subprocess.run(["git", "clone", "-q", "--bare", f"file://{work}", str(bare)], check=True)
    git("repack", "-adq", at=bare)
    git("pack-refs", "--all", at=bare)
    found = files.git_repositories(spark, str(tmp_path / "all"))
    assert files.pack_index(spark, str(tmp_path / "all")).count() == 1
    rows, counters = files.git_files(found)
    assert sorted((r["version_name"], r["path"], bytes(r["content"])) for r in rows.collect()) == [("main", "A.java", b"class A { int x; }"), ("v1", "A.java", b"class A {}")]
    assert {r["counter"]: r["n"] for r in counters.collect()} == {"killed": 0, "processed_files": 2, "missing_objects": 0}
    rows, counters = files.git_files(found, seconds=0)
    assert rows.count() == 0 and {r["counter"]: r["n"] for r in counters.collect()} == {"killed": 1, "processed_files": 0, "missing_objects": 0}
    lost = found.withColumn("packed_refs", F.concat(F.lit("1" * 40 + " refs/heads/gone\n"), "packed_refs"))
    rows, counters = files.git_files(lost)
    assert rows.count() == 2 and {r["counter"]: r["n"] for r in counters.collect()} == {"killed": 0, "processed_files": 2, "missing_objects": 1}
    (bare / "objects" / "pack" / "second.pack").write_bytes(b"x")
    with pytest.raises(Exception, match="one pack file"):
        files.git_repositories(spark, str(tmp_path / "all")).count()


def test_fetch(spark, tmp_path):
    from keyloom.sources import repositories

    work, folder = tmp_path / "w", tmp_path / "mirror"
    git = lambda *a: subprocess.run(["git", "-C", str(work), "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    work.mkdir()
    folder.mkdir()
    git("init", "-q", "-b", "main", ".")
    (work / "A.java").write_text("class A {}")
    git("add", ".")
    git("commit", "-qm", "x")
    lines = [f"al-pha git file://{work}", "beta svn http://nowhere.invalid/b", f"gamma git file://{tmp_path}/none", f"123 git file://{work}", ""]
    listing = spark.createDataFrame([(x,) for x in lines], "value string")
    for want in ("cloned", "updated"):
        outcomes, found = repositories.fetched(spark, listing, str(folder))
        assert {r["name"]: r["outcome"] for r in outcomes.collect()} == {"alpha": want, "beta": "skipped", "gamma": "failed"}
        rows, _ = files.git_files(found)
        assert sorted(bytes(r["content"]).decode() for r in rows.collect()) == (["class A {}"] if want == "cloned" else ["class A { int x; }"])
        if want == "cloned":
            (work / "A.java").write_text("class A { int x; }")
            git("commit", "-qam", "y")
    assert [p.name for p in folder.iterdir()] == ["alpha"]


def test_merged_configurations():
    from keyloom.sources import repositories

    a, b = "<property><name>x</name><value>1</value></property>\n", "<property><name>x</name><value>2</value></property>\n<property><name>y</name><value>3</value></property>\n"
    assert repositories.properties(repositories.merged_properties(a, b)) == {"x": "2", "y": "3"}
    assert repositories.merged_settings("A=1\n", "A=2\n").index("A=1") < repositories.merged_settings("A=1\n", "A=2\n").index("A=2")


def test_streams(spark, tmp_path):
    rng = random.Random(1)
    docs = spark.createDataFrame([(i, " ".join(rng.choice("abc") for _ in range(9))) for i in range(20)], "doc_id int, text string")
    docs.write.parquet(str(tmp_path / "docs"))
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "docs"))
    run = counts.streaming_word_totals(stream, "text").writeStream.format("memory").queryName("totals").outputMode("complete").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    run.awaitTermination()
    by = wordcount.words_by_doc(docs, "doc_id", "text")
    assert {tuple(r) for r in spark.table("totals").collect()} == {(r["word"], r["n"]) for r in wordcount.word_totals(by, "doc_id").collect()}
    events = spark.sql("select timestamp'2024-01-01 00:10:00' ts, 'x' event_type union all select timestamp'2024-01-01 00:50:00', 'x' union all select timestamp'2024-01-01 05:00:00', 'y'")
    events.write.parquet(str(tmp_path / "ev"))
    s = spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev"))
    run = counts.event_windows(s).writeStream.format("memory").queryName("windows").outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert [(r["event_type"], r["n"]) for r in spark.table("windows").collect()] == [("x", 2)]


def test_popular_hashes_are_woven_into_the_clones(spark):
    """End to end against a plain version: rough matches, woven ones before them at the same place, stitched."""
    rng = random.Random(4)
    rows = {(f"h{rng.randrange(9)}", f"f{i}"): rng.randrange(40) for i in range(8) for _ in range(6)}
    df = spark.createDataFrame([(h, f, 1, p, 5) for (h, f), p in rows.items()], "hash string, function string, clone_type int, position int, length int")
    n = {h: sum(x == h for x, _ in rows) for h, _ in rows}
    pairs = [(f, g, p, q, h) for (h, f), p in rows.items() for (x, g), q in rows.items() if x == h and f < g]
    limit = 5
    rough = {}
    for f, g, p, q, h in sorted((x for x in pairs if n[x[4]] < limit), key=lambda x: x[4]):
        rough.setdefault((f, g, p), (f, g, p, 1, h, q))
    starts = {f for f, _, _ in rough}
    woven = [(f, g, p, 0, h, q) for f, g, p, q, h in pairs if n[h] >= limit and f in starts]
    assert rough and woven and any(n[h] >= limit and f not in starts for f, _, _, _, h in pairs)
    every = sorted([*rough.values(), *woven])
    want = sorted((f, *c) for f in starts for c in C.stitch([(g, p, q) for x, g, p, _, _, q in every if x == f]))
    columns = ["this_function", "that_function", "this_position", "this_length", "that_position", "that_length"]
    assert sorted(tuple(r) for r in C.expand(C.all_matches(C.collisions(df), limit)).select(*columns).collect()) == want
    found, names = C.coded(C.collisions(df))
    assert sorted(tuple(r) for r in C.named(C.expand(C.all_matches(found, limit)), names).select(*columns).collect()) == want
    for least in (2, 3, limit, 100):
        classes = C.clone_classes(found, least)
        every = C.named(C.expand(C.all_matches(found, least)), names).select(*columns, "nth", "ended").collect()
        assert sorted(map(tuple, C.named(classes.expanded(), names).select(*columns, "nth", "ended").collect())) == sorted(map(tuple, every)), least
    assert C.clone_classes(found.limit(0)).expanded().count() == 0


def test_clone_queries_take_popular_hashes(spark, tmp_path):
    from keyloom.plans import catalog

    popular = [(b"p", f"f{i:03d}".encode(), 1, 3, 5) for i in range(C.POPULAR)]
    rows = [*popular, (b"r", b"f000", 1, 0, 5), (b"r", b"f001", 1, 0, 5)]
    spark.createDataFrame(rows, "hash binary, function binary, clone_type int, position int, length int").write.parquet(str(tmp_path / "snippets.parquet"))
    got = [tuple(r)[1:3] + tuple(r)[4:] for r in catalog.QUERIES["expand_clones"](spark, str(tmp_path)).collect()]
    assert len(got) == C.POPULAR - 1 and got.count((0, 8, 0, 8)) == 1 and got.count((3, 5, 3, 5)) == C.POPULAR - 2


def test_class_members_are_found_without_matches(spark, tmp_path, monkeypatch):
    """the members of classes need no pair of functions, so neither rough matches nor clones are made for them."""
    from keyloom.plans import catalog

    def never(*_, **__):
        raise AssertionError("matches were made")

    # f000 to f058 hold p at 3, f059 at 4; f001 and f002 share r, so only f001 may be first; s is in one function
    rows = [*[(b"p", f"f{i:03d}".encode(), 1, 4 if i == 59 else 3, 5) for i in range(60)], (b"r", b"f001", 1, 0, 5), (b"r", b"f002", 1, 0, 5), (b"s", b"f003", 1, 0, 5)]
    spark.createDataFrame(rows, "hash binary, function binary, clone_type int, position int, length int").write.parquet(str(tmp_path / "snippets.parquet"))
    for name in ("rough_pairs", "expand"):
        monkeypatch.setattr(C, name, never)
    key = {f"f{i:03d}".encode().hex(): i for i in range(60)}
    got = sorted((key[r["function"]], key[r["class_function"]], r["first"]) for r in catalog.QUERIES["clone_class_members"](spark, str(tmp_path)).collect())
    assert got == [(i, 59 if i == 59 else 0, i == 1) for i in range(60)]


def test_clones_are_listed_without_stored_matches(spark, tmp_path, monkeypatch):
    """block by block the clones are those of all matches, and neither query makes a table of matches."""
    from keyloom.plans import catalog

    rng = random.Random(7)
    rows = list({(f"h{rng.randrange(9)}".encode(), f"f{i % 11}".encode()): rng.randrange(60) for i in range(60)}.items())
    df = spark.createDataFrame([(h, f, 1, p, 5) for (h, f), p in rows] + [(None, b"f1", 1, 0, 5), (b"h1", None, 1, 0, 5)], "hash binary, function binary, clone_type int, position int, length int")
    columns = ["this_function", "that_function", "nth", "this_position", "this_length", "that_position", "that_length", "ended"]
    plain = lambda out: sorted(tuple(r) for r in out.select(*columns).collect())
    want = {least: plain(C.expand(C.all_matches(C.collisions(df), least))) for least in (2, 5, 100)}
    assert len(want[5]) > 10 and len({len(x) for x in want.values()}) > 1
    df.write.parquet(str(tmp_path / "snippets.parquet"))

    def never(*_, **__):
        raise AssertionError("matches were made")

    for name in ("rough_pairs", "woven_pairs", "expand"):
        monkeypatch.setattr(C, name, never)
    assert {least: plain(C.block_clones(df, least)) for least in want} == want
    monkeypatch.setattr(C, "FUNCTIONS_A_BLOCK", 1)
    monkeypatch.setattr(C, "LEAST_BLOCKS", 1)
    assert plain(C.block_clones(df, 5)) == want[5]
    assert C.block_clones(df.limit(0)).count() == 0
    assert catalog.QUERIES["expand_clones"](spark, str(tmp_path)).count() == len(want[100])


@pytest.mark.parametrize("name", ["expand_woven_clones", "stitched_matches"])
def test_woven_clone_queries_store_no_matches(spark, tmp_path, monkeypatch, name):
    """60 functions share a popular hash and the first two a rare one."""
    from keyloom.plans import catalog

    def never(*_, **__):
        raise AssertionError("matches were made")

    rows = [*[(b"p", f"f{i:03d}".encode(), 1, 3, 5) for i in range(60)], (b"r", b"f000", 1, 0, 5), (b"r", b"f001", 1, 0, 5)]
    spark.createDataFrame(rows, "hash binary, function binary, clone_type int, position int, length int").write.parquet(str(tmp_path / "snippets.parquet"))
    for f in ("rough_pairs", "woven_pairs", "expand"):
        monkeypatch.setattr(C, f, never)
    got = [tuple(r)[1:3] + tuple(r)[4:] for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()]
    assert len(got) == 59 and got.count((0, 8, 0, 8)) == 1 and got.count((3, 5, 3, 5)) == 58


def plain_training(x, y, steps, w):
    """One shard, step by step."""
    k = max(1, int(0.02 * len(x) + 0.5))
    batch = list(zip(x[:k], y[:k]))
    for _ in range(steps):
        wrong = [(f, t) for f, t in batch if f @ w >= 0 and t < 0]
        gradient = np.mean([(1 / (1 + np.exp(-(f @ w))) - (t + 1) / 2) * f for f, t in [*batch, *wrong * 3]], axis=0)
        w = w - gradient
        if np.linalg.norm(gradient) < 1e-4:
            break
    return w


def test_training_follows_the_rule():
    rng = np.random.default_rng(1)
    shards = [(rng.normal(size=(n, 36)), rng.choice([-1.0, 1.0], n)) for n in (1, 20, 130, 400, 401)]
    for steps in (1, 7, 400):
        got = linear.train_many(shards, steps, linear.START)
        assert all(np.allclose(w, plain_training(x, y, steps, np.array(linear.START)), atol=1e-9) for w, (x, y) in zip(got, shards))
    assert len(linear.START) == 36 and linear.batch_size(25) == 1 and linear.batch_size(75) == 2 and linear.batch_size(1) == 1


def test_train_models_takes_all_steps(spark, tmp_path):
    from keyloom.plans import catalog

    rng = np.random.default_rng(3)
    rows = [(i, i % 2, [float(v) for v in rng.normal(size=64) / 10]) for i in range(12)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    instances = catalog._instances(spark, str(tmp_path)).filter("shard = 0").toPandas().assign(k=lambda x: x["features"].map(tuple)).sort_values(["k", "label"])
    got = {r["shard"]: r["weights"] for r in catalog.QUERIES["train_models"](spark, str(tmp_path)).collect()}
    x, y = np.vstack(instances["features"].to_list()), instances["label"].to_numpy(float)
    assert np.allclose(got[0], plain_training(x, y, 10_000, np.zeros(64)), atol=1e-5)
    assert not np.allclose(got[0], plain_training(x, y, 200, np.zeros(64)), atol=1e-3)


def test_strict_instances(spark):
    features, label = linear.parse_instance_strictly(F.col("l"))
    df = spark.createDataFrame([("1.5 2 1",)], "l string").select(features.alias("f"), label.alias("y"))
    assert tuple(df.first()) == ([1.5, 2.0], 1)
    bad = spark.createDataFrame([("1.5 x 1",)], "l string").select(features.alias("f"))
    with pytest.raises(Exception, match="no number: x"):
        bad.collect()


def test_gapped_sketches_equal_the_column_expression(spark):
    from keyloom.functions import text as T

    rng = random.Random(2)
    texts = ["\n".join(" ".join(rng.choice(["t", "(", ")", "1", "", "="]) for _ in range(rng.randrange(0, 6))) for _ in range(rng.randrange(1, 14))) + rng.choice(["", "\n"]) for _ in range(60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, "", None])], "function int, type2 string")
    got = {(r["function"], r["position"]): r["hash"] for r in snippets._gapped(df).collect()}
    parts = df.select("function", T.lines(F.col("type2")).alias("lines")).filter("size(lines) >= 5").select("*", F.explode(F.sequence(F.lit(0), F.size("lines") - 5)).alias("position"))
    want = {(r["function"], r["position"]): r["h"] for r in parts.select("function", "position", T.sketch(T.get_lines(F.col("lines"), F.col("position"), 5)).alias("h")).collect() if r["h"]}
    assert got == want and got
