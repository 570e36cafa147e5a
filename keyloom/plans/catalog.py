"""The driver's queries over the reference operators, each over whole tables, with SQL where SQL can tell the result."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.functions import text as T
from keyloom.functions.charset import guess_charset
from keyloom.functions.tokenizer import functions_of
from keyloom.operators import clones as C
from keyloom.operators import etl, keyed, linear, snippets, wordcount
from keyloom.operators.skew import spread
from keyloom.plans import sql as S
from keyloom.sources import files
from keyloom.store import folder, written

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    """Registers a query under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def hexed(c):
    return F.lower(F.hex(c))


def distinct_functions(spark: SparkSession, d: str) -> DataFrame:
    # one exchange; its width is given, so that a small table is spread over all cores all the same, and the aggregate keeps it
    rows = table(spark, d, "code_functions").filter("hash is not null and contents is not null")
    width = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(width, "hash").groupBy("hash").agg(F.min("contents").alias("contents"))


# --- word counts

_WORDS = r"w AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\s+')) AS word FROM documents)"


@query(f"WITH {_WORDS} SELECT word, doc_id, count(*)::BIGINT AS n FROM w WHERE word <> '' GROUP BY word, doc_id")
def word_count_by_doc(spark: SparkSession, d: str) -> DataFrame:
    return wordcount.words_by_doc(table(spark, d, "documents"), "doc_id", "text")


@query(f"WITH {_WORDS} SELECT word, doc_id, count(*)::BIGINT AS n FROM w GROUP BY word, doc_id")
def word_count_with_empty(spark: SparkSession, d: str) -> DataFrame:
    return wordcount.words_by_doc(table(spark, d, "documents"), "doc_id", "text", keep_empty=True)


@query(f"WITH {_WORDS} SELECT word, count(*)::BIGINT AS n, min(doc_id) AS first_doc FROM w WHERE word <> '' GROUP BY word")
def word_total(spark: SparkSession, d: str) -> DataFrame:
    return wordcount.word_totals(word_count_by_doc(spark, d), "doc_id").withColumnRenamed("first_key", "first_doc")


_STARTS = r"""p AS (SELECT DISTINCT doc_id, text, regexp_extract_all(text, '\w+') AS w, regexp_split_to_array(text, '\w+') AS g FROM documents WHERE text IS NOT NULL),
u AS (SELECT doc_id, text, unnest(w) AS word, unnest(list_transform(g[1 : len(w)], lambda x: length(x))) AS gap, generate_subscripts(w, 1) AS i FROM p WHERE len(w) > 0),
starts AS (SELECT doc_id, word, (sum(gap + length(word)) OVER (PARTITION BY doc_id, text ORDER BY i) - length(word))::INTEGER AS start FROM u)"""


@query(f"WITH {_STARTS} SELECT doc_id, word, start FROM starts")
def word_occurrences(spark: SparkSession, d: str) -> DataFrame:
    """Every occurrence with its place; repeated rows of a document count once."""
    return wordcount.word_occurrences(table(spark, d, "documents").select("doc_id", "text").distinct(), "doc_id", "text")


@query(r"SELECT doc_id, count(*)::BIGINT AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\w+')) AS word FROM documents) WHERE word = 'your' GROUP BY doc_id")
def word_filter(spark: SparkSession, d: str) -> DataFrame:
    found = wordcount.word_occurrences(table(spark, d, "documents"), "doc_id", "text")
    return found.filter("word = 'your'").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query(r"SELECT lower(hex(encode(word))) AS word_bytes, count(*)::BIGINT AS n FROM (SELECT unnest(regexp_split_to_array(contents, '[ \t\n\x0b\f\r]+')) AS word FROM code_files WHERE contents IS NOT NULL) WHERE word <> '' GROUP BY word")
def latin1_words(spark: SparkSession, d: str) -> DataFrame:
    """Word counts over bytes read as ISO-8859-1; words shown by their bytes."""
    raw = table(spark, d, "code_files").select(F.col("contents").cast("binary").alias("raw"))
    return wordcount.latin1_words(raw, "raw").select(F.lower(F.hex(F.encode("word", "ISO-8859-1"))).alias("word_bytes"), "n")


@query("SELECT count(*)::BIGINT AS n_rows, sum(strlen('{\"doc_id\":' || doc_id || ',\"n_chars\":' || n_chars || '}'))::BIGINT AS n_bytes FROM documents WHERE n_chars IS NOT NULL")
def output_size(spark: SparkSession, d: str) -> DataFrame:
    return wordcount.output_size(table(spark, d, "documents").select("doc_id", "n_chars").filter("n_chars is not null"))


@query("SELECT event_type, min(value) AS least, list_sort(list(value))[count(*) // 2 + 1] AS median FROM events WHERE value IS NOT NULL GROUP BY event_type")
def timings_min_median(spark: SparkSession, d: str) -> DataFrame:
    return wordcount.median_and_minimum(table(spark, d, "events"), "event_type", "value")


# --- keyed rows

SNIPPET_KEYS = keyed.KeySpec(("hash",), ("function",), ("clone_type", "position"))


@query("SELECT lower(hex(hash)) AS hash, lower(hex(function)) AS function, clone_type, position, length FROM (SELECT *, row_number() OVER (PARTITION BY hash, function ORDER BY clone_type, position, length) AS r FROM snippets WHERE hash IS NOT NULL AND function IS NOT NULL) WHERE r = 1")
def keyed_first_wins(spark: SparkSession, d: str) -> DataFrame:
    out = keyed.first_wins(table(spark, d, "snippets"), SNIPPET_KEYS)
    return out.select(hexed("hash").alias("hash"), hexed("function").alias("function"), "clone_type", "position", "length")


@query("""SELECT lower(hex(function)) AS function, string_agg(clone_type || ':' || position || ':' || h, ' ' ORDER BY clone_type, position) AS cells FROM (
SELECT function, clone_type, position, min(lower(hex(hash))) AS h FROM snippets WHERE hash IS NOT NULL AND function IS NOT NULL GROUP BY ALL) GROUP BY function""")
def keyed_rows(spark: SparkSession, d: str) -> DataFrame:
    spec = keyed.KeySpec(("function",), ("clone_type", "position"), ("hash",))
    out = keyed.rows(table(spark, d, "snippets").filter("hash is not null"), spec, "hash")
    cell = F.transform("cells", lambda c: F.concat_ws(":", c["clone_type"].cast("string"), c["position"].cast("string"), F.lower(F.hex(c["hash"]))))
    return out.select(hexed("function").alias("function"), F.array_join(cell, " ").alias("cells"))


@query("SELECT lower(hex(hash)) AS hash, lower(hex(function)) AS function, position, clone_type FROM snippets WHERE lower(hex(hash)) LIKE '3f%'")
def read_row_prefix(spark: SparkSession, d: str) -> DataFrame:
    out = keyed.read_row(table(spark, d, "snippets"), "hash", b"\x3f")
    return out.select(hexed("hash").alias("hash"), hexed("function").alias("function"), "position", "clone_type")


@query("SELECT lower(hex(hash)) AS hash, lower(hex(function)) AS function, position, clone_type FROM snippets WHERE lower(hex(function)) LIKE 'ff%'")
def read_column_prefix(spark: SparkSession, d: str) -> DataFrame:
    out = keyed.read_column(table(spark, d, "snippets"), SNIPPET_KEYS, b"\xff")
    return out.select(hexed("hash").alias("hash"), hexed("function").alias("function"), "position", "clone_type")


@query("SELECT lower(hex(hash)) AS hash, lower(hex(function)) AS function, clone_type, position, length FROM (SELECT *, row_number() OVER (PARTITION BY hash, function ORDER BY clone_type DESC, position DESC, length DESC) AS r FROM snippets WHERE hash IS NOT NULL AND function IS NOT NULL) WHERE r = 1")
def keyed_last_wins(spark: SparkSession, d: str) -> DataFrame:
    out = keyed.last_wins(table(spark, d, "snippets"), SNIPPET_KEYS)
    return out.select(hexed("hash").alias("hash"), hexed("function").alias("function"), "clone_type", "position", "length")


_FIRST = "first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY hash, function ORDER BY clone_type, position, length) AS r FROM snippets WHERE hash IS NOT NULL AND function IS NOT NULL) WHERE r = 1)"


def _stored(spark: SparkSession, d: str) -> keyed.Sharded:
    flow = keyed.Pipeline.influx(table(spark, d, "snippets"), SNIPPET_KEYS).map(keyed.identity)
    return flow.last_efflux(keyed.identity)


@query(f"WITH {_FIRST} SELECT lower(hex(hash)) AS hash, lower(hex(function)) AS function, position FROM first WHERE lower(hex(hash)) LIKE '3f%'")
def stored_read_row(spark: SparkSession, d: str) -> DataFrame:
    """A pipeline's stored result, looked up by row key."""
    return _stored(spark, d).read_row(b"\x3f").select(hexed("hash").alias("hash"), hexed("function").alias("function"), "position")


@query(f"WITH {_FIRST} SELECT lower(hex(hash)) AS hash, lower(hex(function)) AS function, position FROM first WHERE lower(hex(function)) LIKE 'ff%'")
def stored_read_column(spark: SparkSession, d: str) -> DataFrame:
    """The same by column key, from the column index."""
    return _stored(spark, d).read_column(b"\xff").select(hexed("hash").alias("hash"), hexed("function").alias("function"), "position")


@query(f"WITH {_FIRST} SELECT clone_type, count(*)::BIGINT AS n, lower(hex(min(hash))) AS least, lower(hex(max(hash))) AS greatest FROM first GROUP BY clone_type")
def ranged_shuffle(spark: SparkSession, d: str) -> DataFrame:
    """Sorted ranges of whole rows, put together again."""
    flow = keyed.Pipeline.influx(table(spark, d, "snippets"), SNIPPET_KEYS).shuffle(SNIPPET_KEYS, 16)
    return flow.df.groupBy("clone_type").agg(F.count(F.lit(1)).alias("n"), hexed(F.min("hash")).alias("least"), hexed(F.max("hash")).alias("greatest"))


@query("SELECT lower(hex(hash)) AS hash, lower(hex(function)) AS function, position, n FROM (SELECT hash, function, position, count(*) OVER (PARTITION BY hash)::BIGINT AS n FROM (SELECT hash, function, min(position) AS position FROM snippets WHERE hash IS NOT NULL AND function IS NOT NULL AND clone_type = 2 GROUP BY hash, function))")
def pipeline_counts(spark: SparkSession, d: str) -> DataFrame:
    """influx, a map, a shuffle, a map over whole rows, the last map: the renamed snippets with the size of their row."""

    def renamed(df: DataFrame) -> DataFrame:
        return df.filter("clone_type = 2").groupBy("hash", "function").agg(F.min("position").alias("position"))

    def sized(df: DataFrame) -> DataFrame:
        return df.join(df.groupBy("hash").agg(F.count(F.lit(1)).alias("n")), "hash")

    keys = keyed.KeySpec(("hash",), ("function",))
    flow = keyed.Pipeline.influx(table(spark, d, "snippets"), keys, keyed.Counters()).map(renamed, "renamed").shuffle(keys).run(sized)
    out = flow.map_and_efflux(keyed.identity)
    return out.select(hexed("hash").alias("hash"), hexed("function").alias("function"), "position", "n")


@query("""SELECT DISTINCT file_id, CASE WHEN path LIKE '%.java' THEN 'main' WHEN path IS NULL THEN 'unnamed' ELSE 'other' END AS output FROM code_files WHERE contents IS NOT NULL""")
def side_outputs(spark: SparkSession, d: str) -> DataFrame:
    """Files told apart by one mapper with two side outputs, which is computed once."""
    tag = F.when(F.col("path").endswith(".java"), "main").when(F.col("path").isNull(), "unnamed").otherwise("other")
    rows = table(spark, d, "code_files").filter("contents is not null").select("file_id", tag.alias("output"))
    main, sides = keyed.with_sides(rows, "output", ["other", "unnamed"], "main")
    out = main.withColumn("output", F.lit("main"))
    for name, side in sides.items():
        out = out.unionByName(side.withColumn("output", F.lit(name)))
    return out.distinct()


class _Lengths:
    def map(self, pdf):
        return pdf.assign(n=pdf["contents"].str.len().astype("int64"))[["file_id", "n"]]

    def close(self):
        pass


@query("SELECT DISTINCT file_id, length(contents)::BIGINT AS n FROM code_files WHERE contents IS NOT NULL")
def mapper_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    """Lengths by a mapper that is opened and closed once a task."""
    rows = table(spark, d, "code_files").filter("contents is not null").select("file_id", "contents")
    return keyed.per_partition(_Lengths, "file_id bigint, n bigint")(rows).distinct()


@query("SELECT lower(hex(hash)) AS hash, lower(hex(code_file)) AS code_file, coalesce(min(base_line), -1) AS base_line, sha1(min(contents)) AS text_hash FROM code_functions WHERE hash IS NOT NULL AND code_file IS NOT NULL GROUP BY ALL")
def encoded_cells(spark: SparkSession, d: str) -> DataFrame:
    """Functions as binary cells and back."""
    rows = table(spark, d, "code_functions").filter("hash is not null and code_file is not null").groupBy("hash", "code_file").agg(F.min("base_line").alias("base_line"), F.min("contents").alias("contents"))
    cells = keyed.encoded(rows, keyed.KeySpec(("hash",), ("code_file",)))
    back = keyed.decoded(cells, "hash binary, code_file binary, base_line int, contents string")
    return back.select(hexed("hash").alias("hash"), hexed("code_file").alias("code_file"), F.coalesce("base_line", F.lit(-1)).alias("base_line"), F.sha1(F.col("contents").cast("binary")).alias("text_hash"))


@query("SELECT 'all' AS stage, count(*)::BIGINT AS n_rows, count(hash)::BIGINT AS n_hashes FROM snippets WHERE hash IS NOT NULL AND function IS NOT NULL UNION ALL SELECT 'gapped', count(*), count(DISTINCT position) FROM snippets WHERE hash IS NOT NULL AND function IS NOT NULL AND clone_type = 3")
def stage_counters(spark: SparkSession, d: str) -> DataFrame:
    """What the counters of two stages saw while they ran."""
    counters = keyed.Counters()
    cells = SNIPPET_KEYS.cell(table(spark, d, "snippets"))
    seen = counters.observe(cells, "all", n_rows=F.count(F.lit(1)), n_hashes=F.count("hash"))
    gapped = counters.observe(seen.filter("clone_type = 3").groupBy("position").agg(F.count(F.lit(1)).alias("n")), "gapped", n_rows=F.sum("n"), n_hashes=F.count(F.lit(1)))
    gapped.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(stage, c["n_rows"], c["n_hashes"]) for stage, c in counters.report()], "stage string, n_rows bigint, n_hashes bigint")


@query("SELECT lower(hex(hash)) AS hash, min(name) AS name FROM projects WHERE hash IS NOT NULL AND name IS NOT NULL GROUP BY hash")
def installed_table(spark: SparkSession, d: str) -> DataFrame:
    """A table created, opened by its name and asked in SQL."""
    tables, keys = keyed.Tables(spark), keyed.KeySpec(("hash",), ("kind",), ("name",))
    made = table(spark, d, "projects").filter("name is not null").withColumn("kind", F.lit("project"))
    folder_ = folder(spark, "tables")
    tables.create("installed_projects", made, keys, folder_)
    tables.drop("installed_projects")
    tables.install("installed_projects", tables.open("installed_projects", keys, folder_).cells(), keys)
    return spark.sql("SELECT lower(hex(hash)) AS hash, name FROM installed_projects")


@query("SELECT n_regionkey::BIGINT AS region, n_name AS name, n_nationkey::BIGINT AS nation FROM nation")
def local_objects(spark: SparkSession, d: str) -> DataFrame:
    """A source of objects of the driver (the 25 nations), each given twice: the first wins."""
    rows = [(int(r["n_regionkey"]), r["n_name"], int(r["n_nationkey"])) for r in table(spark, d, "nation").collect()]
    return keyed.from_objects(spark, [*rows, *[(a, b, -1) for a, b, _ in rows]], "region bigint, name string, nation bigint", keyed.KeySpec(("region",), ("name",)))


@query("SELECT lower(hex(function)) AS function, min(position) AS position FROM snippets WHERE function IS NOT NULL AND clone_type IS NOT NULL AND clone_type = 1 GROUP BY function")
def written_efflux(spark: SparkSession, d: str) -> DataFrame:
    """The last map's cells, written to a folder and read back."""
    keys = keyed.KeySpec(("function",), ("clone_type",), ("position",))
    flow = keyed.Pipeline.influx(table(spark, d, "snippets"), keys)
    out = flow.map_and_efflux(lambda df: df.filter("clone_type = 1").select("function", "clone_type", "position"), folder(spark, "efflux"))
    return out.select(hexed("function").alias("function"), "position")


@query("SELECT (sum(length(l) + 1) OVER (ORDER BY l) - length(l) - 1)::BIGINT AS \"offset\", l AS contents FROM (SELECT n_name || ' ' || n_nationkey AS l FROM nation)")
def file_lines(spark: SparkSession, d: str) -> DataFrame:
    """The lines of a file (the 25 nations in order), with their byte offsets, by a Hadoop input format."""
    at = folder(spark, "lines")
    line = F.concat_ws(" ", "n_name", F.col("n_nationkey").cast("string")).alias("l")
    table(spark, d, "nation").select(line).coalesce(1).sortWithinPartitions("l").write.text(at)
    return files.lines_with_offsets(spark, at)


@query("SELECT n_regionkey::BIGINT AS region, string_agg(n_name, chr(10) ORDER BY n_name) || chr(10) AS content FROM nation GROUP BY n_regionkey")
def file_texts(spark: SparkSession, d: str) -> DataFrame:
    """Whole files as texts: one for each region, with its nations as lines."""
    at = folder(spark, "texts")
    rows = table(spark, d, "nation").select("n_regionkey", F.col("n_name").alias("l"))
    rows.repartition(1).sortWithinPartitions("n_regionkey", "l").write.partitionBy("n_regionkey").text(at)
    found = files.whole_texts(spark, at)
    return found.select(F.regexp_extract(F.input_file_name(), "n_regionkey=([0-9]+)", 1).cast("bigint").alias("region"), "content")


# --- normal forms and fingerprints


@query(f"WITH {S.FUNCTIONS} SELECT fn, {S.type1('c')} AS text FROM fns")
def normalize_type1(spark: SparkSession, d: str) -> DataFrame:
    return distinct_functions(spark, d).select(hexed("hash").alias("fn"), T.normalize_type1(F.col("contents")).alias("text"))


@query(f"WITH {S.FUNCTIONS} SELECT fn, {S.type2(S.type1('c'))} AS text FROM fns")
def normalize_type2(spark: SparkSession, d: str) -> DataFrame:
    return distinct_functions(spark, d).select(hexed("hash").alias("fn"), T.normalize_type2(T.normalize_type1(F.col("contents"))).alias("text"))


def _snippets(spark: SparkSession, d: str, kind: int) -> DataFrame:
    return snippets.snippets(distinct_functions(spark, d), kinds=(kind,)).select(hexed("function").alias("fn"), "position", "hash")


@query(f"WITH {S.FUNCTIONS}, {S.window_rows(S.type1('c'))} SELECT fn, position, sha1(w) AS hash FROM windows")
def snippets_literal(spark: SparkSession, d: str) -> DataFrame:
    return _snippets(spark, d, snippets.LITERAL)


@query(f"WITH {S.FUNCTIONS}, {S.window_rows(S.type2(S.type1('c')))} SELECT fn, position, sha1(w) AS hash FROM windows")
def snippets_renamed(spark: SparkSession, d: str) -> DataFrame:
    return _snippets(spark, d, snippets.RENAMED)


@query(f"WITH {S.FUNCTIONS}, {S.window_rows(S.type2(S.type1('c')))}, {S.gapped()} SELECT fn, position, s AS hash FROM sketched WHERE s IS NOT NULL")
def snippets_gapped(spark: SparkSession, d: str) -> DataFrame:
    return _snippets(spark, d, snippets.GAPPED)


@query(f"""WITH f AS (SELECT DISTINCT source, lang, sha1(text) AS h FROM documents WHERE text IS NOT NULL AND source IS NOT NULL AND lang IS NOT NULL),
v AS (SELECT source, lang, {S.xor_digest("h")} AS version_hash FROM f GROUP BY source, lang),
p AS (SELECT source, {S.xor_digest("version_hash")} AS project_hash FROM (SELECT DISTINCT source, version_hash FROM v) GROUP BY source)
SELECT v.source AS project_name, v.lang AS version_name, version_hash, project_hash FROM v JOIN p ON v.source = p.source""")
def xor_digests(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").filter("source is not null and lang is not null")
    rows = docs.select(F.col("source").alias("project_name"), F.col("lang").alias("version_name"), F.col("doc_id").cast("string").alias("path"), F.col("text").alias("contents"))
    made = snippets.populated(rows)
    versions, projects = made["versions"], made["projects"]
    out = versions.join(projects.select(F.col("hash").alias("project"), F.col("name").alias("project_name")), "project")
    return out.select("project_name", F.col("name").alias("version_name"), F.col("hash").alias("version_hash"), F.col("project").alias("project_hash")).distinct()


#: The splitter's pattern without what only keeps its search linear.
_HEADS = r"(?:[^\n]*[^.](?:class|interface)|\n(?:class|interface)|[a-zA-Z \[\]<>,]*\([a-zA-Z \[\]<>,]*\)[a-zA-Z \[\]<>,]*\{)[^\n]*"


@query(rf"""WITH f AS (SELECT row_number() OVER () AS r, file_id, contents AS t, regexp_extract_all(contents, '{_HEADS}') AS m, regexp_split_to_array(contents, '{_HEADS}') AS g FROM code_files WHERE path LIKE '%.java' AND contents IS NOT NULL),
u AS (SELECT r, t, unnest(m) AS m, unnest(list_transform(g[1 : len(m)], lambda x: length(x))) AS gap, generate_subscripts(m, 1) AS i FROM f WHERE len(m) > 0),
h AS (SELECT r, t, m, sum(gap + length(m)) OVER (PARTITION BY r ORDER BY i) - length(m) AS pos FROM u),
s AS (SELECT r, pos - CASE WHEN pos = 0 OR t[pos::BIGINT] = chr(10) THEN 0 ELSE length(regexp_extract(t[1 : pos::BIGINT], '[^\n]*$')) END AS start FROM h WHERE NOT regexp_matches(m, '\b(?:switch|while|if|for)\b\s*\(')),
b AS (SELECT r, 0 AS start FROM f UNION ALL SELECT r, start FROM s),
c AS (SELECT r, start, lead(start) OVER w AS stop FROM b WINDOW w AS (PARTITION BY r ORDER BY start)),
p AS (SELECT file_id, length(t[1 : start::BIGINT]) - length(replace(t[1 : start::BIGINT], chr(10), '')) AS base_line, CASE WHEN stop IS NULL THEN t[start::BIGINT + 1 :] ELSE t[start::BIGINT + 1 : stop::BIGINT] END AS chunk, stop FROM c JOIN f USING (r))
SELECT file_id, base_line::INTEGER AS base_line, sha1(chunk) AS fn FROM (SELECT *, {S.type1('chunk')} AS n FROM p) WHERE (base_line > 0 OR stop IS NULL) AND len(regexp_split_to_array(n, '\r\n|\r|\n')) >= 5""")
def tokenized_functions(spark: SparkSession, d: str) -> DataFrame:
    """Functions split from all Java files, by file."""
    java = table(spark, d, "code_files").filter(F.col("path").endswith(".java")).select("file_id", "contents")
    found = functions_of(spread(java), "file_id", "contents")
    return found.select(F.col("code_file").alias("file_id"), "base_line", hexed("hash").alias("fn"))


# --- clones


def _colliding(spark: SparkSession, d: str) -> DataFrame:
    return C.collisions(table(spark, d, "snippets"))


#: Lower than the default of 500, so that small tables have popular hashes too.
_POPULAR = 60


@query(f"WITH {S.COLLIDING} SELECT lower(hex(hash)) AS hash, lower(hex(function)) AS function, position, n::BIGINT AS n FROM colliding WHERE n >= {_POPULAR}")
def popular_snippets(spark: SparkSession, d: str) -> DataFrame:
    return C.popular_snippets(_colliding(spark, d), _POPULAR).select(hexed("hash").alias("hash"), hexed("function").alias("function"), "position", "n")


@query(f"WITH {S.COLLIDING}, {S.rough()} SELECT lower(hex(this_function)) AS this_function, lower(hex(that_function)) AS that_function, this_position, that_position, lower(hex(hash)) AS hash FROM rough")
def rough_pairs(spark: SparkSession, d: str) -> DataFrame:
    out = C.rough_pairs(_colliding(spark, d))
    return out.select(hexed("this_function").alias("this_function"), hexed("that_function").alias("that_function"), "this_position", "that_position", hexed("hash").alias("hash"))


@query(f"""WITH {S.COLLIDING}, keys AS (SELECT function, array_to_string(list_transform(range(0, octet_length(function)), lambda i: translate(substr(lower(hex(function)), 2 * i + 1, 1), '0123456789abcdef', '89abcdef01234567') || substr(lower(hex(function)), 2 * i + 2, 1)), '') AS o FROM (SELECT DISTINCT function FROM colliding)),
s AS (SELECT c.*, o FROM colliding c JOIN keys USING (function)),
r AS (SELECT a.function AS f, b.function AS g, a.position AS p, b.position AS q, hash, row_number() OVER (PARTITION BY a.function, b.function, a.position ORDER BY hash, b.position) AS r FROM s a JOIN s b USING (hash) WHERE a.n < 500 AND a.o < b.o)
SELECT lower(hex(f)) AS this_function, lower(hex(g)) AS that_function, p AS this_position, q AS that_position, lower(hex(hash)) AS hash FROM r WHERE r = 1""")
def rough_pairs_signed(spark: SparkSession, d: str) -> DataFrame:
    """With functions ordered by signed bytes."""
    out = C.rough_pairs(_colliding(spark, d), signed=True)
    return out.select(hexed("this_function").alias("this_function"), hexed("that_function").alias("that_function"), "this_position", "that_position", hexed("hash").alias("hash"))


@query(f"WITH {S.COLLIDING}, {S.rough(_POPULAR)}, {S.woven(_POPULAR)} SELECT lower(hex(this_function)) AS this_function, lower(hex(that_function)) AS that_function, this_position, that_position, lower(hex(hash)) AS hash FROM woven")
def woven_pairs(spark: SparkSession, d: str) -> DataFrame:
    colliding = _colliding(spark, d)
    out = C.woven_pairs(C.rough_pairs(colliding, _POPULAR), C.popular_snippets(colliding, _POPULAR))
    return out.select(hexed("this_function").alias("this_function"), hexed("that_function").alias("that_function"), "this_position", "that_position", hexed("hash").alias("hash"))


_CLONE_ROWS = "c AS (SELECT DISTINCT this.function AS a, that.function AS b FROM clones WHERE this.function IS NOT NULL AND that.function IS NOT NULL)"
_VOCABULARIES = rf"""WITH {S.FUNCTIONS}, {_CLONE_ROWS}, v AS (SELECT fn, list_distinct(regexp_extract_all(c, '[a-zA-Z][a-zA-Z0-9]*')) AS v FROM fns),
pairs AS (SELECT x.fn AS a, y.fn AS b, x.v AS va, y.v AS vb FROM c JOIN v x ON x.fn = lower(hex(c.a)) JOIN v y ON y.fn = lower(hex(c.b)))"""


def _clone_texts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "clones").select(F.col("this.function").alias("a"), F.col("that.function").alias("b")).filter("a is not null and b is not null").distinct()
    texts = distinct_functions(spark, d)
    return rows.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b")


@query(_VOCABULARIES + "SELECT a, b, round(len(list_intersect(va, vb)) / len(list_distinct(list_concat(va, vb))), 9) AS similarity FROM pairs")
def vocabulary_similarity(spark: SparkSession, d: str) -> DataFrame:
    sim = T.vocabulary_similarity(T.vocabulary(F.col("ta")), T.vocabulary(F.col("tb")))
    return _clone_texts(spark, d).select(hexed("a").alias("a"), hexed("b").alias("b"), F.round(sim, 9).alias("similarity"))


@query(_VOCABULARIES + f"SELECT a, b FROM pairs WHERE NOT coalesce({S.SPAM}, FALSE)")
def spam_filter(spark: SparkSession, d: str) -> DataFrame:
    kept = _clone_texts(spark, d).filter(~T.is_spam(F.col("ta"), F.col("tb")))
    return kept.select(hexed("a").alias("a"), hexed("b").alias("b"))


def _clones(spark: SparkSession, d: str, threshold: int = C.POPULAR) -> tuple[DataFrame, DataFrame]:
    """(clones of numbered functions, names)."""
    found, names = C.coded(_colliding(spark, d))
    return C.clone_classes(found, threshold).expanded(), names


def _fine(spark: SparkSession, d: str, threshold: int = C.POPULAR, strict: bool = False) -> DataFrame:
    clones, names = _clones(spark, d, threshold)
    strings = table(spark, d, "code_functions").filter("hash is not null and contents is not null").select(F.col("hash").alias("function"), "contents").join(names, "function").select(F.col("i").alias("hash"), "contents")
    return C.named(C.fine_clones(clones, strings, strict), names)


def _shown(clones: DataFrame) -> DataFrame:
    return clones.select(hexed("this_function").alias("this_function"), "this_position", "this_length", hexed("that_function").alias("that_function"), "that_position", "that_length")


def _listed(spark: SparkSession, d: str, threshold: int = C.POPULAR, by_class: bool = True) -> DataFrame:
    out = C.block_clones(table(spark, d, "snippets"), threshold, hexed, by_class)
    return out.select("this_function", "this_position", "this_length", "that_function", "that_position", "that_length")


@query(f"WITH RECURSIVE {S.COLLIDING}, {S.rough()}, {S.woven()}, {S.clones()} SELECT lower(hex(this_function)) AS this_function, this_position, this_length, lower(hex(that_function)) AS that_function, that_position, that_length FROM clones")
def expand_clones(spark: SparkSession, d: str) -> DataFrame:
    """Matches stitched to clones."""
    return _listed(spark, d)


@query(f"WITH RECURSIVE {S.COLLIDING}, {S.rough(_POPULAR)}, {S.woven(_POPULAR)}, {S.clones()} SELECT lower(hex(this_function)) AS this_function, this_position, this_length, lower(hex(that_function)) AS that_function, that_position, that_length FROM clones")
def expand_woven_clones(spark: SparkSession, d: str) -> DataFrame:
    """Clones where hashes of 60 functions or more are popular, so that small tables have such."""
    return _listed(spark, d, _POPULAR)


@query(f"WITH RECURSIVE {S.COLLIDING}, {S.rough(_POPULAR)}, {S.woven(_POPULAR)}, {S.clones()} SELECT lower(hex(this_function)) AS this_function, this_position, this_length, lower(hex(that_function)) AS that_function, that_position, that_length FROM clones")
def stitched_matches(spark: SparkSession, d: str) -> DataFrame:
    """The same from the matches of every two functions, without classes."""
    return _listed(spark, d, _POPULAR, by_class=False)


@query(f"WITH {S.COLLIDING}, {S.rough(_POPULAR)}, pop AS (SELECT * FROM colliding WHERE n >= {_POPULAR}), prof AS (SELECT function, string_agg(hex(hash) || ':' || position, ' ' ORDER BY hash) AS p FROM pop GROUP BY function) SELECT lower(hex(function)) AS function, lower(hex(min(function) OVER (PARTITION BY p))) AS class_function, function IN (SELECT this_function FROM rough) AS first FROM prof")
def clone_class_members(spark: SparkSession, d: str) -> DataFrame:
    """Functions with popular snippets, the smallest function of their class, and whether they may come first."""
    out = C.class_members(table(spark, d, "snippets"), _POPULAR)
    return out.select(hexed("function").alias("function"), hexed("class_function").alias("class_function"), "first")


@query(f"WITH RECURSIVE {S.FUNCTIONS}, {S.COLLIDING}, {S.rough()}, {S.woven()}, {S.clones()}, {S.fine()} SELECT this_function, this_position, this_length, that_function, that_position, that_length FROM fine")
def fine_clones(spark: SparkSession, d: str) -> DataFrame:
    return _shown(_fine(spark, d))


@query(f"WITH RECURSIVE {S.FUNCTIONS}, {S.COLLIDING}, {S.rough()}, {S.woven()}, {S.clones()}, {S.fine()}, {S.strict()} SELECT this_function, this_position, this_length, that_function, that_position, that_length FROM strict")
def fine_clones_strict(spark: SparkSession, d: str) -> DataFrame:
    """Up to the first failure of each function, in the order of the reference's passes."""
    return _shown(_fine(spark, d, strict=True))


@query("""SELECT DISTINCT lower(hex(f.hash)) AS function, lower(hex(c.hash)) AS code_file, lower(hex(v.hash)) AS version, lower(hex(p.hash)) AS project
FROM code_functions f JOIN code_files c ON f.code_file = c.hash JOIN versions v ON c.version = v.hash JOIN projects p ON v.project = p.hash WHERE f.hash IS NOT NULL""")
def occurrences(spark: SparkSession, d: str) -> DataFrame:
    out = C.occurrences(*[table(spark, d, t) for t in ("code_functions", "code_files", "versions", "projects")])
    return out.select(*[hexed(c).alias(c) for c in ("function", "code_file", "version", "project")])


@query("SELECT DISTINCT lower(hex(hash)) AS function, lower(hex(code_file)) AS code_file FROM code_functions f WHERE NOT EXISTS (SELECT 1 FROM code_files c WHERE c.hash = f.code_file AND c.path LIKE 'src/%')")
def missing_links(spark: SparkSession, d: str) -> DataFrame:
    """Functions whose file is not among those below src."""
    out = C.missing_links(table(spark, d, "code_functions"), table(spark, d, "code_files").filter("path like 'src/%'"))
    return out.select(hexed("hash").alias("function"), hexed("code_file").alias("code_file")).distinct()


@query("SELECT sha1(text) AS hash, n_groups, n_occurrences FROM (SELECT text, count(*)::BIGINT AS n_groups, sum(coalesce(len(occurrences), 0))::BIGINT AS n_occurrences FROM clone_groups WHERE text IS NOT NULL GROUP BY text)")
def group_text_keys(spark: SparkSession, d: str) -> DataFrame:
    """Stored groups under the SHA-1 of their text: those with equal texts are one."""
    rows = table(spark, d, "clone_groups").withColumn("grp", F.monotonically_increasing_id())
    merged = C.groups_by_text(rows).select("hash", "text", "n_groups")
    sizes = rows.groupBy("text").agg(F.sum(F.coalesce(F.size("occurrences"), F.lit(0))).alias("n_occurrences"))
    return merged.join(sizes, "text").select("hash", "n_groups", "n_occurrences")


def _links(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "clones").select(F.col("this.function").alias("this_function"), F.col("that.function").alias("that_function"))


@query(f"""WITH RECURSIVE {_CLONE_ROWS}, e AS (SELECT a, b FROM c UNION SELECT b, a FROM c), reach AS (SELECT a AS v, a AS w FROM e UNION SELECT r.v, e.b FROM reach r JOIN e ON r.w = e.a)
SELECT lower(hex(v)) AS function, lower(hex(min(w))) AS grp FROM reach GROUP BY v""")
def clone_groups(spark: SparkSession, d: str) -> DataFrame:
    return C.clone_groups(_links(spark, d)).select(hexed("function").alias("function"), hexed("grp").alias("grp"))


@query(f"""WITH RECURSIVE {_CLONE_ROWS}, e AS (SELECT a, b FROM c UNION SELECT b, a FROM c), reach AS (SELECT a AS v, a AS w FROM e UNION SELECT r.v, e.b FROM reach r JOIN e ON r.w = e.a),
g AS (SELECT v, min(w) AS grp FROM reach GROUP BY v)
SELECT DISTINCT lower(hex(grp)) AS grp, lower(hex(f.hash)) AS function, lower(hex(c.hash)) AS code_file, lower(hex(v.hash)) AS version, lower(hex(p.hash)) AS project
FROM g JOIN code_functions f ON f.hash = g.v JOIN code_files c ON f.code_file = c.hash JOIN versions v ON c.version = v.hash JOIN projects p ON v.project = p.hash""")
def group_occurrences(spark: SparkSession, d: str) -> DataFrame:
    found = C.occurrences(*[table(spark, d, t) for t in ("code_functions", "code_files", "versions", "projects")])
    out = C.group_occurrences(C.clone_groups(_links(spark, d)), found)
    return out.select(*[hexed(c).alias(c) for c in ("grp", "function", "code_file", "version", "project")])


@query(f"""WITH RECURSIVE {S.FUNCTIONS}, {S.COLLIDING}, {S.rough()}, {S.woven()}, {S.clones()}, {S.fine()},
e AS (SELECT this_function AS a, that_function AS b FROM fine UNION SELECT that_function, this_function FROM fine), reach AS (SELECT a AS v, a AS w FROM e UNION SELECT r.v, e.b FROM reach r JOIN e ON r.w = e.a), g AS (SELECT v, min(w) AS grp FROM reach GROUP BY v),
heads AS (SELECT grp, min({{'f': this_function, 't': that_function, 'p': this_position, 'n': this_length}}) AS c FROM fine JOIN g ON v = this_function GROUP BY grp)
SELECT grp, sha1(array_to_string(l[c.p + 1 : c.p + c.n], chr(10))) AS hash FROM heads JOIN texts ON fn = c.f""")
def clone_group_texts(spark: SparkSession, d: str) -> DataFrame:
    """The groups of the fine clones with their text's SHA-1."""
    clones = written(_fine(spark, d), "clones")
    return C.group_texts(clones, C.clone_groups(clones), distinct_functions(spark, d)).select(hexed("grp").alias("grp"), "hash")


# --- classifier (the table has 64 features, so training starts from zeros)

_DIMS = 64


def _training_lines(spark: SparkSession, d: str) -> DataFrame:
    """One text for each label: a line of features and 1 or 0 (whether the label is even)."""
    rows = table(spark, d, "embeddings").filter("embedding is not null and label is not null")
    line = F.concat_ws(" ", F.array_join(F.transform("embedding", lambda x: F.round(x.cast("double"), 4).cast("decimal(12,4)").cast("string")), " "), F.when(F.col("label") % 2 == 0, "1").otherwise("0"))
    return rows.groupBy("label").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", line.alias("l")))), lambda x: x["l"]), "\n").alias("text"))


_LINES = """ls AS (SELECT label, vec_id, array_to_string(list_transform(embedding, lambda x: round(x::DOUBLE, 4)::DECIMAL(12, 4)::VARCHAR), ' ') || CASE WHEN label % 2 = 0 THEN ' 1' ELSE ' 0' END AS line FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL),
sharded AS (SELECT DISTINCT ((row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) % 80)::INTEGER AS shard, line FROM ls)"""


@query(f"WITH {_LINES} SELECT shard, sha1(line) AS line_hash FROM sharded")
def line_shards(spark: SparkSession, d: str) -> DataFrame:
    return linear.line_shards(_training_lines(spark, d), "label", "text").select("shard", F.sha1(F.col("line").cast("binary")).alias("line_hash"))


def _instances(spark: SparkSession, d: str) -> DataFrame:
    features, label = linear.parse_instance(F.col("line"))
    return linear.line_shards(_training_lines(spark, d), "label", "text").select("shard", features.alias("features"), label.alias("label"))


@query(f"WITH {_LINES}, n AS (SELECT shard, list_transform(string_split(line, ' '), lambda x: x::DOUBLE) AS x FROM sharded) SELECT shard, round(list_sum(x[:-2]), 6) AS total, len(x) - 1 AS n_features, CASE WHEN x[-1] > 0.5 THEN 1 ELSE -1 END AS label FROM n")
def instance_parse(spark: SparkSession, d: str) -> DataFrame:
    total = F.aggregate("features", F.lit(0.0), lambda a, x: a + x)
    return _instances(spark, d).select("shard", F.round(total, 6).alias("total"), F.size("features").cast("bigint").alias("n_features"), "label")


@query()
def train_models(spark: SparkSession, d: str) -> DataFrame:
    """One model a shard, with the reference's 10,000 steps at most; weights rounded to 6 places."""
    models = linear.train(_instances(spark, d))
    return models.select("shard", F.transform("weights", lambda x: F.round(x, 6)).alias("weights"))


_STEPS = 25


@query(f"""WITH RECURSIVE {_LINES}, n AS (SELECT shard, list_transform(string_split(line, ' '), lambda x: x::DOUBLE) AS x FROM sharded),
i AS (SELECT shard, x[:-2] AS f, CASE WHEN x[-1] > 0.5 THEN 1 ELSE -1 END AS y, row_number() OVER (PARTITION BY shard ORDER BY x[:-2], x[-1]) AS r, count(*) OVER (PARTITION BY shard) AS c FROM n),
b AS (SELECT shard, list({{'f': f, 'y': y}} ORDER BY r) AS b FROM i WHERE r <= greatest(1, floor(0.02 * c + 0.5)) GROUP BY shard),
w AS (SELECT shard, b, list_transform(range(0, {_DIMS}), lambda j: 0.0::DOUBLE) AS w, 0 AS step, FALSE AS done FROM b
UNION ALL SELECT shard, b, list_transform(range(1, {_DIMS} + 1), lambda j: w[j] - g[j]), step + 1, list_sum(list_transform(g, lambda v: v * v)) < 1e-8 FROM (
  SELECT *, list_transform(range(1, {_DIMS} + 1), lambda j: list_sum(list_transform(s, lambda t: t.f[j] * t.e * t.k)) / list_sum(list_transform(s, lambda t: t.k))) AS g FROM (
    SELECT *, list_transform(z, lambda t: {{'f': t.f, 'e': 1 / (1 + exp(-t.z)) - (t.y + 1) * 0.5, 'k': CASE WHEN t.z >= 0 AND t.y < 0 THEN 4.0 ELSE 1.0 END}}) AS s FROM (
      SELECT *, list_transform(b, lambda t: {{'f': t.f, 'y': t.y, 'z': list_dot_product(t.f, w)}}) AS z FROM w WHERE step < {_STEPS} AND NOT done))))
SELECT shard, list_transform(w, lambda x: round(x, 6)) AS weights FROM (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY step DESC) AS last FROM w) WHERE last = 1""")
def train_few_steps(spark: SparkSession, d: str) -> DataFrame:
    """The same rule for 25 steps, which SQL can follow."""
    models = linear.train(_instances(spark, d), iterations=_STEPS)
    return models.select("shard", F.transform("weights", lambda x: F.round(x, 6)).alias("weights"))


@query("SELECT i::INTEGER AS i, round(avg(embedding[i + 1]::DOUBLE), 6) AS weight FROM (SELECT embedding, unnest(range(0, len(embedding))) AS i FROM embeddings) GROUP BY i")
def model_average(spark: SparkSession, d: str) -> DataFrame:
    models = table(spark, d, "embeddings").select(F.transform("embedding", lambda x: x.cast("double")).alias("weights"))
    return linear.model_average(models).select("i", F.round("weight", 6).alias("weight"))


_FIXED = "list_transform(range(0, 64), lambda i: CASE WHEN i % 2 = 0 THEN 1.0 ELSE -0.5 END)"


@query(f"SELECT vec_id, CASE WHEN list_sum(list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE * {_FIXED}[i]::DOUBLE)) >= 0 THEN 1 ELSE -1 END AS predicted FROM embeddings WHERE embedding IS NOT NULL")
def classify(spark: SparkSession, d: str) -> DataFrame:
    weights = F.transform(F.sequence(F.lit(0), F.lit(_DIMS - 1)), lambda i: F.when(i % 2 == 0, 1.0).otherwise(-0.5))
    rows = table(spark, d, "embeddings").filter("embedding is not null")
    return rows.select("vec_id", linear.classify(weights, F.transform("embedding", lambda x: x.cast("double"))).alias("predicted"))


@query(f"SELECT label, count(*)::BIGINT AS n FROM (SELECT label, list_sum(list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE * {_FIXED}[i]::DOUBLE)) AS s FROM embeddings WHERE embedding IS NOT NULL) WHERE s >= 0 AND label % 2 = 1 GROUP BY label")
def misclassified(spark: SparkSession, d: str) -> DataFrame:
    truth = table(spark, d, "embeddings").select("vec_id", F.col("label").alias("c"), F.when(F.col("label") % 2 == 0, 1).otherwise(-1).alias("label"))
    return linear.misclassified(classify(spark, d).join(truth, "vec_id")).groupBy(F.col("c").alias("label")).agg(F.count(F.lit(1)).alias("n"))


# --- small rankings and sources


def _repositories(spark: SparkSession, d: str) -> DataFrame:
    """Files as candidate addresses of the document's source."""
    docs = table(spark, d, "documents").filter("source is not null")
    url = F.concat(F.lit("http://host/"), "source", F.lit("/"), F.coalesce("category", F.lit("x")), F.lit("/"), F.col("doc_id").cast("string"))
    return docs.select(F.col("source").alias("name"), F.coalesce("lang", F.lit("git")).alias("type"), url.alias("url"), "doc_id")


@query(r"""WITH r AS (SELECT source AS name, coalesce(lang, 'git') AS type, 'http://host/' || source || '/' || coalesce(category, 'x') || '/' || doc_id AS url, doc_id FROM documents WHERE source IS NOT NULL),
n AS (SELECT *, regexp_replace(lower(name), '[^a-z]', '', 'g') AS a, regexp_replace(lower(url), '[^a-z]', '', 'g') AS b FROM r),
s AS (SELECT *, (CASE WHEN regexp_matches(url, '(?i)src|source|core|standard|build|master') THEN 75 ELSE 0 END + CASE WHEN NOT regexp_matches(url, '(?i)doc|docs|extras|extra|tool|tools|test|testing') THEN -75 ELSE 0 END
  + (CASE WHEN a = '' THEN length(b) + 1 ELSE (length(b) - length(replace(b, a, ''))) // length(a) END) * 10 + 1000 // length(url) + CASE WHEN regexp_matches(type, '(?i)git') THEN 100 ELSE 0 END)::INTEGER AS score FROM n)
SELECT name, type, url, score FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score DESC, doc_id) AS k FROM s) WHERE k = 1""")
def best_repository(spark: SparkSession, d: str) -> DataFrame:
    return etl.best_repositories(_repositories(spark, d), "doc_id")


@query("""SELECT event_id, event_type AS name, ((value * 1000)::BIGINT // 1000)::VARCHAR AS duration, json_extract_string(props, '$.k') AS state FROM events WHERE value IS NOT NULL AND props IS NOT NULL""")
def job_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Events dressed as job reports, read back."""
    events = table(spark, d, "events").filter("value is not null and props is not null")
    job = F.struct(F.col("event_type").alias("name"), F.lit(0).cast("bigint").alias("startTime"), F.rint(F.col("value") * 1000).cast("bigint").alias("finishTime"), F.get_json_object("props", "$.k").alias("state"))
    reports = events.select("event_id", F.to_json(F.struct(job.alias("job"))).alias("json"))
    return etl.job_statistics(reports, "json", "event_id").select("event_id", "name", "duration", "state")


@query("SELECT DISTINCT lower(hex(project)) AS repo, lower(hex(hash)) AS sha, name FROM versions WHERE project IS NOT NULL AND hash IS NOT NULL AND name IS NOT NULL AND name <> '' AND name NOT LIKE '%' || chr(10) || '%' AND name NOT LIKE '%' || chr(13) || '%'")
def packed_references(spark: SparkSession, d: str) -> DataFrame:
    """Versions written as packed references of their project, between comments, peeled and remote ones, and parsed back."""
    rows = table(spark, d, "versions").filter("project is not null and hash is not null and name is not null and name <> ''").filter(~F.col("name").rlike(r"[\r\n]"))
    sha = hexed("hash")
    line = F.concat(sha, F.when(F.length("name") > 8, F.lit(" refs/tags/")).otherwise(F.lit(" refs/heads/")), "name", F.lit("\n^"), sha, F.lit("\n"), sha, F.lit(" refs/remotes/origin/"), "name")
    refs = rows.groupBy(hexed("project").alias("repo")).agg(F.concat(F.lit("# pack-refs with: peeled\n"), F.array_join(F.collect_list(line), "\r\n")).alias("text"))
    return files.packed_refs(refs, "repo", "text").distinct()


@query("""SELECT path, place, CASE place WHEN 'plain' THEN path ELSE project END AS project FROM (
SELECT DISTINCT path, place, regexp_extract(path, '([^/]+)\\.[^./]*$', 1) AS project FROM code_files, (VALUES ('plain'), ('git'), ('bare')) AS p(place) WHERE path LIKE '%/%.%') WHERE project <> ''""")
def project_names(spark: SparkSession, d: str) -> DataFrame:
    """Names of repositories that lie at the files' places: in a work tree, bare, and no repository at all."""
    rows = table(spark, d, "code_files").filter("path like '%/%.%'").select("path", F.regexp_extract("path", r"([^/]+)\.[^./]*$", 1).alias("stem")).distinct().filter("stem <> ''")
    rows = rows.select("path", "stem", F.explode(F.array(F.lit("plain"), F.lit("git"), F.lit("bare"))).alias("place"))
    at = F.when(F.col("place") == "git", F.concat(F.lit("repos/"), "stem", F.lit("/.git/objects/pack/a.pack"))).when(F.col("place") == "bare", F.concat(F.lit("repos/"), "stem", F.lit("/objects/pack/a.pack"))).otherwise(F.col("path"))
    return rows.select("path", "place", files.project_name(at).alias("project"))


_PLAYS = "plays AS (SELECT doc_id, 'Prologue ' || replace(replace(text, chr(10) || chr(10), chr(10) || 'ACT IV' || chr(10)), '. ', '. ACT XI ') AS play FROM documents WHERE text IS NOT NULL)"


@query(rf"""WITH {_PLAYS} SELECT DISTINCT doc_id, (i - 1)::INTEGER AS number, sha1(p[i]) AS content_hash FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT doc_id, regexp_split_to_array(play, '\bACT\s[IVX]+') AS p FROM plays))""")
def acts(spark: SparkSession, d: str) -> DataFrame:
    """Documents as plays: an act begins at each paragraph and sentence."""
    play = F.concat(F.lit("Prologue "), F.replace(F.replace("text", F.lit("\n\n"), F.lit("\nACT IV\n")), F.lit(". "), F.lit(". ACT XI ")))
    found = files.acts(table(spark, d, "documents").select("doc_id", play.alias("play")), "play", "doc_id")
    return found.select("doc_id", "number", F.sha1(F.col("content").cast("binary")).alias("content_hash")).distinct()


@query(r"""WITH t AS (SELECT DISTINCT file_id, contents FROM code_files WHERE contents IS NOT NULL AND contents NOT LIKE chr(65279) || '%')
SELECT file_id, v AS written, CASE v WHEN 'UTF-16LE' THEN v WHEN 'UTF-16BE' THEN v WHEN 'UTF-8 with mark' THEN 'UTF-8' ELSE CASE WHEN strlen(contents) = length(contents) THEN 'US-ASCII' ELSE 'UTF-8' END END AS charset
FROM t, (VALUES ('UTF-8'), ('UTF-8 with mark'), ('UTF-16LE'), ('UTF-16BE')) AS e(v)""")
def charsets(spark: SparkSession, d: str) -> DataFrame:
    """The guessed encodings of each file's bytes, as they are and written in three more ways."""
    rows = table(spark, d, "code_files").filter("contents is not null").filter(~F.col("contents").startswith("﻿")).select("file_id", "contents").distinct()
    marked = F.concat(F.lit("﻿"), F.col("contents"))
    forms = {"UTF-8": F.encode("contents", "UTF-8"), "UTF-8 with mark": F.encode(marked, "UTF-8"), "UTF-16LE": F.encode(marked, "UTF-16LE"), "UTF-16BE": F.encode(marked, "UTF-16BE")}
    each = rows.select("file_id", F.explode(F.array(*[F.struct(F.lit(k).alias("written"), v.alias("raw")) for k, v in forms.items()])).alias("e")).select("file_id", "e.*")
    return each.select("file_id", "written", guess_charset("raw").alias("charset"))


@query(r"""SELECT doc_id, "offset", line_hash FROM (SELECT doc_id, text, i, sha1(l) AS line_hash, (sum(strlen(l) + 1) OVER (PARTITION BY doc_id, text ORDER BY i) - strlen(l) - 1)::BIGINT AS "offset" FROM (
SELECT doc_id, text, unnest(p) AS l, generate_subscripts(p, 1) AS i FROM (SELECT DISTINCT doc_id, text, string_split(CASE WHEN text LIKE '%' || chr(10) THEN text[:-2] ELSE text END, chr(10)) AS p FROM documents WHERE text IS NOT NULL AND text <> '')))""")
def line_offsets(spark: SparkSession, d: str) -> DataFrame:
    """The lines of each document with the byte at which they begin."""
    out = files.text_line_offsets(table(spark, d, "documents").select("doc_id", "text").distinct(), "doc_id", "text")
    return out.select(F.col("key").alias("doc_id"), "offset", F.sha1(F.col("contents").cast("binary")).alias("line_hash"))
