"""Problem 5: source files that do not parse in the language their path declares.

Texts of Java, ECMAScript and JSON are lexed in chunks of whole lines, whatever their length. A chunk is a map from each
lexer state before it to the state after it and the classes of its tokens; its bracket summary (closers without openers, then
openers without closers) tells early what can never fit. Balanced statements are judged by local grammars as soon as they are
complete, and reduced. Maps compose associatively, so the chunks of a text are folded in any grouping: in the task that
read the text, or by several tasks for a long one. Python and XML are judged by the parsers that come with Python.
"""

import ast
import sys
import warnings
from collections.abc import Iterator
from functools import reduce
from itertools import groupby
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm import java_grammar as java
from keyloom.llm import json_grammar as json
from keyloom.llm import script_grammar as script
from keyloom.operators.skew import spread

LANGUAGES = ["java", "py", "js", "json", "xml"]
BRACES = ["java", "js", "json"]
#: Characters of a chunk.
CHUNK = 8192
#: The chunks of longer texts are spread over several tasks.
SPREAD = 4_000_000
#: Nested brackets that are followed; a text with more gets no verdict (null) rather than a wrong one. The frames lie on the heap, some 1 KB a level.
DEEPEST = 200_000
MARK = "﻿"


def declared(path: Column) -> Column:
    """The language that the extension of a path declares, else null."""
    ext = F.regexp_extract(path, r"\.([a-z]+)$", 1)
    return F.when(ext.isin(LANGUAGES), ext)


def bracket_summary(classes: str) -> tuple[str, str] | None:
    """(closers that lack an opener, openers that lack a closer); None if a pair does not fit."""
    closers, openers = [], []
    for m in java.BRACKETS.finditer(classes):
        c = m.group()
        if c in "([{":
            openers.append(c)
        elif not openers:
            closers.append(c)
        elif java.CLOSE[openers.pop()] != c:
            return None
    return "".join(closers), "".join(openers)


def join_summaries(a: tuple[str, str] | None, b: tuple[str, str] | None) -> tuple[str, str] | None:
    """The summary of two chunks in a row."""
    if a is None or b is None:
        return None
    n = min(len(a[1]), len(b[0]))
    if any(java.CLOSE[x] != y for x, y in zip(reversed(a[1]), b[0][:n])):
        return None
    return a[0] + b[0][n:], a[1][: len(a[1]) - n] + b[1]


def depth(classes: str) -> int:
    """The deepest nesting of brackets."""
    now = most = 0
    for m in java.BRACKETS.finditer(classes):
        now += 1 if m.group() in "([{" else -1
        most = max(most, now)
    return most


def python_parses(text: str) -> bool | None:
    """None where the parser runs out of memory or depth."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            compile(text, "file", "exec", ast.PyCF_ONLY_AST, dont_inherit=True)
    except (MemoryError, RecursionError):
        return None
    except (SyntaxError, ValueError):
        return False
    return True


def xml_parses(text: str) -> bool:
    try:
        expat.ParserCreate().Parse(text, True)
    except (expat.ExpatError, ValueError):
        return False
    return True


Entry = tuple[object, str]


class Judge:
    """Chunk maps, their composition and the verdict on a whole text, for the brace languages; library parsers for the others."""

    def __init__(self):
        self.classes, self.grammar = java.Classes(), java.Grammar()
        self.start = {"java": java.NORMAL, "js": (False, False), "json": 0}
        self.plain = sys.getrecursionlimit()

    def chunk(self, language: str, text: str) -> dict[object, Entry]:
        """state before -> (state after, reduced classes)."""
        if language == "json":
            found = {0: (0, json.lex(text))}
        else:
            found = java.chunk_map(text, self.classes) if language == "java" else script.chunk_map(text)
        kept: dict[str, str] = {}
        return {s: (after, kept.get(c) or kept.setdefault(c, self.settled(language, c))) for s, (after, c) in found.items()}

    def settled(self, language: str, classes: str) -> str:
        """Classes reduced; # alone if their brackets can never fit."""
        if language == "java":
            classes = self.grammar.reduced(classes)
        elif language == "json":
            classes = json.reduced(classes)
        return "#" if bracket_summary(classes) is None else classes

    def compose(self, language: str, a: dict[object, Entry], b: dict[object, Entry]) -> dict[object, Entry]:
        """The map of two chunks in a row."""
        out: dict[object, Entry] = {}
        for s, (middle, first) in a.items():
            after, second = b[middle]
            out[s] = after, first + second
        return out

    def fold(self, language: str, maps: list[dict[object, Entry]]) -> dict[object, Entry]:
        """The composition of maps in a row, settled once at the end; any grouping gives the same verdict."""
        whole = reduce(lambda a, b: self.compose(language, a, b), maps)
        return whole if len(maps) == 1 else {s: (after, self.settled(language, c)) for s, (after, c) in whole.items()}

    def from_start(self, language: str, maps: list[dict[object, Entry]]) -> Entry:
        """The fold for the state in which a text begins."""
        state, parts = self.start[language], []
        for m in maps:
            state, classes = m[state]
            parts.append(classes)
        return state, parts[0] if len(parts) == 1 else self.settled(language, "".join(parts))

    def verdict(self, language: str, end: Entry) -> bool | None:
        """Whether a whole text with this end state and these classes parses."""
        state, classes = end
        if state == java.COMMENT and language == "java" or language == "js" and state[0]:
            return False
        if language == "json":
            return json.check(classes)
        levels = depth(classes)
        if levels > DEEPEST:
            return None
        sys.setrecursionlimit(self.plain + 2000 + 12 * levels + 4 * classes.count("E") + 4 * classes.count("?"))
        try:
            return self.grammar.check(classes) if language == "java" else script.check(classes)
        except RecursionError:
            return None
        finally:
            sys.setrecursionlimit(self.plain)

    def __call__(self, language: str, text: str, chunk: int = CHUNK) -> bool | None:
        text = text.removeprefix(MARK)
        if language not in BRACES:
            return python_parses(text) if language == "py" else xml_parses(text)
        maps = [self.chunk(language, piece) for piece in chunks(text, chunk)]
        return self.verdict(language, self.from_start(language, maps) if maps else (self.start[language], ""))


def chunks(text: str, size: int) -> Iterator[str]:
    """Pieces of about `size` characters, cut after newlines that no backslash precedes."""
    at = 0
    while at < len(text):
        end = at + size
        while True:
            end = text.find("\n", end) + 1 or len(text)
            if end == len(text) or not text[max(0, end - 3) : end - 1].removesuffix("\r").endswith("\\"):
                break
        yield text[at:end]
        at = end


def _judge(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge()
        for batch in batches:
            verdicts = [judge(g, t, size) for g, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(verdicts, pa.bool_())], ["id", "lang", "valid"])

    return run


def _split(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, lang, text in zip(*(batch.column(c).to_pylist() for c in range(3))):
                for no, piece in enumerate(chunks(text.removeprefix(MARK), size)):
                    yield pa.RecordBatch.from_pydict({"name": [name], "lang": [lang], "no": pa.array([no], pa.int32()), "piece": [piece]})

    return run


def _states(language: str) -> tuple:
    return {"java": java.STATES, "js": script.STATES, "json": (0,)}[language]


def _fold_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Successive pieces of a text that one task holds, folded to one map: rows (name, lang, first piece, state before, state after, classes), states by number."""
    judge = Judge()

    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in range(4)))

    def shown(name: str, lang: str, first: int, maps: list) -> pa.RecordBatch:
        states = _states(lang)
        whole = judge.fold(lang, maps)
        out = [(name, lang, first, states.index(s), states.index(after), c) for s, (after, c) in whole.items()]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string()))], ["name", "lang", "first", "before", "after", "classes"])

    def run_of(item: tuple) -> tuple:
        nth, (name, lang, no, _) = item
        return name, lang, no - nth

    for (name, lang, _), group in groupby(enumerate(rows()), run_of):
        first, maps = None, []
        for _, (_, _, no, piece) in group:
            first = no if first is None else first
            maps.append(judge.chunk(lang, piece))
            if len(maps) == 64:
                maps = [judge.fold(lang, maps)]
        yield shown(name, lang, first, maps)


def _finish(key, pdf):
    """The verdict on a text from the maps of its runs."""
    import pandas as pd

    judge, lang = Judge(), key[1]
    states = _states(lang)
    runs: dict[int, dict] = {}
    for first, before, after, classes in zip(pdf["first"], pdf["before"], pdf["after"], pdf["classes"]):
        runs.setdefault(int(first), {})[states[int(before)]] = states[int(after)], classes
    valid = judge.verdict(lang, judge.from_start(lang, [runs[k] for k in sorted(runs)]))
    return pd.DataFrame({"name": [key[0]], "lang": [lang], "valid": pd.array([valid], dtype="boolean")})


def parse_verdicts(files: DataFrame, key: str, path: str, text: str, chunk: int = CHUNK, spread_chars: int = SPREAD) -> DataFrame:
    """(id, lang, valid) of each row with a text and a declared language.

    Rows without a language or with a null text are no cases; a null key is kept, repeated rows come repeatedly; an empty
    text is a valid Java, Python or script file and no valid JSON or XML; other columns are not read. Syntax only. Whole
    texts are judged, whatever their length, by one rule: chunk maps, composed. valid is null where brackets are nested more than
    DEEPEST deep, or Python's own parser gives up.

    Texts of spread_chars characters or less are folded by the task that reads them, without any exchange. The chunks of longer ones are
    range-partitioned, each task folds the chunks it holds, and the folded maps, reduced to what is still open, meet by text.
    """
    rows = files.select(F.col(key).alias("id"), declared(F.col(path)).alias("lang"), F.col(text).alias("text")).filter("lang is not null and text is not null")
    kind = files.schema[key].dataType.simpleString()
    is_long = F.col("lang").isin(BRACES) & (F.length("text") > spread_chars)
    short = spread(rows.filter(~is_long)).mapInArrow(_judge(chunk), f"id {kind}, lang string, valid boolean")
    long = rows.filter(is_long).withColumn("name", F.sha2("text", 256))
    pieces = long.select("name", "lang", "text").mapInArrow(_split(chunk), "name string, lang string, no int, piece string").dropDuplicates(["name", "lang", "no"])
    ordered = pieces.repartitionByRange("name", "lang", "no").sortWithinPartitions("name", "lang", "no")
    runs = ordered.mapInArrow(_fold_runs, "name string, lang string, first int, before int, after int, classes string")
    folded = runs.groupBy("name", "lang").applyInPandas(_finish, "name string, lang string, valid boolean")
    return short.unionByName(long.select("id", "lang", "name").join(folded, ["name", "lang"]).select("id", "lang", "valid"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """file_id of files that do not parse."""
    found = parse_verdicts(spark.read.parquet(f"{d}/code_files.parquet"), "file_id", "path", "contents")
    return found.filter("not valid and id is not null").select(F.col("id").alias("file_id")).distinct()


def p5_spread(spark: SparkSession, d: str) -> DataFrame:
    """The rows of p5_found with chunks of 300 characters, and those of texts above 2,000 folded by several tasks."""
    found = parse_verdicts(spark.read.parquet(f"{d}/code_files.parquet"), "file_id", "path", "contents", 300, 2000)
    return found.filter("not valid and id is not null").select(F.col("id").alias("file_id")).distinct()


def p5_rates(spark: SparkSession, d: str) -> DataFrame:
    """project_name, lang, n_files, n_invalid, rate: distinct files of each project name (null if unknown) and language."""
    files = spark.read.parquet(f"{d}/code_files.parquet").filter("file_id is not null")
    verdicts = parse_verdicts(files, "file_id", "path", "contents").groupBy("id", "lang").agg(F.max(~F.col("valid")).alias("bad"))
    versions = spark.read.parquet(f"{d}/versions.parquet").filter("hash is not null").groupBy(F.col("hash").alias("version")).agg(F.min("project").alias("project"))
    projects = spark.read.parquet(f"{d}/projects.parquet").filter("hash is not null").groupBy(F.col("hash").alias("project")).agg(F.min("name").alias("project_name"))
    of = files.groupBy(F.col("file_id").alias("id")).agg(F.min("version").alias("version")).join(versions, "version", "left").join(projects, "project", "left")
    out = verdicts.join(of, "id").groupBy("project_name", "lang").agg(F.count(F.lit(1)).alias("n_files"), F.sum(F.col("bad").cast("bigint")).alias("n_invalid"))
    return out.withColumn("rate", F.round(F.col("n_invalid") / F.col("n_files"), 6))


def p5_json(spark: SparkSession, d: str) -> DataFrame:
    """file_id, valid: the verdicts on JSON files, which SQL has too; with small chunks, so that files have several."""
    files = spark.read.parquet(f"{d}/code_files.parquet").filter("path like '%.json' and file_id is not null")
    return parse_verdicts(files, "file_id", "path", "contents", 200).select(F.col("id").alias("file_id"), "valid").distinct()


QUERIES = {"p5_found": p5_found, "p5_spread": p5_spread, "p5_json": p5_json, "p5_rates": p5_rates}
SQL = {"p5_json": "SELECT DISTINCT file_id, json_valid(contents) AS valid FROM code_files WHERE path LIKE '%.json' AND contents IS NOT NULL AND file_id IS NOT NULL"}
