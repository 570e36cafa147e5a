"""Files as tables: whole files, lines, acts, packed references, pack indexes, Git trees."""

import subprocess
import tempfile
import time
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The limit of a pack file, the time for a repository in seconds, and the patterns of references, paths and act headings.
MOST_PACK_BYTES = 500 * 1048576
MOST_SECONDS = 900
REFERENCE = r"^([a-f0-9]{40}) refs/(?:tags|heads)/(.+)$"
PROJECT = (r"^.+?/([^/]+)/.git/.*$", r"^.+?/([^/]+)/objects/.*$")
ACT = r"\bACT\s[IVX]+"


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content): the bytes of each file in a directory, not below it."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "content")


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, content): each file of a directory as UTF-8 text."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file_name"), F.col("value").alias("content"))


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_number, contents): numbers are unique and ascend within a file's splits, but have gaps; no task counts all lines."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("line_number"), F.col("value").alias("contents"))


def lines_with_offsets(spark: SparkSession, path: str) -> DataFrame:
    """(offset, contents): each line with the byte at which it begins in its file, from splits of files of any size."""
    return input_format(spark, path, "org.apache.hadoop.mapreduce.lib.input.TextInputFormat", "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.Text", "offset bigint, contents string")


def input_format(spark: SparkSession, path: str, format_class: str, key_class: str, value_class: str, schema: str, conf: dict | None = None) -> DataFrame:
    """The (key, value) records of any Hadoop file input format, under the two names and types of the schema. For formats that spark.read has none for."""
    records = spark.sparkContext.newAPIHadoopFile(path, format_class, key_class, value_class, conf=conf)
    return spark.createDataFrame(records, schema)


def keyed_records(records: DataFrame) -> DataFrame:
    """(row, col, contents): each record a row of its own, its key both row and column key."""
    key, value = records.columns
    return records.select(F.col(key).cast("string").cast("binary").alias("row"), F.col(key).cast("string").cast("binary").alias("col"), F.col(value).cast("binary").alias("contents"))


def text_line_offsets(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, offset, contents): the lines of texts in a column, with the byte of the text's UTF-8 at which each begins. A newline at the end begins no line; null texts have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, t in zip(pdf.iloc[:, 0], pdf.iloc[:, 1]):
                at = 0
                for line in t.removesuffix("\n").split("\n") if t else ():
                    rows.append((k, at, line))
                    at += len(line.encode("utf-8", "surrogatepass")) + 1
            yield pd.DataFrame(rows, columns=["key", "offset", "contents"])

    kind = texts.schema[key].dataType.simpleString()
    return texts.select(key, text).filter(F.col(text).isNotNull()).mapInPandas(run, f"key {kind}, offset bigint, contents string")


def acts(plays: DataFrame, text: str, *keys: str) -> DataFrame:
    """(keys, number, content): the pieces between act headings, from 0; null texts have none."""
    return plays.select(*keys, F.posexplode(F.split(text, ACT, -1)).alias("number", "content"))


def packed_refs(refs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, sha, name) of heads and tags; peeled, remote and comment lines are no references."""
    line = REFERENCE
    rows = refs.select(key, F.explode(F.split(text, "\r?\n", -1)).alias("line")).filter(F.col("line").rlike(line))
    return rows.select(key, F.regexp_extract("line", line, 1).alias("sha"), F.regexp_extract("line", line, 2).alias("name"))


def project_name(path: Column) -> Column:
    """The directory that holds .git or objects, else the whole path."""
    found = [F.nullif(F.regexp_extract(path, p, 1), F.lit("")) for p in PROJECT]
    return F.coalesce(*found, path)


def pack_index(spark: SparkSession, path: str) -> DataFrame:
    """(length, path) of all pack files below a directory."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.pack").option("recursiveFileLookup", True).load(path)
    return found.select("length", "path")


def git_repositories(spark: SparkSession, path: str) -> DataFrame:
    """(repository, pack_path, pack_length, pack, packed_refs) of bare repositories below a directory: what git_files() takes.

    A repository with no pack file or several, or with one above MOST_PACK_BYTES, raises when it is read. The pack's bytes are read only
    where they are asked for.
    """
    base = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    packs = base.option("pathGlobFilter", "*.pack").load(path).select(F.regexp_extract("path", r"^(.*)/objects/pack/[^/]+$", 1).alias("repository"), F.col("path").alias("pack_path"), F.col("length").alias("pack_length"), F.col("content").alias("pack"))
    refs = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "packed-refs").load(path)
    refs = refs.select(F.regexp_extract("path", r"^(.*)/packed-refs$", 1).alias("repository"), F.decode("content", "UTF-8").alias("packed_refs"))
    one = packs.groupBy("repository").agg(F.count(F.lit(1)).alias("n"), F.max("pack_length").alias("most"))
    sound = (F.col("n") == 1) & (F.col("most") <= MOST_PACK_BYTES)
    checked = refs.join(one, "repository", "left").withColumn("n", F.when(F.coalesce(sound, F.lit(False)), F.col("n")).otherwise(F.raise_error(F.concat(F.lit("one pack file of at most 500 MB expected in "), F.col("repository"))).cast("bigint")))
    return checked.filter("n = 1").join(packs, "repository").select("repository", "pack_path", "pack_length", "pack", "packed_refs")


COUNTERS = ("killed", "processed_files", "missing_objects")


class _Repository:
    """One repository unpacked into a folder of the task, which nothing else reads, and walked by the git program."""

    def __init__(self, folder: str, pack: bytes, refs: str, seconds: float):
        self.git, self.end = ["git", "-C", folder], time.monotonic() + seconds
        self.call("init", "-q", "--bare", ".")
        # objects that a damaged pack lacks are missed where they are needed
        self.call("unpack-objects", "-q", "-r", input=pack, check=False)
        Path(folder, "packed-refs").write_text(refs)
        self.reader = None

    def left(self) -> float:
        rest = self.end - time.monotonic()
        if rest <= 0:
            raise subprocess.TimeoutExpired("git", 0)
        return rest

    def call(self, *args: str, input: bytes | None = None, check: bool = True) -> subprocess.CompletedProcess:
        return subprocess.run([*self.git, *args], input=input, capture_output=True, check=check, timeout=self.left())

    def tree(self, sha: str, suffix: str) -> list[tuple[str, str]] | None:
        """(blob, path) of the files with the suffix; None if an object is missing."""
        out = self.call("ls-tree", "-r", "-z", sha, check=False)
        if out.returncode:
            return None
        entries = (e.partition("\t") for e in out.stdout.decode("utf-8", "replace").split("\0") if e)
        return [(head.split(" ")[2], path) for head, _, path in entries if path.endswith(suffix)]

    def blob(self, sha: str) -> bytes | None:
        """By one process for the whole repository."""
        self.left()
        if self.reader is None:
            self.reader = subprocess.Popen([*self.git, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE)
        self.reader.stdin.write(sha.encode() + b"\n")
        self.reader.stdin.flush()
        head = self.reader.stdout.readline().split()
        if head[-1] == b"missing":
            return None
        out = self.reader.stdout.read(int(head[2]))
        self.reader.stdout.read(1)
        return out

    def close(self) -> None:
        if self.reader:
            self.reader.kill()
            self.reader.communicate()


def _walk(suffix: str, seconds: float, most_bytes: int = 64 << 20):
    columns = ["kind", "project_name", "version_name", "path", "content", "n"]

    def repository(name: str, pack: bytes, refs: str) -> Iterator[tuple]:
        """Files, then the counters. Time runs out: killed, and nothing counts as processed. A missing object ends its version only."""
        seen, repo = dict.fromkeys(COUNTERS, 0), None
        with tempfile.TemporaryDirectory() as tmp:
            try:
                repo = _Repository(tmp, pack, refs, seconds)
                for ref in refs.splitlines():
                    sha, _, ref_name = ref.partition(" ")
                    if not ref_name.startswith(("refs/heads/", "refs/tags/")):
                        continue
                    entries = repo.tree(sha, suffix)
                    if entries is None:
                        seen["missing_objects"] += 1
                        continue
                    for blob, path in entries:
                        content = repo.blob(blob)
                        if content is None:
                            seen["missing_objects"] += 1
                            break
                        seen["processed_files"] += 1
                        yield "file", name, ref_name.split("/", 2)[2], path, content, 1
            except subprocess.TimeoutExpired:
                seen = {"killed": 1, "processed_files": 0, "missing_objects": seen["missing_objects"]}
            finally:
                if repo:
                    repo.close()
        for counter, n in seen.items():
            yield counter, name, None, None, None, n

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, size = [], 0
        for pdf in batches:
            for name, pack, refs in zip(pdf["repository"], pdf["pack"], pdf["packed_refs"]):
                for row in repository(name, bytes(pack), refs):
                    rows.append(row)
                    size += len(row[4] or b"")
                    if size > most_bytes:
                        yield pd.DataFrame(rows, columns=columns)
                        rows, size = [], 0
        yield pd.DataFrame(rows, columns=columns)

    return run


def git_walk(repositories: DataFrame, suffix: str = ".java", seconds: float = MOST_SECONDS) -> DataFrame:
    """(kind, project_name, version_name, path, content, n) of (repository, pack, packed_refs) rows: files, and a row for each of COUNTERS and repository.

    One repository at a time in a task, at most `seconds` each: one that takes longer is given up with the files found so far and counts as killed.
    A version with a missing object ends there; the files before it stay.
    """
    return repositories.select("repository", "pack", "packed_refs").mapInPandas(_walk(suffix, seconds), "kind string, project_name string, version_name string, path string, content binary, n bigint")


def git_files(repositories: DataFrame, suffix: str = ".java", seconds: float = MOST_SECONDS) -> tuple[DataFrame, DataFrame]:
    """((project_name, version_name, path, content), (counter, n)): the files of git_walk() and the sums of its counters, from one run."""
    from keyloom.operators.keyed import with_sides

    files, sides = with_sides(git_walk(repositories, suffix, seconds), "kind", COUNTERS, "file")
    counters = None
    for name, rows in sides.items():
        total = rows.select(F.lit(name).alias("counter"), "n")
        counters = total if counters is None else counters.unionByName(total)
    return files.drop("n"), counters.groupBy("counter").agg(F.sum("n").alias("n"))
