"""Functions to line-window fingerprints, and the hierarchy of projects, versions, files and functions."""

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.functions import text as T
from keyloom.functions.tokenizer import functions_of

LITERAL, RENAMED, GAPPED = 1, 2, 3


def _windows(df: DataFrame, clone_type: int, normal: str) -> DataFrame:
    parts = df.select("function", T.lines(F.col(normal)).alias("lines")).filter(F.size("lines") >= T.MINIMUM_LINES)
    at = parts.select("function", "lines", F.explode(F.sequence(F.lit(0), F.size("lines") - T.MINIMUM_LINES)).alias("position"))
    window = T.get_lines(F.col("lines"), F.col("position"), T.MINIMUM_LINES)
    return at.select(F.sha1(window.cast("binary")).alias("hash"), "function", "position", F.lit(clone_type).alias("clone_type"), F.lit(T.MINIMUM_LINES).alias("length"))


_RUN = re.compile(T.SHINGLE)


def _shingles(window: str) -> set[str]:
    """As text.shingles(): the runs counted from the first four tokens are, where no token is empty, all runs of four."""
    tokens = window.split(" ")
    if len(window[1:].split(" ")) <= 4:
        return set()
    if "" not in tokens:
        return {" ".join(tokens[i : i + 4]) for i in range(len(tokens) - 3)}
    pieces = window[1:].split(" ")
    return {x for start in (window, *(" ".join(pieces[k:]) for k in (1, 2, 3))) for x in _RUN.findall(start)}


class _Digests(dict):
    """shingle -> its SHA-1 as a number; emptied when large."""

    def __missing__(self, shingle: str) -> int:
        if len(self) > 300_000:
            self.clear()
        h = self[shingle] = int.from_bytes(hashlib.sha1(shingle.encode("utf-8", "surrogatepass")).digest())
        return h


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hash, function, position) of each window: text.sketch() over arrays, since neighbouring windows share nearly all their shingles."""
    digests, n = _Digests(), T.MINIMUM_LINES
    for batch in batches:
        at, position, hashes = [], [], []
        for i, text in enumerate(batch.column(1).to_pylist()):
            lines = text.split("\n") if text is not None else []
            if text is not None and text.endswith("\n"):
                lines.pop()
            for p in range(len(lines) - n + 1):
                window = ("\n" if p else "") + "\n".join(lines[p : p + n]) + "\n"
                found = [digests[x] for x in _shingles(window)]
                for mask in (3, 1, 0):
                    value = 0
                    for h in found:
                        if h >> 152 & mask == mask:
                            value ^= h
                    if value:
                        at.append(i)
                        position.append(p)
                        hashes.append(f"{value:040x}")
                        break
        yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.string()), batch.column(0).take(pa.array(at, pa.int64())), pa.array(position, pa.int32())], ["hash", "function", "position"])


def _gapped(df: DataFrame) -> DataFrame:
    kind = df.schema["function"].dataType.simpleString()
    out = df.select("function", "type2").mapInArrow(_sketches, f"hash string, function {kind}, position int")
    return out.select("hash", "function", "position", F.lit(GAPPED).alias("clone_type"), F.lit(T.MINIMUM_LINES).alias("length"))


def snippets(functions: DataFrame, key: str = "hash", contents: str = "contents", kinds: tuple[int, ...] = (LITERAL, RENAMED, GAPPED)) -> DataFrame:
    """(hash hex, function, position, clone_type, length): every window of five lines of each function, in up to three forms.

    LITERAL hashes the type-1 normal form, RENAMED the type-2 form, GAPPED is a shingle sketch of the type-2 form.
    Texts of fewer than five lines, and null ones, have no windows; a window with too few tokens has no sketch. One projection a
    form; no exchange.
    """
    normal = functions.select(F.col(key).alias("function"), T.normalize_type1(F.col(contents)).alias("type1")).withColumn("type2", T.normalize_type2(F.col("type1")))
    out = None
    for kind in kinds:
        part = _gapped(normal) if kind == GAPPED else _windows(normal, kind, "type1" if kind == LITERAL else "type2")
        out = part if out is None else out.unionByName(part)
    return out


def populated(files: DataFrame, with_functions: bool = False) -> dict[str, DataFrame]:
    """projects, versions, code_files (and functions, strings and snippets) of (project_name, version_name, path, contents) rows.

    A file's hash is the SHA-1 of its contents; a version's is the exclusive or of its distinct file hashes, a project's
    that of its distinct version hashes. Versions without files and projects without versions do not appear. The digests
    are aggregates of bit lanes, combined on the map side. with_functions splits each distinct contents once into functions
    (hash, code_file, contents, base_line), each distinct function text once (strings) and its windows once (snippets): what the
    reference's caches of written files and functions are for.
    """
    hashed = files.filter("contents is not null").withColumn("hash", F.sha1(F.col("contents").cast("binary")))
    of = ["project_name", "version_name"]
    versions = hashed.select(*of, "hash").distinct().groupBy(*of).agg(T.xor_digest(F.col("hash")).alias("version_hash"))
    projects = versions.select("project_name", "version_hash").distinct().groupBy("project_name").agg(T.xor_digest(F.col("version_hash")).alias("project_hash"))
    named = versions.join(projects, "project_name")
    out = {
        "projects": projects.select(F.col("project_hash").alias("hash"), F.col("project_name").alias("name")),
        "versions": named.select(F.col("version_hash").alias("hash"), F.col("project_hash").alias("project"), F.col("version_name").alias("name")),
        "code_files": hashed.join(versions, of).select("hash", F.col("version_hash").alias("version"), "path", "contents").distinct(),
    }
    if with_functions:
        texts = hashed.groupBy("hash").agg(F.min("contents").alias("contents"))
        functions = functions_of(texts, "hash", "contents").select(F.lower(F.hex("hash")).alias("hash"), "code_file", "contents", "base_line")
        strings = functions.groupBy("hash").agg(F.min("contents").alias("contents"))
        out |= {"functions": functions, "strings": strings, "snippets": snippets(strings)}
    return out
