"""Problem 2: files that are not hand-written source, by layout statistics first, then by path and head.

Layout statistics of the whole text (mean and maximum line length, shares of white space, letters and digits, numeric literals,
encoded runs, repeated and numbered lines) are held against thresholds tuned per language. What they leave open, the
place in the tree and the comments before the first declaration tell: generated and third-party files of ordinary layout.
Each verdict names its source.
"""

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.operators.skew import spread

#: Thresholds by language. Minified: a mean line above mean_line, or a longest line above max_line that holds most of the text,
#: with white space below white and letters and digits below dense (prose on one line has more). Data: numeric literals among
#: words above numeric, or a share of the text in encoded runs above encoded.
LAYOUT = {
    "js": {"mean_line": 160, "max_line": 500, "white": 0.09, "dense": 0.93, "numeric": 0.5, "encoded": 0.4},
    "java": {"mean_line": 300, "max_line": 2000, "white": 0.08, "dense": 0.93, "numeric": 0.42, "encoded": 0.4},
    "py": {"mean_line": 300, "max_line": 2000, "white": 0.08, "dense": 0.93, "numeric": 0.55, "encoded": 0.4},
    "ts": {"mean_line": 160, "max_line": 500, "white": 0.09, "dense": 0.93, "numeric": 0.5, "encoded": 0.4},
    "css": {"mean_line": 160, "max_line": 500, "white": 0.07, "dense": 0.93, "numeric": 0.7, "encoded": 0.5},
    "c": {"mean_line": 300, "max_line": 2000, "white": 0.08, "dense": 0.93, "numeric": 0.5, "encoded": 0.4},
    "sh": {"mean_line": 300, "max_line": 2000, "white": 0.08, "dense": 0.93, "numeric": 0.6, "encoded": 0.4},
    # numbers, encoded values and long lines are what formats for data are for: only text packed into encoded runs counts
    "json": {"mean_line": None, "max_line": None, "white": 0, "dense": 1, "numeric": None, "encoded": 0.9},
    "xml": {"mean_line": None, "max_line": None, "white": 0, "dense": 1, "numeric": None, "encoded": 0.9},
}
OTHER = {"mean_line": 300, "max_line": 2000, "white": 0.08, "dense": 0.93, "numeric": 0.6, "encoded": 0.5}
#: Further formats for data, which have the thresholds of JSON.
DATA_FORMATS = frozenset(["json", "xml", "properties", "csv", "tsv", "txt", "md", "yml", "yaml", "html", "svg", "sql", "lock", "log", "ini", "cfg", "toml"])

#: Directories by convention, outside the package part of a path.
GENERATED_DIRS = frozenset(["gen", "generated", "generated-sources", "generated-src", "src-gen", "src-generated", "autogen"])
VENDOR_DIRS = frozenset(["vendor", "vendors", "vendored", "third_party", "third-party", "thirdparty", "3rdparty", "external", "externals", "deps", "contrib", "node_modules", "bower_components", "lib", "libs"])

#: What tools write into the head of their output, in several languages.
GENERATED_HEAD = re.compile(
    r"""@generated\b|<auto-?generated|@(?:javax\.annotation\.(?:processing\.)?)?Generated\b|\bauto-?\s?generated\b|\b(?:was|is|code|file|class|automatically|been|sources?)?\s*generated\s+(?:by|from|with|using)\b|\bcode\s+generated\b
|\bdo\s+not\s+(?:edit|modify|change|touch)\b|\bnot\s+for\s+editing\b|\bmachine-(?:made|generated|written)\b|\bregenerate\s+with\b|\b(?:changes|edits?|modifications)\b[^.\n]*\b(?:lost|overwritten)\b
|\bautomatisch\s+(?:erzeugt|generiert|erstellt)|\b(?:généré|créé)e?s?\s+automatiquement|\bautomatiquement\s+générée?|\bgenerad[oa]\s+autom[áa]ticamente|\bgerad[oa]\s+automaticamente|\bwygenerowan\w*\s+automatycznie|\bautomaticky\s+(?:vy)?generován|\bсгенерирован|\bсоздан\w*\s+автоматически|自动生成|自動生成""",
    re.IGNORECASE | re.VERBOSE,
)
#: What marks a copy of somebody else's file.
VENDOR_HEAD = re.compile(
    r"""\bvendored\s+(?:copy|from|version)\b|\bcopied\s+(?:verbatim\s+)?from\b|\bsee\s+upstream\b|\bimported\s+from\s+upstream\b|\btaken\s+from\s+the\s+\S+\s+(?:sources?|distribution|project|library)\b|@license\b|\bbased\s+on\s+upstream\b
|\bv\d+(?:\.\d+)+\s+(?:\(c\)|©|\|)|^\W*[\w.-]+\s+v?\d+(?:\.\d+){1,3}\W*\n\W*(?:distributed|released|licensed)\s+under\b""",
    re.IGNORECASE | re.VERBOSE | re.MULTILINE,
)
QUOTED = re.compile(r"\"[^\"\n]*\"|'[^'\n]*'|`[^`\n]*`")
#: The first declaration ends the head.
DECLARATION = re.compile(r"^[ \t]*(?:(?:public|protected|private|abstract|final|static|strictfp)\s+)*(?:class|interface|enum|@interface|def|function|async|export|module)\b|^[ \t]*(?:var|let|const|if|for|while|return|try|with|[\w$.]+\s*=|\{|\[|<[a-zA-Z])", re.MULTILINE)
COMMENT = re.compile(r"/\*[\s\S]*?\*/|//[^\n]*|^[ \t]*#[^\n]*|<!--[\s\S]*?-->|^[ \t]*@[\w.]+[^\n]*", re.MULTILINE)
FAMILY = re.compile(r"\b[a-zA-Z]+_\d+\s*\(|_FIELD_NUMBER\s*=|\bbitField\d+_|\bcase\s+\d+:\s*return\s+-?\d+;")
NUMBER = re.compile(r"\b(?:0[xX][0-9a-fA-F]+|\d[\d_]*(?:\.\d+)?(?:[eE][+-]?\d+)?)[lLfFdD]?\b")
WORD = re.compile(r"\w+(?:\.\d+)?")
#: Long encoded runs: base64 of 60 characters or more, hex digits of 32 or more, escapes of 8 bytes or more.
ENCODED = re.compile(r"[A-Za-z0-9+/=]{60,}|(?<![A-Za-z0-9])[0-9a-f]{32,}(?![A-Za-z0-9])|(?<![A-Za-z0-9])[0-9A-F]{32,}(?![A-Za-z0-9])|(?:\\x[0-9a-fA-F]{2}){8,}|(?:\\[0-7]{3}){8,}|(?:\\u[0-9a-fA-F]{4}){8,}")
WHITE, DIGITS = b" \t\r\n\f\v", b"0123456789"
ALNUM = bytes(range(48, 58)) + bytes(range(65, 91)) + bytes(range(97, 123))
SOURCE_ROOT = re.compile(r"(?:^|/)(?:src/)?(?:main/|test/)?(?:java|resources|kotlin|scala)/")


def extension(path: str | None) -> str:
    name = (path or "").rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[-1].lower() if "." in name else ""


def place(path: str | None) -> str | None:
    """generated, vendored or None, by the directories outside the package part of a path (the first two where there is no source root)."""
    dirs = (path or "").split("/")[:-1]
    m = SOURCE_ROOT.search(path or "")
    outer = (path or "")[: m.start()].split("/") + m.group().split("/") if m else dirs[:2]
    outer = {x.lower() for x in outer}
    if outer & VENDOR_DIRS:
        return "vendored"
    return "generated" if outer & GENERATED_DIRS else None


def head(text: str) -> str:
    """The comments and annotations before the first declaration, without what stands in quotes."""
    masked = COMMENT.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text) if text.lstrip()[:1] not in "{[<" else text
    m = DECLARATION.search(masked)
    end = m.start() if m else len(text)
    return QUOTED.sub(" ", "\n".join(x.group() for x in COMMENT.finditer(text[:end] + "\n")))


def layout(text: str) -> dict[str, float]:
    """Statistics of the whole text, on its UTF-8 bytes; lines of one character or none do not count as lines."""
    raw = text.encode("utf-8", "replace")
    n = max(len(raw), 1)
    lines = raw.split(b"\n")
    if lines and not lines[-1]:
        lines.pop()
    filled = [x for x in map(len, lines) if x > 1] or [0]
    return {
        "chars": len(raw),
        "max_line": max(filled),
        "mean_line": sum(filled) / len(filled),
        "white": 1 - len(raw.translate(None, WHITE)) / n,
        "alnum": 1 - len(raw.translate(None, ALNUM)) / n,
        "digits": 1 - len(raw.translate(None, DIGITS)) / n,
        "lines": len(filled),
    }


def by_layout(ext: str, text: str, s: dict[str, float]) -> str | None:
    """data, minified or generated by the layout statistics alone."""
    limits = LAYOUT.get(ext) or (LAYOUT["json"] if ext in DATA_FORMATS else OTHER)
    if limits["numeric"] and s["digits"] > 0.1:
        words = len(WORD.findall(text))
        if words > 40 and len(NUMBER.findall(text)) > limits["numeric"] * words:
            return "data"
    # runs of letters and digits are looked for only where these prevail; escapes wherever there is a backslash
    if s["alnum"] > 0.72 or "\\x" in text or "\\u" in text or "\\0" in text:
        if sum(map(len, ENCODED.findall(text))) > limits["encoded"] * s["chars"]:
            return "data"
    if limits["mean_line"] and s["chars"] > 200 and s["white"] < limits["white"] and s["alnum"] < limits["dense"]:
        if s["mean_line"] > limits["mean_line"] or s["max_line"] > limits["max_line"] and s["max_line"] > 0.5 * s["chars"]:
            return "minified"
    if ext == "java" and ("_FIELD_NUMBER" in text or "(int c)" in text or "bitField" in text):
        if sum(1 for line in text.split("\n") if FAMILY.search(line)) > 0.25 * s["lines"]:
            return "generated"
    return None


def verdict(path: str | None, text: str) -> tuple[str | None, str | None]:
    """(kind, source): generated, minified, vendored or data, and layout, path or head; (None, None) for hand-written source (and for empty texts)."""
    s, ext = layout(text), extension(path)
    if s["chars"] and (found := by_layout(ext, text, s)):
        return found, "layout"
    if where := place(path):
        return where, "path"
    top = head(text) if s["chars"] else ""
    if top:
        if VENDOR_HEAD.search(top):
            return "vendored", "head"
        if GENERATED_HEAD.search(top):
            return "generated", "head"
    return None, None


def kind(path: str | None, text: str) -> str | None:
    return verdict(path, text)[0]


def _classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [verdict(p, t or "") for p, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([v[k] for v in found], pa.string()) for k in (0, 1))], ["id", "kind", "source"])


def file_kinds(files: DataFrame, key: str, path: str, text: str) -> DataFrame:
    """(id, kind, source) of each row: generated, minified, vendored, data, or null for hand-written source; by layout, path or head.

    Works row by row, in one pass over the whole texts, without any exchange. A null path tells nothing, a null text is
    judged by its path only; a null key is kept, repeated rows come repeatedly; other columns are not read.
    """
    rows = files.select(F.col(key).alias("id"), F.col(path).alias("path"), F.col(text).alias("text"))
    return spread(rows).mapInArrow(_classify, f"id {files.schema[key].dataType.simpleString()}, kind string, source string")


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [layout(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([s[k] for s in found], t) for k, t in STATISTICS.items())], ["id", *STATISTICS])


STATISTICS = {"chars": pa.int64(), "lines": pa.int64(), "max_line": pa.int64(), "mean_line": pa.float64(), "white": pa.float64(), "alnum": pa.float64(), "digits": pa.float64()}


def layouts(files: DataFrame, key: str, text: str) -> DataFrame:
    """(id, chars, lines, max_line, mean_line, white, alnum, digits): the layout statistics of each row with a text, in bytes of UTF-8."""
    rows = files.select(F.col(key).alias("id"), F.col(text).alias("text")).filter("text is not null")
    return spread(rows).mapInArrow(_statistics, f"id {files.schema[key].dataType.simpleString()}, chars bigint, lines bigint, max_line bigint, mean_line double, white double, alnum double, digits double")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """file_id of files that are not hand-written source."""
    found = file_kinds(spark.read.parquet(f"{d}/code_files.parquet"), "file_id", "path", "contents")
    return found.filter("kind is not null and id is not null").select(F.col("id").alias("file_id")).distinct()


def p2_kinds(spark: SparkSession, d: str) -> DataFrame:
    """kind, source, n_files: distinct files of each kind, by what told it; hand-written ones under 'source'."""
    found = file_kinds(spark.read.parquet(f"{d}/code_files.parquet"), "file_id", "path", "contents").filter("id is not null")
    one = found.groupBy("id").agg(F.max(F.struct("kind", "source")).alias("v"))
    return one.groupBy(F.coalesce("v.kind", F.lit("source")).alias("kind"), F.coalesce("v.source", F.lit("none")).alias("source")).agg(F.count(F.lit(1)).alias("n_files"))


def p2_layout(spark: SparkSession, d: str) -> DataFrame:
    """file_id and the layout statistics that lead the verdicts, shares rounded to 6 places."""
    found = layouts(spark.read.parquet(f"{d}/code_files.parquet").filter("file_id is not null"), "file_id", "contents")
    return found.select(F.col("id").alias("file_id"), "chars", "lines", "max_line", *[F.round(c, 6).alias(c) for c in ("mean_line", "white", "alnum", "digits")]).distinct()


QUERIES = {"p2_found": p2_found, "p2_kinds": p2_kinds, "p2_layout": p2_layout}
SQL = {
    "p2_layout": r"""
WITH f AS (SELECT DISTINCT file_id, contents AS c, strlen(contents) AS n, list_filter(list_transform(string_split(contents, chr(10)), lambda x: strlen(x)), lambda x: x > 1) AS l FROM code_files WHERE contents IS NOT NULL AND file_id IS NOT NULL)
SELECT DISTINCT file_id, n::BIGINT AS chars, greatest(len(l), 1)::BIGINT AS lines, coalesce(list_max(l), 0)::BIGINT AS max_line, round(coalesce(list_sum(l) / len(l), 0), 6) AS mean_line,
  round(1 - strlen(regexp_replace(c, '[ \t\r\n\f\v]', '', 'g')) / greatest(n, 1), 6) AS white, round(1 - strlen(regexp_replace(c, '[A-Za-z0-9]', '', 'g')) / greatest(n, 1), 6) AS alnum, round(1 - strlen(regexp_replace(c, '[0-9]', '', 'g')) / greatest(n, 1), 6) AS digits
FROM f"""
}
