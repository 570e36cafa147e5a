"""Source files to functions: chunks between lines that look like a method or type head."""

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.functions.text import MINIMUM_LINES, count_lines, normalize_type1

#: The characters around a method head's parentheses.
_HEAD = r"[a-zA-Z \[\]<>,]"
#: A line that names a class or interface after any character but a dot (the line's own, or the newline before it), or a
#: method head up to its brace; then the rest of the line. The longest match wins in the original automaton: of the type forms
#: that is the one which crosses a newline, and it is tried first. Both begin as far left as they can, at a line's start and
#: at the start of a run of head characters; looking for them only there keeps the search linear.
SPLITTER = re.compile(rf"(?:(?<![^\n])[^\n]*[^.](?:class|interface)|\n(?:class|interface)|(?<!{_HEAD}){_HEAD}*+\({_HEAD}*+\){_HEAD}*+\{{)[^\n]*")
CONTROL = re.compile(r"\b(?:switch|while|if|for)\b\s*\(", re.ASCII)


def split_functions(text: str) -> list[tuple[int, str]]:
    """(base line, contents) of each chunk. What comes before the first head, and chunks while no line is counted yet, are dropped; the last chunk always counts."""
    out: list[tuple[int, str]] = []
    line = begin = 0
    for m in SPLITTER.finditer(text):
        if CONTROL.search(m.group()):
            continue
        start = m.start()
        if start and text[start - 1] != "\n":
            start = text.rfind("\n", 0, start) + 1
        chunk = text[begin:start]
        if line > 0:
            out.append((line, chunk))
        begin = start
        line += chunk.count("\n")
    return [*out, (line, text[begin:])]


def _tokenize(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(k, line, part) for k, text in zip(pdf.iloc[:, 0], pdf.iloc[:, 1]) if text is not None for line, part in split_functions(text)]
        yield pd.DataFrame(rows, columns=["code_file", "base_line", "contents"])


def functions_of(files: DataFrame, key: str, text: str) -> DataFrame:
    """(code_file, base_line, contents, hash): functions with at least MINIMUM_LINES lines in normal form; the hash is of the raw contents.

    Null texts have none, equal rows come repeatedly. Keys keep their type.
    """
    kind = files.schema[key].dataType.simpleString()
    parts = files.select(key, text).mapInPandas(_tokenize, f"code_file {kind}, base_line int, contents string")
    kept = parts.filter(count_lines(normalize_type1(F.col("contents"))) >= MINIMUM_LINES)
    return kept.withColumn("hash", F.unhex(F.sha1(F.col("contents").cast("binary"))))
