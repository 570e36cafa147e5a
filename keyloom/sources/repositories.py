"""Repositories fetched by the git program into a folder, from which files.git_repositories() reads them."""

import re
import shutil
import subprocess
import uuid
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.operators import etl
from keyloom.sources import files
from keyloom.store import written

#: Seconds for one repository.
MOST_SECONDS = 600


def _git(*args: str, seconds: float) -> bool:
    try:
        return subprocess.run(["git", *args], capture_output=True, timeout=seconds, stdin=subprocess.DEVNULL).returncode == 0
    except subprocess.TimeoutExpired:
        return False


def _tidy(path: str, seconds: float) -> bool:
    """One pack file, and all references packed, as the reader wants it."""
    return all(_git("-C", path, *step, seconds=seconds) for step in (("gc", "--quiet"), ("repack", "-a", "-d", "-q"), ("pack-refs", "--all")))


def _one(folder: str, name: str, url: str, seconds: float) -> str:
    target = Path(folder, name)
    if target.exists():
        got = _git("-C", str(target), "fetch", "--quiet", url, "+refs/heads/*:refs/heads/*", "+refs/tags/*:refs/tags/*", seconds=seconds) and _tidy(str(target), seconds)
        return "updated" if got else "failed"
    # a clone appears under its name when it is whole, so a task that is run again, or twice, does no harm
    part = Path(folder, f".{name}-{uuid.uuid4().hex}")
    try:
        if not (_git("clone", "--quiet", "--bare", "--", url, str(part), seconds=seconds) and _tidy(str(part), seconds)):
            return "failed"
        try:
            part.rename(target)
        except OSError:
            return "updated" if target.exists() else "failed"
        return "cloned"
    finally:
        shutil.rmtree(part, ignore_errors=True)


def _fetch(folder: str, seconds: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for name, kind, url in zip(pdf["name"], pdf["type"], pdf["url"]):
                outcome = "skipped" if "git" not in (kind or "").lower() else _one(folder, name, url, seconds)
                rows.append((name, url, f"{folder}/{name}", outcome))
            yield pd.DataFrame(rows, columns=["name", "url", "path", "outcome"])

    return run


def fetch(repositories: DataFrame, folder: str, seconds: float = MOST_SECONDS) -> DataFrame:
    """(name, url, path, outcome) of (name, type, url) rows: bare clones below a folder, which all executors must see at the same path (a mount).

    Names are reduced to letters; of several repositories with one name the smallest address is taken, and rows without a name or address are left
    out. outcome: cloned, updated (it was there), failed (within `seconds`), or skipped: what is no Git repository, which has no
    equivalent here.
    """
    letters = F.regexp_replace("name", "[^A-Za-z]", "")
    rows = repositories.select(letters.alias("name"), "type", F.trim("url").alias("url")).filter("name <> '' and url <> ''")
    one = rows.groupBy("name").agg(F.min(F.struct("url", "type")).alias("r")).select("name", "r.type", "r.url")
    return one.mapInPandas(_fetch(folder, seconds), "name string, url string, path string, outcome string")


def fetched(spark: SparkSession, listing: DataFrame, folder: str, column: str = "value", seconds: float = MOST_SECONDS) -> tuple[DataFrame, DataFrame]:
    """(outcomes, repositories) of a listing of (name, type, url) lines: the best repository of each name, fetched, then read as files.git_repositories() does."""
    lines = etl.repository_lines(listing, column).withColumn("nth", F.monotonically_increasing_id())
    outcomes = written(fetch(etl.best_repositories(lines, "nth"), folder, seconds), "fetched")
    return outcomes, files.git_repositories(spark, folder)


def merged_properties(cluster: str, node: str) -> str:
    """One XML configuration of two lists of properties; the node's come first."""
    head = '<?xml version="1.0"?>\n<?xml-stylesheet type="text/xsl" href="configuration.xsl"?>\n<configuration>\n<!-- merged; edit the sources -->'
    return "\n".join([head, "<!-- node -->", node.rstrip("\n"), "<!-- cluster -->", cluster.rstrip("\n"), "</configuration>\n"])


def merged_settings(cluster: str, node: str) -> str:
    """One shell file of two lists of settings; the node's come last, so that they hold."""
    return "\n".join(["# merged; edit the sources", "# cluster", cluster.rstrip("\n"), "# node", node.rstrip("\n"), ""])


def properties(text: str) -> dict[str, str]:
    """name -> value of a merged XML configuration; the first of equal names holds."""
    found: dict[str, str] = {}
    for m in re.finditer(r"<property>\s*<name>(.*?)</name>\s*<value>(.*?)</value>", text, re.DOTALL):
        found.setdefault(m.group(1).strip(), m.group(2).strip())
    return found
