"""Small rankings and exports."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _letters(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z]", "")


def repository_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """(name, type, url) of blank-separated lines, without what stands in "(via ...)"."""
    parts = F.split(F.trim(F.regexp_replace(column, r"\(via.*?\)", "")), r"\s+")
    return lines.select(*[F.try_element_at(parts, F.lit(i + 1)).alias(n) for i, n in enumerate(("name", "type", "url"))])


def repository_score(name: Column, kind: Column, url: Column, strict: bool = True) -> Column:
    """How likely a repository is a project's main one. strict keeps the reference's inverted penalty: 75 less if the address does NOT speak of docs, extras, tools or tests."""
    good = F.when(url.rlike("(?i)src|source|core|standard|build|master"), 75).otherwise(0)
    other = url.rlike("(?i)doc|docs|extras|extra|tool|tools|test|testing")
    bad = F.when(~other if strict else other, -75).otherwise(0)
    plain = _letters(name)
    repeats = F.when(F.length(plain) > 0, F.size(F.split(_letters(url), plain, -1)) - 1).otherwise(F.length(_letters(url)) + 1)
    return good + bad + repeats * 10 + F.floor(F.lit(1000) / F.greatest(F.length(url), F.lit(1))).cast("int") + F.when(kind.rlike("(?i)git"), 100).otherwise(0)


def best_repositories(repositories: DataFrame, order: str, strict: bool = True) -> DataFrame:
    """The highest score of each name; the first by `order` among equals. Rows without a name or url are left out."""
    scored = repositories.filter("name is not null and url is not null").withColumn("score", repository_score(F.col("name"), F.coalesce("type", F.lit("")), F.col("url"), strict))
    best = scored.groupBy("name").agg(F.max(F.struct("score", (-F.col(order)).alias("o"), "type", "url")).alias("b"))
    return best.select("name", "b.type", "b.url", "b.score")


#: The fields of a job report, in order; those ending in Time are milliseconds.
JOB_FIELDS = ["name", "duration", "state", "mapstotal", "mapscompleted", "reducesTotal", "uberized", "avgMapTime", "avgReduceTime", "avgShuffleTime", "avgMergeTime", "failedReduceAttempts", "killedReduceAttempts", "successfulReduceAttempts", "failedMapAttempts", "killedMapAttempts", "successfulMapAttempts"]


def job_statistics(reports: DataFrame, column: str, *keys: str) -> DataFrame:
    """One row of strings (after the key columns) for each JSON report; times in whole seconds. What is no report gives nulls."""

    def value(f: str) -> Column:
        def of(name: str) -> Column:
            return F.get_json_object(column, f"$.job.{name}")

        if f == "duration":
            return F.floor((of("finishTime").try_cast("bigint") - of("startTime").try_cast("bigint")) / 1000).cast("string")
        return F.floor(of(f).try_cast("bigint") / 1000).cast("string") if f.endswith("Time") else of(f)

    return reports.select(*keys, *[value(f).alias(f) for f in JOB_FIELDS])


def write_statistics(stats: DataFrame, path: str) -> None:
    stats.write.mode("overwrite").option("sep", ";").option("header", True).csv(path)
