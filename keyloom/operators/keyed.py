"""Keyed rows: shuffles that keep one value for each (row, column), lookups by prefix, pipelines of maps and shuffles."""

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, GroupedData, Observation, SparkSession
from pyspark.sql import functions as F

from keyloom.store import discard, folder, remove, written


@dataclass(frozen=True)
class KeySpec:
    """The choice of keys: columns of the row key, of the column key, and the order in which values arrived (the first wins)."""

    row: tuple[str, ...]
    col: tuple[str, ...]
    order: tuple[str, ...] = ()

    def cell(self, df: DataFrame) -> DataFrame:
        """Rows whose keys are complete; a null key is no key."""
        return df.dropna(subset=[*self.row, *self.col])


def first_wins(df: DataFrame, spec: KeySpec) -> DataFrame:
    """One row for each (row, column): the first by spec.order, whatever its contents.

    With an order this is an aggregate combined on the map side (min of a struct), so a key repeated a billion times
    costs one row a task. Without an order any row is kept.
    """
    keys = [*spec.row, *spec.col]
    df = spec.cell(df)
    if not spec.order:
        return df.dropDuplicates(keys)
    ordered = list(spec.order)
    rest = [c for c in df.columns if c not in keys and c not in ordered]
    best = df.groupBy(*keys).agg(F.min(F.struct(*[F.col(c) for c in [*ordered, *rest]])).alias("__first"))
    return best.select(*[F.col(c) if c in keys else F.col("__first")[c].alias(c) for c in df.columns])


def last_wins(df: DataFrame, spec: KeySpec) -> DataFrame:
    """One row for each (row, column): the last by spec.order, as a store keeps that overwrites what is put again. Without an order any row is kept."""
    keys = [*spec.row, *spec.col]
    df = spec.cell(df)
    if not spec.order:
        return df.dropDuplicates(keys)
    ordered = list(spec.order)
    rest = [c for c in df.columns if c not in keys and c not in ordered]
    best = df.groupBy(*keys).agg(F.max(F.struct(*[F.col(c) for c in [*ordered, *rest]])).alias("__last"))
    return best.select(*[F.col(c) if c in keys else F.col("__last")[c].alias(c) for c in df.columns])


def shuffle(df: DataFrame, spec: KeySpec, partitions: int | None = None) -> DataFrame:
    """first_wins, then whole rows in range partitions, sorted by row and column: the contract of a sharded source."""
    df = first_wins(df, spec)
    ranged = df.repartitionByRange(partitions, *spec.row) if partitions else df.repartitionByRange(*spec.row)
    return ranged.sortWithinPartitions(*spec.row, *spec.col)


def rows(df: DataFrame, spec: KeySpec, *values: str) -> DataFrame:
    """One row for each row key, its cells in the order of their column key. For rows that fit a task; else use grouped()."""
    cells = F.array_sort(F.collect_list(F.struct(*spec.col, *values)))
    return first_wins(df, spec).groupBy(*spec.row).agg(cells.alias("cells"))


def grouped(df: DataFrame, spec: KeySpec) -> GroupedData:
    """For mappers over whole rows (applyInPandas)."""
    return first_wins(df, spec).groupBy(*spec.row)


def prefix_end(prefix: bytes) -> bytes | None:
    """The least byte string above all that start with the prefix; None if there is none (no prefix, or all 0xFF)."""
    kept = prefix.rstrip(b"\xff")
    return kept[:-1] + bytes([kept[-1] + 1]) if kept else None


def _has_prefix(c: str, prefix: bytes | str) -> Column:
    """A range, which Parquet statistics can prune, for binary keys; startswith (pushed down as such) for text."""
    if isinstance(prefix, str):
        return F.col(c).startswith(prefix)
    inside = F.col(c) >= F.lit(bytearray(prefix))
    end = prefix_end(prefix)
    return inside if end is None else inside & (F.col(c) < F.lit(bytearray(end)))


def read_row(df: DataFrame, column: str, prefix: bytes | str) -> DataFrame:
    """Cells whose row key starts with a prefix; the empty prefix gives all with a key."""
    return df.filter(_has_prefix(column, prefix))


def read_column(df: DataFrame, spec: KeySpec, prefix: bytes | str) -> DataFrame:
    """Cells whose (first) column key starts with a prefix, in the order of column and row."""
    return df.filter(_has_prefix(spec.col[0], prefix)).orderBy(*spec.col, *spec.row)


@dataclass(frozen=True)
class Sharded:
    """A stored source: cells in files of ascending row keys, and the column index, the same cells in files of ascending column keys.

    A prefix is a range, so the files (and row groups) that cannot hold it are left out by their statistics: findShard without a search.
    """

    spark: SparkSession
    path: str
    spec: KeySpec

    def cells(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def read_row(self, prefix: bytes | str) -> DataFrame:
        """Cells whose row key starts with a prefix."""
        return read_row(self.cells(), self.spec.row[0], prefix)

    def read_column(self, prefix: bytes | str) -> DataFrame:
        """Cells whose column key starts with a prefix, from the index alone: files are in the order of column and row."""
        return read_row(self.spark.read.parquet(f"{self.path}/columns"), self.spec.col[0], prefix)

    def shards(self) -> DataFrame:
        """(shard, first, last): the least and greatest row key of each file."""
        return self.cells().groupBy(F.input_file_name().alias("shard")).agg(F.min(self.spec.row[0]).alias("first"), F.max(self.spec.row[0]).alias("last"))


def write_sharded(df: DataFrame, path: str, spec: KeySpec, shards: int | None = None) -> Sharded:
    """The cells of df (first wins) as a Sharded source at a path; empty shards leave no file."""
    cells = shuffle(df, spec, shards)
    cells.write.mode("overwrite").parquet(f"{path}/rows")
    stored = df.sparkSession.read.parquet(f"{path}/rows")
    ranged = stored.repartitionByRange(shards, *spec.col) if shards else stored.repartitionByRange(*spec.col)
    ranged.sortWithinPartitions(*spec.col, *spec.row).write.mode("overwrite").parquet(f"{path}/columns")
    return Sharded(df.sparkSession, path, spec)


def encoded(df: DataFrame, spec: KeySpec) -> DataFrame:
    """(row, col, contents), all binary: objects as cells. Keys are the JSON of their columns if there are several, else the one as it is; contents the JSON of all other columns (binary ones in base64)."""

    def key(names: tuple[str, ...]) -> Column:
        return F.col(names[0]).cast("binary") if len(names) == 1 and df.schema[names[0]].dataType.simpleString() in ("binary", "string") else F.to_json(F.struct(*names)).cast("binary")

    rest = [c for c in df.columns if c not in (*spec.row, *spec.col)]
    return spec.cell(df).select(key(spec.row).alias("row"), key(spec.col).alias("col"), F.to_json(F.struct(*[*spec.row, *spec.col, *rest]), {"ignoreNullFields": "false"}).cast("binary").alias("contents"))


def decoded(cells: DataFrame, schema: str) -> DataFrame:
    """The objects of encoded cells; contents that are none raise an error when read."""
    parsed = F.from_json(F.col("contents").cast("string"), schema, {"mode": "FAILFAST"})
    return cells.select(parsed.alias("o")).select("o.*")


def per_partition(open_: Callable, schema: str) -> Callable[[DataFrame], DataFrame]:
    """A mapper with a life cycle: open_() is called once a task and gives an object with map(pdf) -> pdf, which is told close() at the end, also after an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mapper = open_()
        try:
            for pdf in batches:
                yield mapper.map(pdf)
        finally:
            mapper.close()

    return lambda df: df.mapInPandas(run, schema)


def with_sides(df: DataFrame, tag: str, names: Iterable[str], main: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(the rows of the main output, {name: rows} of the side outputs): a mapper's rows, told apart by their tag and stored once, so no output computes the mapper again. Rows of other tags are lost."""
    df.write.partitionBy(tag).parquet(path := folder(df.sparkSession, "sides"))
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    outs = {n: back.filter(F.col(tag) == n).drop(tag) for n in (main, *names)}
    return outs.pop(main), outs


@dataclass
class Counters:
    """Named counts of each stage, taken while it runs; they begin anew with every stage."""

    stages: list[tuple[str, Observation]] = field(default_factory=list)

    def observe(self, df: DataFrame, stage: str, **counts: Column) -> DataFrame:
        seen = Observation(f"{stage}-{len(self.stages)}")
        self.stages.append((stage, seen))
        return df.observe(seen, *[c.alias(name) for name, c in (counts or {"rows": F.count(F.lit(1))}).items()])

    def report(self) -> list[tuple[str, dict]]:
        """(stage, counts); waits for stages that have not run."""
        return [(stage, seen.get) for stage, seen in self.stages]


Mapper = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Pipeline:
    """influx -> (map -> shuffle)* -> map_and_efflux over lazy DataFrames; a mapper is any function of a DataFrame.

    A mapper over single rows uses expressions, one over whole keyed rows uses grouped(), one with a life cycle per_partition(). Side outputs
    come from with_sides(), or from side() where the stage is cheap. Mappers are plain functions: Spark sends a copy to each task.
    """

    df: DataFrame
    spec: KeySpec
    counters: Counters | None = None

    @classmethod
    def influx(cls, df: DataFrame, spec: KeySpec, counters: Counters | None = None) -> "Pipeline":
        return cls(spec.cell(df), spec, counters)

    def map(self, mapper: Mapper, name: str = "map") -> "Pipeline":
        out = mapper(self.df)
        return Pipeline(self.counters.observe(out, name) if self.counters else out, self.spec, self.counters)

    def shuffle(self, spec: KeySpec, partitions: int | None = None) -> "Pipeline":
        """First wins; whole rows in sorted ranges if a number of partitions is given, else left to the optimiser."""
        return Pipeline(shuffle(self.df, spec, partitions) if partitions else first_wins(self.df, spec), spec, self.counters)

    def run(self, mapper: Mapper) -> "Pipeline":
        """An offline stage: the mapper sees the whole stored table (as a job of its own would) and may do with it what it likes."""
        return Pipeline(mapper(written(self.df, "stage")), self.spec, self.counters)

    def last_efflux(self, mapper: Mapper) -> "Sharded":
        """The last map's cells, stored as a source that can be looked up."""
        return write_sharded(mapper(self.df), folder(self.df.sparkSession, "efflux"), self.spec)

    def side(self, mapper: Mapper) -> DataFrame:
        """A side output of this stage."""
        return mapper(self.df)

    def map_and_efflux(self, mapper: Mapper, path: str | None = None) -> DataFrame:
        """The last map; written if a path is given, and in any case one value for each key."""
        out = first_wins(mapper(self.df), self.spec)
        if path:
            out.write.mode("overwrite").parquet(path)
            return out.sparkSession.read.parquet(path)
        return out


def identity(df: DataFrame) -> DataFrame:
    return df


class Tables:
    """A registry: name -> (DataFrame, keys), also reachable in SQL as views."""

    def __init__(self, spark: SparkSession):
        self.spark, self.held, self.made = spark, {}, []

    def install(self, name: str, df: DataFrame, spec: KeySpec) -> None:
        df.createOrReplaceTempView(name)
        self.held[name] = df, spec

    def source(self, name: str) -> DataFrame:
        return self.held[name][0]

    def read_row(self, name: str, prefix: bytes | str) -> DataFrame:
        df, spec = self.held[name]
        return read_row(df, spec.row[0], prefix)

    def read_column(self, name: str, prefix: bytes | str) -> DataFrame:
        df, spec = self.held[name]
        return read_column(df, spec, prefix)

    def create(self, name: str, df: DataFrame, spec: KeySpec, path: str) -> Sharded:
        """A stored table under a path, with its column index; replaces one of that name."""
        stored = write_sharded(df, f"{path}/{name}", spec)
        self.install(name, stored.cells(), spec)
        return stored

    def open(self, name: str, spec: KeySpec, path: str) -> Sharded:
        """A stored table; that it exists shows when it is read."""
        return Sharded(self.spark, f"{path}/{name}", spec)

    def drop(self, name: str, path: str | None = None) -> None:
        """Takes a table off the registry and, if a path is given, deletes its files. A table that is not there is no error."""
        self.spark.catalog.dropTempView(name)
        self.held.pop(name, None)
        if path:
            remove(self.spark, f"{path}/{name}")

    def close(self) -> None:
        """Deletes the temporary tables."""
        for df in self.made:
            discard(df)
        self.made.clear()

    def temporary(self, df: DataFrame, name: str = "temporary") -> DataFrame:
        """Stored in the shared folder under a random name, until close()."""
        self.made.append(written(df, name))
        return self.made[-1]


def from_objects(spark: SparkSession, cells: Iterable[tuple], schema: str, spec: KeySpec) -> DataFrame:
    """A keyed source from local rows, in input order; an empty input gives an empty source."""
    df = spark.createDataFrame([(*c, i) for i, c in enumerate(cells)], f"{schema}, __nth bigint")
    return first_wins(df, KeySpec(spec.row, spec.col, ("__nth",))).drop("__nth")


