"""A bagged linear classifier: shards of lines, one model a shard, the mean of the models."""

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHARDS = 80
BATCH_SHARE = 0.02
FALSE_POSITIVE_WEIGHT = 3.0
TOLERANCE = 1e-4


def line_shards(files: DataFrame, key: str, text: str, shards: int = SHARDS, distinct: bool = True) -> DataFrame:
    """(shard, line): line i of each text goes to shard i mod shards; empty lines are left out, equal lines of a shard collapse if distinct."""
    lines = files.select(key, F.posexplode(F.split(text, "\n", -1)).alias("i", "line")).filter("line <> ''")
    out = lines.select((F.col("i") % shards).alias("shard"), "line")
    return out.distinct() if distinct else out


def parse_instance(line: Column) -> tuple[Column, Column]:
    """(features, label) of a line of numbers: the leading doubles up to the first piece that is none; the last of them is the label, 1 above 0.5, else -1. Null for a line without numbers."""
    pieces = F.transform(F.split(F.trim(line), r"\s+", -1), lambda x: x.try_cast("double"))
    end = F.array_position(F.transform(pieces, lambda x: x.isNull()), True)
    numbers = F.when(end > 0, F.slice(pieces, F.lit(1), F.greatest(end - 1, F.lit(0)).cast("int"))).otherwise(pieces)
    label = F.when(F.try_element_at(numbers, F.lit(-1)) > 0.5, 1).when(F.size(numbers) > 0, -1)
    return F.slice(numbers, F.lit(1), F.greatest(F.size(numbers) - 1, F.lit(0))), label


def parse_instance_strictly(line: Column) -> tuple[Column, Column]:
    """(features, label) by the rule of the second reference implementation: pieces between single blanks; any that is no number is an error when read."""
    numbers = F.transform(F.split(line, " ", -1), lambda x: F.coalesce(x.try_cast("double"), F.raise_error(F.concat(F.lit("no number: "), x)).cast("double")))
    label = F.when(F.element_at(numbers, -1) > 0.5, 1).otherwise(-1)
    return F.slice(numbers, F.lit(1), F.size(numbers) - 1), label


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def scale(a: Column, k: Column | float) -> Column:
    return F.transform(a, lambda x: x * k)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def classify(weights: Column, features: Column) -> Column:
    """1 if the product is not negative, else -1."""
    return F.when(dot(weights, features) >= 0, 1).otherwise(-1)


#: The weights that training starts from.
START = [
    -1.1466, -2.2231, -0.2428, -0.8678, 2.0886, 0.0985, -2.0055, -0.0099, -0.0609, -0.9270, -1.5213, 0.5135,
    -0.2026, -0.4987, 0.5676, -0.8285, 0.6187, -0.0617, -0.2748, -2.0780, -1.1740, 2.2460, 0.8605, -0.1293,
    -0.0787, 1.1157, -0.4567, 1.1253, -2.4983, 0.6353, 1.4149, -0.7522, 0.8811, -2.4835, 4.6290, -0.8594,
]


def batch_size(n: int, share: float = BATCH_SHARE) -> int:
    """round(share * n), halves up, and at least one instance (where the reference would stop with an error)."""
    return max(1, int(np.floor(share * n + 0.5)))


def train_many(shards: list[tuple[np.ndarray, np.ndarray]], iterations: int = 10_000, start: np.ndarray | None = None, share: float = BATCH_SHARE) -> np.ndarray:
    """Weights (one row a shard) by gradient steps of length one on the logistic loss, all shards at once.

    The reference draws a shard's batch of k = round(0.02 n) instances without replacement from the first k: the batch is these k, in an order
    that sums do not see. Its false positives at the present weights are in it three times more. A shard ends after the step whose gradient is
    shorter than the tolerance, or after `iterations` steps. Shards with one number of features; start defaults to zeros.
    """
    sizes = [batch_size(len(x), share) for x, _ in shards]
    d, most = shards[0][0].shape[1], max(sizes)
    x, y, held = np.zeros((len(shards), most, d)), np.zeros((len(shards), most)), np.zeros((len(shards), most))
    for i, ((xs, ys), k) in enumerate(zip(shards, sizes)):
        x[i, :k], y[i, :k], held[i, :k] = xs[:k], ys[:k], 1.0
    w = np.tile(np.zeros(d) if start is None else np.asarray(start, float), (len(shards), 1))
    live = np.arange(len(shards))
    target, negative, turned = (y + 1) * 0.5, y < 0, np.ascontiguousarray(x.transpose(0, 2, 1))
    for _ in range(iterations):
        raw = np.matmul(x, w[live][:, :, None])[:, :, 0]
        weight = held + (FALSE_POSITIVE_WEIGHT * held) * ((raw >= 0) & negative)
        gap = (0.5 + 0.5 * np.tanh(0.5 * raw) - target) * weight / weight.sum(axis=1, keepdims=True)
        gradient = np.matmul(turned, gap[:, :, None])[:, :, 0]
        w[live] -= gradient
        going = np.einsum("ij,ij->i", gradient, gradient) >= TOLERANCE * TOLERANCE
        if not going.all():
            live, x, turned, held, target, negative = (a[going] for a in (live, x, turned, held, target, negative))
            if not len(live):
                break
    return w


def _train(iterations: int, start: list[float] | None, share: float) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[int, np.ndarray, np.ndarray]] = []

        def models() -> pd.DataFrame:
            out = []
            for d in sorted({x.shape[1] for _, x, _ in held}):
                mine = [h for h in held if h[1].shape[1] == d]
                first = start if start is not None else START if d == len(START) else None
                out += zip((h[0] for h in mine), train_many([h[1:] for h in mine], iterations, first, share).tolist())
            held.clear()
            return pd.DataFrame(out, columns=["shard", "weights"])

        for shard, pdf in _whole_shards(batches):
            held.append((shard, np.vstack(pdf["features"].to_list()), pdf["label"].to_numpy(float)))
            if sum(x.size for _, x, _ in held) > MOST_NUMBERS:
                yield models()
        if held:
            yield models()

    return run


#: Numbers of features that a task trains on at once.
MOST_NUMBERS = 4_000_000


def _whole_shards(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, pd.DataFrame]]:
    """Shards of rows that come sorted by shard."""
    parts: list[pd.DataFrame] = []
    for pdf in batches:
        for shard, rows in pdf.groupby("shard", sort=True):
            if parts and parts[0]["shard"].iloc[0] != shard:
                yield int(parts[0]["shard"].iloc[0]), pd.concat(parts)
                parts = []
            parts.append(rows)
    if parts:
        yield int(parts[0]["shard"].iloc[0]), pd.concat(parts)


def train(instances: DataFrame, iterations: int = 10_000, start: list[float] | None = None, share: float = BATCH_SHARE) -> DataFrame:
    """(shard, weights) of (shard, features, label), by train_many(); start defaults to the reference's 36 weights where there are 36 features, else zeros.

    The instances of a shard are taken in the order of features and label, so the result does not depend on that of the rows. A shard is one
    task's; choose their number by its memory. Null features or labels are left out; all instances of a shard have one length.
    """
    kept = instances.filter("features is not null and label is not null").select("shard", "features", "label")
    cores = instances.sparkSession.sparkContext.defaultParallelism
    ordered = kept.repartition(cores, "shard").sortWithinPartitions("shard", "features", "label")
    return ordered.mapInPandas(_train(iterations, start, share), "shard int, weights array<double>")


def model_average(models: DataFrame) -> DataFrame:
    """(i, weight): the mean of each weight over all models."""
    return models.select(F.posexplode("weights").alias("i", "weight")).groupBy("i").agg(F.avg("weight").alias("weight"))


def model_text(weights: Column) -> Column:
    """Weights with a blank after each."""
    return F.concat(F.array_join(weights.cast("array<string>"), " "), F.lit(" "))


def misclassified(scored: DataFrame) -> DataFrame:
    """Rows taken for positive that are not."""
    return scored.filter("predicted = 1 and label = -1")
