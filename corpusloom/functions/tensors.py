"""Element-wise model kernels as columns and joins, for inspecting small models' tensors in tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rms_norm(x: Column, eps: float = 1e-6) -> Column:
    """Each component over the root of the mean square."""
    mean = F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v) / F.size(x)
    return F.transform(x, lambda v: v / F.sqrt(mean + eps))


def rotary(x: Column, dim: int, position: Column, base: float = 10_000.0, scaling: float = 1.0) -> Column:
    """Pairs of components turned by the position's angle; ``scaling`` raises the base for longer contexts."""
    if scaling != 1.0:
        base = base * scaling ** (dim / (dim - 2))
    angle = lambda i: position / F.pow(F.lit(base), (i - i % 2) / F.lit(float(dim)))
    at = lambda i: F.element_at(x, (i + 1).cast("int"))
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.when(i % 2 == 0, at(i) * F.cos(angle(i)) - at(i + 1) * F.sin(angle(i))).otherwise(at(i - 1) * F.sin(angle(i)) + at(i) * F.cos(angle(i))))


def gated(gate: Column, up: Column) -> Column:
    """SiLU of one array times another."""
    return F.zip_with(gate, up, lambda g, u: g / (1 + F.exp(-g)) * u)


def visible_pairs(spark, length: int, window: int | None = None) -> DataFrame:
    """i, j: positions j that position i attends to."""
    first = F.lit(0).cast("long") if window is None else F.greatest(F.lit(0).cast("long"), F.col("id") - window + 1)
    return spark.range(length).select(F.col("id").alias("i"), F.explode(F.sequence(first, F.col("id"))).alias("j"))


def cross_entropy(logits: DataFrame, targets: DataFrame, row: str, token: str, logit: str, target: str, ignore_id: int, smoothing: float = 0.0) -> DataFrame:
    """loss and rows: mean negative log-likelihood of the targets that are not ``ignore_id``, with label smoothing."""
    w = Window.partitionBy(row)
    shifted = logits.withColumn("_x", F.col(logit) - F.max(logit).over(w))
    scored = shifted.withColumn("_lp", F.col("_x") - F.ln(F.sum(F.exp("_x")).over(w)))
    joined = scored.join(targets.where(F.col(target) != ignore_id).select(row, target), row)
    each = joined.groupBy(row).agg(F.max(F.when(F.col(token) == F.col(target), F.col("_lp"))).alias("hit"), F.avg("_lp").alias("mean"))
    return each.agg(F.avg(-(1 - smoothing) * F.col("hit") - smoothing * F.col("mean")).alias("loss"), F.count("*").alias("rows"))
