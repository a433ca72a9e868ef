"""Decoding filters over a table of logits: one row per prompt and token."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def tempered(df: DataFrame, temperature: float, logit: str = "logit") -> DataFrame:
    return df.withColumn(logit, F.col(logit) / max(temperature, 1e-8))


def softmax(df: DataFrame, prompt: str, logit: str = "logit", name: str = "p") -> DataFrame:
    w = Window.partitionBy(prompt)
    e = df.withColumn("_e", F.exp(F.col(logit) - F.max(logit).over(w)))
    return e.withColumn(name, F.col("_e") / F.sum("_e").over(w)).drop("_e")


def top_k(df: DataFrame, prompt: str, k: int, logit: str = "logit") -> DataFrame:
    """Tokens no worse than the k-th, ties included; 0 keeps all."""
    if k <= 0:
        return df
    return df.withColumn("_r", F.rank().over(Window.partitionBy(prompt).orderBy(F.desc(logit)))).where(F.col("_r") <= k).drop("_r")


def top_p(df: DataFrame, prompt: str, token: str, p: float, logit: str = "logit") -> DataFrame:
    """The fewest most likely tokens that reach probability p; 1 or more keeps all."""
    if p >= 1:
        return df
    w = Window.partitionBy(prompt).orderBy(F.desc(logit), token).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return softmax(df, prompt, logit, "_p").withColumn("_before", F.sum("_p").over(w) - F.col("_p")).where(F.col("_before") <= p).drop("_p", "_before")


def penalised(df: DataFrame, history: DataFrame, prompt: str, token: str, penalty: float, logit: str = "logit") -> DataFrame:
    """Logits of tokens that the prompt has had are divided by the penalty, or multiplied if not positive."""
    had = history.select(prompt, token).distinct().withColumn("_had", F.lit(True))
    x = F.col(logit)
    return df.join(had, [prompt, token], "left").withColumn(logit, F.when(F.col("_had"), F.when(x > 0, x / penalty).otherwise(x * penalty)).otherwise(x)).drop("_had")


def argmax(df: DataFrame, prompt: str, token: str, logit: str = "logit") -> DataFrame:
    """The token of the largest logit, the smallest of equals."""
    best = df.groupBy(prompt).agg(F.max(F.struct(F.col(logit), (-F.col(token)).alias("_t"))).alias("_b"))
    return best.select(prompt, (-F.col("_b._t")).alias(token))


def drawn(df: DataFrame, prompt: str, token: str, seed: int, logit: str = "logit") -> DataFrame:
    """One token a prompt by inverse distribution, from a number that the seed and the prompt decide."""
    w = Window.partitionBy(prompt).orderBy(F.desc(logit), token).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(prompt).cast("string"))), 1, 13)  # 52 bits
    u = F.conv(digits, 16, 10).cast("long") / float(1 << 52)
    s = softmax(df, prompt, logit, "_p").withColumn("_to", F.sum("_p").over(w)).where(F.col("_to") >= u)
    first = s.groupBy(prompt).agg(F.min(F.struct("_to", token)).alias("_f"))
    every = argmax(df, prompt, token, logit)  # for a sum that rounding has left below u
    return every.withColumnRenamed(token, "_a").join(first, prompt, "left").select(prompt, F.coalesce(F.col(f"_f.{token}"), "_a").alias(token))
