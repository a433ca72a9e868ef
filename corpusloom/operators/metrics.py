"""Corpus metrics as joins and aggregations of counted n-grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sequences as S
from ..functions import text as T


def matched(df: DataFrame, id_col: str, ref: str, hyp: str, orders: int, chars: bool = False) -> DataFrame:
    """n, hits (multiset intersection), hyp_total, ref_total for every order from 1 to ``orders``, also where there is nothing.

    Both sides are read and counted together, by one shuffle on the n-gram of a pair.
    """
    items = lambda c: F.filter(F.split(F.col(c), ""), lambda x: x != "") if chars else T.words(F.col(c))
    sides = F.explode(F.array(F.struct(F.lit(True).alias("is_hyp"), items("h").alias("x")), F.struct(F.lit(False).alias("is_hyp"), items("r").alias("x")))).alias("side")
    base = df.select(F.col(id_col).alias("pair"), F.col(ref).alias("r"), F.col(hyp).alias("h")).select("pair", sides).select("pair", "side.is_hyp", F.col("side.x").alias("items"))
    # Of a given order, words joined by a space and characters joined by nothing stay distinct.
    joined = lambda n: F.transform(S.ngrams(F.col("items"), n), lambda g: F.array_join(g, "" if chars else " "))
    every = base.select("pair", "is_hyp", F.explode(F.array(*(F.struct(F.lit(n).alias("n"), joined(n).alias("grams")) for n in range(1, orders + 1)))).alias("o"))
    grams = every.select("pair", "is_hyp", "o.n", F.explode("o.grams").alias("gram"))
    counts = grams.groupBy("pair", "n", "gram").agg(F.count_if("is_hyp").alias("h"), F.count_if(~F.col("is_hyp")).alias("r"))
    found = counts.groupBy("n").agg(F.sum(F.least("h", "r")).alias("hits"), F.sum("h").alias("hyp_total"), F.sum("r").alias("ref_total"))
    dense = df.sparkSession.range(1, orders + 1).select(F.col("id").cast("int").alias("n"))
    return dense.join(F.broadcast(found), "n", "left").na.fill(0, ["hits", "hyp_total", "ref_total"])  # a row an order


def bleu(df: DataFrame, id_col: str, ref: str, hyp: str, max_order: int = 4, smooth: bool = True) -> DataFrame:
    """bleu, brevity_penalty, precisions, ref_len, hyp_len of a corpus of pairs; lengths are totals of the first order."""
    one = 1.0 if smooth else 0.0
    p = F.when(F.col("hyp_total") == 0, 0.0).otherwise((F.col("hits") + one) / (F.col("hyp_total") + one))
    orders = matched(df, id_col, ref, hyp, max_order).withColumn("p", p)
    length = lambda c: F.max(F.when(F.col("n") == 1, F.col(c)))
    mean = F.when(F.min("p") > 0, F.exp(F.sum(F.ln(F.greatest("p", F.lit(1e-300)))) / max_order)).otherwise(0.0)
    agg = orders.agg(length("ref_total").alias("ref_len"), length("hyp_total").alias("hyp_len"), mean.alias("mean"), F.transform(F.array_sort(F.collect_list(F.struct("n", "p"))), lambda x: x["p"]).alias("precisions"))
    penalty = F.when(F.col("hyp_len") == 0, 0.0).when(F.col("hyp_len") >= F.col("ref_len"), 1.0).otherwise(F.exp(1 - F.col("ref_len") / F.greatest("hyp_len", F.lit(1))))
    return agg.select((penalty * F.col("mean")).alias("bleu"), penalty.alias("brevity_penalty"), "precisions", "ref_len", "hyp_len")


def chrf(df: DataFrame, id_col: str, ref: str, hyp: str, max_order: int = 6, beta: float = 2.0) -> DataFrame:
    """chrf, avg_precision, avg_recall: character n-grams with spaces, orders weighed alike."""
    o = matched(df, id_col, ref, hyp, max_order, chars=True)
    share = lambda c: F.sum(F.col("hits") / F.greatest(F.col(c), F.lit(1))) / max_order
    a = o.agg(share("hyp_total").alias("avg_precision"), share("ref_total").alias("avg_recall"))
    p, r, b = F.col("avg_precision"), F.col("avg_recall"), beta * beta
    return a.select(F.when(p + r > 0, (1 + b) * p * r / F.greatest(b * p + r, F.lit(1e-300))).otherwise(0.0).alias("chrf"), p, r)


def token_accuracy(df: DataFrame, ref: str, pred: str, ignore_id: int) -> DataFrame:
    """accuracy, correct, total over positions of both arrays whose reference is not ``ignore_id``."""
    each = df.select(F.explode(S.paired(F.col(ref), F.col(pred))).alias("x")).where(F.col("x.a") != ignore_id)
    return each.agg((F.count_if(F.col("x.a") == F.col("x.b")) / F.greatest(F.lit(1), F.count("*"))).alias("accuracy"), F.count_if(F.col("x.a") == F.col("x.b")).alias("correct"), F.count("*").alias("total"))


def generation_quality(df: DataFrame, text: str, profile: T.ScriptProfile = T.DEVANAGARI) -> DataFrame:
    """Per text: script ratios, distinct-1, distinct-2 and the repetition of 4-grams."""
    made = T.with_barrier(df, _words=T.words(F.col(text)), _visible=T.visible_count(F.col(text)), _target=T.target_count(F.col(text), profile), _latin=T.latin_count(F.col(text)))
    w = F.col("_words")
    return made.select(*df.columns, F.size(w).alias("n_tokens"), T.ratio(F.col("_target"), F.col("_visible")).alias("target_ratio"), T.ratio(F.col("_latin"), F.col("_visible")).alias("latin_ratio"), S.distinct_share(S.ngrams(w, 1)).alias("distinct_1"), S.distinct_share(S.ngrams(w, 2)).alias("distinct_2"), S.repetition(S.ngrams(w, 4)).alias("repetition_rate"))


def macro_average(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(F.count("*").alias("n"), *(F.coalesce(F.avg(c), F.lit(0.0)).alias(f"avg_{c}") for c in columns))


def perplexity(df: DataFrame, batch: str, loss: str, most: int | None = None) -> DataFrame:
    """Mean of batch means, and its exponential with the exponent capped at 20; with ``most`` only of batches 0 to most - 1."""
    rows = df if most is None else df.where(F.col(batch) < most)
    mean = rows.groupBy(batch).agg(F.avg(loss).alias("l")).agg(F.avg("l").alias("avg_loss"), F.count("*").alias("n_batches"))
    return mean.select("avg_loss", F.exp(F.least("avg_loss", F.lit(20.0))).alias("perplexity"), "n_batches")


def parameter_count(shapes: DataFrame, shape: str = "shape", trainable: str = "trainable") -> DataFrame:
    n = F.aggregate(F.col(shape), F.lit(1).cast("long"), lambda a, x: a * x)
    return shapes.select(n.alias("n"), F.col(trainable).alias("t")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(F.sum(F.when(F.col("t"), F.col("n"))), F.lit(0)).alias("trainable"))


def parameter_summary(shapes: DataFrame, component: str = "component", shape: str = "shape") -> DataFrame:
    """Each component's parameters and its share of all; components are few."""
    n = F.aggregate(F.col(shape), F.lit(1).cast("long"), lambda a, x: a * x)
    each = shapes.groupBy(component).agg(F.sum(n).alias("n"))
    return each.crossJoin(each.agg(F.sum("n").alias("_all"))).select(component, "n", (F.col("n") / F.greatest(F.lit(1), "_all")).alias("share"))  # the total is one row


def ratio_percent(part: Column, whole: Column) -> Column:
    return 100.0 * part / F.greatest(F.lit(1), whole)
