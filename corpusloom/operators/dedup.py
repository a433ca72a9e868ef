"""Exact deduplication: the first of equal texts in input order stays."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_by_digest(df: DataFrame, text: str, order: list[str], scope: list[str] | None = None, costly: bool = False) -> DataFrame:
    """The first row of each text (within each ``scope``).

    Only digests and order keys are compared: each digest's least order key is
    found by an aggregation that combines before the shuffle, and rows find out
    whether they are it by a join that splits hot digests.  That reads ``df``
    twice; where its rows are ``costly`` to compute they are computed once and
    travel whole, the first of each digest in each task only.
    """
    scope = scope or []
    if costly:
        rank = F.row_number().over(Window.partitionBy("_digest", *scope).orderBy(*order))
        return df.withColumn("_digest", F.sha2(F.col(text), 256)).withColumn("_rank", rank).where("_rank = 1").drop("_digest", "_rank")
    keyed = df.withColumn("_digest", F.sha2(F.col(text), 256)).withColumn("_order", F.struct(*order))
    first = keyed.groupBy("_digest", *scope).agg(F.min("_order").alias("_first"))
    same = F.col("_order").eqNullSafe(F.col("_first"))
    cond = [F.col("k._digest").eqNullSafe(F.col("f._digest")), *(F.col(f"k.{s}").eqNullSafe(F.col(f"f.{s}")) for s in scope)]
    joined = keyed.alias("k").join(first.alias("f"), cond).where(same)
    return joined.select(*(F.col(f"k.{c}") for c in df.columns))


def unseen(df: DataFrame, text: str, earlier: DataFrame) -> DataFrame:
    """Rows whose text an earlier corpus (column ``digest``) does not have."""
    return df.withColumn("_digest", F.sha2(F.col(text), 256)).join(earlier.select(F.col("digest").alias("_digest")), "_digest", "left_anti").drop("_digest")


def parallel_keep(df: DataFrame, concat_col: str = "c", first_col: str = "h", order: str = "i", valid_c: str = "valid_c", valid_h: str = "valid_h", shared: bool = True) -> DataFrame:
    """Two texts a row on one set of seen texts: ``new`` (the joined text was new) and ``kept`` of every row.

    A row's joined text is tested first, and if it is new its first side is
    tested and remembered too.  Only ``new`` depends on itself, through first
    sides that equal later joined texts; it is found by repetition until nothing
    changes, each round two aggregations and joins.  With ``shared=False`` the
    sides have a set of their own, so rows with an empty second side survive.
    """
    c, h, i = F.col(concat_col), F.col(first_col), F.col(order)
    rows = df.withColumn("_c", F.when(F.col(valid_c), F.sha2(c, 256))).withColumn("_h", F.when(F.col(valid_h), F.sha2(h, 256)))
    # Rows whose joined text is invalid are never new and have no key to meet others by: they take no part.
    base = rows.where("_c is not null").select(i.alias("_i"), "_c", "_h")
    earliest = base.groupBy("_c").agg(F.min("_i").alias("_first"))
    base = base.join(earliest, "_c").withColumn("_fresh", F.col("_i") == F.col("_first")).drop("_first")

    def flagged(marked: DataFrame) -> DataFrame:
        """_new from the first sides of rows now believed new."""
        firsts = marked.where("_new and _h is not null").groupBy(F.col("_h").alias("_c")).agg(F.min("_i").alias("_m"))
        seen = F.col("_m").isNotNull() & (F.col("_m") < F.col("_i"))
        return marked.drop("_new").join(firsts, "_c", "left").withColumn("_new", F.col("_fresh") & (~seen if shared else F.lit(True))).drop("_m")

    marked = base.withColumn("_new", F.col("_fresh")).checkpoint()
    while shared:
        nxt = flagged(marked).checkpoint()
        mark = lambda d: d.where("_new").agg(F.count("*"), F.sum(F.xxhash64("_i").cast("decimal(38,0)"))).head()
        same, marked = mark(nxt) == mark(marked), nxt
        if same:
            break
    by_c = base.groupBy(F.col("_c").alias("_h")).agg(F.min("_i").alias("_mc"))
    by_h = marked.where("_new and _h is not null").groupBy("_h").agg(F.min("_i").alias("_mh"))
    # Only new rows with a valid first side can be kept.
    judged = marked.where("_new and _h is not null").join(by_c, "_h", "left").join(by_h, "_h", "left")
    joined_before = F.col("_mc").isNotNull() & (F.col("_mc") <= F.col("_i")) if shared else F.lit(False)
    kept = ~joined_before & ~(F.col("_mh").isNotNull() & (F.col("_mh") < F.col("_i")))
    flags = marked.where("_new").select(F.col("_i").alias(order), F.lit(True).alias("_isnew")).join(judged.where(kept).select(F.col("_i").alias(order), F.lit(True).alias("_iskept")), order, "left")
    return df.join(flags, order, "left").withColumn("new", F.coalesce("_isnew", F.lit(False))).withColumn("kept", F.coalesce("_iskept", F.lit(False))).drop("_isnew", "_iskept")


def parallel_stats(judged: DataFrame, valid_c: str = "valid_c", valid_h: str = "valid_h") -> DataFrame:
    """seen, passed, low_quality, duplicate as a sequential cleaner counts them."""
    new, kept, vc, vh = (F.col(x) for x in ("new", "kept", valid_c, valid_h))
    n = lambda x: F.count_if(x)
    return judged.agg(
        (F.count("*") + n(new) - n(kept)).alias("seen"),
        n(new).alias("passed"),
        (n(~vc) + n(new & ~vh)).alias("low_quality"),
        (n(vc) - n(new) + n(new & vh) - n(kept)).alias("duplicate"),
    )
