"""Corpus cleaning: extraction, normalisation, quality rules, exact deduplication and counts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import dedup, extract
from .quality import Quality, with_reason


@dataclass
class Cleaned:
    """``rows`` that survive, and a one-row table of counts."""

    rows: DataFrame
    stats: DataFrame


def judged(df: DataFrame, text: str, config: Quality = Quality()) -> DataFrame:
    """``df`` with ``clean`` and ``reject_reason``; rows without text are left out."""
    made = T.with_barrier(T.spread(df.where(F.col(text).isNotNull())), clean=T.cleaned(F.col(text), config.profile))
    return with_reason(made, "clean", config)


def clean(df: DataFrame, text: str, order: list[str], config: Quality = Quality(), dedup_texts: bool = True, scope: list[str] | None = None) -> Cleaned:
    """Valid rows of ``df`` with ``clean``; of equal cleaned texts (in each ``scope``) the first by ``order``.

    Counts: seen, passed, low_quality, duplicate.
    """
    every = judged(df, text, config)
    valid = every.where("reject_reason is null").drop("reject_reason")
    rows = dedup.first_by_digest(valid, "clean", order, scope, costly=True) if dedup_texts else valid
    per_text = every.groupBy(F.when(F.col("reject_reason").isNull(), F.sha2("clean", 256)).alias("d"), *(scope or [])).agg(F.count("*").alias("n"))
    distinct = F.count_if(F.col("d").isNotNull()) if dedup_texts else F.coalesce(F.sum(F.when(F.col("d").isNotNull(), F.col("n"))), F.lit(0))
    stats = per_text.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("seen"), distinct.alias("passed"), F.coalesce(F.sum(F.when(F.col("d").isNull(), F.col("n"))), F.lit(0)).alias("low_quality")).withColumn("duplicate", F.col("seen") - F.col("passed") - F.col("low_quality"))
    return Cleaned(rows, stats)


def clean_json(lines: DataFrame, schema: str, config: Quality = Quality(), dedup_texts: bool = True, dedup_keys: str = "shared") -> Cleaned:
    """Clean records of JSON lines (columns value and line) into the schema's clean record.

    monolingual gives text; instruct gives instruction and output; parallel
    gives hi and en, where ``dedup_keys`` is ``shared`` (joined texts and first
    sides on one set of seen texts) or ``sides`` (sets of their own).
    """
    extract.extractor(schema)
    if schema == "parallel":
        return _clean_parallel(lines, config, dedup_texts, dedup_keys)
    if schema == "instruct":
        kind = "struct<messages:array<struct<role:string,content:string>>>"
        text = extract.instruct(F.from_json("value", kind)["messages"])
    else:
        text = extract.monolingual(F.col("value"))
    out = clean(lines.withColumn("raw", text), "raw", ["line"], config, dedup_texts)
    if schema == "monolingual":
        return Cleaned(out.rows.select("line", F.col("clean").alias("text")), out.stats)
    instruction, output = extract.instruct_parts(F.col("clean"))
    return Cleaned(out.rows.select("line", instruction.alias("instruction"), output.alias("output")), out.stats)


def _clean_parallel(lines: DataFrame, config: Quality, dedup_texts: bool, dedup_keys: str) -> Cleaned:
    side = lambda key: F.when(extract.json_text(F.col("value"), f"$.translation.{key}").isNotNull(), extract.json_text(F.col("value"), f"$.translation.{key}"))
    present = lambda key: F.expr(f"try_variant_get(try_parse_json(value), '$.translation.{key}', 'variant')").isNotNull()
    raw = lines.withColumn("hi", F.when(present("hi"), side("hi")).otherwise("")).withColumn("en", F.when(present("en"), side("en")).otherwise(""))
    raw = raw.where("hi is not null and en is not null").withColumn("both", extract.parallel(F.col("hi"), F.col("en"))).where("both is not null")
    made = T.with_barrier(raw, c=T.cleaned(F.col("both"), config.profile), h=T.cleaned(F.col("hi"), config.profile))
    for name in ("c", "h"):
        made = with_reason(made, name, config).withColumn(f"valid_{name}", F.col("reject_reason").isNull()).drop("reject_reason")
    made = made.select(F.col("line").alias("i"), "c", "h", "valid_c", "valid_h", T.strip(F.col("en")).alias("en")).checkpoint()
    if dedup_texts:
        judged_rows = dedup.parallel_keep(made, shared=dedup_keys == "shared")
    else:
        judged_rows = made.withColumn("new", F.col("valid_c")).withColumn("kept", F.col("valid_c") & F.col("valid_h"))
    return Cleaned(judged_rows.where("kept").select(F.col("i").alias("line"), F.col("h").alias("hi"), "en"), dedup.parallel_stats(judged_rows))
