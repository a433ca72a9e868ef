"""Corpus pipeline: five stages, each reading and (but for the last) returning documents.

Toxic documents go; of near copies one stays; text that starts earlier elsewhere
goes; documents that hold a benchmark item go; the rest is packed for training.
Every stage is judged on what its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import scratch
from corpusloom.llm.decontamination import decontaminated
from corpusloom.llm.idfilter import without
from corpusloom.llm.ngramjoin import jaccard_components
from corpusloom.llm.packing import pack
from corpusloom.llm.suffixdedup import kept_text
from corpusloom.llm.toxicity import with_score


def _stage(k: int, f):
    """Tables that stage k makes belong to it; those of stage k - 1 go, since its result has been written."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        scratch.release(f"pipeline-{k - 1}")
        scratch.narrow_batches(spark)
        with scratch.owned_by(f"pipeline-{k}"):
            return f(spark, docs, sf_dir)

    return run_stage


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5."""
    name = "_".join(["score", *docs.columns])  # a name that no column has
    scored = with_score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), score_col=name)
    return scored.where(F.col(name) < 0.5).drop(name)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near copies, once; documents without an id stay.

    Different texts under one id are documents of their own, equal or blank ones are one.
    """
    known = docs.where("doc_id is not null")
    if known.groupBy("doc_id").count().where("count > 1").head(1):
        return _first_of_each_group(known).select(*docs.columns).unionByName(docs.where("doc_id is null"))
    copies = scratch.written(jaccard_components(docs).where("doc_id != component_id").select("doc_id"), "copies")
    scratch.free_shuffles(docs.sparkSession)
    return without(docs, "doc_id", copies)


def _first_of_each_group(docs: DataFrame) -> DataFrame:
    """Of documents whose ids clash: grouped under an id for each (doc_id, text), and the least pair of each group stays."""
    vertex, digest = ("_".join([x, *docs.columns]) for x in ("vertex", "digest"))  # names that no column has
    docs = docs.withColumn(digest, F.sha2(F.when(F.col("text").rlike(r"\S"), F.col("text")).otherwise(""), 256))
    seed = 0
    while True:
        keyed = docs.withColumn(vertex, F.xxhash64("doc_id", digest, F.lit(seed)))
        pairs = scratch.written(keyed.select("doc_id", F.col(digest).alias("digest"), F.col(vertex).alias("vertex")).distinct(), "kept-pairs")
        if not pairs.groupBy("vertex").count().where("count > 1").head(1):
            break
        seed += 1  # two pairs with one id: others are drawn
    found = jaccard_components(keyed.select(F.col(vertex).alias("doc_id"), "text")).distinct()
    least = pairs.join(found.select(F.col("doc_id").alias("vertex"), "component_id"), "vertex").groupBy("component_id").agg(F.min(F.struct("doc_id", "digest", "vertex")).alias("first"))
    chosen = scratch.written(least.select(F.col("first.vertex").alias(vertex)), "kept-ids")
    return keyed.join(chosen, vertex, "left_semi").dropDuplicates([vertex])


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes of 100-byte strings that start earlier; half characters at a cut go too."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    cut = kept_text(docs, with_text=True, extra=others)
    columns = {"doc_id": F.col("doc_id"), "text": F.col("kept"), **{c: F.col(f"x{i}") for i, c in enumerate(others)}}
    if "n_chars" in columns:
        columns["n_chars"] = F.length("kept").cast(docs.schema["n_chars"].dataType)
    return cut.select(*(columns[c].alias(c) for c in docs.columns))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item to 80 percent of its shingles."""
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of the packed windows."""
    return pack(docs)


STAGES = [(f.__name__, _stage(k, f)) for k, f in enumerate((not_toxic, one_of_each_group, without_repeats, without_benchmark, packed))]

#: Toxicity and packing can't be expressed in SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            with scratch.owned_by(f"pipeline-{k + 1}-input"):
                docs = scratch.written(docs, f"stage-{name}")
            scratch.release(f"pipeline-{k}-input")
    return docs
