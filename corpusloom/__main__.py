"""python -m corpusloom clean --schema S --input PATH --output DIR: clean a JSON-lines corpus."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import cleaning, extract
from .operators.quality import Quality
from .plans.checkpoints import ensure_checkpoint_dir
from .sources import jsonl


def clean(spark: SparkSession, args: argparse.Namespace) -> dict:
    shared = f"{ensure_checkpoint_dir(spark)}/numbered"
    lines = jsonl.read_lines(spark, args.input, shared)
    config = Quality().bounded("too_short", least=args.min_chars).bounded("too_long", most=args.max_chars).bounded("few_target_chars", least=args.min_target_chars).bounded("high_latin_ratio", most=args.max_latin_ratio)
    out = cleaning.clean_json(lines, args.schema, config, not args.no_dedup)
    jsonl.write_json(out.rows.drop("line"), args.output)
    return {"n_in": lines.count(), "n_out": spark.read.text(args.output).count(), **out.stats.head().asDict()}


def tokenizer_corpus(spark: SparkSession, args: argparse.Namespace) -> dict:
    lines = jsonl.read_lines(spark, args.input, f"{ensure_checkpoint_dir(spark)}/numbered")
    texts = lines.select("line", extract.tokenizer_text(F.col("value")).alias("text")).where("text is not null")
    if args.max_lines:
        texts = texts.orderBy("line").limit(args.max_lines)
    jsonl.write_lines(texts, "text", args.output)
    return {"written": texts.count()}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    parser = argparse.ArgumentParser(prog="corpusloom")
    commands = parser.add_subparsers(dest="command", required=True)
    c = commands.add_parser("clean")
    c.add_argument("--schema", choices=sorted(extract.SCHEMAS), required=True)
    c.add_argument("--no_dedup", action="store_true")
    for name, default, kind in (("min_chars", 20, int), ("max_chars", 50_000, int), ("min_target_chars", 10, int), ("max_latin_ratio", 0.9, float)):
        c.add_argument(f"--{name}", type=kind, default=default)
    t = commands.add_parser("tokenizer-corpus")
    t.add_argument("--max_lines", type=int, default=0)
    for p in (c, t):
        p.add_argument("--input", required=True)
        p.add_argument("--output", required=True)
    args = parser.parse_args(argv)
    spark = spark or SparkSession.builder.appName("corpusloom").getOrCreate()
    return {"clean": clean, "tokenizer-corpus": tokenizer_corpus}[args.command](spark, args)


if __name__ == "__main__":
    print(main())
