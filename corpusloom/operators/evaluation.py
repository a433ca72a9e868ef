"""Generation for a table of prompts, and the evaluation report as a whole."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.numbers import rate, rounded
from ..sources import jsonl
from . import metrics, report


def generated(prompts: DataFrame, model: Callable[[], Callable[[pd.Series], pd.DataFrame]], prompt: str = "prompt") -> DataFrame:
    """``prompts`` with output, n_tokens and seconds.

    ``model`` is called once a task (it may load weights there) and gives a
    function from a batch of prompts to these three columns, row by row.
    Null prompts are left out; columns of these names in ``prompts`` are replaced.
    """
    made = ("output string", "n_tokens long", "seconds double")
    names = [m.split()[0] for m in made]
    rows = prompts.drop(*names).where(F.col(prompt).isNotNull())
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields] + list(made))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        generate = model()
        for b in batches:
            yield pd.concat([b.reset_index(drop=True), generate(b[prompt].reset_index(drop=True))[names].reset_index(drop=True)], axis=1)

    return rows.mapInPandas(run, schema)


def batch_results(made: DataFrame, prompt: str = "prompt") -> DataFrame:
    """prompt, output and tokens_per_sec of :func:`generated` rows."""
    return made.select(F.col(prompt).alias("prompt"), "output", rounded(rate(F.col("n_tokens"), F.col("seconds")), 2).alias("tokens_per_sec"))


def write_batch(made: DataFrame, path: str, prompt: str = "prompt") -> None:
    jsonl.write_json(batch_results(made, prompt), path)


SHARES = ("target_ratio", "distinct_1", "distinct_2", "repetition_rate")
AVERAGED = ("n_tokens", "target_ratio", "latin_ratio", "distinct_1", "distinct_2", "repetition_rate")


def samples(made: DataFrame, text: str = "output", prompt: str = "prompt", profile: T.ScriptProfile = T.DEVANAGARI) -> DataFrame:
    """Each generation with its measures, shares rounded to four places."""
    q = metrics.generation_quality(made.select(prompt, text), text, profile)
    return q.select(F.col(prompt).alias("prompt"), F.col(text).alias("generated"), F.col("n_tokens").cast("long").alias("n_tokens"), *(rounded(F.col(c), 4).alias(c) for c in SHARES))


def quality_summary(made: DataFrame, id_col: str, text: str = "output", prompt: str = "prompt", profile: T.ScriptProfile = T.DEVANAGARI) -> DataFrame:
    """One row: macro averages of unrounded measures, corpus BLEU and chrF of the texts against their prompts."""
    q = metrics.generation_quality(made.select(text), text, profile)
    averages = metrics.macro_average(q, list(AVERAGED)).withColumnRenamed("n", "n_prompts")
    sides = made.select(id_col, prompt, text)
    b = metrics.bleu(sides, id_col, prompt, text).select(rounded(F.col("bleu"), 6).alias("corpus_bleu"))
    c = metrics.chrf(sides, id_col, prompt, text).select(rounded(F.col("chrf"), 6).alias("corpus_chrf"))
    return averages.crossJoin(b).crossJoin(c)  # one row each


def evaluate(losses: DataFrame, predicted: DataFrame, made: DataFrame | None, path: str, *, batch: str = "batch_id", loss: str = "loss", ref: str = "ref", pred: str = "pred", ignore_id: int = 0, id_col: str = "id", most_batches: int | None = None, about: dict[str, str] | None = None) -> None:
    """Write the report to ``path``/report and the samples, a line each, to ``path``/samples.

    Parts: run (what ``about`` says), perplexity of ``losses``, token_accuracy of
    the id arrays in ``predicted`` and, where texts were ``made``,
    generation_quality.  Samples grow with the prompts, so they are no part of
    the report's one row.  Empty tables give zeros and, for a mean, null.
    """
    spark = losses.sparkSession
    parts = {"perplexity": metrics.perplexity(losses, batch, loss, most_batches), "token_accuracy": metrics.token_accuracy(predicted, ref, pred, ignore_id)}
    if about:
        parts = {"run": spark.range(1).select(*(F.lit(v).alias(k) for k, v in about.items()))} | parts
    if made is not None:
        parts["generation_quality"] = quality_summary(made, id_col)
        jsonl.write_json(samples(made), f"{path}/samples")
    report.write(report.nested(parts), f"{path}/report")
