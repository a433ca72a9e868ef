import json
import math
import random
import struct

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from corpusloom.functions.numbers import rate, rounded
from corpusloom.operators import evaluation, schedule
from corpusloom.plans.registry import backwards
from corpusloom.sources import jsonl, settings
from corpusloom.sources.streamed import IteratorSource


def test_rounded_like_python(spark):
    rng = random.Random(3)
    xs = [0.0, -0.0, 0.001, 2.675, 0.125, 0.375, 1.005, 0.1234565, 2.5e-7, 1e15 + 0.5, 1e300, 123456.0000005]
    xs += [rng.randrange(10**7) / 10**k for k in range(2, 9) for _ in range(200)]
    xs += [(2 * rng.randrange(10**5) + 1) / 2**k for k in range(1, 9) for _ in range(50)]
    xs += [struct.unpack("<d", struct.pack("<Q", rng.randrange(900 << 52, 1070 << 52)))[0] for _ in range(500)]
    xs += [-x for x in xs if x]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for digits in (2, 4, 6):
        for r in df.select("x", rounded(F.col("x"), digits).alias("y")).collect():
            want = round(r.x, digits)
            assert r.y == want and math.copysign(1, r.y) == math.copysign(1, want), (r.x, digits, r.y)
    odd = spark.createDataFrame([(None,), (math.nan,), (math.inf,)], "x double").select(rounded(F.col("x"), 2).alias("y")).collect()
    assert odd[0].y is None and math.isnan(odd[1].y) and odd[2].y == math.inf


def test_rate(spark):
    rows = spark.createDataFrame([(4, 2.0), (4, 0.0)], "n long, s double").select(rate(F.col("n"), F.col("s")).alias("r")).collect()
    assert [r.r for r in rows] == [2.0, 4 / 1e-6]


def test_generation_of_odd_rows(spark, tmp_path):
    p = spark.createDataFrame([("b a", 1, "x"), ("b a", 1, "x"), (None, 2, None), ("", 3, None), ("wort " * 5000, None, "y")], "prompt string, `a b` long, output string")
    made = evaluation.generated(p, backwards)
    assert made.columns == ["prompt", "a b", "output", "n_tokens", "seconds"]
    assert sorted(r.n_tokens for r in made.collect()) == [0, 2, 2, 5000]
    evaluation.write_batch(made, f"{tmp_path}/out")
    found = [json.loads(r.value) for r in spark.read.text(f"{tmp_path}/out").collect()]
    assert len(found) == 4 and {"prompt": "b a", "output": "a b", "tokens_per_sec": 2e6} in found
    assert evaluation.generated(p.where("false"), backwards).count() == 0


def test_report_of_empty_tables(spark, tmp_path):
    losses = spark.createDataFrame([], "batch_id long, loss double")
    predicted = spark.createDataFrame([], "ref array<int>, pred array<int>")
    made = spark.createDataFrame([], "id long, prompt string, output string")
    evaluation.evaluate(losses, predicted, made, f"{tmp_path}/r")
    report = json.loads(spark.read.text(f"{tmp_path}/r/report", wholetext=True).head().value)
    assert report["perplexity"]["n_batches"] == 0 and report["perplexity"]["avg_loss"] is None
    assert report["token_accuracy"] == {"accuracy": 0.0, "correct": 0, "total": 0}
    assert report["generation_quality"]["n_prompts"] == 0 and report["generation_quality"]["corpus_bleu"] == 0


def test_retention(spark):
    saves = [(1, 0.5, "a"), (2, 0.5, "b"), (3, None, "c"), (4, 0.9, "a"), (5, 0.1, None), (6, 0.7, "d")]
    got = schedule.retained(spark.createDataFrame(saves, "step long, val_loss double, path string"), 2).collect()
    assert {r.path: (r.step, r.kept) for r in got} == {"a": (4, False), "b": (2, True), "c": (3, False), "d": (6, True)}


def test_partial_window_is_not_logged(spark):
    e = spark.createDataFrame([(s, 30.0, float(s), 10, 0.0) for s in range(1, 6)], "step long, loss double, norm double, tokens long, seconds double")
    rows = schedule.metric_log(e, 2, "step", "loss", "norm", "tokens", "seconds", lambda s: s * 1.0).orderBy("step").collect()
    assert [(r.step, r.lr, r.grad_norm, r.tokens_per_sec) for r in rows] == [(2, 1.0, 2.0, 20 / 1e-6), (4, 3.0, 4.0, 40 / 1e-6)]
    assert all(r.perplexity == pytest.approx(math.exp(20)) for r in rows)


def endless(prefix):
    n = 0
    while True:
        yield {"text": f"{prefix}{n}", "more": n}
        n += 1


def test_iterator_stops_early(spark):
    spark.dataSource.register(IteratorSource)
    read = lambda: spark.read.format("rows").schema("text string, absent int")
    got = read().option("factory", "tests.test_reports:endless").option("most", 7).option("prefix", "t").load().collect()
    assert [tuple(r) for r in got] == [(f"t{n}", None) for n in range(7)]
    with pytest.raises(PySparkException):
        read().load().collect()


def test_corpus_file(spark, tmp_path):
    (tmp_path / "c.txt").write_text("one\n \n\ntwo\n")
    assert [r.text for r in jsonl.corpus_file(spark, f"{tmp_path}/c.txt").collect()] == ["one", "two"]
    with pytest.raises(FileNotFoundError):
        jsonl.corpus_file(spark, f"{tmp_path}/none.txt")


def test_every_setting():
    s = settings.resolved({"model": {"model_dim": 64, "sliding_window": 128}, "data": {"paths": ["a", "b"]}, "training": {"grad_accumulation_steps": 2}})
    assert (s.dim, s.sliding_window, s.paths, s.seed, s.eval_every) == (64, 128, ("a", "b"), 42, 500)
    assert settings.effective_batch_size(s) == 16
