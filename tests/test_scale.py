"""What keeps plans even and single: one evaluation of costly rows, buckets by quantiles, chunked running means."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import ordering, quality, schedule
from corpusloom.plans import registry

SF = "/root/testdata/sf0.001"


def test_costly_rows_are_computed_once(spark):
    plan = registry.quality_dedup(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == plan.count("FileScan") == 1


def test_buckets_by_quantile_are_even(spark):
    keys = [*range(1000), 10**15, -(10**15), 7, 7, 7]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    rows = df.withColumn("b", ordering.range_bucket(df, "k", 16)).collect()
    per_bucket = {b: sum(r.b == b for r in rows) for b in {r.b for r in rows}}
    assert len(per_bucket) == 16 and max(per_bucket.values()) < 200
    assert [r.b for r in sorted(rows, key=lambda r: r.k)] == sorted(r.b for r in rows)
    got = ordering.ranked(df.where("k != 7"), ordering.range_bucket(df, "k", 16), ["k"]).collect()
    assert [r["rank"] for r in sorted(got, key=lambda r: r.k)] == list(range(1, len(got) + 1))
    assert ordering.running(df.limit(0), "k", sums={"s": "k"}).count() == 0


@pytest.mark.parametrize("chunk", [1, 7, 256])
def test_running_mean_of_norms(spark, chunk):
    rng = random.Random(chunk)
    rows = [(run, step, rng.random() * (9 if rng.random() < 0.1 else 1)) for run in "ab" for step in range(50)]
    want = {}
    for run in "ab":
        mean = 0.0
        for r, step, g in rows:
            if r == run:
                spike = step > 5 and mean > 0 and g > 2 * mean
                want[run, step] = (0.98 * mean + 0.02 * g, spike, mean / g if spike else 1.0)
                mean = want[run, step][0]
    rng.shuffle(rows)
    got = {(r.run, r.step): (r.ema, r.spike, r.lr_scale) for r in schedule.smoothed_norms(spark.createDataFrame(rows, "run string, step int, g double"), "run", "step", "g", 5, chunk=chunk).collect()}
    assert got.keys() == want.keys()
    for k, (ema, spike, scale) in want.items():
        assert got[k][1] == spike and abs(got[k][0] - ema) < 1e-9 and abs(got[k][2] - scale) < 1e-9


def test_running_mean_rounds_as_its_sql(spark):
    """Means that lie on a tie, a series of several chunks, equal floats throughout; null norms, steps and series."""
    want, rows = {}, []
    for run in range(300):
        mean = 0.0
        for step in range(700 if run == 7 else 3):
            g = round(0.01 * ((7919 * run + 104729 * step) % 50_000), 2)
            mean = 0.98 * mean + 0.02 * g
            rows.append((run, step, g))
            want[run, step] = mean
    rows += [(-1, 0, 1.0), (-1, 1, None), (-1, 2, 1.0), (-2, None, 8.0), (-2, 5, 4.0), (None, 3, 1.0), (None, 2, 5.0)]
    want |= {(-1, 0): 0.02, (-1, 1): None, (-1, 2): None, (-2, 5): 0.08, (-2, None): 0.98 * 0.08 + 0.02 * 8.0, (None, 2): 0.1}
    got = schedule.smoothed_norms(spark.createDataFrame(rows[::-1], "run int, step int, g double"), "run", "step", "g", 200).collect()
    assert len(got) == len(want) and {(r.run, r.step): r.ema for r in got} == want


def test_rules_are_data(spark):
    config = quality.Quality().bounded("too_short", least=3).without("few_target_chars", "high_latin_ratio").also(quality.Rule("many_target_chars", "target", most=0))
    df = spark.createDataFrame([("ab",), ("abcd",), ("aaaaa",), ("abc हद",)], "t string")
    got = [r.reject_reason for r in quality.with_reason(df, "t", config).orderBy(F.col("t")).collect()]
    assert got == ["repeated_chars", "too_short", "many_target_chars", None]
