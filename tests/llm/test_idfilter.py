import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusloom.llm import components, idfilter, scratch

from .test_ngramjoin import brute_force


def test_a_filter_finds_all_ids_and_few_others(spark):
    ids = spark.range(0, 60_000, 3, 3).select((F.col("id") * 1_000_003 - 7).alias("x"))
    made = idfilter.id_filter(ids, 20_000)
    every = np.arange(60_000) * 1_000_003 - 7
    found = made.find(every)
    assert len(made.bits) == 5 and found[::3].all() and found.sum() < 20_400


@pytest.mark.parametrize("limits", [{}, {"MOST_BLOCKS": 1}, {"MOST_BLOCKS": 1, "MISTAKES": 0}])
def test_without_is_exact(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(idfilter, name, value)
    ids = scratch.written(spark.range(0, 60_000, 2).select(F.col("id").alias("gone")), "gone")
    df = spark.range(-5, 60_005, 1, 3).select(F.when(F.col("id") >= 0, F.col("id")).alias("k"), F.array(F.col("id").cast("string")).alias("others"))
    got = idfilter.without(df, "k", ids).collect()
    assert sorted(r.k for r in got if r.k is not None) == [*range(1, 60_000, 2), *range(60_000, 60_005)]
    assert sum(r.k is None for r in got) == 5 and all(r.others == [str(r.k)] for r in got if r.k is not None)
    assert idfilter.without(df, "k", ids.where("gone < 0")).count() == 60_010


def test_likely_keeps_what_a_join_needs(spark):
    ids = scratch.written(spark.range(0, 40_000, 2).select(F.col("id").alias("x")), "ids")
    some = idfilter.likely(spark.range(0, 200_000, 1, 3).select(F.when(F.col("id") < 150_000, F.col("id")).alias("k")), "k", ids)
    assert some.join(ids, F.col("k") == F.col("x")).count() == 20_000 and some.count() < 22_000


def test_texts_of_a_group_stage_are_not_exchanged(spark):
    some = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    rows = [(k, some(k % 30) + (" end" if k > 70 else "")) for k in range(90)] + [(None, some(1))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    docs = scratch.written(docs, "docs")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = dict(corpus_pipeline.STAGES)["one_of_each_group"](spark, docs, "")
        assert "Exchange" not in kept._jdf.queryExecution().executedPlan().toString()
        got = {tuple(r) for r in kept.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == {rows[d] for d, _, c in brute_force(rows[:90]) if d == c} | {rows[90]}


def test_few_edges_take_few_tables(spark, monkeypatch):
    chain = [(k, k + 1) for k in range(0, 40)] + [(100, 60), (60, 80), (80, 100), (7, 7), (90, 91), (91, 90)]
    edges = spark.createDataFrame(chain, "u long, v long")
    names, written = [], scratch.written
    monkeypatch.setattr(scratch, "written", lambda df, name: names.append(name) or written(df, name))
    few = {tuple(r) for r in components.components(edges).collect()}
    assert len(names) == 2
    monkeypatch.setattr(components, "ONE_TASK", 0)
    assert few == {tuple(r) for r in components.components(edges).collect()} == {(k, 0) for k in range(41)} | {(k, 60) for k in (60, 80, 100)} | {(k, 90) for k in (90, 91)}
    assert not components.components(edges.where("u = v")).collect()


def test_least_reachable_against_plain_search():
    rng = np.random.default_rng(5)
    for _ in range(30):
        u, v = rng.integers(0, 60, (2, rng.integers(1, 50)))
        least = {int(x): int(x) for x in np.r_[u, v]}
        for _ in range(60):
            for a, b in zip(u.tolist(), v.tolist()):
                least[a] = least[b] = min(least[a], least[b])
        nodes, found = components.least_reachable(u, v)
        assert dict(zip(nodes.tolist(), found.tolist())) == least
    assert not len(components.least_reachable(np.zeros(0, np.int64), np.zeros(0, np.int64))[0])
