import duckdb
import pytest

import corpus_pipeline
from corpusloom.llm import queries

from .test_decontamination import brute_force as leaks
from .test_ngramjoin import brute_force as groups
from .test_repeats import brute_force as repeats

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    names = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        names.append(name)
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k == 4:
            break
        assert docs.columns == columns
        rows = docs.collect()
        now = {r.doc_id: r.text for r in rows}
        assert len(now) == len(rows)
        if name == "not_toxic":
            marked = {r.doc_id for r in queries.op10_toxicity(spark, SF).where("predicted = 1").collect()}
            assert set(now) == set(seen) - marked and all(now[d] == seen[d] for d in now)
        elif name == "one_of_each_group":
            assert set(now) == {d for d, _, c in groups(list(seen.items())) if d == c} and all(now[d] == seen[d] for d in now)
        elif name == "without_repeats":
            want = repeats(seen, lambda t: list(t.encode()), 100, bytes)
            assert set(now) == set(seen) and all(r.n_chars == len(r.text) for r in rows)
            lost = {d: len(seen[d].encode()) - len(now[d].encode()) - want[d][1] for d in now}
            assert all(0 <= x <= 6 * max(1, want[d][2]) if want[d][1] else x == 0 for d, x in lost.items())
        else:
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert set(now) == set(seen) - {d for d, *_ in leaks(list(seen.items()), items)}
        seen = now
    assert len(names) == 5 and {r.doc_id for r in docs.select("doc_id").distinct().collect()} == set(seen)


def test_stages_on_odd_rows(spark, tmp_path):
    word = "plain words that say nothing bad about anyone at all and go on for a while so that there is text"
    rows = [(1, word, "en", "a", 1, 0.5, ["x"], "k"), (1, word, "en", "a", 1, 0.5, ["x"], "k"), (2, word, None, None, None, None, None, None), (None, word, "en", "a", 1, 0.1, [], "k"), (3, None, "en", "b", None, 0.1, [], "k"), (4, "", "en", "b", 0, 0.1, [], "k"), (5, "é" * 9000, "fr", "c", 9000, 0.2, [], "k")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, node array<string>, kept string"
    for name, some in (("rows", rows), ("none", [])):
        docs = spark.createDataFrame(some, schema)
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            columns = docs.columns
            stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}{k}")
            docs = spark.read.parquet(f"{tmp_path}/{name}{k}")
            if k < 4:
                assert docs.columns == columns
        got = {r.doc_id for r in docs.collect()}
        assert got == ({1, None, 3, 4, 5} if some else set())


def test_texts_that_share_an_id(spark):
    some = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    rows = [(1, some(1)), (7, some(1) + " more"), (7, some(2)), (7, some(2)), (8, some(3)), (8, some(4)), (8, some(4) + " end"), (9, some(2)), (5, None), (5, ""), (5, "  "), (6, ""), (None, some(1))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    stage = dict(corpus_pipeline.STAGES)["one_of_each_group"]
    got = [(r.doc_id, (r.text or "").strip()) for r in stage(spark, docs, SF).collect()]
    left = {(1, some(1)), (7, some(2)), (8, some(3)), (5, ""), (6, ""), (None, some(1))}
    # Of two near copies under one id either stays.
    assert len(got) == 7 and left < set(got) and {(8, some(4)), (8, some(4) + " end")} & set(got)
    copies = spark.createDataFrame([(3, some(1)), (3, some(1))], "doc_id long, text string")
    assert [tuple(r) for r in stage(spark, copies, SF).collect()] == [(3, some(1))]


def test_run(spark):
    got = corpus_pipeline.run(spark, SF)
    windows = got.groupBy("sequence_id").sum("length").collect()
    assert sum(r[1] == 2048 for r in windows) == len(windows) - 1


@pytest.mark.parametrize("name", ["op1_warc", "op4_anchor_dedup", "op5_decontamination", "op6_jaccard_join"])
def test_queries_against_sql(spark, name):
    with duckdb.connect() as db:
        for table in ("documents", "pages", "benchmark"):
            db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
        want = db.sql(queries.ORACLES[name])
        got = queries.QUERIES[name](spark, SF).select(*want.columns)
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want.fetchall()))
