import duckdb
import pytest

import __spark_entry__
from corpusloom.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    with duckdb.connect() as db:
        for t in TABLES:
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        yield db


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, db, name):
    want = db.sql(registry.ORACLES[name])
    got = registry.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda rs: sorted(str([list(x) if isinstance(x, (list, tuple)) else x for x in r]) for r in rs)
    assert rows(got.select(*want.columns).collect()) == rows(want.fetchall())


def test_streaming_equals_batch(spark):
    batch = registry.quality_dedup(spark, SF).selectExpr("sha2(text, 256) AS digest")
    assert sorted(r.digest for r in registry.streaming_clean(spark, SF).collect()) == sorted(r.digest for r in batch.collect())


def test_rows_only_queries(spark):
    drawn = registry.multinomial_draw(spark, SF)
    allowed = {tuple(r) for r in registry.top_k(spark, SF).collect()} | {tuple(r) for r in registry.logits(spark, SF).select("vec_id", "token_id").collect()}
    rows = drawn.collect()
    assert len({r.vec_id for r in rows}) == len(rows) == 500 and {tuple(r) for r in rows} <= allowed
    for r in registry.sentencepiece_round_trip(spark, SF).collect():
        assert r.n_ids == r.n_pieces > 0 and r.decoded.split()
    assert registry.parallel_clean(spark, SF).count() > 0


def test_whole_vocabulary_is_looked_up(spark, db):
    got = registry.QUERIES["vocabulary_lookup_all"](spark, SF).collect()
    words = {w for (text,) in db.sql("SELECT text FROM benchmark").fetchall() for w in text.split()}
    assert len(words) > 100 and {r.piece for r in got} == words and all(r.piece == r.back for r in got)
    assert sorted(r.id for r in got) == list(range(1, len(words) + 1))


def test_vocabulary_in_buckets(spark):
    words = [w for k in range(1, 40) for w in [f"é{k}", f"a{k}", "b" * k, f"ab{k % 7}"] for _ in range(k)]
    counts = {w: words.count(w) for w in words}
    got = registry.by_count(spark.createDataFrame([(w,) for w in words], "w string"), "w").collect()
    assert [r.w for r in sorted(got, key=lambda r: r.id)] == sorted(counts, key=lambda w: (-counts[w], w.encode()))


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
