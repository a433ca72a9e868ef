import re
import unicodedata

from pyspark.sql import functions as F

from corpusloom.functions import sequences as S
from corpusloom.functions import text as T
from corpusloom.operators import cleaning, quality

NOISE = re.compile("[^\u0900-\u097f\u0020-\u007e\u00a0-\u00ff\u2000-\u206f\n\r\t]")


def expected_clean(text):
    t = unicodedata.normalize("NFC", text)
    t = re.sub(r"https?://\S+|www\.\S+", " ", t, flags=re.IGNORECASE)
    t = NOISE.sub(" ", re.sub(r"<[^>]+>", " ", t))
    return re.sub(r"[ \t]{2,}", " ", t).strip()


EDGES = ["\u0958\u0959", "न\u093c", "e\u0301", "\u00a0\u2003x\u2028\u3000\u001c", "awww.x.y z", "HTTP://A b", "http://a\u00a0b", '<a href="http://a">t</a> u > v', "😀₹", "বাংলা", "a\u007fb", "क\u200dष", "a\tb", "a  \t b", "http\u017f://x y", "", " \n ", "a\r\r\r\r\rb", "<\n>x<", "x" * 50]


def test_cleaning_edges(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(EDGES)], "i int, t string")
    got = {r.i: r.c for r in df.select("i", T.cleaned(F.col("t")).alias("c")).collect()}
    assert got == {i: expected_clean(t) for i, t in enumerate(EDGES)}


def test_quality_boundaries(spark):
    d = "क"
    rows = {"short": d * 19, "fits": "कख" * 10, "long": "कख" * 25000 + d, "full": "कख" * 25000, "few": "कख" * 4 + d + "ab" * 9, "enough": "कख" * 5 + "ab" * 9, "latin": "कख" * 5 + "ab" * 46, "ratio": "कख" * 5 + "ab" * 45, "five": "कख" * 10 + ".....", "four": "कख" * 10 + "....", "lines": "कख" * 10 + "\n" * 5 + d, "returns": "कख" * 10 + "\r" * 5 + d}
    df = spark.createDataFrame(list(rows.items()), "k string, clean string")
    got = {r.k: r.reject_reason for r in quality.with_reason(df).collect()}
    assert got == {"short": "too_short", "fits": None, "long": "too_long", "full": None, "few": "few_target_chars", "enough": None, "latin": "high_latin_ratio", "ratio": None, "five": "repeated_chars", "four": None, "lines": None, "returns": "repeated_chars"}


def test_barrier_keeps_the_plan_single(spark):
    df = cleaning.judged(spark.createDataFrame([("x",)], "text string"), "text").where("reject_reason is null")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert plan.count("regexp_replace") <= 10


def test_ngram_guards(spark):
    df = spark.createDataFrame([(["a"],), ([],), (["a", "b", "a", "b"],)], "w array<string>")
    got = [tuple(r) for r in df.select(F.size(S.ngrams(F.col("w"), 2)), S.distinct_share(S.ngrams(F.col("w"), 2)), S.repetition(S.ngrams(F.col("w"), 1))).collect()]
    assert got == [(0, 0.0, 0.0), (0, 0.0, 0.0), (3, 2 / 3, 0.5)]
    assert [r[0] for r in df.select(S.padded(F.transform("w", lambda x: F.length(x)), 2, 9).alias("p")).select(F.size("p")).collect()] == [2, 2, 2]
