import time
import tracemalloc
from types import SimpleNamespace

import corpus_pipeline
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import scratch, textarrays, toxicity
from corpusloom.llm.suffixdedup import byte_anchors


@pytest.mark.parametrize("kernel", [lambda g: toxicity.features(g, 18), lambda g: textarrays.shingle_sets(g.lower().words()), byte_anchors])
def test_a_group_of_texts_takes_little_memory(kernel):
    texts = pa.array([" ".join(f"w{(i * 7919 + j * 31) % 5000}" for j in range(300)) for i in range(2500)])
    assert texts.nbytes > 2 << 21
    textarrays._powers.cache_clear()
    tracemalloc.start()
    try:
        for group in textarrays.text_groups(texts):
            kernel(group)
        assert tracemalloc.get_traced_memory()[1] < 48 << 20
    finally:
        tracemalloc.stop()


def test_stages_get_narrow_arrow_batches(spark):
    before = spark.conf.get(scratch.BATCH_CONF)
    try:
        stage = corpus_pipeline._stage(0, lambda spark, docs, sf_dir: docs.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"]) for b in batches), "n long"))
        docs = spark.range(0, 9000, 1, 1).select(F.repeat(F.lit("abcdefgh"), 300).alias("text"))
        sizes = [r.n for r in stage(spark, docs, "").collect()]
        assert sum(sizes) > 9000 * 2400 and max(sizes) < scratch.BATCH_BYTES + 10_000
        spark.conf.set(scratch.BATCH_CONF, "1m")
        scratch.narrow_batches(spark)
        assert spark.conf.get(scratch.BATCH_CONF) == "1m"  # a smaller limit stays
    finally:
        spark.conf.set(scratch.BATCH_CONF, before)


def test_the_drivers_heap_is_narrowed_while_nothing_is_written(spark):
    heap = spark._jvm.java.lang.Runtime.getRuntime()
    scratch.written(spark.range(3), "watched")
    held = [spark._jvm.java.nio.ByteBuffer.allocate(heap.maxMemory() // 32) for _ in range(18)]
    assert heap.totalMemory() > heap.maxMemory() // 2
    del held  # an action may leave as much, before anything else is written
    until = time.monotonic() + 60
    while heap.totalMemory() > heap.maxMemory() // 2 and time.monotonic() < until:
        time.sleep(0.2)
    assert heap.totalMemory() <= heap.maxMemory() // 2


def test_freed_memory_outside_the_heap_can_be_given_back(spark):
    assert scratch.trim(spark._jvm)


def test_the_watch_ends_with_its_session_and_begins_anew(monkeypatch):
    monkeypatch.setattr(scratch, "LOOK_S", 0.01)
    monkeypatch.setattr(scratch, "_WATCHES", [])
    looks = []
    monkeypatch.setattr(scratch, "narrow_heap", looks.append)
    for jvm in ("first", "second"):
        context = SimpleNamespace(_jvm=jvm, _jsc=object())
        for _ in range(2):
            scratch.watch(SimpleNamespace(sparkContext=context))
        (thread,) = scratch._WATCHES
        while jvm not in looks:
            time.sleep(0.01)
        context._jsc = None  # as SparkContext.stop() leaves it
        thread.join(10)
        assert not thread.is_alive()
