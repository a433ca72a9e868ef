import random
import zlib
from collections import defaultdict

from corpusloom.llm import sharding


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, shard int, slot string")


def smallest_capacity(sizes, shards):
    """Brute force: try capacities upwards with a greedy fill."""
    capacity = max([*sizes, -(-sum(sizes) // shards)])
    while True:
        used, room = 1, capacity
        for s in sizes:
            if s > room:
                used, room = used + 1, capacity
            room -= s
        if used <= shards:
            return capacity
        capacity += 1


def test_minimax_against_brute_force(spark):
    rng = random.Random(3)
    texts = ["", None, "é" * 3] + ["x" * rng.randrange(1, 60) + str(i) for i in range(150)]
    rows = [(i, rng.choice(texts), None, "clash") for i in range(600)] + [(7, "same", 1, "x")] * 3 + [(None, "n", 1, "x")]
    got = sharding.shard_documents(rows_of(spark, rows), 7).collect()
    assert len(got) == len(rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.text_crc32) for r in got) == sorted((-1 if d is None else d, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    shard_of, slots, totals = {}, defaultdict(list), defaultdict(int)
    for r in got:
        assert shard_of.setdefault((r.text_crc32, r.size), r.shard) == r.shard
        slots[r.shard].append(r.slot)
        totals[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    keys = {r.text_crc32: r.k for r in rows_of(spark, rows).selectExpr("crc32(cast(coalesce(text, '') as binary)) text_crc32", "xxhash64(coalesce(text, '')) k").collect()}
    groups = defaultdict(int)
    for r in got:
        groups[keys[r.text_crc32]] += r.size
    assert max(totals.values()) == smallest_capacity([groups[k] for k in sorted(groups)], 7)


def test_one_giant_group_and_empty(spark):
    rows = [(i, "copy", 0, "") for i in range(400)] + [(1000 + i, f"t{i}", 0, "") for i in range(300)]
    got = sharding.shard_documents(rows_of(spark, rows), 5).collect()
    assert len({r.shard for r in got if r.size == 12 and r.doc_id < 400}) == 1
    assert sharding.shard_documents(rows_of(spark, []), 5).collect() == []
