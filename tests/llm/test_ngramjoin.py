import random
import re
from itertools import combinations

import numpy as np

from corpusloom.llm import countrtree, ngramjoin
from corpusloom.llm.components import components

LOWER = {i: i + 32 for i in range(65, 91)}


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_force(rows):
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    smallest = {}
    for i, (d, _) in enumerate(rows):
        smallest[find(i)] = min(smallest.get(find(i), d), d)
    return sorted((d, len(sets[i]), smallest[find(i)]) for i, (d, _) in enumerate(rows))


def corpus(seed, n=260):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    fresh = lambda k: rng.choices(words, k=k)
    passage = fresh(60)
    texts = []
    for i in range(n):
        kind = rng.randrange(6)
        if kind == 0 or len(texts) < 5:
            w = fresh(rng.choice([1, 3, 5, 20, 80, 300]))
        elif kind == 1:  # shares a passage
            w = fresh(rng.randrange(5, 60)) + passage + fresh(rng.randrange(5, 60))
        elif kind == 2:  # an exact copy
            w = list(rng.choice(texts))
        else:  # a chain or star of edits
            w = list(rng.choice(texts[: 8 if kind == 3 else None]))
            for _ in range(rng.randrange(1, 4)):
                w[rng.randrange(len(w))] = rng.choice(words)
        texts.append(w)
    ids = list(range(n))
    rng.shuffle(ids)
    return [(d, " ".join(x.upper() if rng.random() < 0.05 else x for x in w)) for d, w in zip(ids, texts)]


def test_components_of_random_texts(spark, monkeypatch):
    monkeypatch.setattr(ngramjoin, "BLOCK", 7)
    monkeypatch.setattr(ngramjoin, "ROUNDS", 2)
    monkeypatch.setattr(ngramjoin, "FREQUENT", 3)
    monkeypatch.setattr(ngramjoin, "PART", 4)
    for seed in (1, 2):
        rows = corpus(seed) + [(9000, None), (9001, ""), (9002, " \n"), (9003, "lone")]
        docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, node int").repartition(3)
        assert sorted(map(tuple, ngramjoin.jaccard_components(docs).collect())) == brute_force(rows)


def test_edges(spark):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (7, "A B c d e f")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n int")
    got = sorted(map(tuple, ngramjoin.jaccard_components(docs).collect()), key=str)
    assert got == [(5, 2, 5), (5, 2, 5), (7, 2, 5), (None, 2, None)]
    assert ngramjoin.jaccard_components(docs.limit(0)).count() == 0


def similar(x, y):
    shared = len(np.intersect1d(x, y))
    return 100 * shared >= 80 * (len(x) + len(y) - shared)


def random_sets(rng, n):
    base = rng.integers(0, 1 << 62, 300, dtype=np.uint64)
    return [np.unique(np.r_[base[rng.permutation(300)[: 300 - rng.integers(0, 60)]], rng.integers(0, 1 << 62, rng.integers(0, 40), dtype=np.uint64)]) for _ in range(n)]


def test_forest_keeps_every_similar_pair():
    rng = np.random.default_rng(3)
    sizes = [1, 2, 3, 150, 17, 40, 300]
    sets = [s for n in sizes for s in random_sets(rng, n)]
    group = np.repeat(np.arange(len(sizes)), sizes)
    classes = rng.integers(0, 60, len(sets))
    shuffled = rng.permutation(len(sets))
    forest = countrtree.CountForest(np.array([countrtree.point(sets[i]) for i in shuffled]), np.array([len(sets[i]) for i in shuffled]), group[shuffled], None, classes[shuffled])
    assert len(forest.levels) == 3
    left, right = forest.pairs(80)
    found = {frozenset(p) for p in zip(shuffled[left].tolist(), shuffled[right].tolist())}
    assert len(found) == len(left)
    assert all(group[i] == group[j] and classes[i] != classes[j] for i, j in map(tuple, found))
    wanted = {frozenset((i, j)) for i, j in combinations(range(len(sets)), 2) if group[i] == group[j] and classes[i] != classes[j] and similar(sets[i], sets[j])}
    assert wanted <= found
    assert len(found) < sum(n * (n - 1) // 2 for n in sizes) / 2


def test_forest_of_queries_and_targets():
    rng = np.random.default_rng(4)
    sets = random_sets(rng, 80)
    target = rng.random(80) < 0.5
    forest = countrtree.CountForest(np.array([countrtree.point(s) for s in sets]), np.array([len(s) for s in sets]), np.zeros(80, int))
    found = set(zip(*(x.tolist() for x in forest.pairs(80, target, ~target))))
    assert {(i, j) for i in range(80) for j in range(80) if not target[i] and target[j] and similar(sets[i], sets[j])} <= found
    assert all(target[j] and not target[i] for i, j in found)
    none = countrtree.CountForest(np.zeros((0, countrtree.GROUPS), np.uint8), np.zeros(0, int), np.zeros(0, int))
    assert len(none.pairs(80)[0]) == 0


def test_family_of_many_near_copies(spark):
    """900 near copies of one text: pairs grow with the copies, not with their square, and the result is exact."""
    rng = random.Random(7)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for d in range(900):
        w = list(base)
        for _ in range(rng.randrange(0, 8)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(3000)}"
        rows.append((d, " ".join(w)))
    seen = []
    inner = ngramjoin._placed
    ngramjoin._placed = lambda pairs, first: seen.append(inner(pairs, first)) or seen[-1]
    try:
        got = sorted(map(tuple, ngramjoin.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
        assert sum(s.count() for s in seen) < 40 * len(rows)
    finally:
        ngramjoin._placed = inner
    assert got == brute_force(rows)


def test_long_texts(spark):
    rng = random.Random(2)
    long = [f"w{rng.randrange(50000)}" for _ in range(120_000)]
    near = list(long)
    for i in range(0, len(near), 60):
        near[i] = "other"
    far = [w if i % 9 else "other" for i, w in enumerate(long)]
    rows = [(9, " ".join(long)), (4, " ".join(near)), (2, " ".join(far)), (1, "short text")]
    got = sorted(map(tuple, ngramjoin.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == brute_force(rows)
    assert [c for _, _, c in got] == [1, 2, 4, 4]


def test_sets_that_share_a_node_get_other_ones(spark, monkeypatch):
    inner = ngramjoin._node
    monkeypatch.setattr(ngramjoin, "_node", lambda tokens, seed=0: 7 if seed == 0 else inner(tokens, seed))
    rows = [(1, "a b c d e f g"), (2, "h i j k l m n"), (3, "a b c d e f g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, ngramjoin.jaccard_components(docs).collect())) == [(1, 3, 1), (2, 3, 2), (3, 3, 1)]


def test_long_chain(spark):
    n = 70
    order = random.Random(0).sample(range(n), n)
    edges = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)] + [(100, 101), (101, 101), (101, 100)], "u long, v long")
    assert sorted(map(tuple, components(edges).collect())) == [(i, 0) for i in range(n)] + [(100, 100), (101, 100)]


def test_bounds_are_no_less_than_the_overlap():
    rng = np.random.default_rng(8)
    pool = rng.integers(0, 1 << 62, 60000, dtype=np.uint64)
    for size in (1, 3, 500, 50000):
        x, y = (np.unique(rng.choice(pool, size)) for _ in range(2))
        shared = len(np.intersect1d(x, y))
        fine = countrtree.fine_bound(countrtree.fine_point(x), countrtree.fine_point(y))
        assert shared <= fine <= min(len(x), len(y))
        forest = countrtree.CountForest(np.array([countrtree.point(s) for s in (x, y)]), np.array([len(x), len(y)]), np.zeros(2, int))
        assert forest._within(np.array([0]), forest.points, np.array([1]), np.array([shared]))[0]
