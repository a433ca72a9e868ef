import numpy as np

from corpusloom.llm import crosspolytope as cp


def brute_force(rows, every, nearest):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, q in good:
        if i % every == 0:
            near = sorted({(-float(q @ v), j) for j, v in good if j != i and len(v) == len(q)})[:nearest]
            out[i] = [(j, -s) for s, j in near]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int")


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(900, 32)).astype(np.float32)
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(base)]
    got = cp.nearest_neighbours(frame(spark, rows)).collect()
    want = brute_force(rows, 20, 20)
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append(r)
    hits = 0
    for q, near in want.items():
        mine = sorted(found[q], key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 21))
        assert all(abs(r.score - float(base[q].astype(float) @ base[r.vec_id].astype(float))) < 1e-12 for r in mine)
        assert [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine)
        hits += len({r.vec_id for r in mine} & {j for j, _ in near})
    assert hits / (20 * len(want)) > 0.9


def test_copies_ties_and_bad_vectors(spark, monkeypatch):
    monkeypatch.setattr(cp, "CANDIDATE_BLOCK", 5)
    monkeypatch.setattr(cp, "QUERY_BLOCK", 2)
    one, two = [1.0, 0.0, 0.0], [0.0, 2.0, 0.0]
    rows = [(i, one) for i in range(0, 60)] + [(i, two) for i in range(60, 90)] + [(100, None), (101, []), (120, [0.0, 0.0, 0.0]), (140, [1.0, None, 0.0]), (160, [float("nan"), 1.0, 1.0]), (180, [float("inf"), 0.0, 0.0]), (None, one), (200, [1.0, 1.0]), (40, one)]
    got = {}
    for r in cp.nearest_neighbours(frame(spark, rows), nearest=25).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = brute_force(rows, 20, 25)
    assert {q: sorted(v) for q, v in got.items()} == {q: [(k + 1, j, s) for k, (j, s) in enumerate(v)] for q, v in want.items() if v}
    assert cp.nearest_neighbours(frame(spark, [])).count() == 0


def test_vectors_are_exchanged_a_few_times_only(spark):
    """All that is shuffled stays within four times the vectors: neither tables nor probes carry copies of them."""
    x = np.random.default_rng(2).normal(size=(4000, 64)).astype(np.float32)
    table = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, score int")
    store = spark.sparkContext._jsc.sc().statusStore()
    shuffled = lambda: sum(store.executorList(False).apply(i).totalShuffleWrite() for i in range(store.executorList(False).size()))
    before = shuffled()
    assert cp.nearest_neighbours(table).count() == 200 * 20
    assert 0 < shuffled() - before < 4 * x.nbytes


def test_copies_in_blocks(spark, monkeypatch):
    """Vectors in many blocks, blocks in passes, queries in many batches, best hits chosen again and again: as brute force, when all is probed."""
    for name, value in (("CANDIDATE_BLOCK", 30), ("PASS", 2), ("QUERY_BLOCK", 7), ("PAIRS", 50), ("HELD", 100)):
        monkeypatch.setattr(cp, name, value)
    rng = np.random.default_rng(3)
    rows = [(i, [float(c) for c in rng.integers(-2, 3, 3 + i % 2)]) for i in range(300)]
    got = {}
    for r in cp.nearest_neighbours(frame(spark, rows), query_every=5, nearest=6, probes=10**6).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = brute_force(rows, 5, 6)
    assert {q: sorted(v) for q, v in got.items()} == {q: [(k + 1, j, s) for k, (j, s) in enumerate(v)] for q, v in want.items() if v}


def test_hadamard_and_axes():
    x = np.eye(8)
    h = cp.hadamard(x)
    assert (h @ h.T == 8 * np.eye(8)).all()
    rng = np.random.default_rng(1)
    v = rng.normal(size=(5, 6))
    for axes in ([8], [8, 4], [8, 8, 1]):
        near = cp.probed(v, 3, axes, 7)
        assert [c in n for c, n in zip(cp.codes(v, 3, axes), near)] == [True] * 5
        assert all(len(set(n)) == min(7, len(n)) for n in near.tolist())
    assert (cp.codes(v, 3, [8]) != cp.codes(-v, 3, [8])).all()
    # Every bucket is probed, nearest first, when all are asked for.
    assert sorted(cp.probed(v[:1], 3, [8, 2], 64)[0].tolist()) == list(range(64))


def test_buckets_keep_their_size():
    for n in (1, 30, 500, 10_000, 10**6, 10**10):
        axes = cp.polytopes(n, 64)
        buckets = np.prod([2.0 * a for a in axes])
        assert set(axes[:-1]) <= {64} and n / buckets <= cp.BUCKET and (buckets <= 2 or n / buckets > cp.BUCKET / 2 - 1e-9)


def test_recall_and_work_at_two_sizes():
    """The share of all vectors that a query is compared with falls as they grow, at a recall above 0.9."""
    shares = []
    for n in (3000, 30000):
        rng = np.random.default_rng(n)
        x = rng.normal(size=(n, 64))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        axes, probes, q = cp.polytopes(n, 64), cp.probes_of(n), x[:40]
        met, rows = np.zeros((40, n), bool), 0
        for t in range(cp.TABLES):
            code, near = cp.codes(x, t, axes), cp.probed(q, t, axes, probes)
            for i in range(40):
                here = np.isin(code, near[i])
                rows += here.sum()
                met[i] |= here
        top = np.argsort(-(q @ x.T) + 9 * np.eye(40, n), axis=1)[:, :20]
        assert np.take_along_axis(met, top, 1).mean() > 0.9
        shares.append(rows / 40 / n)
    assert shares[1] < 0.5 * shares[0]
