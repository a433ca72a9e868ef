import hashlib
import random
import re

import numpy as np
import pytest

from corpusloom.llm import anchordedup, deepshallow, repeats, suffixdedup


def brute_force(docs, units, width, join):
    seen, out = {}, {}
    for d, text in sorted(docs.items()):
        u = units(text)
        gone = [False] * len(u)
        for s in range(len(u) - width + 1):
            w = tuple(u[s : s + width])
            if seen.setdefault(w, (d, s)) != (d, s):
                gone[s : s + width] = [True] * width
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[d] = (len(u), sum(gone), runs, hashlib.sha256(join([x for x, g in zip(u, gone) if not g])).hexdigest())
    return out


def corpus(seed, n=90):
    rng = random.Random(seed)
    words = ["a", "bb", "É", "d　d", "the", "of", "x" * 9] + [f"w{i}" for i in range(300)]
    fresh = lambda k: rng.choices(words, k=k)
    passages = [fresh(rng.randrange(12, 70)) for _ in range(4)]
    texts = [["lone"], fresh(19), fresh(20), ["rep"] * 150, ["p", "q"] * 60, ["z" * 700]]
    while len(texts) < n:
        kind = rng.randrange(5)
        if kind == 0:
            w = fresh(rng.randrange(0, 120))
        elif kind == 1:
            w = fresh(rng.randrange(0, 40)) + rng.choice(passages) + fresh(rng.randrange(0, 40))
        elif kind == 2:
            w = list(rng.choice(texts))
        else:
            w = list(rng.choice(texts))
            for _ in range(rng.randrange(1, 4)):
                w[rng.randrange(len(w))] = rng.choice(words)
        texts.append(w or ["x"])
    rng.shuffle(texts)
    return {3 * i + 1: rng.choice([" ", "  ", "\n", "\t "]).join(w) for i, w in enumerate(texts)}


@pytest.mark.parametrize("wide", [512, 2])
def test_bytes_and_words_against_brute_force(spark, monkeypatch, wide):
    monkeypatch.setattr(repeats, "WIDE", wide)
    docs = corpus(wide)
    rows = [(d, t, "k") for d, t in docs.items()] + [(5000, None, "k"), (5001, "", "k"), (4, docs[4], "again"), (None, docs[7], "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string").repartition(3)
    docs |= {5000: "", 5001: ""}
    got = suffixdedup.kept_text(df).collect()
    assert len(got) == len(rows)
    want = brute_force(docs, lambda t: list(t.encode()), 100, bytes)
    assert sum(w[1] for w in want.values()) > 1000
    for r in got:
        if r.doc_id is None:
            assert (r.n_removed, r.kept_sha256) == (0, hashlib.sha256(docs[7].encode()).hexdigest())
        else:
            assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id], r.doc_id
    words = lambda t: re.findall(rb"[^\x20\x09-\x0D]+", t.encode())
    want = brute_force(docs, words, 20, b" ".join)
    assert sum(w[1] for w in want.values()) > 300
    got = anchordedup.kept_words(df).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            assert (r.n_words, r.n_removed, r.kept_sha256) == (want[r.doc_id][0], want[r.doc_id][1], want[r.doc_id][3]), r.doc_id


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert suffixdedup.kept_text(df).count() == anchordedup.kept_words(df).count() == 0


def test_deep_shallow_order():
    rng = random.Random(1)
    for width, alphabet in ((100, b"ab"), (20, b"abc"), (5, b"ab"), (100, b"a")):
        data = bytes(rng.choices(alphabet, k=700)) * 2 + bytes(rng.choices(alphabet, k=300))
        starts = np.arange(len(data) - width + 1)
        got = deepshallow.sorted_classes(data, starts, width)
        assert [data[c[0] : c[0] + width] for c in got] == sorted({data[s : s + width] for s in starts.tolist()})
        assert sorted(s for c in got for s in c) == starts.tolist()
        assert all(data[s : s + width] == data[c[0] : c[0] + width] for c in got for s in c)


def test_cover_has_every_difference():
    d = anchordedup.COVER
    assert {(x - y) % anchordedup.PERIOD for x in d for y in d} == set(range(anchordedup.PERIOD))


def test_joined_hash_is_sparks(spark):
    ids = [0, 1, -5, 2**62, -(2**63)]
    got = [r[0] for r in spark.createDataFrame([(i,) for i in ids], "x long").selectExpr("xxhash64(x)").collect()]
    assert repeats.xxhash64_long(np.array(ids)).tolist() == got


def test_texts_longer_than_a_stretch(spark):
    """A text of over 4 MiB is searched as one: what lies across the ends of its stretches too."""
    rng = random.Random(9)
    words = [f"{rng.randrange(16**6):06x}" for _ in range(800_000)]
    long = " ".join(words)
    border = 1 << suffixdedup.PLACE_BITS
    assert len(long) > border + 10**6
    copied = "".join(long[border - 250 : border + 50])
    rows = [(1, long), (2, "# " + copied + " #"), (3, "% " + " ".join(words[700_000:700_030]) + " %"), (4, long[-99:])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffixdedup.kept_text(df).collect()}
    # Words 700,000 to 700,029 and the space before and after them.
    assert got == {1: (len(long), 0, 0), 2: (304, 300, 1), 3: (213, 211, 1), 4: (99, 0, 0)}
    got = {r.doc_id: (r.n_words, r.n_removed) for r in anchordedup.kept_words(df).collect()}
    whole = len(copied.split()) - (long[border - 251] != " " and long[border - 250] != " ") - (long[border + 50] != " " and long[border + 49] != " ")
    assert got == {1: (800_000, 0), 2: (len(rows[1][1].split()), whole), 3: (32, 30), 4: (len(rows[3][1].split()), 0)}
