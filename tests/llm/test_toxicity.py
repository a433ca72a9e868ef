import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa

from corpusloom.llm import toxicity as tx
from corpusloom.llm.textarrays import text_groups


def corpus(n=900):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(n):
        words = [f"w{rng.randrange(300)}" for _ in range(40)]
        bad = i % 4 == 0
        if bad:
            words[rng.randrange(40)] = rng.choice(["vile", "Foul,", "rotten"])
        rows.append((i, " ".join(words), "score clash"))
        labels.append((i, int(bad), 7))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows + [(5000, None, ""), (5001, "", ""), (None, "w1 vile", ""), (3, "w1", "")], "doc_id long, text string, score string")
    marks = spark.createDataFrame(labels + [(None, 1, 0), (5000, None, 0)], "doc_id long, toxic int, quality int")
    got = tx.toxicity(docs, marks).collect()
    assert len(got) == len(rows) + 4
    truth = {i: y for i, y, _ in labels}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    empty = [r.score for r in got if r.doc_id in (5000, 5001)]
    assert empty[0] == empty[1] < 0.5
    assert tx.toxicity(docs.limit(0), marks).count() == 0
    assert {r.score for r in tx.toxicity(docs, marks.limit(0)).collect()} == {0.5}


def test_features_stay_inside_a_document():
    def slots(*texts):
        out = []
        for group in text_groups(pa.array(list(texts))):
            s, owner = tx.features(group, 20)
            out += [sorted(s[owner == i]) for i in range(len(group))]
        return out

    assert slots("a b", "c d e", "", "B! a") == slots("a b") + slots("c d e") + [[]] + slots("b a")
    assert len(slots("one two three four")[0]) == 4 + 3 + 2 + 1


def test_l1_gives_sparse_weights():
    rng = np.random.default_rng(0)
    examples = []
    for i in range(600):
        y = i % 3 == 0
        examples.append((np.unique(np.append(rng.integers(10, 2000, 30), 3 if y else 11)), int(y)))
    kept, w, bias = tx.fit(examples, tx.Settings(bits=11)).compact()
    assert 3 in kept and len(kept) < 50 and w[list(kept).index(3)] > 1 > bias


def plain_features(text):
    """Words, pairs and skip-grams by plain loops, in groups of one kind."""
    lower = (text or "").encode()
    lower = bytes(b + 32 if 65 <= b <= 90 else b for b in lower)
    words = re.findall(rb"[0-9a-z'\x80-\xff]+", lower)
    return [[(k, a) if k == 0 else (k, a, words[i + k]) for i, a in enumerate(words) if i + k < len(words)] for k in range(4)]


def plain_ftrl(examples, order, s):
    """FTRL-proximal on dictionaries: z, n of each coordinate; the bias has no L1 term."""
    z, n = {}, {}
    ones = sum(y for _, y in examples.values())
    lift = min(2.0, max(1.0, (len(examples) - ones) / max(ones, 1)))

    def weight(c):
        pull = 0.0 if c == "bias" else s.l1
        if abs(z.get(c, 0.0)) <= pull:
            return 0.0
        return -(z[c] - math.copysign(pull, z[c])) / ((s.beta + math.sqrt(n.get(c, 0.0))) / s.alpha + s.l2)

    for epoch in order:
        for i in epoch:
            found, y = examples[i]
            at = [*found, "bias"]
            w = {c: weight(c) for c in at}
            g = (1 / (1 + math.exp(-sum(w.values()))) - y) * (lift if y else 1.0)
            for c in at:
                old = n.get(c, 0.0)
                z[c] = z.get(c, 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / s.alpha * w[c]
                n[c] = old + g * g
    return weight


def test_scores_against_plain_ftrl(spark):
    rows, labels = corpus(240)
    rng = random.Random(4)
    rows[7] = (7, " ".join(f"W{rng.randrange(300)}" for _ in range(20_000)) + " n\u00e4ive, don't", "")
    rows[9] = (9, None, "")
    settings = tx.Settings(bits=20, l1=2.0, epochs=3)

    slot, names = {}, {}
    for i, text, _ in rows:
        kinds = plain_features(text)
        names[i] = [f for kind in kinds for f in kind]
        for group in text_groups(pa.array([text or ""])):
            got, owner = tx.features(group, settings.bits)
            assert len(got) == len(names[i]) and not owner.any()
            for f, at in zip(names[i], got.tolist()):
                assert slot.setdefault(f, at) == at
    apart = len(slot) - len(set(slot.values()))
    assert apart < 3 * len(slot) ** 2 / 2 ** (settings.bits + 1)  # different features meet only by chance

    truth = {i: y for i, y, _ in labels}
    learned = {i: ({slot[f] for f in names[i]}, truth[i]) for i, _, _ in rows if zlib.crc32(str(i).encode()) % 5}
    ids = spark.createDataFrame([(i,) for i in learned], "id long")
    order = [[r.id for r in ids.orderBy(tx.F.xxhash64("id", tx.F.lit(e)), "id").collect()] for e in range(settings.epochs)]
    weight = plain_ftrl(learned, order, settings)
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string").repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, toxic int, quality int")
    got = {r.doc_id: r.score for r in tx.toxicity(docs, marks, settings).collect()}
    want = {i: 1 / (1 + math.exp(-(sum(weight(c) for c in {slot[f] for f in names[i]}) + weight("bias")))) for i, _, _ in rows}
    assert got.keys() == want.keys() and len({round(x, 3) for x in want.values()}) > 10
    assert max(abs(got[i] - want[i]) for i in want) < 1e-4
