import random
import re

from corpusloom.llm import decontamination as dec

LOWER = {i: i + 32 for i in range(65, 91)}


def grams(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}, w


def brute_force(docs, items):
    out = []
    for item, text in items:
        _, w = grams(text, 1)
        if not w:
            continue
        width = min(5, len(w))
        q = grams(text, width)[0]
        for d, t in docs:
            shared = len(q & grams(t, width)[0])
            if 100 * shared >= 80 * len(q):
                out.append((d, item, len(q), shared))
    return sorted(out, key=str)


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(60)]
    text = lambda k: " ".join(rng.choices(words, k=k))
    items = [(i, text(rng.choice([1, 2, 4, 5, 6, 12, 30, 60]))) for i in range(60)] + [(900, None), (901, ""), (902, " \t ")]
    docs = [(i, text(rng.randrange(0, 400))) for i in range(120)] + [(500, None), (501, ""), (502, "W1 w2"), (503, text(30000))]
    for i in range(60):  # leaks: whole, upper-case, with an edit, in two halves
        w = items[i][1].split()
        if i % 4 == 1:
            w = [x.upper() for x in w]
        elif i % 4 == 2:
            w[len(w) // 2] = "edited"
        elif i % 4 == 3:
            w = w[: len(w) // 2 + 4] + ["gap"] * 50 + w[len(w) // 2 :]
        docs.append((1000 + i, f"{text(200)}\n{' '.join(w)}\u0009{text(100)}"))
    docs += [(1003, docs[-1][1]), (None, items[7][1])]
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, item_id string")
    b = spark.createDataFrame([(*r, 0) for r in items], "item_id long, text string, doc_id int")
    want = brute_force(docs, items)
    assert len(want) > 40
    assert sorted(map(tuple, dec.contamination(d, b).collect()), key=str) == want
    monkeypatch.setattr(dec, "BLOCK_SHINGLES", 300)
    assert sorted(map(tuple, dec.contamination(d, b).collect()), key=str) == want
    kept = dec.decontaminated(d, b)
    assert kept.columns == d.columns
    bad = {w[0] for w in want}
    assert sorted((r.doc_id, r.text or "") for r in kept.where("doc_id is not null").collect()) == sorted((i, t or "") for i, t in docs if i is not None and i not in bad or i == 1003 and (i, t) not in [x for x in docs if brute_force([x], items)])
    assert dec.contamination(d.limit(0), b).count() == 0 and dec.contamination(d, b.limit(0)).count() == 0
