import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa

from corpusloom.llm import packing, tokens
from corpusloom.llm.textarrays import text_groups

ODD = ["H̱ x Å", "don't, 'tis a',b x'rex 12ab3 <|endoftext|> hi <|ENDOFTEXT|>", "…,— word—word", "", "\x1c a\x00b ΣΑΣ. Σ'", "a b  Ć", "x" * 5000, "many short words " * 3000]


def ids_of(texts, path=None):
    out = []
    enc = tokens.encoder(path)
    for group in text_groups(pa.array(texts)):
        ids, offsets = enc.encode(group)
        out += [ids[a:b].astype("<u4") for a, b in zip(offsets[:-1], offsets[1:])]
    return out


def test_pieces_give_the_tokenizer_s_ids():
    tok = tokens.encoder(None).tokenizer
    assert [list(i) for i in ids_of(ODD)] == [e.ids + [1] for e in tok.encode_batch(ODD, add_special_tokens=False)]


def test_other_tokenizers_get_whole_texts(spark, tmp_path):
    from public_tokenizers import path
    from tokenizers import Tokenizer, models, pre_tokenizers

    cased = Tokenizer(models.WordLevel({"Hello": 1, "hello": 2, "?": 0}, unk_token="?"))
    cased.pre_tokenizer = pre_tokenizers.Whitespace()
    cased.save(str(tmp_path / "cased.json"))
    assert [x.tolist() for x in ids_of(["Hello hello", "", "HELLO"], str(tmp_path / "cased.json"))] == [[1, 2, 1], [1], [0, 1]]
    texts = [*ODD, "The Quick brown fox, Hello World", "  two  spaces\n\nlines\t", ""]
    tok = Tokenizer.from_file(path("byte_bpe_50k.json"))
    want = [e.ids + [1] for e in tok.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in ids_of(texts, path("byte_bpe_50k.json"))] == want
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'s' AS source")
    got = packing.pack(docs, tokenizer=path("byte_bpe_50k.json")).collect()
    assert {r.doc_id: r.doc_tokens for r in got} == {d: len(w) for d, w in enumerate(want)}
    assert all(r.ids_crc32 == zlib.crc32(np.array(want[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) for r in got)
    assert tokens.encoder(None).by_pieces and not tokens.encoder(path("byte_bpe_50k.json")).by_pieces


def test_schedule_is_the_round_robin():
    rng = random.Random(0)
    for _ in range(20):
        totals, window = [rng.randrange(1, 300) for _ in range(rng.randrange(1, 7))], rng.randrange(5, 40)
        s = packing.Schedule(np.array(totals), window)
        served, states = [0] * len(totals), []
        for token in range(sum(totals)):  # sequential simulation, one token at a time
            if token % window == 0:
                states.append(list(served))
            behind = min((q for q in range(len(totals)) if served[q] < totals[q]), key=lambda q: ((served[q] + 0.5) / totals[q], q))
            served[behind] += 1
        assert s.served(np.arange(s.windows + 1)).tolist() == [*states, totals]


def test_every_id_once_and_mixture(spark):
    rng = random.Random(4)
    words = [f"word{i}" for i in range(200)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(0, 300))), "abc"[min(2, i % 4)], 0) for i in range(300)]
    rows += [(1000 + i, t, None, 0) for i, t in enumerate(ODD)] + [(2000, None, "a", 0), (None, "null id", "b", 0), (5, rows[5][1], rows[5][2], 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, length int").repartition(3)
    got = packing.pack(docs).collect()
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        windows[r.sequence_id].append(r)
    for w, rs in windows.items():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at == 2048 or w == max(windows)
    want = dict(zip([r[0] for r in rows], ids_of([r[1] or "" for r in rows])))
    for d, ids in want.items():
        copies = 2 if d == 5 else 1
        assert sum(r.length for r in pieces[d]) == copies * len(ids) and {r.doc_tokens for r in pieces[d]} == {len(ids)}
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in pieces[d])
        if copies == 1:
            at = 0
            for r in sorted(pieces[d], key=lambda r: r.start):
                assert r.start == at
                at += r.length
    source = {r[0]: r[2] for r in rows}
    total = sum(r.length for r in got)
    for s in ("a", "b", "c", None):
        share = sum(r.length for r in got if source[r.doc_id] == s) / total
        for w in range(len(windows) - 1):
            assert abs(sum(r.length for r in windows[w] if source[r.doc_id] == s) - share * 2048) <= 8
    assert packing.pack(docs.limit(0)).count() == 0


def packed_shares(spark, sources, rows_of, window=2048, **kw):
    """Tokens of each source in each window, as [windows, sources], after a check that windows are full and ids whole."""
    rows = [(d, " ".join([f"w{d % 9}"] * (5 + d % 37)), s) for d, s in enumerate(s for s in sources for _ in range(rows_of(s)))]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(3), window, **kw).collect()
    place, of = {s: i for i, s in enumerate(sources)}, {r[0]: r[2] for r in rows}
    held, pieces, windows = np.zeros((max(r.sequence_id for r in got) + 1, len(sources)), int), defaultdict(list), defaultdict(list)
    for r in got:
        held[r.sequence_id, place[of[r.doc_id]]] += r.length
        pieces[r.doc_id].append(r)
        windows[r.sequence_id].append(r)
    for rs in windows.values():
        rs.sort(key=lambda r: r.offset)
        assert [r.offset for r in rs] == [sum(x.length for x in rs[:i]) for i in range(len(rs))]
    want = dict(zip(of, ids_of([r[1] for r in rows])))
    for d, ids in want.items():
        at = 0
        for r in sorted(pieces[d], key=lambda r: r.start):
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    assert (held[:-1].sum(1) == window).all()
    return held


def even(held, most):
    """No source is further than ``most`` tokens from its share of all windows before any."""
    share = held.sum(0) / held.sum()
    return (np.abs(held[:-1].cumsum(0) - np.outer(held[:-1].sum(1).cumsum(), share)) <= most).all()


def test_sources_of_one_hash_stay_apart(spark):
    hashed = spark.range(200).selectExpr("concat('s', id) AS s").selectExpr("s", "pmod(xxhash64(s), 256) AS h").collect()
    same = next([a.s, b.s] for a in hashed for b in hashed if a.h == b.h and a.s < b.s)
    assert even(packed_shares(spark, [*same, "other"], lambda s: 150), 3)


def test_more_sources_than_queues(spark):
    sources = [f"host{i}" for i in range(300)]
    rows_of = lambda s: 3 + int(s[4:]) % 5
    assert even(packed_shares(spark, sources, rows_of), 4)
    assert even(packed_shares(spark, sources[:40], rows_of, window=100, queues=3), 4)


def test_weights(spark):
    for kw in ({}, {"queues": 3}):
        held = packed_shares(spark, list("abcdef"), lambda s: 100, window=200, weights={"a": 0.5, "b": 0.1}, **kw)
        lasts = held[: np.flatnonzero(held[:, 0])[-1]]  # until "a" has run out
        assert len(lasts) > 5 and (np.abs(lasts.cumsum(0)[:, :2] - np.outer(np.arange(1, len(lasts) + 1), [100, 20])) <= 4).all()
        rest = lasts[:, 2:].cumsum(0)
        assert (np.abs(rest - rest.sum(1, keepdims=True) * held[:, 2:].sum(0) / held[:, 2:].sum()) <= 4).all()
