import random
import zlib
from collections import defaultdict

import numpy as np

from corpusloom.llm import idmatrix

from .test_packing import ODD, ids_of


def test_best_fit_against_linear_search():
    rng = random.Random(2)
    for most in (1, 7, 64, 100):
        lengths = np.array([rng.randrange(1, most + 1) for _ in range(300)])
        place, offset, rows = idmatrix.best_fit(lengths, most)
        left, used = [], 0
        for n in sorted(lengths.tolist(), reverse=True):  # best fit decreasing, by linear search
            fits = [i for i, c in enumerate(left) if c >= n]
            if fits:
                left[min(fits, key=lambda i: left[i])] -= n
            else:
                left.append(most - n)
        assert rows == len(left)
        for r in range(rows):
            spans = sorted((offset[i], lengths[i]) for i in np.flatnonzero(place == r))
            assert [o for o, _ in spans] == [sum(n for _, n in spans[:i]) for i in range(len(spans))]
            assert sum(n for _, n in spans) <= most


def test_round_trip(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices(["alpha", "beta", "gam"], k=rng.randrange(0, 300))), "x") for i in range(200)]
    rows += [(1000 + i, t, "x") for i, t in enumerate(ODD)] + [(2000, None, "x"), (None, "null id", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    want = dict(zip([r[0] for r in rows], ids_of([r[1] or "" for r in rows])))
    matrix = idmatrix.id_matrix(docs, 256, round_tokens=4000).cache()
    pieces, rows_of = defaultdict(list), defaultdict(list)
    for r in idmatrix.digest(matrix).collect():
        pieces[r.doc_id].append(r)
        rows_of[r.sequence_id].append(r)
        assert r.position_reset and r.ids_crc32 == zlib.crc32(want[r.doc_id][r.start : r.start + r.length].tobytes())
    for d, ids in want.items():
        assert sum(r.length for r in pieces[d]) == len(ids) == pieces[d][0].doc_tokens
        assert len({r.start for r in pieces[d]}) == len(pieces[d])
    for m in matrix.collect():
        assert len(m.ids) == len(m.position_ids) == 1024 and m.cu_seqlens[0] == 0
        assert sorted(r.offset for r in rows_of[m.sequence_id]) == m.cu_seqlens[:-1]
        at = np.frombuffer(m.position_ids, "<u4")
        assert all((at[a:b] == np.arange(b - a)).all() for a, b in zip(m.cu_seqlens, m.cu_seqlens[1:]))
        assert not np.frombuffer(m.ids, "<u4")[m.cu_seqlens[-1] :].any()
    assert idmatrix.write_and_digest(docs.limit(0)).count() == 0
