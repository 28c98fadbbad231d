"""Hard negatives against brute force: ties, equal vectors, chunks of anchors, loose cells, and edge cases."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chatloom.llm import hardnegatives, queries
from chatloom.llm.hardnegatives import Kept, cells, integer_rows, mine

SCHEMA = "vec_id long, label int, embedding array<float>, id string, row int, q string, anchor int, code int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y", 2, 3) for r in rows], SCHEMA)


def mined_by_hand(rows, every, positives=5, negatives=5, share=(80, 100)):
    """Plain Python over all pairs."""
    whole = set()
    for i, label, v in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) and abs(x * 256) <= 1 << 26 for x in v):
            whole.add((i, label, tuple(math.floor(256 * float(np.float32(x))) for x in v)))
    out = []
    for i, label, v in whole:
        if i % every:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(v, w, strict=False)), j, other) for j, other, w in whole if j != i))
        for s, j, _ in [x for x in scored if x[2] == label][:positives]:
            fit = [x for x in scored if x[2] != label and share[0] * -s <= share[1] * -x[0] <= share[1] * -s][:negatives]
            out += [(i, j, rank + 1, x[1], -s, -x[0]) for rank, x in enumerate(fit)]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.collect())


def vectors(rng, n, dims, labels=4, spread=0.3):
    return [(i, rng.randrange(labels), [rng.gauss(0.1, spread) for _ in range(dims)]) for i in range(n)]


@pytest.mark.parametrize(("chunk_bytes", "n_cells"), [(1 << 25, 256), (2000, 256), (1 << 25, 4)])
def test_mining_by_brute_force(spark, monkeypatch, chunk_bytes, n_cells):
    # small chunks: several scans; four cells: loose bounds, more candidates, the same result
    monkeypatch.setattr(hardnegatives, "cells", lambda rows: cells(rows, n_cells))
    rows = vectors(random.Random(5), 400, 12)
    want = mined_by_hand(rows, 10)
    assert got(mine(table(spark, rows), F.col("id") % 10 == 0, chunk_bytes=chunk_bytes)) == want and len(want) > 300


def test_ties_and_groups_of_equal_vectors(spark):
    # a third of all rows is one vector, in two labels; components of few values make ties everywhere
    rng = random.Random(6)
    rows = [(i, rng.randrange(3), [rng.choice([0.0, 0.25, 0.5]) for _ in range(4)]) for i in range(300)]
    rows += [(1000 + i, i % 2, [0.25, 0.25, 0.25, 0.25]) for i in range(150)]
    assert got(mine(table(spark, rows), F.col("id") % 10 == 0)) == mined_by_hand(rows, 10)


def test_mining_edges(spark):
    rng = random.Random(7)
    rows = vectors(rng, 60, 3, labels=2)
    rows += [(None, 1, [1.0, 1.0, 1.0]), (200, None, [1.0]), (201, 0, None), (202, 0, [1.0, None]), (203, 1, [math.nan, 0.0]), (204, 1, [math.inf]), (205, 1, [-math.inf, 1.0])]
    rows += [(210, 0, []), (211, 1, [0.5]), (212, 0, [0.5, -0.5, 0.25, 0.125, 3.0]), (213, 1, [1e6, 1.0, 1.0]), (220, 1, [4000.0, 3000.0, -2000.0])]
    rows += [(0, 0, [0.5, 0.5, 0.5]), (0, 1, [0.5, 0.5, 0.25]), *rows[5:15], *rows[5:15]]  # one id twice; repeated rows
    assert got(mine(table(spark, rows), F.col("id") % 10 == 0)) == mined_by_hand(rows, 10)
    assert got(mine(table(spark, rows), F.col("id") < 0)) == got(mine(table(spark, rows[:0]), F.col("id") >= 0)) == []
    alone = [(0, 1, [1.0]), (1, 1, [0.5])]  # positives without negatives
    assert got(mine(table(spark, alone), F.col("id") == 0)) == []
    assert got(mine(table(spark, [(0, 1, []), (1, 1, []), (2, 2, [])]), F.col("id") == 0)) == [(0, 1, 1, 2, 0, 0)]


def test_bounds_hold_and_leave_few_candidates(spark):
    rows = vectors(random.Random(8), 3000, 32, labels=3, spread=0.1)
    whole = integer_rows(table(spark, rows), "vec_id", F.col("label"), "embedding", 256)
    found = cells(whole)
    q = np.array([r.q for r in whole.collect()])
    at, codes = np.arange(32), found.encode(q)
    assert (found.low[at, codes] <= q).all() and (q <= found.high[at, codes]).all()
    middle, half = found.edges(codes, 32)
    center, radius = middle @ q[:50].T, half @ np.abs(q[:50]).T
    exact = q @ q[:50].T
    assert (center - radius <= exact).all() and (exact <= center + radius).all()
    kept = Kept(np.full(50, -np.inf), 5)
    i, j = np.nonzero(np.ones_like(exact, bool))
    kept.add(j, i, i, (center - radius)[i, j], (center + radius)[i, j], np.ones(len(i), bool))
    key, row, *_ = kept.squeeze()
    assert len(key) < 50 * 5 * 3
    for a in range(50):
        assert set(sorted(range(len(q)), key=lambda r: (-exact[r, a], r))[:5]) <= set(row[key == a].tolist())


def test_cells_of_a_thinned_sample(spark):
    # fewer sampled rows than rows: looser cells, which still cover all values, and the same result
    rows = vectors(random.Random(12), 500, 8)
    whole = integer_rows(table(spark, rows), "vec_id", F.col("label"), "embedding", 256)
    found = cells(whole, 16, sample=20)
    q = np.array([r.q for r in whole.collect()])
    codes = found.encode(q)
    assert (found.low[np.arange(8), codes] <= q).all() and (q <= found.high[np.arange(8), codes]).all()


def test_query_equals_brute_force(spark, sf_dir):
    rows = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert got(queries.QUERIES["op11_hard_negatives"](spark, sf_dir)) == mined_by_hand(rows, 100)
