from __future__ import annotations

import math
import random

import numpy as np
from pyspark.sql import functions as F

from docloom.llm import bit_mining

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, positives=5, negatives=10, every=100):
    kept = []
    for k, (i, v, label) in enumerate(rows):
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            kept.append((k, i, [math.floor(256 * float(np.float32(x))) for x in v], label))
    out = []
    for k, i, q, label in kept:
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, w)), j, n, lab) for n, j, w, lab in kept)  # noqa: B905
        for s, j, n, lab in [x for x in scored if x[3] == label and x[2] != k][:positives]:
            fit = [(-t, m) for t, m, _, other in scored if other != label and 30 * -s <= 100 * -t <= 90 * -s]
            out += [(i, j, r + 1, m, -s, t) for r, (t, m) in enumerate(fit[:negatives])]
    return sorted(out)


def made(n, seed, size=8, spread=1.0):
    draw = random.Random(seed)
    return [(i, [draw.gauss(0.2, spread) for _ in range(size)], draw.randrange(3)) for i in range(n)]


def test_mined_by_brute_force(spark):
    rows = made(500, 1) + made(300, 2, spread=0.01)[1:]
    rows = [(k, v, lab) for k, (_, v, lab) in enumerate(rows)]
    for size in (bit_mining.ROWS, 97):
        got = bit_mining.mine(spark.createDataFrame(rows, SCHEMA).repartition(3), block=size)
        want = brute(rows)
        assert want and sorted(map(tuple, got.collect())) == want


def test_ties_copies_and_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    same = [(k, [0.5, -0.25, 0.75], k % 2) for k in range(250)]  # a hot vector: every score ties
    odd = [(300, None, 1), (400, [1.0, None, 1.0], 1), (500, [1.0, nan, 0.0], 1), (600, [inf, 0.0, 0.0], 0), (None, [1.0, 1.0, 1.0], 0), (700, [1.0, 1.0, 1.0], None), (800, [], 0), (900, [0.5], 1), (-100, [0.4, -0.2, 0.7], 0)]
    near = [(1000 + k, [0.25 + k / 512, -0.125, 0.375], k % 3) for k in range(40)]
    rows = same + odd + near
    docs = spark.createDataFrame(rows, SCHEMA).coalesce(1).withColumn("r", F.lit(0)).withColumn("score", F.lit("clash"))
    want = brute(rows)
    assert want and sorted(map(tuple, bit_mining.mine(docs).collect())) == want
    twice = rows + [rows[0], rows[0], rows[-1]]
    assert sorted(map(tuple, bit_mining.mine(spark.createDataFrame(twice, SCHEMA).coalesce(1)).collect())) == brute(twice)


def test_empty_tables_and_few_rows(spark):
    assert bit_mining.mine(spark.createDataFrame([], SCHEMA)).count() == 0
    assert bit_mining.mine(spark.createDataFrame([(1, [1.0], 1)], SCHEMA)).count() == 0
    few = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.5, 0.0], 2), (3, [0.95, 0.0], 2)]
    assert sorted(map(tuple, bit_mining.mine(spark.createDataFrame(few, SCHEMA)).collect())) == [(0, 1, 1, 2, 65536, 32768)]


def test_planes_are_exact_and_drop_pairs():
    draw = np.random.default_rng(3)
    q, x = draw.integers(-200, 200, (20, 16)), draw.integers(-300, 150, (500, 16))
    bits = bit_mining.planes(-300, 150)
    asked = []

    def keep(a, r, low, high):
        true = (q[a] * x[r]).sum(1)
        assert (low <= true).all() and (true <= high).all()
        asked.append(len(a))
        return high >= bit_mining._kth(a, low, 3, 20)[a]

    a, r, s = bit_mining.bit_sliced(q.astype(float), x, np.ones((20, 500), bool), bits, keep)
    assert ((q[a] * x[r]).sum(1) == s).all() and asked[0] == 10_000 and len(a) < 200 and asked[-1] < 3000
    for k in range(20):
        assert set(np.sort((x @ q[k]))[-3:]) <= set(s[a == k])
