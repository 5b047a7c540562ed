import hashlib
import math
import random

import numpy as np
import pytest
from quirefold.llm import centroids as ce

SCHEMA = "vec_id long, embedding array<float>, row int, cluster string"


def brute(rows, clusters=8, rounds=10, n=4):
    kept = [(k, [math.floor(max(-(2**27), min(2**27, 1024 * float(np.float32(x))))) for x in v]) for k, v in rows if v is not None and len(v) == n and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    c = [v for _, v in order[:clusters]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min((far(v, x), j) for j, x in enumerate(c))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        groups = [[v for (_, v), j in zip(kept, own) if j == i] for i in range(len(c))]
        c = [[sum(x) // len(g) for x in zip(*g)] if g else old for g, old in zip(groups, c)]
    out = [(k, *near(v)) for k, v in kept]
    total = lambda j: sum(d for _, d, i in out if j in (None, i))
    fits = lambda x: x if x < 2**63 else None
    return sorted(((k, j, d, fits(total(j)), fits(total(None)), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for k, d, j in out), key=repr)


def table(seed, count):
    r = random.Random(seed)
    rows = [(i, [r.gauss(3 * (i % 5), 1) for _ in range(4)]) for i in range(count)]
    odd = [(None, [0.5] * 4), (3, [0.5] * 4), (3, [0.25] * 4), (7, None), (8, []), (9, [1.0] * 5), (10, [1.0, None, 1.0, 1.0]), (11, [math.nan, 1.0, 1.0, 1.0]), (12, [math.inf] * 4), (13, [-0.0001] * 4)]
    return rows + odd + rows[:4]


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("bits", [1, 3, 6, 8])
def test_against_brute_force(spark, bits):
    rows = table(1, 300)
    df = spark.createDataFrame([(*r, 1, "clash") for r in rows], SCHEMA).repartition(3)
    assert found(ce.cluster_vectors(df, dimensions=4, bits=bits)) == brute(rows)


def test_few_equal_huge_and_no_vectors(spark):
    for rows in ([(1, [1.0, 2.0, 3.0, 4.0]), (2, [1.0, 2.0, 3.0, 4.0])], [(i, [0.0] * 4) for i in range(30)], [(i, [1e30 * (-1) ** i, 2e5, -1e9, float(i)]) for i in range(20)], [(1, None)]):
        df = spark.createDataFrame([(*r, 1, "clash") for r in rows], SCHEMA)
        assert found(ce.cluster_vectors(df, dimensions=4, rounds=3)) == brute(rows, rounds=3)


def test_approximations_decide_most_vectors_of_clear_clusters(spark):
    r = np.random.default_rng(2)
    middles = r.normal(0, 5, (8, 16))
    rows = [(i, (middles[i % 8] + r.normal(0, 0.3, 16)).tolist(), 1, "") for i in range(2000)]
    vectors, fetched = ce.vector_table(spark.createDataFrame(rows, SCHEMA), dimensions=16), []
    ce.fit(vectors, bits=4, fetched=fetched)
    assert fetched and sum(fetched[1:]) < 0.2 * 2000 * max(1, len(fetched) - 1)


def test_decisions_from_cells_are_right():
    r = np.random.default_rng(3)
    v = r.integers(-500, 500, (3000, 6))
    v[:50] = 3
    for bits in (2, 5, 8):
        cells = ce.Cells(v[:400], bits)
        cells.bound(v.min(0), v.max(0))
        codes = cells.decode(cells.encode(v))
        assert all(((cells.low[d][codes[:, d]] <= v[:, d]) & (v[:, d] <= cells.high[d][codes[:, d]])).all() for d in range(6))
        c = np.concatenate([v[100:107], v[103:104]])
        decided = cells.decide(codes, c)
        assert (decided[decided >= 0] == ce.nearest(v, c)[0][decided >= 0]).all()
        assert bits < 5 or (decided >= 0).mean() > 0.5
