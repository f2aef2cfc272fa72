import random
from math import floor, inf, isfinite, nan

import numpy as np
import pytest
from pyspark.sql import functions as F

from martmend.llm import mining, queries


def plain(rows, every=5):
    """Brute force over (vec_id, vector, label)."""
    held = sorted({(i, tuple(floor(256 * x) for x in v), k) for i, v, k in rows if i is not None and k is not None and v is not None and all(x is not None and isfinite(x) for x in v)})
    out = []
    for anchor, a, label in held:
        if anchor % every:
            continue
        scored = [(-sum(x * y for x, y in zip(a, v, strict=True)), i, k == label) for i, v, k in held if i != anchor and len(v) == len(a)]
        for s, positive, _ in sorted(x for x in scored if x[2])[:5]:
            near = sorted((t, i) for t, i, same in scored if not same and 50 * -s <= 100 * -t <= 95 * -s)[:3]
            out += [(anchor, positive, r, i, -s, -t) for r, (t, i) in enumerate(near, 1)]
    return sorted(out)


def vectors(rng, n, dim, spread):
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(5)]
    return [(i, [c + rng.gauss(0, spread) for c in rng.choice(centres)], rng.randrange(4)) for i in range(n)]


def mined(spark, rows, every=5):
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label int, block int")
    found = mining.mine(df, lambda vec_id: vec_id % every == 0)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, found.collect()))


def test_hilbert_curve_steps_to_neighbours():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3), -1).reshape(-1, 3)
    keys = mining.hilbert(grid, 3)
    order = np.array(sorted(range(len(grid)), key=lambda i: keys[i].tobytes()))
    assert len({k.tobytes() for k in keys}) == 512
    assert (np.abs(np.diff(grid[order], axis=0)).sum(axis=1) == 1).all()


def test_bounds_hold_for_every_row():
    rng = np.random.default_rng(3)
    for scale in (10, 2**30):
        a, v = rng.integers(-scale, scale, (20, 6)), rng.integers(-scale, scale, (50, 6))
        low, high = mining.bounds(a, v.min(axis=0)[None], v.max(axis=0)[None])
        exact = np.array([[sum(int(x) * int(y) for x, y in zip(p, q, strict=True)) for q in v] for p in a])
        assert (mining.product(a, v) == exact).all() and (low <= exact).all() and (exact <= high).all()
        assert (mining.unpack(mining.pack(v), 50, 6) == v).all()


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_mine_in_small_blocks_against_brute_force(spark, monkeypatch, spread):
    for name, value in {"BLOCK": 8, "PARTITION": 60, "GROUP": 2, "PART": 4, "CHUNK": 6}.items():
        monkeypatch.setattr(mining, name, value)
    rows = vectors(random.Random(6), 300, 6, spread)
    expected = plain(rows)
    assert expected and mined(spark, rows) == expected


def test_clustered_blocks_are_skipped(spark, monkeypatch):
    monkeypatch.setattr(mining, "BLOCK", 16)
    blocks = mining.blocked(mining.usable(spark.createDataFrame(vectors(random.Random(7), 800, 4, 0.02), "vec_id long, embedding array<double>, label int"))).collect()
    v = [mining.unpack(b.v, len(b.ids), b.dim) for b in blocks]
    assert sum(len(x) for x in v) == 800
    read = total = 0
    for b, x in zip(blocks, v, strict=True):
        for a, i in zip(x, b.ids, strict=True):
            if i % 50 == 0:
                least = sorted((int(s) for y in v for s in mining.product(a[None], y)[0]), reverse=True)[5]
                for other in blocks:
                    _, high = mining.bounds(a[None], mining.unpack(other.lo, 1, 4), mining.unpack(other.hi, 1, 4))
                    read, total = read + int(high[0, 0] >= least), total + 1
    assert read < total / 3


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(mining, "BLOCK", 4)
    rng = random.Random(8)
    rows = vectors(rng, 60, 3, 0.5) + [(100 + i, [0.5, 0.5, 0.5], i % 2) for i in range(30)]
    rows += [(5, [0.1, 0.2, 0.3], 1), rows[10], rows[10], (5, [9.0], 1), (205, [1.0], 1), (206, [0.9], 2), (207, [1.1], 1)]
    rows += [(300, None, 1), (305, [1.0, None, 1.0], 1), (310, [1.0, nan, 1.0], 1), (315, [1.0, inf, 1.0], 1), (320, [1.0, 1.0, 1.0], None), (None, [1.0, 1.0, 1.0], 1), (325, [], 1), (326, [], 1), (327, [], 2), (330, [0.0, 0.0, 0.0], 1)]
    assert mined(spark, rows) == plain(rows)
    assert mined(spark, rows[:1]) == [] and mined(spark, [(300, None, 1)]) == []


def test_query_against_brute_force(spark):
    path = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{path}/embeddings.parquet").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))).collect()
    assert sorted(map(tuple, queries.op13_mining(spark, path).collect())) == plain([(r.vec_id, r.embedding, r.label) for r in rows], 50)
