"""Operator 7 against brute force."""

import numpy as np
from pyspark.sql import functions as F

from martmend.llm import ann, queries


def brute(rows, k=5, step=50):
    sound = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, a in sound:
        if q % step == 0:
            scored = [(-float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), i) for i, b in sound if i != q]
            out[q] = sorted(scored)[:k]
    return out


def agree(got, want):
    """The same cosines to the last places, and the same ids wherever the cosines do not tie there."""
    assert got.keys() == want.keys()
    for q, rows in want.items():
        assert [round(s, 14) for s, _ in got[q]] == [round(s, 14) for s, _ in rows] or np.allclose([s for s, _ in got[q]], [s for s, _ in rows], rtol=0, atol=3e-15)
        for (s, i), (t, j) in zip(got[q], rows, strict=True):
            assert i == j or abs(s - t) <= 1e-15, (q, got[q], rows)


def test_odd_vectors_copies_and_ties(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.standard_normal(4)]) for i in range(120)]
    rows += [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(200, 290)]
    rows += [(i, [float(x * (i - 399)) for x in (0.1, -0.2, 0.3, 0.7)]) for i in range(400, 461)]
    rows += [(300, None), (301, [0.0] * 4), (302, [1.0, None, 1.0, 1.0]), (303, [1.0, float("nan"), 1.0, 1.0]), (304, [float("inf"), 1.0, 1.0, 1.0]), (305, [1.0, 2.0]), (None, [1.0] * 4), (50, rows[50][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit(0)).withColumn("c", F.lit("x"))
    kept = [(r.vec_id, r.embedding) for r in df.distinct().collect() if r.embedding is None or len(r.embedding) == 4]
    want = brute(kept)
    got: dict = {}
    for r in sorted(ann.nearest(df, lambda v: v % 50 == 0).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    agree(got, want)
    assert ann.nearest(df.limit(0), lambda v: v % 50 == 0).count() == 0
    assert ann.nearest(df.where("vec_id in (50, 51)"), lambda v: v % 50 == 0).count() == 1


def test_cosines_that_differ_in_late_places_are_told_apart(spark):
    base = np.array([3.0, 1.0, -2.0, 0.5])
    aside = np.array([1.0, -3.0, 0.0, 0.0])  # at a right angle
    steps = {0: 0.0, 10: 4e-7, 11: 1.3e-7, 12: 4.4e-8, 13: 0.0, 14: 2.3e-7, 16: 9e-8, 941: 0.0, 942: 0.0}
    rows = [(i, [float(x) for x in base + e * aside]) for i, e in steps.items()] + [(i, [float(x) for x in -base * i]) for i in range(1, 9)]
    found = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda v: v == 0).orderBy("rank").collect()
    assert [r.vec_id for r in found] == [13, 941, 942, 12, 16]
    assert [r.score for r in found] == sorted((r.score for r in found), reverse=True)


def test_many_ties_leave_a_bounded_number_of_candidates(spark):
    # Signed unit vectors in 40 dimensions: nearly all are at right angles, so their cosines tie.
    rows = [(2 * d + s, [(1.0 if s else -1.0) if j == d else 0.0 for j in range(40)]) for d in range(40) for s in (0, 1)]
    found = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda v: v % 50 == 0).collect()
    got = {q: [r.vec_id for r in sorted(found, key=lambda r: r["rank"]) if r.query_id == q] for q in (0, 50)}
    assert got == {0: [2, 3, 4, 5, 6], 50: [0, 1, 2, 3, 4]}


def test_recall_of_the_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    want = brute(rows)
    got: dict = {}
    for r in queries.op7_ann(spark, "/root/testdata/sf0.1").collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert sum(len(got[q] & {i for _, i in w}) for q, w in want.items()) >= 0.9 * sum(map(len, want.values()))
