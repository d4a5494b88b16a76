from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.llm import ann


def brute(rows, every=20, k=20):
    ok = {i: np.array(v, float) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    ids = np.array(sorted(ok))
    m = np.stack([ok[i] for i in ids])
    out = {}
    for q in ids[ids % every == 0]:
        s = (m * ok[q]).sum(1)
        s[ids == q] = -np.inf
        best = np.lexsort((ids, -s))[:k]
        out[int(q)] = [(int(ids[b]), float(s[b])) for b in best if np.isfinite(s[b])]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


def test_recall_and_order(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    want = brute([(r["vec_id"], list(r["embedding"])) for r in e.collect()])
    got = found(ann.search(e))
    assert set(got) == set(want)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    for q, rows in got.items():
        assert len(rows) == 20 and rows == sorted(rows, key=lambda x: (-x[1], x[0]))
        exact = dict(want[q])
        assert all(abs(s - exact[i]) < 1e-12 for i, s in rows if i in exact)


def test_blocks_and_parts_agree(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    a, b = found(ann.search(e, probes=0)), found(ann.search(e.repartition(7), probes=0, query_bytes=1000))
    same = sum(len(set(a[q]) & set(b[q])) for q in a)
    assert same >= 0.98 * sum(map(len, a.values()))


def test_recall_on_clusters_visits_few_lists(spark):
    """Clusters, one of which holds a third of the rows, and copies: recall against brute force, and lists visited."""
    r = np.random.default_rng(3)
    middle = r.standard_normal((30, 48)) * 3
    of = np.where(r.random(3000) < 0.33, 0, r.integers(0, 30, 3000))
    m = middle[of] + r.standard_normal((3000, 48)) * 0.7
    m[500:700] = m[500]
    rows = [(i, v.tolist()) for i, v in enumerate(m)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(6)
    got, want = found(ann.search(df)), brute(rows)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert set(got) == set(want) and hits >= 0.93 * sum(map(len, want.values()))
    exact = found(ann.search(df, probes=0))
    assert sum(len({i for i, _ in exact[q]} & {i for i, _ in want[q]}) for q in want) >= 0.98 * sum(map(len, want.values()))
    for q in range(500, 700, 20):
        assert [i for i, _ in exact[q]] == [i for i, _ in want[q]]


def test_few_vectors_are_computed_exactly(monkeypatch):
    """The bound alone chooses: of 4,000 vectors some percent are computed exactly, and the best 20 are among them."""
    r = np.random.default_rng(5)
    m, q = r.standard_normal((4000, 64)), r.standard_normal((40, 64))
    turn = ann.rotation(64)
    codes, asked = ann.Codes.of(m, turn), ann.Queries(q, turn)
    guess, bound = asked.estimate(np.arange(40), codes, np.zeros(40))
    exact = q @ m.T
    floor = -np.sort(-exact[:, :1000], 1)[:, 19]
    chosen = guess + bound >= floor[:, None]
    best = np.argsort(-exact, 1)[:, :20]
    assert np.take_along_axis(chosen, best, 1).mean() > 0.95 and chosen.mean() < 0.45
    # the better the floor, the fewer
    assert (guess + bound >= -np.sort(-exact, 1)[:, 19:20]).mean() < 0.75 * chosen.mean()


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0, 2.0]), (20, [0.0, 1.0, 1.0]), (1, [1.0, 1.0, 1.0]), (2, [1.0, 1.0, 1.0]), (3, None), (40, [0.0, 0.0, 0.0]), (5, [nan, 1.0, 1.0]), (6, [inf, 1.0, 1.0]), (60, [None, 1.0, 1.0]), (7, [1.0, 2.0]), (8, []), (0, [1.0, 0.0, 2.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string")
    got = found(ann.search(df))
    assert got == {0: [(1, 3.0), (2, 3.0), (20, 2.0)], 20: [(0, 2.0), (0, 2.0), (1, 2.0), (2, 2.0)]}
    assert ann.search(df.limit(0)).count() == 0
    assert ann.search(df.filter("vec_id = 20")).count() == 0
    apart = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0, 1.0]), (20, [1.0, 0.0, 0.0])], "vec_id long, embedding array<double>")
    assert found(ann.search(apart)) == {0: [(1, 3.0)], 20: [(2, 1.0)]}


def test_many_equal_vectors(spark):
    df = spark.range(300).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.lit(0.5), F.lit(-1.0)).alias("embedding")).repartition(5)
    got = found(ann.search(df))
    for q, rows in got.items():
        assert [i for i, _ in rows] == [i for i in range(21) if i != q][:20]


def test_estimates_are_within_bounds():
    r = np.random.default_rng(1)
    turn = ann.rotation(64)
    assert np.allclose(turn @ turn.T, np.eye(64))
    for d in (64, 50):
        c = r.standard_normal(d)
        m, q = r.standard_normal((3000, d)) + c, r.standard_normal((3, d))
        m[7] = c
        guess, bound = ann.Queries(q, turn).estimate(np.array([0, 2]), ann.Codes.of(m - c, turn), (q @ c)[[0, 2]])
        exact = q[[0, 2]] @ m.T
        assert (np.abs(guess - exact) <= bound + 1e-9).mean() > 0.93
        assert np.abs((guess - exact).mean(1)).max() < 0.1 * exact.std() and np.allclose(guess[:, 7], exact[:, 7])
