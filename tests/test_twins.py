"""What SQL can't express, and changed members, against plain Python and numpy on small fixtures."""

from __future__ import annotations

import math
import re
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lattica.operators import aggregates, doublets, embedding, features, gather, handle, metrics, order, ranking, tokens
from lattica.operators import nb_glm as glm
from lattica.operators.transform import pflog
from lattica.plans.dataset import Dataset, bind
from lattica.plans.predicate import compile_predicate
from lattica.plans.registry import ORACLES, QUERIES
from lattica.sources.store import Store, StoreError, shard_statistics, shards_to_read

from test_engine import made

TINY = "/root/testdata/sf0.001"

#: Queries without SQL, and the test that holds their operator against a plain version.
TWINS = {
    "shuffle_cells": "test_shuffle_is_a_seeded_permutation", "sample_genes": "test_engine.test_tokens",
    "downsample_counts": "test_downsampling",
    "highly_variable_loess": "test_highly_variable_genes", "highly_variable_loess_batches": "test_highly_variable_genes", "highly_variable_paper": "test_highly_variable_genes",
    "control_genes": "test_control_genes", "agreement_sweep": "test_agreement_of_equal_clusterings", "pairwise_nb_regression": "test_regressions_over_pseudobulk",
    "pseudobulk_regression": "test_regressions_over_pseudobulk", "neighbour_connectivities": "test_connectivities", "lisi_scores": "test_lisi", "leiden_clusters": "test_leiden",
    "umap_layout": "test_engine.test_graph_operators", "pca_scores": "test_engine.test_pca", "pflog_pca_scores": "test_pflog_pca", "harmony_corrected": "test_engine.test_harmony_mixes_batches",
    "approximate_neighbours": "test_approximate_neighbours", "randomized_pca_scores": "test_randomized_pca", "pca_neighbour_graph": "test_pca_neighbour_chain",
}


def test_every_query_has_sql_or_a_twin():
    assert set(TWINS) == set(QUERIES) - set(ORACLES)


@pytest.mark.parametrize("name", sorted(TWINS))
def test_query_without_sql_runs_on_whole_tables(spark, name):
    """The registered query gives rows of its operator; what they hold is the twin's matter."""
    assert not QUERIES[name](spark, TINY).isEmpty()


@pytest.fixture(scope="module")
def small(spark):
    r = np.random.default_rng(0)
    m = r.poisson(0.8, (30, 12)).astype(float)
    m[3] = 0
    m[:, 5] = 0
    groups = [["a", "b", "c", None][i % 4] for i in range(30)]
    return m, groups, made(spark, m, groups)


def points_of(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "cell_ix long, vec array<double>")


# ---- orders, tokens


def test_shuffle_is_a_seeded_permutation(small):
    _, _, d = small
    of = lambda seed, f=d: {r["cell_ix"]: r["new_ix"] for r in order.shuffle_cells(f, seed).collect()}
    a = of(1)
    assert sorted(a.values()) == list(range(30)) == sorted(a) and a == of(1, replace(d, obs=d.obs.repartition(5))) and a != of(2)
    gone = order.delete_cells(d, F.col("grp") == "a")
    assert sorted(of(1, gone).values()) == list(range(22))


def test_downsampling(small):
    m, _, d = small
    for mode in ("binomial", "multinomial"):
        got = tokens.downsample(d.x, 4, 1, mode).toPandas()
        again = tokens.downsample(d.x.repartition(3), 4, 1, mode).toPandas()
        key = ["cell_ix", "gene_ix"]
        assert got.sort_values(key).reset_index(drop=True).equals(again.sort_values(key).reset_index(drop=True))
        assert all(v <= m[c, g] for c, g, v in got.itertuples(index=False))
        total = got.groupby("cell_ix")["value"].sum()
        for c in range(30):
            if m[c].sum() <= 4:
                assert total.get(c, 0) == m[c].sum()
            elif mode == "multinomial":
                assert total.get(c, 0) == 4
    with pytest.raises(ValueError):
        tokens.downsample(d.x, 4, 1, "other")


def test_collated_sets(spark, small):
    m, _, d = small
    sets = spark.createDataFrame([(i % 3, i) for i in range(30)], "set_id long, cell_ix long")
    got = {r["cell_ix"]: r for r in tokens.collate_sets(d.x, sets, 4, -1).collect()}
    assert set(got) == {i for i in range(30) if m[i].any()}
    for i, r in got.items():
        best = [j for j in sorted(range(12), key=lambda j: (-m[i, j], j)) if m[i, j]][:4]
        pad = 4 - len(best)
        assert r["set_id"] == i % 3 and r["ids"] == best + [-1] * pad and r["padded"] == [False] * len(best) + [True] * pad
        assert np.allclose(r["values"], [math.log1p(m[i, j]) for j in best] + [0] * pad)


def test_bin_ties_and_edges(spark):
    x = spark.createDataFrame([(0, j, float(v)) for j, v in enumerate([1, 2, 2, 3, 5])], "cell_ix long, gene_ix long, value double")
    edges = [1.0, 2.0, 2.0, 4.0]
    at = lambda tie, seed=0: [r["bin"] for r in tokens.bin_values(x, 5, edges, tie, seed).orderBy("gene_ix").collect()]
    left, right = at("left"), at("right")
    assert left == [int(np.digitize(v, edges)) for v in [1, 2, 2, 3, 5]] and right == [int(np.digitize(v, edges, right=True)) for v in [1, 2, 2, 3, 5]]
    drawn = [at("seeded", s) for s in range(8)]
    assert drawn[0] == at("seeded", 0) and all(r <= v <= l for bins in drawn for r, v, l in zip(right, bins, left)) and len(set(map(tuple, drawn))) > 1
    with pytest.raises(ValueError):
        tokens.bin_values(x, 5, [2.0, 1.0])


def test_batches_in_random_order(spark):
    sets = spark.createDataFrame([(i,) for i in range(23)], "set_id long")
    a, b = ({r["set_id"]: r["batch"] for r in tokens.batch_plans(sets.repartition(n), 5, ["set_id"], 7).collect()} for n in (1, 4))
    assert a == b and sorted(pd.Series(a).value_counts()) == [3, 5, 5, 5, 5] and a != {i: i // 5 for i in range(23)}


@pytest.mark.parametrize("axes", [1, 2, 3])
def test_spatial_neighbours(spark, axes):
    r = np.random.default_rng(axes)
    x = np.concatenate([r.normal(0, 1, (60, axes)), r.normal(50, 0.01, (15, axes)), np.zeros((6, axes))])
    names = [f"x{i}" for i in range(axes)]
    rows = [(i, *map(float, v)) for i, v in enumerate(x)] + [(900, *[None] * axes)]
    frame = spark.createDataFrame(rows, "cell_ix long, " + ", ".join(f"{n} double" for n in names))
    got = {}
    for row in tokens.spatial_neighbours(frame, names, 7).collect():
        got.setdefault(row["src"], []).append((row["rank"], row["dst"]))
    assert len(got) == len(x)
    for i in range(len(x)):
        dist = np.sqrt(((x - x[i]) ** 2).sum(1))
        dist[i] = np.inf
        assert [j for _, j in sorted(got[i])] == np.lexsort((np.arange(len(x)), dist))[:7].tolist()
    assert tokens.spatial_neighbours(frame.limit(3), names, 7).count() == 6 and tokens.spatial_neighbours(frame.limit(0), names, 7).count() == 0


def test_multimodal_batches(spark, small):
    m, _, d = small
    other = spark.createDataFrame([(0, 1, 2.0), (5, 0, 3.0)], "cell_ix long, gene_ix long, value double")
    got = list(gather.multimodal_batches({"rna": d.x, "adt": other}, {"rna": 12, "adt": 2}, d.obs, 8, 3))
    cells = np.concatenate([b["cell_ix"] for b in got])
    assert sorted(cells) == list(range(30)) and [len(b["cell_ix"]) for b in got] == [8, 8, 8, 6]
    assert np.allclose(np.concatenate([b["rna"] for b in got]), m[cells])
    adt = np.concatenate([b["adt"] for b in got])
    assert adt.sum() == 5 and adt[list(cells).index(5), 0] == 3


# ---- tests and gene selection


def test_rank_genes_groups(small):
    m, groups, d = small
    t = ranking.rank_genes_groups(d, "grp", tie_correct=True, pts=True).toPandas()
    for g, rows in t.groupby("grp"):
        own = np.array([x == g for x in groups])
        rows = rows.set_index("gene_ix").sort_index()
        assert list(rows.index) == [j for j in range(12) if m[:, j].any()]
        p = {}
        for j, r in rows.iterrows():
            ranks = pd.Series(m[:, j]).rank().to_numpy()
            n, n1 = 30, own.sum()
            c = pd.Series(m[:, j]).value_counts().to_numpy().astype(float)
            z = (ranks[own].sum() - n1 * (n + 1) / 2) / math.sqrt(n1 * (n - n1) / 12 * (n + 1 - (c**3 - c).sum() / (n * (n - 1))))
            p[j] = math.erfc(abs(z) / math.sqrt(2))
            assert r["score"] == pytest.approx(z) and r["pval"] == pytest.approx(p[j])
            assert r["logfoldchange"] == pytest.approx(math.log2((m[own, j].mean() + 1e-9) / (m[~own, j].mean() + 1e-9)))
            assert r["pts"] == pytest.approx((m[own, j] > 0).mean()) and r["pts_rest"] == pytest.approx((m[~own, j] > 0).mean())
        by_p = sorted(p, key=lambda j: (p[j], j))
        least = 1.0
        for i in range(len(by_p), 0, -1):
            least = min(least, p[by_p[i - 1]] * len(by_p) / i)
            assert rows.loc[by_p[i - 1], "pval_adj"] == pytest.approx(least)
        assert rows.sort_values("rank").index.tolist() == sorted(p, key=lambda j: (-rows.loc[j, "score"], j))
    cut = ranking.extract(ranking.rank_genes_groups(d, "grp"), 0.9, -1.0, 1.0).toPandas()
    whole = ranking.rank_genes_groups(d, "grp").toPandas()
    assert len(cut) == ((whole["pval_adj"] < 0.9) & (whole["logfoldchange"] > -1) & (whole["logfoldchange"] < 1)).sum()


def test_pairwise_reference_with_absent_genes(spark):
    r = np.random.default_rng(3)
    m = r.poisson(0.6, (40, 9)).astype(float)
    groups = [["ref", "x", "y"][i % 3] for i in range(40)]
    own = {g: np.array([v == g for v in groups]) for g in ("ref", "x", "y")}
    m[own["ref"], 1] = 0
    m[own["x"], 2] = 0
    m[own["ref"] | own["x"], 3] = 0
    m[:, 4] = 0
    got = {(r["target"], r["gene_ix"]): r for r in ranking.pairwise_reference(made(spark, m, groups), "grp", "ref").collect()}
    for g in "xy":
        for j in range(9):
            x, y = m[own[g], j], m[own["ref"], j]
            if not x.any() and not y.any():
                assert (g, j) not in got or got[g, j]["statistic"] == len(x) * len(y) / 2
                continue
            u = sum((p > q) + 0.5 * (p == q) for p in x for q in y)
            pool = np.concatenate([x, y])
            c, n = pd.Series(pool).value_counts().to_numpy().astype(float), len(pool)
            v = len(x) * len(y) / 12 * (n + 1 - (c**3 - c).sum() / (n * (n - 1)))
            assert got[g, j]["statistic"] == pytest.approx(u)
            assert got[g, j]["z"] == pytest.approx((max(u, len(x) * len(y) - u) - len(x) * len(y) / 2 - 0.5) / math.sqrt(v))


def plain_loess(x, y, span=0.3):
    n = len(x)
    k = min(n, max(4, math.ceil(span * n)))
    out = []
    for p in x:
        near = np.argsort(np.abs(x - p), kind="stable")[:k]
        a, h = x[near] - p, np.abs(x[near] - p).max() * 1.000001
        w = np.sqrt((1 - (np.abs(a) / h) ** 3) ** 3)
        out.append(np.linalg.lstsq(np.stack([np.ones(k), a, a * a], 1) * w[:, None], y[near] * w, rcond=None)[0][0])
    return np.array(out)


def test_loess_is_exact_at_every_point():
    r = np.random.default_rng(8)
    x = r.normal(0, 1, 900)
    y = np.sin(2 * x) + r.normal(0, 0.1, 900)
    assert np.abs(features.loess(x, y) - plain_loess(x, y)).max() < 1e-6


def test_loess_of_many_points_and_of_counted_ones():
    """A window of many points isn't walked through, and (x, mean y, count) gives what the repeated points give."""
    import time

    r = np.random.default_rng(4)
    x = np.concatenate([r.exponential(1, 60_000) ** 3, r.normal(0, 1, 60_000)])
    y = np.sin(x) + r.normal(0, 0.1, len(x))
    began = time.process_time()
    got = features.loess(x, y)
    assert time.process_time() - began < 40
    k = math.ceil(0.3 * len(x))
    for i in (0, 1, 59_999, 60_000, 119_999, int(x.argmax()), int(x.argmin())):
        near = np.argpartition(np.abs(x - x[i]), k - 1)[:k]
        a = (x[near] - x[i]) / (np.abs(x[near] - x[i]).max() * 1.000001)
        w = np.sqrt((1 - np.abs(a) ** 3) ** 3)
        assert got[i] == pytest.approx(np.linalg.lstsq(np.stack([np.ones(k), a, a * a], 1) * w[:, None], y[near] * w, rcond=None)[0][0], abs=1e-8)
    places, count, mean = np.sort(r.normal(0, 1, 80)), r.integers(1, 9, 80), r.normal(0, 1, 80)
    assert np.abs(features.loess(places, mean, 0.4, count) - plain_loess(np.repeat(places, count), np.repeat(mean, count), 0.4)[np.cumsum(count) - 1]).max() < 1e-6


def test_highly_variable_genes(spark):
    r = np.random.default_rng(1)
    m = r.negative_binomial(2, 0.4, (90, 60)).astype(float) * (r.random((90, 60)) < 0.7)
    m[:, 7] = 0
    batch = [["p", "q", "r"][i % 3] for i in range(90)]
    d = made(spark, m, batch)

    def variances(rows):
        x = m[rows]
        n, mean, var = len(x), x.mean(0), x.var(0, ddof=1)
        use = np.flatnonzero(var > 0)
        std = np.sqrt(10 ** plain_loess(np.log10(mean[use]), np.log10(var[use])))
        c = np.minimum(x[:, use], std * math.sqrt(n) + mean[use])
        return dict(zip(use.tolist(), (n * mean[use] ** 2 + (c**2).sum(0) - 2 * mean[use] * c.sum(0)) / ((n - 1) * std**2)))

    one = variances(np.arange(90))
    got = features.variance_stabilised(d, n_top=10).toPandas().set_index("gene_ix")
    assert all(got.loc[j, "variance_norm"] == pytest.approx(v, rel=1e-5) for j, v in one.items()) and len(got) == len(one)
    best = sorted(one, key=lambda j: (-one[j], j))[:10]
    assert sorted(got.index[got["highly_variable"]]) == sorted(best)

    per = [variances(np.array([b == g for b in batch])) for g in "pqr"]
    ranks = {}
    for v in per:
        for i, j in enumerate(sorted(v, key=lambda j: (-v[j], j))[:10]):
            ranks.setdefault(j, []).append(i)
    every = set().union(*per)
    median = lambda j: float(np.median(ranks[j])) if j in ranks else math.inf
    often = lambda j: -len(ranks.get(j, ()))
    for flavor, key in (("seurat_v3", lambda j: (median(j), often(j), j)), ("seurat_v3_paper", lambda j: (often(j), median(j), j))):
        got = features.variance_stabilised(d, n_top=10, batch="grp", flavor=flavor).toPandas().set_index("gene_ix")
        assert sorted(got.index[got["highly_variable"]]) == sorted(sorted(every, key=key)[:10])
        assert all(got.loc[j, "n_batches"] == len(ranks.get(j, ())) for j in every)


@pytest.mark.parametrize("flavor", ["seurat_v3", "seurat_v3_paper"])
def test_batches_are_fitted_at_distinct_means(spark, monkeypatch, flavor):
    m = np.random.default_rng(3).integers(0, 3, (12, 80)).astype(float)
    batch, asked, fit = ["p", "q"] * 6, [], features.loess
    monkeypatch.setattr(features, "loess", lambda x, *a: asked.append(len(x)) or fit(x, *a))
    rows = features.variance_stabilised(made(spark, m, batch), n_top=5, batch="grp", flavor=flavor).collect()
    parts = [m[i::2] for i in range(2)]
    assert sorted(asked) == sorted(len(np.unique(x.sum(0)[x.var(0) > 0])) for x in parts)
    assert sum(r["highly_variable"] for r in rows) == 5 and len(rows) == int(((parts[0].var(0) > 0) | (parts[1].var(0) > 0)).sum())


def test_control_genes(spark, small):
    m, _, d = small
    bins = features.expression_bins(aggregates.sample_moments(d), 4)
    of = {r["gene_ix"]: r["bin"] for r in bins.collect()}
    listed = d.var.filter("gene_ix IN (1, 8)")
    got = features.control_genes(bins, listed, 2, 5).collect()
    assert got == features.control_genes(bins.repartition(3), listed, 2, 5).collect() or sorted(got) == sorted(features.control_genes(bins.repartition(3), listed, 2, 5).collect())
    for b in {of[1], of[8]}:
        pool = [g for g, x in of.items() if x == b and g not in (1, 8)]
        chosen = [r["gene_ix"] for r in got if r["bin"] == b]
        assert len(chosen) == min(2, len(pool)) and set(chosen) <= set(pool)
    assert {r["bin"] for r in got} <= {of[1], of[8]}
    draws = {tuple(sorted(r["gene_ix"] for r in features.control_genes(bins, listed, 2, s).collect())) for s in range(6)}
    assert len(draws) > 1


def test_regressions_over_pseudobulk(spark):
    r = np.random.default_rng(6)
    m = r.negative_binomial(5, 0.3, (120, 15)).astype(float)
    m[:60, 0] *= 4
    d = made(spark, m, ["t" if i < 60 else "ref" for i in range(120)])
    d = replace(d, obs=d.obs.withColumn("rep", F.concat(F.lit("s"), (F.col("cell_ix") % 4).cast("string"))))
    bulk = aggregates.pseudobulk(d, ["rep", "grp"], total=True)
    got = glm.pseudobulk_dex(bulk, "rep", "grp", "ref", "t").toPandas().set_index("gene")
    columns = sorted(f"s{k}|{g}" for k in range(4) for g in ("ref", "t"))
    table = pd.DataFrame({c: m[[i for i in range(120) if f"s{i % 4}|{'t' if i < 60 else 'ref'}" == c]].sum(0) for c in columns}, index=[str(j) for j in range(15)])
    design = np.stack([np.ones(8), [float(c.endswith("|t")) for c in columns]], 1)
    want = glm.nb_glm(spark, table, design).toPandas().set_index("gene")
    assert set(got.index) == set(want.index)
    for c in ("log2fc", "pval", "base_mean"):
        assert np.allclose(got[c].sort_index(), want[c].sort_index(), rtol=1e-4)
    assert got["log2fc"].idxmax() == "0"
    pair = gather.pdex_nb_glm(d, "grp", "ref", "rep").toPandas().set_index("feature")
    assert set(pair["target"]) == {"t"} and np.allclose(pair["fold_change"].sort_index(), got["log2fc"].sort_index(), rtol=1e-4)
    by_p = pair["pval"].sort_values(kind="stable")
    least, adjusted = 1.0, {}
    for i in range(len(by_p), 0, -1):
        least = min(least, by_p.iloc[i - 1] * len(by_p) / i)
        adjusted[by_p.index[i - 1]] = least
    assert all(pair.loc[g, "pval_adj"] == pytest.approx(v) for g, v in adjusted.items())


def plain_nb_fit(y, design, offset):
    """One gene's coefficients and dispersion, by Newton steps and a fine grid."""
    beta, alpha = np.array([math.log((y / np.exp(offset)).mean()), 0.0]), 0.1
    for _ in range(200):
        mu = np.exp(design @ beta + offset)
        w = mu / (1 + alpha * mu)
        beta = np.linalg.solve((design * w[:, None]).T @ design + glm.RIDGE * np.eye(2), design.T @ (w * (design @ beta + (y - mu) / mu)))

    def likelihood(t):
        q, w = math.exp(-t), mu / (1 + math.exp(t) * mu)
        each = sum(math.lgamma(v + q) - math.lgamma(q) + q * math.log(q / (q + m)) + v * math.log(m / (q + m)) for v, m in zip(y, mu))
        return each - 0.5 * np.linalg.slogdet((design * w[:, None]).T @ design)[1]

    return beta, math.exp(max(np.linspace(math.log(1e-3), math.log(10), 4000), key=likelihood))


def test_genes_fitted_together_are_those_fitted_alone():
    r = np.random.default_rng(9)
    design, offset = np.stack([np.ones(16), np.arange(16) % 2.0], 1), r.normal(0, 0.2, 16)
    y = r.negative_binomial(2, 0.2, (12, 16)).astype(float) + (np.arange(16) == 0)
    start = np.stack([np.log((y / np.exp(offset)).mean(1)), np.zeros(12)], 1)
    beta, mu, _ = glm.fit_beta(y, design, offset, np.full(12, 0.1), start)
    alpha = glm.fit_alpha(y, design, mu)
    for i in range(12):
        b, a = plain_nb_fit(y[i], design, offset)
        assert np.allclose(beta[i], b, atol=1e-5) and alpha[i] == pytest.approx(a, rel=0.01)


def no_rows_as_pandas(*_):
    raise AssertionError("the table of genes and samples is collected")


def regression_data(spark):
    m = np.random.default_rng(7).negative_binomial(5, 0.3, (60, 30)).astype(float)
    m[:, 4] = 0
    d = made(spark, m, ["t", "ref", "u"] * 20)
    return replace(d, obs=d.obs.withColumn("rep", F.concat(F.lit("s"), F.floor(F.col("cell_ix") / 15).cast("string"))))


def test_pseudobulk_regression_collects_no_samples(spark, monkeypatch):
    d = regression_data(spark)
    bulk = aggregates.pseudobulk(d, ["rep", "grp"], total=True)
    monkeypatch.setattr(type(bulk), "toPandas", no_rows_as_pandas)
    assert {r["gene"] for r in glm.pseudobulk_dex(bulk, "rep", "grp", "ref", "t").collect()} == {str(j) for j in range(30) if j != 4}


def test_pairwise_regressions_collect_no_samples(spark, monkeypatch):
    d = regression_data(spark)
    monkeypatch.setattr(type(d.x), "toPandas", no_rows_as_pandas)
    rows = gather.pdex_nb_glm(d, "grp", "ref", "rep", 1).collect()
    assert {(r["target"], r["feature"]) for r in rows} == {(t, str(j)) for t in "tu" for j in range(30) if j != 4}


# ---- embeddings and graphs


def test_pflog_pca(small):
    m, _, d = small
    delta, _ = pflog(d, 0.05)
    scores, load, values = embedding.pca(d, 3, x=delta)
    z = np.log1p(0.2 * m)
    c = z - z.mean(0)
    w, v = np.linalg.eigh(c.T @ c / 29)
    assert np.allclose(values, w[::-1][:3]) and np.allclose(np.abs(load @ v[:, ::-1][:, :3]), np.eye(3), atol=1e-6)
    assert np.allclose(np.stack([r["vec"] for r in scores.orderBy("cell_ix").collect()]), c @ load.T)


def test_randomized_pca(spark):
    r = np.random.default_rng(2)
    m = np.maximum(0, np.rint(r.normal(0, 1, (80, 4)) @ (r.normal(0, 1, (4, 40)) * np.array([9, 7, 5, 3])[:, None]) + r.normal(0, 0.6, (80, 40)))).astype(float)
    d = made(spark, m, [None] * 80)
    a, b = (embedding.pca(d, 4, method=how) for how in ("covariance", "randomized"))
    assert np.allclose(a[2], b[2], rtol=1e-3) and np.abs(a[1] - b[1]).max() < 0.02
    x, y = (np.stack([row["vec"] for row in p[0].orderBy("cell_ix").collect()]) for p in (a, b))
    assert np.abs(x - y).max() < 0.05 * np.abs(x).max()
    _, load, _ = embedding.pca(d, 2, d.var.filter("gene_ix < 9"), method="randomized")
    assert load.shape == (2, 9)
    raw = embedding.pca(d, 2, zero_center=False)
    w = np.linalg.eigvalsh(m.T @ m / 79)
    assert np.allclose(raw[2], w[::-1][:2])
    with pytest.raises(ValueError):
        embedding.pca(d, 41)


def test_randomized_pca_of_many_genes_collects_none_as_rows(spark, monkeypatch):
    r = np.random.default_rng(5)
    m, some = np.zeros((30, 70_000)), r.choice(70_000, 400, replace=False)
    m[:, some] = np.maximum(0, np.rint(r.normal(0, 1, (30, 3)) @ (r.normal(0, 1, (3, 400)) * np.array([9, 6, 3])[:, None]) + r.normal(0, 0.5, (30, 400))))
    d = made(spark, m, [None] * 30)
    with monkeypatch.context() as held:
        for name in ("collect", "toPandas"):
            held.setattr(type(d.x), name, no_rows_as_pandas)
        scores, load, values = embedding.pca(d, 2, method="randomized")
    c = m - m.mean(0)
    _, w, v = np.linalg.svd(c, full_matrices=False)
    assert np.allclose(values, w[:2] ** 2 / 29, rtol=1e-3) and np.allclose(np.abs(load @ v[:2].T), np.eye(2), atol=0.02)
    assert np.allclose(np.stack([x["vec"] for x in scores.orderBy("cell_ix").collect()]), c @ load.T)


def test_randomized_pca_of_many_genes_sends_slices(spark, monkeypatch):
    """No table of all genes is sent by the driver, and columns that span less than was asked for do as well."""
    m, some = np.zeros((6, 70_000)), np.random.default_rng(8).choice(70_000, 300, replace=False)
    m[:, some] = np.random.default_rng(9).integers(0, 9, (6, 300))
    sent, put = [], type(spark.sparkContext).broadcast

    def note(sc, value):
        sent.extend(len(x) for x in (value if isinstance(value, (list, tuple)) else [value]) if np.ndim(x) == 2)
        return put(sc, value)

    monkeypatch.setattr(type(spark.sparkContext), "broadcast", note)
    scores, load, values = embedding.pca(made(spark, m, [None] * 6), 3, method="randomized", rounds=3)
    assert sent and max(sent) < 70_000
    c = m - m.mean(0)
    _, w, v = np.linalg.svd(c, full_matrices=False)
    assert np.allclose(values, w[:3] ** 2 / 5) and np.allclose(np.abs(load @ v[:3].T), np.eye(3), atol=1e-6)
    assert np.allclose(np.stack([x["vec"] for x in scores.orderBy("cell_ix").collect()]), c @ load.T)


def blobs(seed=3, n=600, k=8):
    r = np.random.default_rng(seed)
    of = np.where(r.random(n) < 0.35, 0, r.integers(0, k, n))
    return r.normal(0, 6, (k, 6))[of] + r.normal(0, 1, (n, 6)), of


def test_approximate_neighbours(spark):
    x, _ = blobs()
    p = points_of(spark, x)
    want = {(r["src"], r["dst"]) for r in embedding.exact_neighbours(p, 10, block=200).collect()}
    got = embedding.approximate_neighbours(p, 10, probes=8, block=100)
    found = [(r["src"], r["dst"]) for r in got.collect()]
    assert len(set(found)) == len(found) and len(want & set(found)) >= 0.9 * len(want)
    everything = {(r["src"], r["dst"]) for r in embedding.approximate_neighbours(p, 10, probes=1000).collect()}
    assert everything == want
    assert embedding.approximate_neighbours(p.limit(0), 3).count() == 0


def test_neighbours_of_many_copies(spark):
    """Copies meet a few of their kind only, and their neighbours are the exact ones, ties included."""
    x, _ = blobs(n=120)
    x = np.concatenate([x, np.repeat(x[:2], 400, 0), np.repeat(x[3:4], 4, 0)])[np.random.default_rng(1).permutation(924)]
    p, met = points_of(spark, x), spark.sparkContext.accumulator(0)
    work = embedding._block_neighbours

    def counted(k):
        def run(batches):
            for t in batches:
                met.add(sum(len(a) * len(b) for a, b in zip(t["a"], t["b"])))
                yield from work(k)([t])

        return run

    embedding._block_neighbours = counted
    try:
        rows = embedding.approximate_neighbours(p, 6, probes=1000).collect()
    finally:
        embedding._block_neighbours = work
    got = {(r["src"], r["rank"]): (r["dst"], round(r["distance"], 9)) for r in rows}
    assert len(rows) == len(got)
    assert got == {(r["src"], r["rank"]): (r["dst"], round(r["distance"], 9)) for r in embedding.exact_neighbours(p, 6).collect()}
    assert 0 < met.value < 3 * 120 * 140


def test_pca_neighbour_chain(spark, small):
    _, _, d = small
    out = embedding.pca_neighbours(d, 3, 5)
    x = np.stack([r["vec"] for r in out["X_pca"].orderBy("cell_ix").collect()])
    for r in out["distances"].filter("rank = 1").collect():
        dist = np.sqrt(((x - x[r["src"]]) ** 2).sum(1))
        dist[r["src"]] = np.inf
        assert r["distance"] == pytest.approx(dist.min())
    assert not out["connectivities"].isEmpty()


def test_connectivities(spark):
    x, _ = blobs(5, 60, 3)
    k = 6
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    w = np.zeros((60, 60))
    for i in range(60):
        near = np.lexsort((np.arange(60), d[i]))[:k]
        v = d[i, near]
        low, high = 1e-6, 1e4
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (low, mid) if np.exp(-np.maximum(v - v.min(), 0) / mid).sum() > np.log2(k) else (mid, high)
        w[i, near] = np.exp(-np.maximum(v - v.min(), 0) / max(low, 1e-3 * v.mean()))
    want = w + w.T - w * w.T
    got = np.zeros((60, 60))
    for r in embedding.connectivities(embedding.exact_neighbours(points_of(spark, x), k), k).collect():
        got[r["src"], r["dst"]] = r["weight"]
    assert np.abs(got - want).max() < 1e-3


def test_lisi(spark):
    x, of = blobs(7, 70, 3)
    k, perplexity = 20, 7
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    labels = spark.createDataFrame([(i, str(v)) for i, v in enumerate(of)], "cell_ix long, label string")
    got = {r["cell_ix"]: r["lisi"] for r in embedding.lisi(embedding.exact_neighbours(points_of(spark, x), k), labels, perplexity).collect()}
    for i in range(70):
        near = np.argsort(d[i], kind="stable")[:k]
        v = d[i, near]
        low, high = 1e-9, 1e6
        for _ in range(300):
            b = math.sqrt(low * high)
            p = np.exp(-(v - v.min()) * b)
            p /= p.sum()
            h = -(p[p > 0] * np.log(p[p > 0])).sum()
            low, high = (b, high) if h > math.log(perplexity) else (low, b)
        shares = pd.Series(p).groupby(of[near]).sum()
        assert got[i] == pytest.approx(1 / (shares**2).sum(), rel=1e-3)


def test_leiden(spark):
    """A ring of cliques is cut into its cliques; on a random graph communities are connected and no worse than one step."""
    rows = []
    for c in range(12):
        rows += [(6 * c + i, 6 * c + j, 1.0) for i in range(6) for j in range(6) if i != j]
        a, b = 6 * c, 6 * ((c + 1) % 12) + 1
        rows += [(a, b, 0.5), (b, a, 0.5)]
    e = spark.createDataFrame(rows, "src long, dst long, weight double")
    got = {r["cell_ix"]: r["cluster"] for r in embedding.leiden(e).collect()}
    assert len(set(got.values())) == 12 and all(len({got[6 * c + i] for i in range(6)}) == 1 for c in range(12))
    x, _ = blobs(9, 400, 6)
    e = embedding.connectivities(embedding.exact_neighbours(points_of(spark, x), 8), 8).cache()
    found = embedding.leiden(e, n_iterations=3)
    label = {r["cell_ix"]: r["cluster"] for r in found.collect()}
    edges = [(r["src"], r["dst"]) for r in e.collect()]
    for c in set(label.values()):
        members = {i for i, v in label.items() if v == c}
        reached, todo = set(), [min(members)]
        while todo:
            i = todo.pop()
            if i not in reached:
                reached.add(i)
                todo += [b for a, b in edges if a == i and b in members]
        assert reached == members
    q = embedding.modularity(e, found).first()[0]
    assert q > 0.7 and q >= embedding.modularity(e, embedding.leiden(e, n_iterations=1)).first()[0] - 1e-9
    assert label == {r["cell_ix"]: r["cluster"] for r in embedding.leiden(e.repartition(3), n_iterations=3).collect()}
    assert len(set(r["cluster"] for r in embedding.leiden(e, resolution=4.0).collect())) > len(set(label.values()))


def test_agreement_of_equal_clusterings(spark):
    x, of = blobs(11, 200, 6)
    f = spark.createDataFrame([(int(o), v.tolist()) for o, v in zip(of, x)], "grp int, vec array<double>")
    for metric in ("ami", "nmi", "ari"):
        one = gather.agreement_sweep(f, f, "grp", metric, (0.5, 1.0), 3).first()
        assert one["score"] == pytest.approx(1) and one["metric"] == metric


def test_group_distances_over_blocks(spark):
    x, of = blobs(13, 150, 3)
    f = spark.createDataFrame([(int(o), v.tolist()) for o, v in zip(of, x)], "grp int, vec array<double>").repartition(4)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    mean = lambda a, b: d[np.ix_(of == a, of == b)].mean()
    for block in (1000, 13):
        got = {(r["a"], r["b"]): r["mean_distance"] for r in metrics.group_distances(f, "grp", block).collect()}
        assert len(got) == 6 and all(v == pytest.approx(mean(a, b)) for (a, b), v in got.items())
        some = {(r["a"], r["b"]): r["mean_distance"] for r in metrics.group_distances(f, "grp", block, control=1).collect()}
        assert set(some) == {(0, 0), (1, 1), (2, 2), (0, 1), (2, 1)} and all(v == pytest.approx(mean(a, b)) for (a, b), v in some.items())
    same = metrics.energy_agreement(f, f, "grp", 1).first()
    assert same["n_groups"] == 2 and same["pearson"] == pytest.approx(1)


# ---- queries, store, changes


def test_plan_filters_below_the_sum(spark):
    q = bind(spark, TINY).query().filter_obs("o_orderstatus == 'F'").with_normalize(1e4)
    plan = q.x()._jdf.queryExecution().executedPlan().toString()
    plan = plan[plan.index("Initial Plan") :] if "Initial Plan" in plan else plan
    assert plan.index("Window") < plan.index("HashAggregate") < plan.index("LeftSemi")
    # lineitem is shuffled once, by cell
    assert len(re.findall(r"Exchange hashpartitioning\(l?_?[a-z_]*#?\d*\w*, \d+\), REPARTITION_BY_COL", plan)) <= 1 and "ReadSchema" in q.x()._jdf.queryExecution().toString()


def test_refusals_of_the_builder(small):
    _, _, d = small
    with pytest.raises(ValueError):
        d.query().with_log1p().collect_as("int")
    assert d.query().collect_as("int")[0].schema["value"].dataType.simpleString() == "int"
    half = d.with_x(d.x.withColumn("value", F.col("value") / 2))
    with pytest.raises(Exception, match="isn't whole"):
        half.query().collect_as("long")[0].collect()
    with pytest.raises(ValueError):
        d.query().read_row_range(5, 2)
    with pytest.raises(ValueError):
        d.query().read_row_range(-1, 2)
    labels = [(names, x.count()) for names, x in d.query().iter_group_shards("grp", "b", 9)]
    assert labels[0][0] == ["b"] and sorted(n for names, _ in labels for n in names) == ["a", "b", "c"]
    with pytest.raises(ValueError):
        handle.Modalities(d.obs, {"a": d, "b": d}).query()


def test_indexing(small):
    m, _, d = small
    h = handle.Handle.of(d)

    def dense(frame, shape):
        out = np.zeros(shape)
        for r in frame.collect():
            out[r["row"], r["column"]] = r["value"]
        return out

    assert np.array_equal(dense(h[2:9, 1:4], (7, 3)), m[2:9, 1:4])
    assert np.array_equal(dense(h[::-2, ::3], (15, 4)), m[::-2, ::3])
    assert np.array_equal(dense(h[[-1, 0, 5], [3, -2]], (3, 2)), m[np.ix_([-1, 0, 5], [3, -2])])
    mask = [bool(i % 3 == 0) for i in range(30)]
    assert np.array_equal(dense(h[mask, None], (10, 12)), m[np.array(mask)])
    assert np.array_equal(dense(h[4, :], (1, 12)), m[4:5])
    assert h[5:5, :].count() == 0
    for bad in ([30], [-31], [True, False]):
        with pytest.raises(IndexError):
            h[bad, None]


def test_statistics_never_skip_a_match(spark):
    r = np.random.default_rng(5)
    rows = [(i, int(i // 10 + r.integers(0, 5)) if r.random() > 0.1 else None, str(r.choice(["a", "b", "c"])) if i > 40 and r.random() > 0.2 else ("z" if i <= 30 else None), float(r.normal()) if r.random() > 0.3 else None) for i in range(200)]
    obs = spark.createDataFrame(rows, "cell_ix long, n long, s string, v double").cache()
    stats = shard_statistics(obs, 10).cache()
    leaves = ["n == 7", "n != 7", "n < 6", "n >= 15", "s == 'a'", "s != 'z'", "s in ['b', 'q']", "s in []", "v > 1.5", "v <= -1.0", "not s == 'z'", "not n in [3, 4]"]
    skipped = 0
    for i in range(60):
        a, b, c = r.choice(leaves, 3)
        text = [a, f"{a} and {b}", f"{a} or {b} and not ({c})", f"not ({a} or {b})", f"not ({a} and {b}) and {c}"][i % 5]
        for mode in ("sql", "pandas"):
            may = {x["shard_id"]: x["may_match"] for x in shards_to_read(stats, obs.schema, text, mode).collect()}
            hit = {x[0] for x in obs.filter(compile_predicate(text, obs.schema, mode)).select(F.floor(F.col("cell_ix") / 10)).distinct().collect()}
            assert all(may[h] for h in hit), (text, mode)
            skipped += sum(not v for v in may.values())
    assert skipped > 300
    with pytest.raises(StoreError):
        shard_statistics(obs, 10, ["nope"])


def test_store_members_and_changes(spark, small, tmp_path):
    m, _, d = small
    ring = spark.createDataFrame([(i, (i + 1) % 30, 1.0) for i in range(30)], "src long, dst long, weight double")
    emb = spark.createDataFrame([(i, [float(i)]) for i in range(30)], "cell_ix long, vec array<double>")
    load = spark.createDataFrame([(j, float(j)) for j in range(12)], "gene_ix long, loading double")
    d = replace(d, obsp={"ring": ring}, obsm={"X": emb}, varm={"PCs": load}, uns={"a": 1})
    s = Store(spark, f"file://{tmp_path}/s", shard_cells=7, index=["grp"])
    s.save(d)
    back = s.open()
    assert back.varm["PCs"].count() == 12 and back.obsp["ring"].count() == 30
    assert s.info() == {"version": 0, "n_cells": 30, "n_genes": 12, "n_values": int((m > 0).sum()), "layers": [], "obsm": ["X"], "obsp": ["ring"], "varm": ["PCs"], "uns_keys": ["a"]}
    genes = lambda: {tuple(r) for r in s.read_genes([2, 9]).select("cell_ix", "gene_ix", "value").collect()}
    want = {(i, j, m[i, j]) for i in range(30) for j in (2, 9) if m[i, j]}
    assert genes() == want
    s.build_gene_major()
    assert "gene_major" in s.manifest()["members"] and genes() == want
    assert s.read_obsm("X", 4, 9).count() == 5 and s.read_obsm("X", cells=[1, 29, 77]).count() == 2 and s.read_obsm("X").count() == 30
    with pytest.raises(StoreError):
        s.read_obsm("Y")
    stats = s.skip_statistics("grp == 'nope'")
    assert stats["shards"] == 5 and stats["skipped"] == 5 and stats["cells_skipped"] == 30
    got = {tuple(r) for r in s.read_matching("grp == 'a'").select("cell_ix", "gene_ix", "value").collect()}
    assert got == {(i, j, m[i, j]) for i in range(0, 30, 4) for j in range(12) if m[i, j]}
    s.modify(obs=back.obs.withColumn("extra", F.lit(1)), var=back.var.withColumn("kind", F.lit("x")), obsm={"X": None, "Y": emb}, varm={"L": load}, uns={"b": 2})
    now = s.open()
    assert "extra" in now.obs.columns and "kind" in now.var.columns and set(now.obsm) == {"Y"} and set(now.varm) == {"PCs", "L"} and now.uns == {"a": 1, "b": 2}
    with pytest.raises(StoreError):
        s.modify(obs=back.obs.filter("cell_ix > 3"))
    sums = s.checksums()
    s.optimize()
    assert {k: v for k, v in s.checksums().items() if k in ("obs", "x", "obsp:ring")} == {k: v for k, v in sums.items() if k in ("obs", "x", "obsp:ring")}
    assert s.watch(0) == s.versions()[-1] and s.watch(s.versions()[-1]) is None
    assert s.provenance()[0] == "save" and s.provenance()[-1] == "optimize"
    assert s.save(d) == s.versions()[-1] and gather.copy_matching(d, Store(spark, f"file://{tmp_path}/t"), F.col("grp") == "a") == 0
    assert Store(spark, f"file://{tmp_path}/t").open().obs.count() == 8


def test_preprocess(spark, small, tmp_path):
    m, _, d = small
    s, t = Store(spark, f"file://{tmp_path}/a"), Store(spark, f"file://{tmp_path}/b")
    s.save(d)
    s.preprocess(t, [("save_layer", {"name": "raw"}), ("filter_cells", {"min_nnz": 5}), ("subset", {"var": "gene_id != 'g2'"}), ("normalize_total", {"target": 10.0}), ("log1p", {}), ("scale", {"by": 2})])
    out = t.open()
    keep = (m > 0).sum(1) >= 5
    cut = np.delete(m, 2, 1)
    total = cut.sum(1, keepdims=True)
    want = 2 * np.log1p(np.where(total > 0, cut * 10 / np.maximum(total, 1), 0))
    names = [j for j in range(12) if j != 2]
    got = {(r["cell_ix"], r["gene_ix"]): r["value"] for r in out.x.collect()}
    assert out.obs.count() == keep.sum() and out.var.count() == 11
    assert got.keys() == {(i, names[j]) for i in np.flatnonzero(keep) for j in range(11) if cut[i, j]}
    assert all(v == pytest.approx(want[i, names.index(j)]) for (i, j), v in got.items())
    assert out.layers["raw"].agg(F.sum("value")).first()[0] == cut[keep].sum()
    with pytest.raises(StoreError):
        s.preprocess(t, [("fly", {})])


def test_changes_reach_all_members(spark, small):
    m, _, d = small
    ring = spark.createDataFrame([(i, (i + 1) % 30, 1.0) for i in range(30)], "src long, dst long, weight double")
    load = spark.createDataFrame([(j, float(j)) for j in range(12)], "gene_ix long, loading double")
    d = replace(d, obsp={"ring": ring}, varm={"PCs": load}, uns={"a": 1})
    cut = order.subset(d, F.col("cell_ix") < 10, F.col("gene_ix") < 4)
    assert {(r["src"], r["dst"]) for r in cut.obsp["ring"].collect()} == {(i, i + 1) for i in range(9)} and cut.varm["PCs"].count() == 4
    both = order.merge([d, d], [0, 100])
    assert both.obsp["ring"].count() == 60 and both.obsp["ring"].filter("(src < 100) <> (dst < 100)").isEmpty() and both.varm["PCs"].count() == 12
    for other in (replace(d, obsp={}), replace(d, varm={"PCs": load.withColumn("loading", F.lit(0.0))}), replace(d, uns={"a": 2})):
        with pytest.raises(order.MergeError):
            order.merge([d, other], [0, 100])
    audit = {(r["member"], r["name"]): r["status"] for r in order.carry_audit(d, replace(cut, varm={}, uns={"a": 1, "b": 2})).collect()}
    assert audit[("obsp", "ring")] == "kept" and audit[("varm", "PCs")] == "lost" and audit[("uns", "b")] == "added" and audit[("obs", "grp")] == "kept"
    gone = order.compact(order.delete_cells(d, F.col("cell_ix") == 5))
    assert gone.obsp["ring"].count() == 28 and gone.obs.count() == 29
    dead = order.merge([order.delete_cells(d, F.col("cell_ix") == 5), d], [0, 100])
    assert dead.obsp["ring"].count() == 58 and dead.obs.count() == 59
    placed = order.merge([d, d], [0, 100], sort_by=["grp"])
    assert placed.obs.agg(F.max("cell_ix")).first()[0] == 59 and placed.x.agg(F.sum("value")).first()[0] == 2 * m.sum()


def test_doublet_tools(spark, tmp_path):
    t = spark.createDataFrame([("c1", 0.9, "Doublet"), ("c2", 0.1, "singlet"), ("c3", None, "NA")], "barcode string, `scDblFinder.score` double, `scDblFinder.class` string")
    got = {r["barcode"]: (r["k_score"], r["k_predicted"]) for r in doublets.normalise(t, "scdblfinder", "k", "barcode").collect()}
    assert got == {"c1": (0.9, True), "c2": (0.1, False), "c3": (None, None)}
    wrong = t.withColumn("scDblFinder.class", F.lit("maybe"))
    with pytest.raises(Exception, match="neither"):
        doublets.normalise(wrong, "scdblfinder", "k", "barcode").collect()
    twice = spark.createDataFrame([("c1", 0.1, 0.2, "Doublet")], "barcode string, pANN_0.25 double, pANN_0.3 double, `DF.classifications_0.25` string".replace("pANN_0.25", "`pANN_0.25`").replace("pANN_0.3 ", "`pANN_0.3` "))
    with pytest.raises(doublets.DoubletError, match="several"):
        doublets.normalise(twice, "doubletfinder", "k", "barcode")
    assert doublets.normalise(twice, "doubletfinder", "k", "barcode", score_column="pANN_0.3").first()["k_score"] == 0.2
    number = spark.createDataFrame([("c1", 0.5, 1.0), ("c2", 0.5, 0.0), ("c3", 0.5, float("nan"))], "barcode string, doublet_score double, doublet_label double")
    assert [r["d_predicted"] for r in doublets.normalise(number, "doubletdetection", "d", "barcode").orderBy("barcode").collect()] == [True, False, None]
    for tool, frame in (("scrublet", number), ("solo", t), ("nope", t), ("generic", t)):
        with pytest.raises(doublets.DoubletError):
            doublets.normalise(frame, tool, "k", "barcode")
    scds = spark.createDataFrame([("c1", 1.5)], "barcode string, cxds_score double")
    assert doublets.normalise(scds, "scds", "s", "barcode").columns == ["barcode", "s_score"]
    with pytest.raises(doublets.DoubletError):
        doublets.consensus(scds, ["s"])
    doublets.export_batches(t.withColumn("batch", F.lit("b1")), "batch", "barcode", f"file://{tmp_path}/out")
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 3
    with pytest.raises(doublets.DoubletError):
        doublets.export_batches(t.unionAll(t).withColumn("batch", F.lit("b1")), "batch", "barcode", f"file://{tmp_path}/again")


def test_cancellation_is_told(spark):
    m = np.full((20, 3), 1e8)
    m[:, 1] += np.arange(20) * 1e-3
    m[:, 2] = np.arange(20)
    got = {r["gene_ix"]: r for r in aggregates.stable_moments(made(spark, m, [None] * 20)).collect()}
    assert all(got[j]["var"] == pytest.approx(m[:, j].var(), rel=1e-3, abs=1e-12) for j in range(3))
    assert got[0]["cancelled"] and got[1]["cancelled"] and not got[2]["cancelled"]


def test_cuts_and_sets(spark):
    f = spark.createDataFrame([(i, float(v)) for i, v in enumerate([5, 1, 1, 1, 1, 9, 7, 3])], "cell_ix long, v double")
    assert [r["cut"] for r in order.cut_points(f, "v", 4).orderBy("part").collect()] == [1.0, 1.0, 5.0]
    assert [r[0] for r in order.take_first(f.filter("v > 1"), 2).collect()] == [0, 5]
    assert order.universe(4, spark).count() == 4 and {r[0] for r in order.complement(f, 11).collect()} == {8, 9, 10}


def test_10x_folder(spark, tmp_path):
    import gzip

    from lattica.sources import files

    d = tmp_path / "f"
    d.mkdir()
    with gzip.open(d / "matrix.mtx.gz", "wt") as f:
        f.write("%%MatrixMarket matrix coordinate integer general\n%x\n3 2 4\n1 1 5\n3 1 2\n2 2 7\n2 2 1\n")
    with gzip.open(d / "barcodes.tsv.gz", "wt") as f:
        f.write("AAA-1\nCCC-1\n")
    with gzip.open(d / "features.tsv.gz", "wt") as f:
        f.write("E1\tone\tGene Expression\nE2\ttwo\tAntibody Capture\nE3\tthree\tGene Expression\n")
    folder = f"file://{d}"
    assert files.detect_format(folder, spark) == "10x-mtx" and files.detect_format(f"{folder}/matrix.mtx.gz", spark) == "mtx"
    x = lambda a: {(r["cell_ix"], r["gene_ix"]): r["value"] for r in a.x.collect()}
    whole = files.read_10x(spark, folder)
    assert x(whole) == {(0, 0): 5, (0, 2): 2, (1, 1): 8} and [r["gene_name"] for r in whole.var.orderBy("gene_ix").collect()] == ["one", "two", "three"]
    rna = files.read_10x(spark, folder, "Gene Expression")
    assert x(rna) == {(0, 0): 5, (0, 1): 2} and [r["gene_id"] for r in rna.var.orderBy("gene_ix").collect()] == ["E1", "E3"]
    both = files.read_10x_modalities(spark, folder)
    assert sorted(both.parts) == ["Antibody Capture", "Gene Expression"] and both.query("Antibody Capture").x().count() == 1
    (d / "old.bin").write_bytes(b"\x89HDF\r\n\x1a\n" + b"0" * 20)
    (d / "t.txt").write_text("a,b\n1,2\n")
    assert files.detect_format(f"{folder}/old.bin", spark) == "hdf5" and files.detect_format(f"{folder}/t.txt", spark) == "table"
    with pytest.raises(ValueError):
        files.read_10x(spark, f"file://{tmp_path}")


def test_sorted_merge_of_parts_whose_moved_keys_meet(small):
    """The second part's keys, moved by 10, are also keys of the first: every cell still has one place and its own values."""
    m, groups, d = small
    got = order.merge([d, d], [0, 10], sort_by=["grp"])
    cells = sorted(((g is not None, g or "", i + o, s, i) for s, o in enumerate((0, 10)) for i, g in enumerate(groups)))
    want = {(place, j, m[i, j]) for place, (*_, i) in enumerate(cells) for j in np.flatnonzero(m[i])}
    rows = [tuple(r) for r in got.x.select("cell_ix", "gene_ix", "value").collect()]
    assert len(rows) == len(want) and set(rows) == want
    assert sorted(r["cell_ix"] for r in got.obs.collect()) == list(range(60))
