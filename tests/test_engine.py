"""The engine's parts against plain Python and numpy."""

from __future__ import annotations

import math
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lattica.functions import special
from lattica.operators import attach, embedding, features, metrics, order, ranking, tokens
from lattica.operators import nb_glm as glm
from lattica.operators import transform as T
from lattica.plans.dataset import Dataset, canonical
from lattica.plans.predicate import PredicateError, compile_predicate
from lattica.plans.query import UnknownNames
from lattica.sources import files
from lattica.sources.store import Store, StoreError, validate


def made(spark, m: np.ndarray, groups: list[str | None]) -> Dataset:
    cells, genes = np.nonzero(m)
    x = spark.createDataFrame(pd.DataFrame({"cell_ix": cells.astype("int64"), "gene_ix": genes.astype("int64"), "value": m[cells, genes].astype(float)}))
    obs = spark.createDataFrame([(i, g) for i, g in enumerate(groups)], "cell_ix long, grp string")
    var = spark.createDataFrame([(i, f"g{i}") for i in range(m.shape[1])], "gene_ix long, gene_id string")
    return Dataset(obs, var, x)


@pytest.fixture(scope="module")
def small(spark):
    r = np.random.default_rng(0)
    m = r.poisson(0.8, (30, 12)).astype(float)
    m[3] = 0
    m[:, 5] = 0
    groups = [["a", "b", "c", None][i % 4] for i in range(30)]
    return m, groups, made(spark, m, groups)


def test_predicates(spark):
    t = spark.createDataFrame([(1, "x", 1.5), (2, None, None), (None, "y", 2.5)], "a long, s string, v double")
    n = lambda p, mode="sql": t.filter(compile_predicate(p, t.schema, mode)).count()
    assert n("a == 1 or s == 'y'") == 2
    assert n("not s == 'x'") == 1 and n("not s == 'x'", "pandas") == 2
    assert n("s != 'x'") == 1 and n("s != 'x'", "pandas") == 2
    assert n("a in [1, 2] and not (v > 2)") == 1
    assert n("a in []") == 0 and n("not a in []") == 2
    for bad in ("a == 'x'", "s == 1", "q == 1", "a = 1", "a == 1 &", "(a == 1", "a == 1 a"):
        with pytest.raises(PredicateError):
            compile_predicate(bad, t.schema)


def test_builder(small):
    m, groups, d = small
    q = d.query().filter_obs("grp == 'a'").select_genes(["g7", "g2", "g7"])
    assert [r["gene_ix"] for r in q.selected_var().orderBy("ord").collect()] == [7, 2]
    with pytest.raises(UnknownNames):
        d.query().select_genes(["nope"])
    with pytest.raises(UnknownNames, match="did you mean"):
        d.query().read_group("grp", "z")
    assert d.query().select_genes([]).x().count() == 0
    assert q.limit(2).count() == groups.count("a") and q.limit(0).cells().count() == 0
    got = {(r["cell_ix"], r["gene_ix"]): r["value"] for r in q.with_normalize(10).with_log1p().x().collect()}
    for i, g in enumerate(groups):
        total = m[i, [2, 7]].sum()
        for j in (2, 7):
            if g == "a" and m[i, j]:
                assert got[i, j] == pytest.approx(math.log1p(m[i, j] * 10 / total))
    gone = order.delete_cells(d, F.col("grp") == "a")
    assert gone.query().filter_obs("grp == 'a'").count() == 0 and gone.query().x().filter("cell_ix = 0").isEmpty()


def test_exact_integers(spark):
    x = spark.createDataFrame([(0, 0, float(2**24 + 1)), (0, 1, float(2**53 - 1)), (0, 0, 1.0)], "cell_ix long, gene_ix long, value double")
    assert {r["gene_ix"]: r["value"] for r in canonical(x).collect()} == {0: 2**24 + 2, 1: 2**53 - 1}


def test_rank_sum(small):
    m, groups, d = small
    got = {(r["grp"], r["gene_ix"]): r for r in ranking.rank_sum(d, "grp", tie_correct=True).collect()}
    for g in "abc":
        own = np.array([x == g for x in groups])
        for j in range(m.shape[1]):
            if not m[:, j].any():
                assert (g, j) not in got
                continue
            ranks = pd.Series(m[:, j]).rank().to_numpy()
            n, n1 = len(m), own.sum()
            t = pd.Series(m[:, j]).value_counts().to_numpy().astype(float)
            v = n1 * (n - n1) / 12 * (n + 1 - (t**3 - t).sum() / (n * (n - 1)))
            assert got[g, j]["score"] == pytest.approx((ranks[own].sum() - n1 * (n + 1) / 2) / math.sqrt(v))


def test_pairwise_reference(small):
    m, groups, d = small
    got = {(r["target"], r["gene_ix"]): r for r in ranking.pairwise_reference(d, "grp", "a").collect()}
    a = np.array([x == "a" for x in groups])
    for g in "bc":
        own = np.array([x == g for x in groups])
        for j in range(m.shape[1]):
            if (g, j) in got:
                x, y = m[own, j], m[a, j]
                u = sum((p > q) + 0.5 * (p == q) for p in x for q in y)
                assert got[g, j]["statistic"] == pytest.approx(u)
                assert got[g, j]["target_mean"] == pytest.approx(np.expm1(np.log1p(x).mean()))


def test_benjamini_hochberg(spark):
    p = [0.01, 0.04, 0.03, 0.9]
    t = spark.createDataFrame([("g", i, v) for i, v in enumerate(p)], "grp string, gene_ix long, pval double")
    got = {r["gene_ix"]: r["pval_adj"] for r in ranking.benjamini_hochberg(t, ["grp"]).collect()}
    assert [round(got[i], 6) for i in range(4)] == [0.04, 0.053333, 0.053333, 0.9]


def test_attach(spark):
    a = spark.createDataFrame([("k1", 1), ("k2", 2), (None, 3)], "k string, n int")
    b = spark.createDataFrame([("k1", 10.0), ("k9", 90.0)], "k string, v double")
    out = {r["n"]: (r["w"], r["st"]) for r in attach.attach(a, b, ["k"], {"v": "w"}, status="st").collect()}
    assert out == {1: (10.0, "present"), 2: (None, "absent"), 3: (None, "absent")}
    assert {r["n"]: r["w"] for r in attach.attach(a, b, ["k"], {"v": "w"}, missing="zero").collect()} == {1: 10.0, 2: 0.0, 3: 0.0}
    for kind in ({"missing": "error"}, {"extra": "error"}):
        with pytest.raises(attach.AttachError):
            attach.attach(a, b, ["k"], {"v": "w"}, **kind)
    with pytest.raises(attach.AttachError):
        attach.attach(a.unionAll(a), b, ["k"], {"v": "w"})


def test_store_versions(spark, small, tmp_path):
    m, _, d = small
    s = Store(spark, f"file://{tmp_path}/store")
    assert s.save(d) == 0
    assert s.mark_deleted(d.obs.filter("cell_ix < 5")) == 1
    assert s.open().read_obs().count() == 25 and s.open(0).read_obs().count() == 30
    assert s.save_layer("log", d.x.withColumn("value", F.log1p("value"))) == 2
    assert s.open().layers["log"].count() == d.x.count()
    s.set_uns({"a": {"b": 1}, "c": 2})
    s.update_uns({"a": 5})
    assert s.open().uns == {"a": 5, "c": 2}
    s.compact()
    live = s.open()
    assert live.obs.count() == 25 and live.x.agg(F.sum("value")).first()[0] == m[5:].sum()
    s.rollback(0)
    assert s.open().read_obs().count() == 30 and s.manifest()["history"][-1] == "rollback to 0"
    with pytest.raises(StoreError):
        s._commit({}, "late", 0, {})
    one = validate(s.open()).first()
    assert not any(one)


def test_append_and_merge(spark, small):
    m, _, d = small
    both = order.append(d, d)
    assert both.obs.count() == 60 and both.x.agg(F.sum("value")).first()[0] == 2 * m.sum()
    with pytest.raises(order.MergeError):
        order.merge([d, replace(d, var=d.var.limit(3))], [0, 100])


def test_sort_nulls_first(small):
    _, groups, d = small
    for rev in (False, True):
        got = [r["cell_ix"] for r in order.sort_cells(d, ["grp"], rev).orderBy("new_ix").collect()]
        ranked = sorted(range(30), key=lambda i: (groups[i] is not None, (ord(groups[i]) * (-1 if rev else 1)) if groups[i] else 0, i))
        assert got == ranked


def test_group_shards(spark):
    d = made(spark, np.ones((20, 1)), ["r"] * 4 + ["x"] * 9 + ["y"] * 4 + ["z"] * 3)
    got = {r["grp"]: r["shard"] for r in order.group_shards(d, "grp", "r", 8).collect()}
    assert got == {"r": 0, "x": 1, "y": 2, "z": 2}


def test_matrix_market_round_trip(spark, small, tmp_path):
    m, _, d = small
    d = replace(d, obs=d.obs.select("cell_ix", F.concat(F.lit("c"), "cell_ix").alias("barcode")))
    files.write_mtx(d, f"file://{tmp_path}/m")
    back = files.read_mtx(spark, f"file://{tmp_path}/m/matrix", f"file://{tmp_path}/m/barcodes", f"file://{tmp_path}/m/features")
    assert {tuple(r) for r in back.x.select("cell_ix", "gene_ix", "value").collect()} == {tuple(r) for r in d.x.collect()}
    assert back.obs.count() == 30 and back.var.filter("gene_id = 'g3' AND gene_ix = 3").count() == 1
    indptr, indices, data = files.to_arrays(d.x, 30)
    assert indptr[-1] == (m > 0).sum() and data.sum() == m.sum()


def test_annotation_table(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("id\tv\na\t1\nb\t2\n")
    t = files.read_annotations(spark, str(tmp_path / "t.tsv"))
    assert t.columns == ["id", "v"] and t.agg(F.sum("v")).first()[0] == 3
    assert files.detect_format("a/b.h5ad") == "h5ad" and files.detect_format("x.mtx.gz") == "mtx"


def test_streaming_append(spark, tmp_path):
    from lattica.streaming.append import append_stream, read_appended

    (tmp_path / "in").mkdir()
    for k in range(2):
        spark.createDataFrame([(1, 1, 2.0), (1, 1, 3.0), (2, k, 1.0)], "cell_ix long, gene_ix long, value double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("cell_ix long, gene_ix long, value double").parquet(str(tmp_path / "in"))
    append_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {(r["cell_ix"], r["gene_ix"]): r["value"] for r in read_appended(spark, str(tmp_path / "out")).collect()}
    assert got == {(1, 1): 10.0, (2, 0): 1.0, (2, 1): 1.0}


def test_tokens(small):
    m, _, d = small
    s = {r["cell_ix"]: r["genes"] for r in tokens.sample_genes(d.x, 5, 1).collect()}
    assert s == {r["cell_ix"]: r["genes"] for r in tokens.sample_genes(d.x.repartition(3), 5, 1).collect()}
    assert all(m[c, g] > 0 for c, gs in s.items() for g in gs)
    low = tokens.downsample(d.x, 4, 1).groupBy("cell_ix").agg(F.sum("value").alias("t")).collect()
    total = {i: m[i].sum() for i in range(30)}
    assert all(r["t"] <= total[r["cell_ix"]] for r in low) and all(r["t"] == total[r["cell_ix"]] for r in low if total[r["cell_ix"]] <= 4)
    seen = [c for b in tokens.training_batches(d, d.var, 7, 3) for c in b["cell_ix"]]
    assert sorted(seen) == list(range(30)) and seen != sorted(seen)


def test_pca(small):
    m, _, d = small
    scores, load, values = embedding.pca(d, 3)
    c = m - m.mean(0)
    w, v = np.linalg.eigh(c.T @ c / 29)
    assert np.allclose(values, w[::-1][:3])
    got = np.stack([r["vec"] for r in scores.orderBy("cell_ix").collect()])
    assert np.allclose(got, c @ load.T)


def _clusters(spark, shift=0.0):
    r = np.random.default_rng(4)
    x = np.concatenate([r.normal(0, 1, (30, 4)) + 8 * np.eye(4)[k] for k in range(3)])
    batch = np.arange(90) % 2
    x[:, 3] += shift * batch
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "cell_ix long, vec array<double>")
    return x, np.repeat(np.arange(3), 30), batch, points


def test_graph_operators(spark):
    x, truth, batch, points = _clusters(spark)
    knn = embedding.exact_neighbours(points, 8, block=20)
    near = {}
    for r in knn.collect():
        near.setdefault(r["src"], []).append((r["rank"], r["dst"]))
    for i in range(90):
        dist = np.sqrt(((x - x[i]) ** 2).sum(1))
        dist[i] = np.inf
        assert [j for _, j in sorted(near[i])] == np.lexsort((np.arange(90), dist))[:8].tolist()
    edges = embedding.connectivities(knn, 8)
    assert edges.alias("a").join(edges.alias("b"), (F.col("a.src") == F.col("b.dst")) & (F.col("a.dst") == F.col("b.src"))).filter("abs(a.weight - b.weight) > 1e-9").isEmpty()
    found = embedding.leiden(edges)
    q = embedding.modularity(edges, found).first()[0]
    labels = {r["cell_ix"]: r["cluster"] for r in found.collect()}
    assert q > 0.5 and all(len({truth[c] for c, k in labels.items() if k == cl}) == 1 for cl in set(labels.values()))
    lay = {r["cell_ix"]: np.array(r["vec"]) for r in embedding.umap(edges, n_epochs=60).collect()}
    mids = [np.mean([lay[i] for i in range(90) if truth[i] == k], 0) for k in range(3)]
    assert np.mean([np.argmin([np.linalg.norm(lay[i] - c) for c in mids]) == truth[i] for i in range(90)]) > 0.9
    labels = spark.createDataFrame([(i, str(batch[i])) for i in range(90)], "cell_ix long, label string")
    scores = [r["lisi"] for r in embedding.lisi(embedding.exact_neighbours(points, 20), labels, 7).collect()]
    assert len(scores) == 90 and 1 <= min(scores) and max(scores) <= 2.0001


def test_harmony_mixes_batches(spark):
    _, _, batch, points = _clusters(spark, shift=3.0)
    b = spark.createDataFrame([(i, str(batch[i])) for i in range(90)], "cell_ix long, batch string")
    out = np.stack([r["vec"] for r in embedding.harmony(points, b, k=3).orderBy("cell_ix").collect()])
    gap = abs(out[batch == 0, 3].mean() - out[batch == 1, 3].mean())
    assert gap < 1.5
    with pytest.raises(ValueError):
        embedding.harmony(points, b, sigma=0)


def test_nb_glm(spark):
    r = np.random.default_rng(5)
    base = r.uniform(50, 500, 40)
    fold = np.ones(40)
    fold[0], fold[1] = 4, 0.25
    counts = pd.DataFrame([[r.negative_binomial(20, 20 / (20 + base[g] * (fold[g] if s >= 4 else 1))) for s in range(8)] for g in range(40)], index=[f"g{i}" for i in range(40)])
    design = np.stack([np.ones(8), (np.arange(8) >= 4).astype(float)], 1)
    out = glm.nb_glm(spark, counts, design).toPandas().set_index("gene")
    assert abs(out.loc["g0", "log2fc"] - 2) < 0.6 and abs(out.loc["g1", "log2fc"] + 2) < 0.6
    assert out.loc["g0", "pval"] < 1e-6 and (out.drop(["g0", "g1"])["pval"] < 0.01).mean() < 0.15


def test_special_functions():
    assert special.digamma(1.0) == pytest.approx(-0.5772156649)
    assert special.trigamma(1.0) == pytest.approx(math.pi**2 / 6)
    assert special.betainc(2, 3, 0.4) == pytest.approx(0.5248)
    assert special.f_cdf(special.f_quantile(0.95, 3, 10), 3, 10) == pytest.approx(0.95)
    assert special.f_quantile(0.95, 3, 10) == pytest.approx(3.708, abs=1e-3)


def test_loess_recovers_a_parabola():
    x = np.linspace(0, 1, 80)
    assert np.allclose(features.loess(x, 2 + x - 3 * x * x), 2 + x - 3 * x * x)


def test_agreement_extremes(spark):
    t = spark.createDataFrame([(i % 3, (i + 1) % 3) for i in range(30)], "a int, b int")
    one = metrics.mutual_information(t, "a", "b").first()
    assert one["nmi"] == pytest.approx(1) and one["ari"] == pytest.approx(1)
    assert metrics.adjusted_mutual_information(t, "a", "b") == pytest.approx(1)
    t = t.select(F.lit(1).alias("a"), F.lit(2).alias("b"))
    assert metrics.adjusted_mutual_information(t, "a", "b") == 1.0


def test_add_and_compare(small):
    m, _, d = small
    assert T.add(d.x, d.x, -1).count() == 0
    from lattica.operators.aggregates import count_where

    got = {r["gene_ix"]: r["n_true"] for r in count_where(d, "gene", ">", -1).collect()}
    assert all(v == 30 for v in got.values()) and len(got) == 12


def test_entry_points(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(2).count() == 2
    assert set(e.oracle_sql()) <= set(e.queries())
