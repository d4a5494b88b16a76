"""Queries of embeddings, neighbour graphs and regression models."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.operators import aggregates as A
from lattica.operators import embedding as E
from lattica.operators import nb_glm as G
from lattica.plans.dataset import bind
from lattica.plans.registration import query, r


def _points(spark, d):
    return bind(spark, d).obsm["X_emb"].select("cell_ix", "vec")


@query("WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) SELECT src, CAST(rank AS BIGINT) AS rank, dst, distance FROM (SELECT a.vec_id AS src, b.vec_id AS dst, round(list_distance(a.v, b.v), 6) AS distance, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.v, b.v), b.vec_id) AS rank FROM e a JOIN e b ON a.vec_id <> b.vec_id) WHERE rank <= 10", base=False)
def exact_neighbours(spark, d):
    return E.exact_neighbours(_points(spark, d), 10).withColumn("distance", r("distance")).select("src", "rank", "dst", "distance")


@query()
def neighbour_connectivities(spark, d):
    return E.connectivities(E.exact_neighbours(_points(spark, d), 15), 15)


@query()
def lisi_scores(spark, d):
    data = bind(spark, d)
    labels = data.obsm["X_emb"].select("cell_ix", "label")
    return E.lisi(E.exact_neighbours(_points(spark, d), 89), labels, 30)


@query()
def leiden_clusters(spark, d):
    return E.leiden(E.connectivities(E.exact_neighbours(_points(spark, d), 15), 15))


@query()
def umap_layout(spark, d):
    return E.umap(E.connectivities(E.exact_neighbours(_points(spark, d), 15), 15), n_epochs=50)


@query()
def pca_scores(spark, d):
    data = bind(spark, d)
    genes = data.var.filter("p_size < 5")
    scores, _, _ = E.pca(data, 5, genes, data.query().with_normalize(1e4).with_log1p().x())
    return scores


@query()
def pflog_pca_scores(spark, d):
    from lattica.operators.transform import pflog

    data = bind(spark, d)
    delta, _ = pflog(data, 0.05)
    scores, _, _ = E.pca(data, 5, data.var.filter("p_size < 5"), delta)
    return scores


@query()
def harmony_corrected(spark, d):
    data = bind(spark, d)
    return E.harmony(_points(spark, d), data.obsm["X_emb"].select("cell_ix", F.pmod("cell_ix", F.lit(3)).alias("batch")), k=5, rounds=3)


@query()
def pseudobulk_regression(spark, d):
    data = bind(spark, d)
    bulk = A.pseudobulk(data, ["n_name", "o_orderstatus"], total=True)
    return G.pseudobulk_dex(bulk, "n_name", "o_orderstatus", "F", "O")
