"""Queries of matrix handles, modalities, doublet votes and stratified tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.operators import gather as G
from lattica.operators import handle as H
from lattica.operators import metrics as M
from lattica.operators import ranking as R
from lattica.operators.doublets import consensus
from lattica.plans.dataset import Dataset, bind
from lattica.plans.queries_stats import _RANKS, _WILCOXON
from lattica.plans.registration import query, r


@query(", t AS (SELECT cell_ix, sum(value) AS t FROM x GROUP BY 1), n AS (SELECT count(*) AS n FROM obs), v AS (SELECT gene_ix, ln(1 + value * 1000.0 / t) / 2 AS v FROM x JOIN t USING (cell_ix)) SELECT gene_ix, round(coalesce(sum(v), 0.0) / any_value(n), 9) AS mean FROM genes LEFT JOIN v USING (gene_ix), n GROUP BY 1")
def handle_chain_mean(spark, d):
    return (H.Handle.of(bind(spark, d)).normalize_total(1000).log1p() / 2).mean(0).withColumn("mean", r("mean", 9))


@query("SELECT gene_ix, coalesce(max(value ** 2), 0.0) AS max FROM genes LEFT JOIN x USING (gene_ix) GROUP BY 1")
def handle_power_max(spark, d):
    return H.Handle.of(bind(spark, d)).power(2).max(0)


@query(", p AS (SELECT l_orderkey AS cell_ix, l_partkey AS gene_ix, sum(l_extendedprice) AS value FROM lineitem GROUP BY 1, 2) SELECT cell_ix, round(coalesce(s, 0.0), 2) AS sum FROM obs LEFT JOIN (SELECT cell_ix, sum(p.value + 3 * x.value) AS s FROM p JOIN x USING (cell_ix, gene_ix) GROUP BY 1) USING (cell_ix)")
def handle_add_sum(spark, d):
    data = bind(spark, d)
    return (H.Handle.of(data, "price") + H.Handle.of(data) * 3).sum(1).withColumn("sum", r("sum", 2))


@query("SELECT r AS row, c AS column, value FROM x JOIN (VALUES (0, 7), (1, 3), (2, 7)) a(r, cell_ix) USING (cell_ix) JOIN (SELECT gene_ix, 10000 - gene_ix AS c FROM genes) USING (gene_ix)")
def handle_indexing(spark, d):
    data = bind(spark, d)
    rows = spark.createDataFrame([(0, 7), (1, 3), (2, 7)], "ord int, cell_ix long")
    return H.Handle.of(data)[rows, data.var.select((10000 - F.col("gene_ix")).alias("ord"), "gene_ix")]


@query("SELECT cell_ix, CAST((SELECT count(*) FROM genes) - count(*) FILTER (WHERE value > 0) AS BIGINT) AS n_true FROM obs LEFT JOIN x USING (cell_ix) GROUP BY 1")
def handle_compare_zero(spark, d):
    return H.Handle.of(bind(spark, d)).compare("<=", 0).sum(1)


@query("SELECT cell_ix, gene_ix, round(ln(1 + 4 * 0.05 * value), 9) AS value FROM x")
def transform_values_pflog(spark, d):
    return H.transform_values(bind(spark, d).matrix(), "pflog_raw").withColumn("value", r("value", 9))


@query("SELECT gene_ix, gene_ix IN (SELECT gene_ix FROM x WHERE value > 49) AS measured FROM genes")
def measured_mask(spark, d):
    data = bind(spark, d)
    return H.measured_mask(data.var, data.matrix().filter("value > 49"))


@query("SELECT cell_ix FROM x GROUP BY 1 HAVING sum(value) >= 120")
def min_counts_mask(spark, d):
    return H.min_counts_mask(bind(spark, d), 120)


@query(", e AS (SELECT user_id AS cell_ix, event_type, sum(value) AS value FROM events GROUP BY 1, 2) SELECT cell_ix, e_n AS events_n, round(e_t, 6) AS events_total, r_n AS rna_n, r_t AS rna_total FROM obs JOIN (SELECT cell_ix, count(*) AS e_n, sum(value) AS e_t FROM e GROUP BY 1) USING (cell_ix) JOIN (SELECT cell_ix, count(*) AS r_n, sum(value) AS r_t FROM x GROUP BY 1) USING (cell_ix)")
def modalities_aligned(spark, d):
    data = bind(spark, d)
    events = spark.read.parquet(f"{d}/events.parquet").groupBy(F.col("user_id").alias("cell_ix"), "event_type").agg(F.sum("value").alias("value"))
    second = Dataset(data.obs, data.var, events)
    out = H.Modalities(data.obs, {"rna": data, "events": second}).aligned()
    return out.withColumn("events_total", r("events_total"))


@query("SELECT doc_id, quality = 0 AS a_predicted, toxic = 1 AS b_predicted, (CASE WHEN quality = 0 THEN 1 ELSE 0 END + CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS doublet_n_tools_calling, CASE WHEN quality IS NULL THEN 0 ELSE 2 END AS doublet_n_tools_voting, CASE WHEN quality IS NULL THEN NULL ELSE quality = 0 OR toxic = 1 END AS doublet_predicted FROM documents LEFT JOIN labels USING (doc_id)", base=False)
def doublet_consensus_any(spark, d):
    t = spark.read.parquet(f"{d}/documents.parquet").select("doc_id").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id", "left")
    t = t.select("doc_id", (F.col("quality") == 0).alias("a_predicted"), (F.col("toxic") == 1).alias("b_predicted"))
    return consensus(t, ["a", "b"], "any")


_STRATA = _RANKS.replace("nc AS (SELECT count(*) AS n FROM obs)", "nc AS (SELECT o_orderstatus, count(*) AS n FROM obs GROUP BY 1)").replace("FROM x, nc WINDOW g AS (PARTITION BY gene_ix)", "FROM x JOIN (SELECT cell_ix, o_orderstatus FROM obs) USING (cell_ix) JOIN nc USING (o_orderstatus) WINDOW g AS (PARTITION BY o_orderstatus, gene_ix)").replace("SELECT cell_ix, gene_ix, value, n -", "SELECT o_orderstatus, cell_ix, gene_ix, value, n -").replace("PARTITION BY gene_ix ORDER", "PARTITION BY o_orderstatus, gene_ix ORDER").replace("PARTITION BY gene_ix, value", "PARTITION BY o_orderstatus, gene_ix, value")


@query(_STRATA + """
, sz AS (SELECT o_orderstatus, o_orderpriority, count(*) AS n1 FROM obs GROUP BY 1, 2),
g AS (SELECT o_orderstatus, gene_ix, any_value(m) AS m, any_value(n) AS n FROM rk GROUP BY 1, 2),
o AS (SELECT rk.o_orderstatus, o_orderpriority, gene_ix, sum(rank) AS w, count(*) AS k FROM rk JOIN (SELECT cell_ix, o_orderpriority FROM obs) USING (cell_ix) GROUP BY 1, 2, 3),
j AS (SELECT o_orderstatus, o_orderpriority, gene_ix, CAST(n AS DOUBLE) AS n, CAST(n1 AS DOUBLE) AS n1, coalesce(w, 0) + (n1 - coalesce(k, 0)) * (n - m + 1) / 2.0 AS w FROM g JOIN sz USING (o_orderstatus) LEFT JOIN o USING (o_orderstatus, o_orderpriority, gene_ix))
SELECT o_orderstatus, o_orderpriority, gene_ix, round((w - n1 * (n + 1) / 2) / sqrt(n1 * (n - n1) / 12 * (n + 1)), 5) AS score FROM j""")
def rank_sum_stratified(spark, d):
    out = R.rank_sum(bind(spark, d), "o_orderpriority", strata=("o_orderstatus",), min_cells=5)
    return out.select("o_orderstatus", "o_orderpriority", "gene_ix", r("score", 5).alias("score"))


@query(", p AS (SELECT o_orderpriority AS target, sum(value) AS depth FROM x JOIN obs USING (cell_ix) GROUP BY 1), s AS (SELECT o_orderpriority AS target, gene_ix, sum(value) AS total FROM x JOIN obs USING (cell_ix) GROUP BY 1, 2), c AS (SELECT target, gene_ix, 1e6 * coalesce(total, 0.0) / depth AS cpm FROM p CROSS JOIN genes LEFT JOIN s USING (target, gene_ix)), f AS (SELECT a.target, a.gene_ix, a.cpm AS t, b.cpm AS r FROM c a JOIN c b USING (gene_ix) WHERE a.target <> '5-LOW' AND b.target = '5-LOW') SELECT target, CAST(count(*) AS BIGINT) AS n_genes FROM f WHERE t > 700 OR r > 700 GROUP BY 1")
def pairwise_cpm_filter(spark, d):
    return R.pairwise_reference(bind(spark, d), "o_orderpriority", "5-LOW", cpm_filter=700).groupBy("target").agg(F.count("*").alias("n_genes"))


@query(_WILCOXON.format(tie="0") + """
, gn AS (SELECT o_orderpriority, count(*) AS ng FROM obs GROUP BY 1), kk AS (SELECT o_orderpriority, gene_ix, count(*) AS k FROM x JOIN obs USING (cell_ix) GROUP BY 1, 2), ka AS (SELECT gene_ix, sum(k) AS ka FROM kk GROUP BY 1)
SELECT o_orderpriority, gene_ix, round(score, 5) AS score, round(logfoldchange, 6) AS logfoldchange, round(coalesce(k, 0) / ng, 9) AS pts, round((ka - coalesce(k, 0)) / ((SELECT count(*) FROM obs) - ng), 9) AS pts_rest
FROM res JOIN gn USING (o_orderpriority) JOIN ka USING (gene_ix) LEFT JOIN kk USING (o_orderpriority, gene_ix) WHERE logfoldchange > 0.001""")
def ranking_extracted(spark, d):
    out = R.extract(R.rank_genes_groups(bind(spark, d), "o_orderpriority", pts=True), pval_cutoff=1.01, log2fc_min=0.001)
    return out.select("o_orderpriority", "gene_ix", r("score", 5).alias("score"), r("logfoldchange").alias("logfoldchange"), r("pts", 9).alias("pts"), r("pts_rest", 9).alias("pts_rest"))


@query()
def adjusted_mutual_information(spark, d):
    obs = bind(spark, d).obs
    return spark.createDataFrame([(round(M.adjusted_mutual_information(obs, "c_mktsegment", "o_orderstatus"), 8),)], "ami double")


@query(", v AS (SELECT gene_id, gene_ix * 2 AS global_ix FROM genes), p AS (SELECT cell_ix % 10 AS set_id, cell_ix AS ord, CASE WHEN cell_ix % 3 = 0 THEN 'a' ELSE 'b' END AS source, cell_ix FROM obs), s AS (SELECT 'a' AS source, cell_ix, gene_ix, value FROM x UNION ALL SELECT 'b', l_orderkey, l_partkey, round(sum(l_extendedprice), 2) FROM lineitem GROUP BY 2, 3) SELECT set_id, ord, source, cell_ix, global_ix AS gene_ix, value FROM p JOIN s USING (source, cell_ix) JOIN genes USING (gene_ix) JOIN v USING (gene_id)")
def gather_cell_sets(spark, d):
    data = bind(spark, d)
    vocabulary = data.var.select("gene_id", (F.col("gene_ix") * 2).alias("global_ix"))
    plan = data.obs.select((F.col("cell_ix") % 10).alias("set_id"), F.col("cell_ix").alias("ord"), F.when(F.col("cell_ix") % 3 == 0, "a").otherwise("b").alias("source"), "cell_ix")
    second = data.with_x(data.layers["price"].withColumn("value", r("value", 2)))
    return G.gather_sets({"a": data, "b": second}, vocabulary, plan)


@query(", e AS (SELECT cell_ix AS src, gene_ix AS dst, value AS weight FROM x) SELECT src, dst, weight FROM e WHERE src IN (SELECT cell_ix FROM obs WHERE c_mktsegment = 'MACHINERY' AND o_totalprice > 300000)")
def graph_rows(spark, d):
    data = bind(spark, d)
    edges = data.matrix().select(F.col("cell_ix").alias("src"), F.col("gene_ix").alias("dst"), F.col("value").alias("weight"))
    return G.graph_rows(edges, data.query().filter_obs("c_mktsegment == 'MACHINERY' and o_totalprice > 300000").cells())


@query()
def agreement_sweep(spark, d):
    e = bind(spark, d).obsm["X_emb"].select("label", "vec")
    return G.agreement_sweep(e, e.withColumn("vec", F.transform("vec", lambda v: F.signum(v))), "label", resolutions=(0.5, 1.0), k=3)


@query()
def pairwise_nb_regression(spark, d):
    data = bind(spark, d)
    return G.pdex_nb_glm(data, "o_orderstatus", "F", "n_name")
