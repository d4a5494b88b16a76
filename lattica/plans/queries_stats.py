"""Queries of rank tests, gene selection, scores and evaluation metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.operators import aggregates as A
from lattica.operators import features as V
from lattica.operators import metrics as M
from lattica.operators import ranking as R
from lattica.plans.dataset import bind
from lattica.plans.registration import query, r

GROUP, REF = "o_orderpriority", "5-LOW"

_RANKS = """
, nc AS (SELECT count(*) AS n FROM obs),
rk AS (SELECT cell_ix, gene_ix, value, n - count(*) OVER g + rank() OVER (PARTITION BY gene_ix ORDER BY value) + (count(*) OVER (PARTITION BY gene_ix, value) - 1) / 2.0 AS rank,
  count(*) OVER g AS m, count(*) OVER (PARTITION BY gene_ix, value) AS ties, n FROM x, nc WINDOW g AS (PARTITION BY gene_ix))
"""


@query(_RANKS + "SELECT cell_ix, gene_ix, rank FROM rk")
def tie_averaged_ranks(spark, d):
    data = bind(spark, d)
    n = data.obs.agg(F.count("*").alias("n_pool"))
    return R.tie_averaged_ranks(data.matrix(), n, ["gene_ix"]).select("cell_ix", "gene_ix", "rank")


_WILCOXON = _RANKS + """
, sz AS (SELECT o_orderpriority, count(*) AS n1 FROM obs GROUP BY 1),
g AS (SELECT gene_ix, any_value(m) AS m, any_value(n) AS n, sum(value) AS s_all, sum(CAST(ties AS DOUBLE) * ties - 1) AS tie FROM rk GROUP BY 1),
o AS (SELECT o_orderpriority, gene_ix, sum(rank) AS w, count(*) AS k, sum(value) AS s FROM rk JOIN obs USING (cell_ix) GROUP BY 1, 2),
j AS (SELECT o_orderpriority, gene_ix, CAST(n AS DOUBLE) AS n, CAST(n1 AS DOUBLE) AS n1, CAST(n - m AS DOUBLE) AS z0, tie, s_all, coalesce(w, 0) + (n1 - coalesce(k, 0)) * (n - m + 1) / 2.0 AS w, coalesce(s, 0.0) AS s
  FROM g CROSS JOIN sz LEFT JOIN o USING (o_orderpriority, gene_ix)),
t AS (SELECT *, n1 * (n - n1) / 12 * (n + 1 - {tie}) AS v FROM j),
res AS (SELECT o_orderpriority, gene_ix, (w - n1 * (n + 1) / 2) / sqrt(v) AS score, log2((s / n1 + 1e-9) / ((s_all - s) / (n - n1) + 1e-9)) AS logfoldchange, s / n1 AS mean_group, (s_all - s) / (n - n1) AS mean_rest FROM t)
"""
_TIE = "(tie + z0 * z0 * z0 - z0) / (n * (n - 1))"
_ROUNDED = "round(score, 5) AS score, round(logfoldchange, 6) AS logfoldchange, round(mean_group, 6) AS mean_group, round(mean_rest, 6) AS mean_rest FROM res"


def _rounded(out):
    return out.withColumns({"score": r("score", 5)} | {c: r(c) for c in ("logfoldchange", "mean_group", "mean_rest")})


@query(_WILCOXON.format(tie="0") + "SELECT o_orderpriority, gene_ix, " + _ROUNDED)
def rank_sum(spark, d):
    return _rounded(R.rank_sum(bind(spark, d), GROUP))


@query(_WILCOXON.format(tie=_TIE) + "SELECT o_orderpriority, gene_ix, " + _ROUNDED)
def rank_sum_tie_corrected(spark, d):
    return _rounded(R.rank_sum(bind(spark, d), GROUP, tie_correct=True))


#: Two-sided p of z by the series of the error function; beyond 4 sqrt(2) it is 0 in the digits kept.
_P = "round(CASE WHEN abs({z}) / sqrt(2.0) > 4 THEN 0.0 ELSE 1 - 2 / sqrt(pi()) * list_sum(list_transform(generate_series(0, 80), lambda i: (CASE WHEN i % 2 = 0 THEN 1 ELSE -1 END) * exp((2 * i + 1) * ln(greatest(abs({z}), 1e-12) / sqrt(2.0)) - lgamma(i + 1)) / (2 * i + 1))) END, 5)"


@query(_WILCOXON.format(tie=_TIE) + "SELECT o_orderpriority, gene_ix, " + _P.format(z="score") + " AS pval, " + _ROUNDED)
def rank_genes_groups(spark, d):
    out = R.rank_genes_groups(bind(spark, d), GROUP, tie_correct=True)
    return _rounded(out.drop("pval_adj", "rank")).withColumn("pval", r("pval", 5))


@query(_WILCOXON.format(tie="0") + ", rd AS (SELECT *, round(score, 6) AS sc FROM res) SELECT o_orderpriority, gene_ix, sc AS score, CAST(row_number() OVER (PARTITION BY o_orderpriority ORDER BY sc DESC NULLS LAST, gene_ix) AS BIGINT) AS rank FROM rd")
def de_ranking(spark, d):
    from pyspark.sql import Window

    t = R.rank_sum(bind(spark, d), GROUP).withColumn("score", r("score"))
    place = F.row_number().over(Window.partitionBy(GROUP).orderBy(F.col("score").desc_nulls_last(), "gene_ix"))
    return t.select(GROUP, "gene_ix", "score", place.cast("long").alias("rank"))


_PDEX = """
, sz AS (SELECT o_orderpriority AS target, count(*) AS n1 FROM obs GROUP BY 1), rn AS (SELECT n1 AS n2 FROM sz WHERE target = '5-LOW'),
tg AS (SELECT * FROM sz, rn WHERE target <> '5-LOW'), xl AS (SELECT x.*, o_orderpriority AS g FROM x JOIN obs USING (cell_ix)),
p AS (SELECT g AS target, gene_ix, value, 1 AS own FROM xl WHERE g <> '5-LOW' UNION ALL SELECT target, gene_ix, value, 0 FROM xl, tg WHERE g = '5-LOW'),
rk AS (SELECT p.*, n1, n2, count(*) OVER (PARTITION BY p.target, gene_ix) AS m, count(*) OVER (PARTITION BY p.target, gene_ix, value) AS ties, rank() OVER (PARTITION BY p.target, gene_ix ORDER BY value) AS r0 FROM p JOIN tg USING (target)),
a AS (SELECT target, gene_ix, CAST(any_value(n1) AS DOUBLE) AS n1, CAST(any_value(n2) AS DOUBLE) AS n2, any_value(m) AS m, coalesce(sum(n1 + n2 - m + r0 + (ties - 1) / 2.0) FILTER (WHERE own = 1), 0.0) AS w, sum(own) AS k,
  coalesce(sum(ln(1 + value)) FILTER (WHERE own = 1), 0.0) AS s1, coalesce(sum(ln(1 + value)) FILTER (WHERE own = 0), 0.0) AS s2, sum(CAST(ties AS DOUBLE) * ties - 1) AS tie FROM rk GROUP BY 1, 2),
b AS (SELECT *, n1 + n2 AS n, n1 + n2 - m AS z0, w + (n1 - k) * (n1 + n2 - m + 1) / 2 - n1 * (n1 + 1) / 2 AS u, exp(s1 / n1) - 1 AS t, exp(s2 / n2) - 1 AS r FROM a),
c AS (SELECT *, n1 * n2 / 12 * (n + 1 - (tie + z0 * z0 * z0 - z0) / (n * (n - 1))) AS v FROM b)
SELECT target, gene_ix, u AS statistic, round((greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / sqrt(v), 5) AS z, round(t, 6) AS target_mean, round(r, 6) AS reference_mean, round((t - r) / (r + 1e-9), 4) AS percent_change FROM c WHERE r > 0"""


@query(_PDEX)
def pairwise_reference(spark, d):
    out = R.pairwise_reference(bind(spark, d), GROUP, REF).filter("reference_mean > 0")
    return out.select("target", "gene_ix", "statistic", r("z", 5).alias("z"), r("target_mean").alias("target_mean"), r("reference_mean").alias("reference_mean"), r("percent_change", 4).alias("percent_change"))


@query(", p AS (SELECT c_mktsegment, gene_ix, count(*) / 1000.0 AS pval FROM x JOIN obs USING (cell_ix) GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY pval, gene_ix) AS rn, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM p) SELECT c_mktsegment, gene_ix, pval, round(least(1.0, min(pval * n / rn) OVER (PARTITION BY c_mktsegment ORDER BY rn DESC)), 9) AS pval_adj FROM k")
def benjamini_hochberg(spark, d):
    data = bind(spark, d)
    p = data.matrix().join(data.read_obs("c_mktsegment"), "cell_ix").groupBy("c_mktsegment", "gene_ix").agg((F.count("*") / 1000.0).cast("double").alias("pval"))
    return R.benjamini_hochberg(p, ["c_mktsegment"]).withColumn("pval_adj", r("pval_adj", 9))


# ---- features


@query(", s AS (SELECT cell_ix, coalesce(sum(value), 0.0) AS sum, CAST(count(x.cell_ix) AS BIGINT) AS nnz FROM obs LEFT JOIN x USING (cell_ix) GROUP BY 1) SELECT * FROM s WHERE nnz >= 3 AND sum <= 150")
def filter_cells(spark, d):
    return V.filter_axis(bind(spark, d), "cell", max_counts=150, min_nnz=3)


@query(", s AS (SELECT gene_ix, coalesce(sum(value), 0.0) AS sum, CAST(count(x.gene_ix) AS BIGINT) AS nnz FROM genes LEFT JOIN x USING (gene_ix) GROUP BY 1) SELECT * FROM s WHERE sum >= 700 AND nnz <= 40")
def filter_genes(spark, d):
    return V.filter_axis(bind(spark, d), "gene", min_counts=700, max_nnz=40)


@query(""", n AS (SELECT count(*) AS n FROM obs), mm AS (SELECT gene_ix, sum(value) / any_value(n) AS mean, (sum(value * value) - any_value(n) * (sum(value) / any_value(n)) * (sum(value) / any_value(n))) / (any_value(n) - 1) AS var FROM x, n GROUP BY 1),
l AS (SELECT gene_ix, ln(1 + mean) AS log_mean, ln(var / mean) AS dispersion FROM mm WHERE mean > 0), e AS (SELECT min(log_mean) AS lo, max(log_mean) AS hi FROM l),
b AS (SELECT l.*, CAST(greatest(1, least(20, ceil((log_mean - lo) / ((hi - lo) / 20)))) AS BIGINT) AS bin FROM l, e)
SELECT gene_ix, round(log_mean, 6) AS log_mean, round(dispersion, 6) AS dispersion, bin, round(CASE WHEN count(*) OVER w = 1 THEN 1.0 ELSE (dispersion - avg(dispersion) OVER w) / stddev_samp(dispersion) OVER w END, 5) AS dispersion_norm FROM b WINDOW w AS (PARTITION BY bin)""")
def highly_variable_dispersion(spark, d):
    out = V.dispersion_bins(A.sample_moments(bind(spark, d)))
    return out.withColumns({"log_mean": r("log_mean"), "dispersion": r("dispersion"), "dispersion_norm": r("dispersion_norm", 5)})


@query()
def highly_variable_loess(spark, d):
    return V.variance_stabilised(bind(spark, d), n_top=200)


@query()
def highly_variable_loess_batches(spark, d):
    return V.variance_stabilised(bind(spark, d), n_top=200, batch="c_mktsegment")


@query(", m AS (SELECT gene_ix, round(coalesce(sum(value), 0.0) / (SELECT count(*) FROM obs), 9) AS mean FROM genes LEFT JOIN x USING (gene_ix) GROUP BY 1) SELECT gene_ix, mean, CAST(floor(rank() OVER (ORDER BY mean) / greatest(1.0, (SELECT round(count(*) / 24.0) FROM m))) AS BIGINT) AS bin FROM m")
def expression_bins(spark, d):
    return V.expression_bins(A.sample_moments(bind(spark, d)).select("gene_ix", r("mean", 9).alias("mean")))


@query(", w AS (SELECT gene_ix, sum(w) AS w FROM (SELECT gene_ix, 1.0 / count(*) OVER () AS w FROM genes WHERE p_size < 5 UNION ALL SELECT gene_ix, -1.0 / count(*) OVER () FROM genes WHERE p_size >= 40) GROUP BY 1) SELECT cell_ix, round(coalesce(s, 0.0), 9) AS score FROM obs LEFT JOIN (SELECT cell_ix, sum(value * w) AS s FROM x JOIN w USING (gene_ix) GROUP BY 1) USING (cell_ix)")
def score_genes(spark, d):
    data = bind(spark, d)
    return V.score_genes_mean(data, data.var.filter("p_size < 5"), data.var.filter("p_size >= 40")).withColumn("score", r("score", 9))


@query(", n AS (SELECT count(*) AS n FROM obs), m AS (SELECT gene_ix, sum(value) / any_value(n) AS mean, sqrt((sum(value * value) - any_value(n) * (sum(value) / any_value(n)) ** 2) / (any_value(n) - 1)) AS sd FROM x SEMI JOIN (SELECT * FROM genes WHERE p_size < 5) USING (gene_ix), n GROUP BY 1) SELECT cell_ix, round((coalesce(s, 0.0) - (SELECT sum(mean / sd) FROM m)) / sqrt((SELECT count(*) FROM genes WHERE p_size < 5)), 6) AS score FROM obs LEFT JOIN (SELECT cell_ix, sum(value / sd) AS s FROM x JOIN m USING (gene_ix) GROUP BY 1) USING (cell_ix)")
def score_genes_zscore(spark, d):
    data = bind(spark, d)
    return V.score_genes_zscore(data, data.var.filter("p_size < 5")).withColumn("score", r("score"))


@query()
def control_genes(spark, d):
    data = bind(spark, d)
    return V.control_genes(V.expression_bins(A.sample_moments(data)), data.var.filter("p_size < 5"), 5)


# ---- metrics

_DENSE = """
, n AS (SELECT o_orderpriority, count(*) AS n FROM obs GROUP BY 1),
ra AS (SELECT o_orderpriority, gene_ix, coalesce(s, 0.0) / n AS v FROM genes CROSS JOIN n LEFT JOIN (SELECT o_orderpriority, gene_ix, sum(value) AS s FROM x JOIN obs USING (cell_ix) GROUP BY 1, 2) USING (o_orderpriority, gene_ix)),
pa AS (SELECT o_orderpriority, gene_ix, coalesce(s, 0.0) / n AS v FROM genes CROSS JOIN n LEFT JOIN (SELECT o_orderpriority, gene_ix, sum(ln(1 + value)) AS s FROM x JOIN obs USING (cell_ix) GROUP BY 1, 2) USING (o_orderpriority, gene_ix)),
re AS (SELECT a.o_orderpriority, gene_ix, a.v, a.v - b.v AS e FROM ra a JOIN ra b USING (gene_ix) WHERE a.o_orderpriority <> '5-LOW' AND b.o_orderpriority = '5-LOW'),
pe AS (SELECT a.o_orderpriority, gene_ix, a.v, a.v - b.v AS e FROM pa a JOIN pa b USING (gene_ix) WHERE a.o_orderpriority <> '5-LOW' AND b.o_orderpriority = '5-LOW')
"""


def _bulks(spark, d):
    data = bind(spark, d)
    real = A.pseudobulk(data, [GROUP], dense=True)
    logged = A.pseudobulk(data, [GROUP], dense=True, x=data.matrix().withColumn("value", F.log1p("value")))
    return real, logged


@query(_DENSE + "SELECT o_orderpriority, CAST(count(*) AS BIGINT) AS n_genes, round(corr(r.e, p.e), 6) AS pearson_delta, round(avg((r.v - p.v) ** 2), 9) AS mse, round(avg(abs(r.v - p.v)), 9) AS mae, round(avg((r.e - p.e) ** 2), 9) AS mse_delta, round(avg(abs(r.e - p.e)), 9) AS mae_delta FROM re r JOIN pe p USING (o_orderpriority, gene_ix) GROUP BY 1")
def perturbation_metrics(spark, d):
    out = M.perturbation_metrics(*_bulks(spark, d), GROUP, REF)
    return out.withColumns({"pearson_delta": r("pearson_delta")} | {c: r(c, 9) for c in ("mse", "mae", "mse_delta", "mae_delta")})


@query(_DENSE + ", ds AS (SELECT p.o_orderpriority, r.o_orderpriority AS other, round(sum(abs(p.e - r.e)), 9) AS dist FROM pe p JOIN re r USING (gene_ix) GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY dist, other) - 1 AS place, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM ds) SELECT o_orderpriority, CAST(place AS BIGINT) AS rank, 1 - place / n AS score FROM k WHERE o_orderpriority = other")
def discrimination_score(spark, d):
    return M.discrimination(*_bulks(spark, d), GROUP, REF)


@query("""
, c AS (SELECT n FROM (SELECT count(*) AS n FROM obs WHERE o_orderpriority = '5-LOW')), b AS (SELECT gene_ix, sum(value) AS s FROM x SEMI JOIN (SELECT * FROM obs WHERE o_orderpriority = '5-LOW') USING (cell_ix) GROUP BY 1),
t AS (SELECT o_orderpriority, gene_ix, coalesce(s, 0.0) / n AS mu FROM (VALUES ('1-URGENT', 17), ('2-HIGH', 3), ('3-MEDIUM', 45)) v(o_orderpriority, gene_ix) LEFT JOIN b USING (gene_ix), c)
SELECT cell_ix, o_orderpriority, round(1 - coalesce(value, 0.0) / (mu + 1e-9), 6) AS efficiency, round(ln(1 + coalesce(value, 0.0)) - ln(1 + mu), 6) AS log_deviation FROM obs JOIN t USING (o_orderpriority) LEFT JOIN x USING (cell_ix, gene_ix)""")
def knockdown_efficiency(spark, d):
    targets = spark.createDataFrame([("1-URGENT", 17), ("2-HIGH", 3), ("3-MEDIUM", 45)], f"{GROUP} string, gene_ix long")
    return M.knockdown(bind(spark, d), GROUP, REF, targets).withColumns({"efficiency": r("efficiency"), "log_deviation": r("log_deviation")})


_VEC = "(SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"


@query(f"SELECT a.vec_id AS a, b.vec_id AS b, round(list_distance(a.v, b.v), 6) AS euclidean, round(list_sum(list_transform(list_zip(a.v, b.v), lambda p: abs(p[1] - p[2]))), 6) AS l1, round(1 - list_cosine_similarity(a.v, b.v), 6) AS cosine FROM {_VEC} a JOIN {_VEC} b ON b.vec_id = a.vec_id + 1", base=False)
def vector_distances(spark, d):
    e = bind(spark, d).obsm["X_emb"]
    j = e.select(F.col("cell_ix").alias("a"), F.col("vec").alias("x")).join(e.select(F.col("cell_ix").alias("b"), F.col("vec").alias("y")), F.col("b") == F.col("a") + 1)
    return j.select("a", "b", *[r(M.distance(F.col("x"), F.col("y"), m)).alias(m) for m in ("euclidean", "l1", "cosine")])


@query(f", e AS {_VEC}, dd AS (SELECT a.label AS a, b.label AS b, avg(list_distance(a.v, b.v)) AS m FROM e a, e b GROUP BY 1, 2) SELECT o.a AS label, round(2 * o.m - s.m - z.m, 6) AS energy_distance FROM dd o JOIN dd s ON s.a = o.a AND s.b = o.a JOIN dd z ON z.a = 0 AND z.b = 0 WHERE o.b = 0 AND o.a <> 0".replace(", e AS", "WITH e AS", 1), base=False)
def energy_distance(spark, d):
    e = bind(spark, d).obsm["X_emb"].select("label", "vec")
    return M.energy_distance(e, "label", 0).withColumn("energy_distance", r("energy_distance"))


_NMI = """
, l AS (SELECT c_mktsegment AS a, o_orderstatus AS b FROM obs), t AS (SELECT a, b, CAST(count(*) AS DOUBLE) AS n FROM l GROUP BY 1, 2), ra AS (SELECT a, sum(n) AS na FROM t GROUP BY 1), cb AS (SELECT b, sum(n) AS nb FROM t GROUP BY 1), nn AS (SELECT sum(n) AS nn FROM t),
mi AS (SELECT sum(n / nn * ln(n * nn / (na * nb))) AS mi, sum(n * (n - 1) / 2) AS pairs FROM t JOIN ra USING (a) JOIN cb USING (b), nn), ha AS (SELECT sum(-na / nn * ln(na / nn)) AS h, sum(na * (na - 1) / 2) AS p FROM ra, nn), hb AS (SELECT sum(-nb / nn * ln(nb / nn)) AS h, sum(nb * (nb - 1) / 2) AS p FROM cb, nn)
SELECT round(mi, 9) AS mutual_information, round(ha.h, 9) AS entropy_a, round(hb.h, 9) AS entropy_b, round(mi / ((ha.h + hb.h) / 2), 9) AS nmi, round((pairs - ha.p * hb.p / (nn * (nn - 1) / 2)) / ((ha.p + hb.p) / 2 - ha.p * hb.p / (nn * (nn - 1) / 2)), 9) AS ari FROM mi, ha, hb, nn"""


@query(_NMI)
def clustering_agreement(spark, d):
    obs = bind(spark, d).obs
    out = M.mutual_information(obs, "c_mktsegment", "o_orderstatus")
    return out.select(*[r(c, 9).alias(c) for c in out.columns])


@query("SELECT doc_id, CASE WHEN quality IS NULL AND toxic IS NULL AND n_chars >= 500 THEN NULL ELSE 2 * (CASE WHEN quality = 0 THEN 1 ELSE 0 END + CASE WHEN toxic = 1 THEN 1 ELSE 0 END + CASE WHEN n_chars < 500 THEN 1 ELSE 0 END) > (CASE WHEN quality IS NULL THEN 0 ELSE 1 END + CASE WHEN toxic IS NULL THEN 0 ELSE 1 END + CASE WHEN n_chars < 500 THEN 1 ELSE 0 END) END AS consensus FROM documents LEFT JOIN labels USING (doc_id)", base=False)
def vote_consensus(spark, d):
    t = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "n_chars").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id", "left")
    votes = [F.col("quality") == 0, F.col("toxic") == 1, F.when(F.col("n_chars") < 500, F.lit(True))]
    return t.select("doc_id", M.vote_consensus(votes).alias("consensus"))


@query("SELECT doc_id, round(CASE WHEN a IS NULL AND b IS NULL THEN NULL ELSE (coalesce(a, 0) + coalesce(b, 0)) / (CASE WHEN a IS NULL THEN 0 ELSE 1 END + CASE WHEN b IS NULL THEN 0 ELSE 1 END) END, 9) AS mean_rank FROM (SELECT doc_id, CASE WHEN n_chars IS NOT NULL THEN percent_rank() OVER (PARTITION BY n_chars IS NULL ORDER BY n_chars) END AS a, CASE WHEN quality IS NOT NULL THEN percent_rank() OVER (PARTITION BY quality IS NULL ORDER BY quality) END AS b FROM documents LEFT JOIN labels USING (doc_id))", base=False)
def mean_rank_consensus(spark, d):
    t = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "n_chars").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id", "left")
    return M.mean_rank(t, ["n_chars", "quality"], "doc_id").withColumn("mean_rank", r("mean_rank", 9))
