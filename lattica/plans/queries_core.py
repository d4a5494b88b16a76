"""Queries of the builder, the aggregates and the transforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.operators import aggregates as A
from lattica.operators import transform as T
from lattica.plans.dataset import bind
from lattica.plans.query import suggest
from lattica.plans.registration import query, r

WHERE = "o_orderstatus == 'F' and o_totalprice > 1000"
NAMES = ["g17", "g3", "g120", "g3", "g45"]
SELECTED = "('g17', 'g3', 'g120', 'g45')"


def flagship(spark, sf_dir):
    """Filter, project, normalise, log, average by group."""
    q = bind(spark, sf_dir).query().filter_obs(WHERE).filter_var("p_size < 25").with_normalize(1e4).with_log1p()
    cells = q.cells().select("cell_ix", "o_orderpriority")
    sizes = cells.groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    got = q.x().join(cells, "cell_ix").groupBy("o_orderpriority", "gene_ix").agg(F.sum("value").alias("s"))
    return got.join(sizes, "o_orderpriority").select("o_orderpriority", "gene_ix", r(F.col("s") / F.col("n")).alias("mean_value"))


_FLAG = """, cells AS (SELECT * FROM obs WHERE o_orderstatus = 'F' AND o_totalprice > 1000),
sel AS (SELECT x.* FROM x SEMI JOIN cells USING (cell_ix) SEMI JOIN (SELECT * FROM genes WHERE p_size < 25) USING (gene_ix)),
nrm AS (SELECT cell_ix, gene_ix, ln(1 + value * 10000.0 / sum(value) OVER (PARTITION BY cell_ix)) AS value FROM sel)
SELECT o_orderpriority, gene_ix, round(sum(value) / any_value(n), 6) AS mean_value
FROM nrm JOIN cells USING (cell_ix) JOIN (SELECT o_orderpriority, count(*) AS n FROM cells GROUP BY 1) USING (o_orderpriority) GROUP BY 1, 2"""


@query(_FLAG)
def flagship_pseudobulk(spark, d):
    return flagship(spark, d)


# ---- builder


@query("SELECT cell_ix, gene_ix, value FROM x SEMI JOIN (SELECT * FROM obs WHERE o_orderstatus = 'F' AND o_totalprice > 1000) USING (cell_ix)")
def filter_obs_collect(spark, d):
    return bind(spark, d).query().filter_obs(WHERE).x()


@query("SELECT cell_ix, gene_ix, value FROM x SEMI JOIN (SELECT * FROM genes WHERE p_brand IN ('Brand#13', 'Brand#21') AND NOT p_size >= 20) USING (gene_ix)")
def filter_var_collect(spark, d):
    return bind(spark, d).query().filter_var("p_brand in ['Brand#13', 'Brand#21'] and not p_size >= 20").x()


@query(f"SELECT gene_id, gene_ix, CASE gene_id WHEN 'g17' THEN 0 WHEN 'g3' THEN 1 WHEN 'g120' THEN 2 ELSE 3 END AS ord FROM genes WHERE gene_id IN {SELECTED}")
def select_genes_order(spark, d):
    return bind(spark, d).query().select_genes(NAMES).selected_var().select("gene_id", "gene_ix", "ord")


@query(f", sel AS (SELECT x.* FROM x SEMI JOIN (SELECT * FROM genes WHERE gene_id IN {SELECTED}) USING (gene_ix)) SELECT cell_ix, gene_ix, round(ln(1 + value * 100.0 / sum(value) OVER (PARTITION BY cell_ix)), 6) AS value FROM sel")
def select_normalize_log1p(spark, d):
    return bind(spark, d).query().select_genes(NAMES).with_normalize(100).with_log1p().x().withColumn("value", r("value"))


@query("SELECT cell_ix, gene_ix, round(value * 10000.0 / sum(value) OVER (PARTITION BY cell_ix), 6) AS value FROM x")
def with_normalize(spark, d):
    return bind(spark, d).query().with_normalize(1e4).x().withColumn("value", r("value"))


@query("SELECT cell_ix, gene_ix, value FROM x SEMI JOIN (SELECT cell_ix FROM obs WHERE o_orderstatus = 'O' ORDER BY cell_ix LIMIT 25) USING (cell_ix)")
def limit_collect(spark, d):
    return bind(spark, d).query().filter_obs("o_orderstatus == 'O'").limit(25).x()


@query("SELECT CAST(count(*) AS BIGINT) AS n, count(*) > 0 AS any FROM obs WHERE o_orderstatus = 'O'")
def count_and_exists(spark, d):
    q = bind(spark, d).query().filter_obs("o_orderstatus == 'O'").limit(5)
    return q.matching().agg(F.count("*").alias("n"), (F.count("*") > 0).alias("any"))


@query("SELECT cell_ix FROM obs LEFT JOIN (SELECT doc_id, quality FROM labels) ON cell_ix = doc_id WHERE NOT (quality = 1) OR quality <> 1 AND cell_ix > 10")
def predicate_null_logic(spark, d):
    data = bind(spark, d)
    labels = spark.read.parquet(f"{d}/labels.parquet").select(F.col("doc_id").alias("cell_ix"), "quality")
    from dataclasses import replace

    data = replace(data, obs=data.obs.join(labels, "cell_ix", "left"))
    return data.query().filter_obs("not (quality == 1) or quality != 1 and cell_ix > 10").cells().select("cell_ix")


@query("SELECT cell_ix FROM obs LEFT JOIN (SELECT doc_id, quality FROM labels) ON cell_ix = doc_id WHERE quality IS DISTINCT FROM 1")
def predicate_pandas_logic(spark, d):
    from dataclasses import replace

    data = bind(spark, d)
    labels = spark.read.parquet(f"{d}/labels.parquet").select(F.col("doc_id").alias("cell_ix"), "quality")
    data = replace(data, obs=data.obs.join(labels, "cell_ix", "left"))
    return data.query().filter_obs("not (quality == 1)", null_mode="pandas").cells().select("cell_ix")


@query("SELECT DISTINCT c_mktsegment FROM obs")
def distinct_values(spark, d):
    return bind(spark, d).read_obs("c_mktsegment").select("c_mktsegment").distinct()


@query("SELECT cell_ix, CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS BIGINT) AS code FROM obs")
def obs_categorical(spark, d):
    obs = bind(spark, d).read_obs("c_mktsegment")
    from pyspark.sql import Window

    levels = obs.select("c_mktsegment").distinct()
    levels = levels.withColumn("code", (F.row_number().over(Window.orderBy("c_mktsegment")) - 1).cast("long"))  # one row a level
    return obs.join(levels, "c_mktsegment", "left").select("cell_ix", F.coalesce("code", F.lit(-1)).alias("code"))


@query("SELECT gene_ix, CAST(count(x.gene_ix) AS BIGINT) AS n FROM genes LEFT JOIN x USING (gene_ix) GROUP BY 1")
def detection_counts_gene(spark, d):
    return A.axis_stats(bind(spark, d), "gene").select("gene_ix", F.col("nnz").alias("n"))


@query("SELECT cell_ix, CAST(count(x.cell_ix) AS BIGINT) AS n FROM obs LEFT JOIN x USING (cell_ix) GROUP BY 1")
def detection_counts_cell(spark, d):
    return A.axis_stats(bind(spark, d), "cell").select("cell_ix", F.col("nnz").alias("n"))


@query("SELECT cell_ix FROM x WHERE gene_ix = 17")
def cells_expressing(spark, d):
    return bind(spark, d).matrix().filter("gene_ix = 17").select("cell_ix")


@query("SELECT cell_ix, gene_ix, value FROM x WHERE cell_ix >= 100 AND cell_ix < 300")
def read_row_range(spark, d):
    return bind(spark, d).query().read_row_range(100, 300)


@query("SELECT cell_ix, gene_ix, value FROM x SEMI JOIN (SELECT * FROM obs WHERE o_orderpriority = '2-HIGH') USING (cell_ix)")
def read_group(spark, d):
    return bind(spark, d).query().read_group("o_orderpriority", "2-HIGH")


@query("SELECT o_orderpriority, CAST(count(*) AS BIGINT) AS n_cells FROM obs GROUP BY 1")
def group_labels(spark, d):
    return bind(spark, d).query().group_labels("o_orderpriority")


@query("SELECT wanted, suggestion, CAST(levenshtein(wanted, suggestion) AS BIGINT) AS distance, CAST(place AS BIGINT) AS place FROM (SELECT wanted, suggestion, row_number() OVER (PARTITION BY wanted ORDER BY levenshtein(wanted, suggestion), suggestion) AS place FROM (SELECT DISTINCT c_mktsegment AS suggestion FROM obs), (VALUES ('BUILDNG'), ('MACHINES')) v(wanted)) WHERE place <= 3")
def category_suggestions(spark, d):
    return suggest(bind(spark, d).read_obs("c_mktsegment"), "c_mktsegment", ["BUILDNG", "MACHINES"]).select("wanted", "suggestion", "distance", "place")


@query("SELECT ord, cell_ix, gene_ix, value FROM (VALUES (0, 7), (1, 3), (2, 7), (3, 100)) v(ord, cell_ix) JOIN x USING (cell_ix)")
def gather_rows(spark, d):
    request = spark.createDataFrame([(0, 7), (1, 3), (2, 7), (3, 100)], "ord int, cell_ix long")
    return T.gather_rows(bind(spark, d).matrix(), request)


@query("SELECT cell_ix, gene_ix, CAST(value AS BIGINT) AS value FROM x")
def collect_exact_integers(spark, d):
    return bind(spark, d).query().collect_as("long")[0]


# ---- aggregates


_STATS = """, n AS (SELECT count(*) AS extent FROM {other}),
s AS (SELECT {key}, sum(value) AS s, count(*) AS k, min(value) AS lo, max(value) AS hi, sum(value * value) AS q FROM x GROUP BY 1)
SELECT {key}, coalesce(s, 0.0) AS sum, CAST(coalesce(k, 0) AS BIGINT) AS nnz, CASE WHEN coalesce(k, 0) >= extent THEN lo ELSE least(coalesce(lo, 0.0), 0.0) END AS min,
CASE WHEN coalesce(k, 0) >= extent THEN hi ELSE greatest(coalesce(hi, 0.0), 0.0) END AS max, coalesce(q, 0.0) AS sum_sq,
round(greatest(coalesce(q, 0.0) / extent - (coalesce(s, 0.0) / extent) * (coalesce(s, 0.0) / extent), 0.0), 6) AS var
FROM {own} LEFT JOIN s USING ({key}), n"""


@query(_STATS.format(key="cell_ix", own="obs", other="genes"))
def row_statistics(spark, d):
    return A.axis_stats(bind(spark, d), "cell").withColumn("var", r("var"))


@query(_STATS.format(key="gene_ix", own="genes", other="obs"))
def column_statistics(spark, d):
    return A.axis_stats(bind(spark, d), "gene").withColumn("var", r("var"))


@query("SELECT CAST(count(*) AS BIGINT) AS nnz, sum(value) AS total, sum(value * value) AS sum_sq, round(sum(value * value) / (SELECT count(*) FROM genes) / (SELECT count(*) FROM obs) - (sum(value) / (SELECT count(*) FROM genes) / (SELECT count(*) FROM obs)) ** 2, 9) AS var FROM x")
def total_statistics(spark, d):
    data = bind(spark, d)
    one = data.matrix().agg(F.count("*").alias("nnz"), F.sum("value").alias("total"), F.sum(F.col("value") * F.col("value")).alias("sum_sq"))
    size = data.var.agg(F.count("*").alias("g")).crossJoin(data.obs.agg(F.count("*").alias("c")))  # single rows
    mean = F.col("total") / F.col("g") / F.col("c")
    return one.crossJoin(size).select("nnz", "total", "sum_sq", r(F.col("sum_sq") / F.col("g") / F.col("c") - mean * mean, 9).alias("var"))


@query("SELECT gene_ix, sum(value) AS sum, CAST(count(*) AS BIGINT) AS nnz FROM x SEMI JOIN (SELECT * FROM obs WHERE c_mktsegment = 'BUILDING') USING (cell_ix) GROUP BY 1")
def masked_column_sums(spark, d):
    q = bind(spark, d).query().filter_obs("c_mktsegment == 'BUILDING'")
    return q.x().groupBy("gene_ix").agg(F.sum("value").alias("sum"), F.count("*").alias("nnz"))


@query(", n AS (SELECT cell_ix, gene_ix, ln(1 + value * 10000.0 / sum(value) OVER (PARTITION BY cell_ix)) AS v FROM x) SELECT gene_ix, round(sum(v), 6) AS sum, round(sum(v * v), 6) AS sum_sq, CAST(count(*) AS BIGINT) AS nnz FROM n GROUP BY 1")
def lazy_transform_sums(spark, d):
    x = bind(spark, d).query().with_normalize(1e4).with_log1p().x()
    return x.groupBy("gene_ix").agg(r(F.sum("value")).alias("sum"), r(F.sum(F.col("value") * F.col("value"))).alias("sum_sq"), F.count("*").alias("nnz"))


@query("SELECT gene_ix, CAST(count(*) FILTER (WHERE value > 25) AS BIGINT) AS n_true FROM genes LEFT JOIN x USING (gene_ix) GROUP BY 1")
def count_above(spark, d):
    return A.count_where(bind(spark, d), "gene", ">", 25)


@query("SELECT gene_ix, CAST((SELECT count(*) FROM obs) - count(*) FILTER (WHERE value > 25) AS BIGINT) AS n_true FROM genes LEFT JOIN x USING (gene_ix) GROUP BY 1")
def count_at_most(spark, d):
    return A.count_where(bind(spark, d), "gene", "<=", 25)


_MOMENTS = ", n AS (SELECT count(*) AS n FROM obs), s AS (SELECT gene_ix, sum(value) AS s, sum(value * value) AS q FROM x GROUP BY 1) SELECT gene_ix, n AS n_cells, round(coalesce(s, 0.0) / n, 9) AS mean, round((coalesce(q, 0.0) - n * (coalesce(s, 0.0) / n) * (coalesce(s, 0.0) / n)) / (n - 1), 9) AS var FROM genes LEFT JOIN s USING (gene_ix), n"


@query(_MOMENTS)
def gene_moments(spark, d):
    return A.sample_moments(bind(spark, d)).select("gene_ix", "n_cells", r("mean", 9).alias("mean"), r("var", 9).alias("var"))


@query(", n AS (SELECT c_mktsegment, count(*) AS n FROM obs GROUP BY 1), s AS (SELECT c_mktsegment, gene_ix, sum(value) AS s, sum(value * value) AS q FROM x JOIN obs USING (cell_ix) GROUP BY 1, 2) SELECT c_mktsegment, gene_ix, n AS n_cells, round(coalesce(s, 0.0) / n, 9) AS mean, round((coalesce(q, 0.0) - n * (coalesce(s, 0.0) / n) * (coalesce(s, 0.0) / n)) / (n - 1), 9) AS var FROM genes CROSS JOIN n LEFT JOIN s USING (c_mktsegment, gene_ix)")
def gene_moments_by_batch(spark, d):
    return A.sample_moments(bind(spark, d), batch="c_mktsegment").select("c_mktsegment", "gene_ix", "n_cells", r("mean", 9).alias("mean"), r("var", 9).alias("var"))


@query(", c AS (SELECT gene_ix, 10.0 + gene_ix % 20 AS clip FROM genes) SELECT gene_ix, round(sum(least(value, clip)), 6) AS clip_sum, round(sum(least(value, clip) ** 2), 6) AS clip_sum_sq FROM x JOIN c USING (gene_ix) GROUP BY 1")
def clipped_sums(spark, d):
    data = bind(spark, d)
    clip = data.var.select("gene_ix", (10.0 + F.col("gene_ix") % 20).alias("clip"))
    return A.clipped_sums(data.matrix(), clip).select("gene_ix", r("clip_sum").alias("clip_sum"), r("clip_sum_sq").alias("clip_sum_sq"))


@query("""
, s AS (SELECT cell_ix, count(*) AS n, sum(value) AS t, coalesce(sum(value) FILTER (WHERE p_size < 10), 0.0) AS m,
  sum(value) FILTER (WHERE rn <= 2) AS t2 FROM (SELECT *, row_number() OVER (PARTITION BY cell_ix ORDER BY value DESC, gene_ix) AS rn FROM x) JOIN genes USING (gene_ix) GROUP BY 1)
SELECT cell_ix, CAST(coalesce(n, 0) AS BIGINT) AS n_genes_by_counts, round(ln(1 + coalesce(n, 0)), 6) AS log1p_n_genes_by_counts, coalesce(t, 0.0) AS total_counts, round(ln(1 + coalesce(t, 0.0)), 6) AS log1p_total_counts,
coalesce(m, 0.0) AS total_counts_small, round(ln(1 + coalesce(m, 0.0)), 6) AS log1p_total_counts_small, CASE WHEN t > 0 THEN round(100 * m / t, 6) ELSE 0.0 END AS pct_counts_small, CASE WHEN t > 0 THEN round(100 * t2 / t, 6) ELSE 0.0 END AS pct_counts_in_top_2_genes
FROM obs LEFT JOIN s USING (cell_ix)""")
def qc_metrics_obs(spark, d):
    out = A.qc_obs(bind(spark, d), F.col("p_size") < 10, "small")
    return out.withColumns({c: r(c) for c in out.columns if c.startswith(("log1p", "pct"))})


@query("""
, n AS (SELECT count(*) AS n FROM obs), s AS (SELECT gene_ix, count(*) AS k, sum(value) AS t FROM x GROUP BY 1)
SELECT gene_ix, CAST(coalesce(k, 0) AS BIGINT) AS n_cells_by_counts, round(coalesce(t, 0.0) / n, 6) AS mean_counts, round(ln(1 + coalesce(t, 0.0) / n), 6) AS log1p_mean_counts,
round(100 * (1 - coalesce(k, 0) / n), 6) AS pct_dropout_by_counts, coalesce(t, 0.0) AS total_counts, round(ln(1 + coalesce(t, 0.0)), 6) AS log1p_total_counts FROM genes LEFT JOIN s USING (gene_ix), n""")
def qc_metrics_var(spark, d):
    out = A.qc_var(bind(spark, d))
    return out.withColumns({c: r(c) for c in out.columns if c.startswith(("log1p", "pct", "mean"))})


_BULK = ", n AS (SELECT o_orderpriority, count(*) AS n_cells FROM obs GROUP BY 1) SELECT o_orderpriority, gene_ix, CAST(any_value(n_cells) AS BIGINT) AS n_cells, round({value}, 6) AS value FROM x JOIN obs USING (cell_ix) JOIN n USING (o_orderpriority) GROUP BY 1, 2"


@query(_BULK.format(value="sum(value)"))
def pseudobulk_sum(spark, d):
    return A.pseudobulk(bind(spark, d), ["o_orderpriority"], total=True).withColumn("value", r("value"))


@query(_BULK.format(value="sum(value) / any_value(n_cells)"))
def pseudobulk_mean(spark, d):
    return A.pseudobulk(bind(spark, d), ["o_orderpriority"]).withColumn("value", r("value"))


@query(_BULK.format(value="exp(sum(ln(1 + value)) / any_value(n_cells)) - 1"))
def pseudobulk_geometric(spark, d):
    return A.pseudobulk(bind(spark, d), ["o_orderpriority"], "geom_raw").withColumn("value", r("value"))


@query(", l AS (SELECT cell_ix, gene_ix, ln(1 + value) AS value FROM x)" + _BULK.replace("FROM x JOIN", "FROM l JOIN").format(value="ln(1 + sum(exp(value) - 1) / any_value(n_cells))"))
def pseudobulk_log_arithmetic(spark, d):
    data = bind(spark, d)
    return A.pseudobulk(data, ["o_orderpriority"], "arith_log1p", x=data.matrix().withColumn("value", F.log1p("value"))).withColumn("value", r("value"))


@query(", n AS (SELECT o_orderpriority, c_mktsegment, count(*) AS n_cells FROM obs GROUP BY 1, 2 HAVING count(*) >= 50) SELECT o_orderpriority, c_mktsegment, gene_ix, CAST(any_value(n_cells) AS BIGINT) AS n_cells, round(sum(value) / any_value(n_cells), 6) AS value FROM x JOIN obs USING (cell_ix) JOIN n USING (o_orderpriority, c_mktsegment) GROUP BY 1, 2, 3")
def pseudobulk_two_keys(spark, d):
    return A.pseudobulk(bind(spark, d), ["o_orderpriority", "c_mktsegment"], min_cells=50).withColumn("value", r("value"))


@query(", n AS (SELECT o_orderpriority, count(*) AS n FROM obs GROUP BY 1), k AS (SELECT o_orderpriority, gene_ix, count(*) AS k FROM x JOIN obs USING (cell_ix) GROUP BY 1, 2), a AS (SELECT gene_ix, sum(k) AS ka FROM k GROUP BY 1) SELECT o_orderpriority, gene_ix, round(coalesce(k, 0) / n, 9) AS pts, round((ka - coalesce(k, 0)) / ((SELECT count(*) FROM obs) - n), 9) AS pts_rest FROM a CROSS JOIN n LEFT JOIN k USING (o_orderpriority, gene_ix)")
def expressing_fractions(spark, d):
    return A.expressing_fractions(bind(spark, d), "o_orderpriority").select("o_orderpriority", "gene_ix", r("pts", 9).alias("pts"), r("pts_rest", 9).alias("pts_rest"))


@query("SELECT median(t) AS target_sum FROM (SELECT sum(value) AS t FROM x GROUP BY cell_ix HAVING sum(value) > 0)")
def median_library_size(spark, d):
    return A.median_library(bind(spark, d))


# ---- transforms


@query(", t AS (SELECT cell_ix, sum(value) AS t FROM x GROUP BY 1) SELECT cell_ix, gene_ix, round(value * (SELECT median(t) FROM t WHERE t > 0) / t, 6) AS value FROM x JOIN t USING (cell_ix)")
def normalize_median(spark, d):
    return T.normalize_total(bind(spark, d)).withColumn("value", r("value"))


@query(f", t AS (SELECT cell_ix, sum(value) AS t FROM x GROUP BY 1) SELECT cell_ix, gene_ix, round(value * 10000.0 / t, 6) AS value FROM x JOIN t USING (cell_ix) SEMI JOIN (SELECT * FROM genes WHERE gene_id IN {SELECTED}) USING (gene_ix)")
def normalize_full_depth(spark, d):
    data = bind(spark, d)
    chosen = data.query().select_genes(NAMES).x()
    return T.normalize_total(data, 1e4, chosen).withColumn("value", r("value"))


@query("SELECT cell_ix, gene_ix, round(value / o_totalprice * 1000, 6) AS value FROM x JOIN obs USING (cell_ix)")
def row_scale(spark, d):
    data = bind(spark, d)
    x = T.row_scale(data.matrix(), data.read_obs("o_totalprice"), "o_totalprice", divide=True)
    return T.elementwise(x, "multiply", 1000.0).withColumn("value", r("value"))


@query("SELECT cell_ix, gene_ix, round(sqrt(value), 6) AS root, round(value ** 1.5, 6) AS pow, round(ln(1 + value), 6) AS log FROM x")
def elementwise(spark, d):
    x = bind(spark, d).matrix()
    return x.select("cell_ix", "gene_ix", r(F.sqrt("value")).alias("root"), r(F.pow("value", F.lit(1.5))).alias("pow"), r(F.log1p("value")).alias("log"))


@query(", p AS (SELECT l_orderkey AS cell_ix, l_partkey AS gene_ix, sum(l_extendedprice) AS value FROM lineitem GROUP BY 1, 2) SELECT cell_ix, gene_ix, round(p.value - 1000 * x.value, 2) AS value FROM p JOIN x USING (cell_ix, gene_ix) WHERE p.value - 1000 * x.value <> 0")
def subtract_layers(spark, d):
    data = bind(spark, d)
    return T.add(data.matrix("price"), T.elementwise(data.matrix(), "multiply", 1000.0), -1).withColumn("value", r("value", 2))


@query(", w AS (SELECT gene_ix, k AS component, sin(gene_ix * (k + 1)) AS weight FROM genes, (VALUES (0), (1), (2)) v(k)) SELECT cell_ix, component, round(sum(value * weight), 6) AS value FROM x JOIN w USING (gene_ix) GROUP BY 1, 2")
def matrix_product(spark, d):
    data = bind(spark, d)
    w = data.var.select("gene_ix", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("component")).withColumn("weight", F.sin(F.col("gene_ix") * (F.col("component") + 1)))
    return T.matmul(data.matrix(), w).withColumn("value", r("value"))


_PFLOG = ", g AS (SELECT count(*) AS g FROM genes), b AS (SELECT cell_ix, -coalesce(sum(ln(1 + 4 * 0.05 * value)), 0.0) / any_value(g) AS baseline FROM obs LEFT JOIN x USING (cell_ix), g GROUP BY 1) "


@query(_PFLOG + "SELECT cell_ix, round(baseline, 9) AS baseline FROM b")
def pflog_baseline(spark, d):
    return T.pflog(bind(spark, d), 0.05)[1].withColumn("baseline", r("baseline", 9))


@query(_PFLOG + "SELECT cell_ix, gene_ix, round(coalesce(ln(1 + 4 * 0.05 * value), 0.0) + baseline, 9) AS value FROM (SELECT cell_ix FROM obs) CROSS JOIN (SELECT gene_ix FROM genes WHERE gene_id IN " + SELECTED + ") LEFT JOIN x USING (cell_ix, gene_ix) JOIN b USING (cell_ix)")
def pflog_dense(spark, d):
    data = bind(spark, d)
    return T.pflog_reconstruct(data, 0.05, data.read_obs(), data.query().select_genes(NAMES).selected_var()).withColumn("value", r("value", 9))


@query(", m AS (" + _MOMENTS.removeprefix(", n AS (SELECT count(*) AS n FROM obs), s AS (SELECT gene_ix, sum(value) AS s, sum(value * value) AS q FROM x GROUP BY 1) ").replace("round(", "(").replace(", 9)", ")").replace("FROM genes LEFT JOIN s USING (gene_ix), n", "FROM genes LEFT JOIN (SELECT gene_ix, sum(value) AS s, sum(value * value) AS q FROM x GROUP BY 1) USING (gene_ix), (SELECT count(*) AS n FROM obs)") + ") SELECT round(median((var - mean) / (mean * mean)), 6) AS alpha FROM m WHERE mean > 0")
def estimate_alpha(spark, d):
    return T.estimate_alpha(bind(spark, d)).select(r("alpha").alias("alpha"))
