"""Queries of the store, graphs in changes, spatial plans, collation, and further metrics."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from lattica.operators import aggregates as A
from lattica.operators import embedding as E
from lattica.operators import features as V
from lattica.operators import handle as H
from lattica.operators import metrics as M
from lattica.operators import order as O
from lattica.operators import tokens as K
from lattica.operators.doublets import normalise
from lattica.plans.dataset import bind
from lattica.plans.queries_stats import _DENSE, GROUP, REF, _bulks
from lattica.plans.registration import ORACLES, query, r
from lattica.sources.shared import shared_dir
from lattica.sources.store import Store, shard_statistics, shards_to_read


def _store(spark, data, **options) -> Store:
    store = Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}", **options)
    store.save(data)
    return store


# ---- store

_SKIP = "o_totalprice > 440000 and (o_orderstatus == 'P' or not o_orderpriority in ['1-URGENT', '2-HIGH'])"


@query("SELECT CAST(cell_ix // 250 AS BIGINT) AS shard_id, CAST(count(*) AS BIGINT) AS n_cells, max(o_totalprice) > 440000 AND (bool_or(o_orderstatus = 'P') OR bool_or(o_orderpriority NOT IN ('1-URGENT', '2-HIGH'))) AS may_match FROM obs GROUP BY 1")
def shard_skips(spark, d):
    obs = bind(spark, d).obs
    return shards_to_read(shard_statistics(obs, 250), obs.schema, _SKIP)


@query("SELECT cell_ix, gene_ix, value FROM x SEMI JOIN (SELECT * FROM obs WHERE o_totalprice > 440000 AND (o_orderstatus = 'P' OR NOT (o_orderpriority IN ('1-URGENT', '2-HIGH')))) USING (cell_ix)")
def store_read_matching(spark, d):
    return _store(spark, bind(spark, d), shard_cells=5000).read_matching(_SKIP)


@query("SELECT cell_ix, gene_ix, value FROM x WHERE gene_ix IN (3, 17, 45) AND cell_ix NOT IN (SELECT cell_ix FROM obs WHERE o_orderstatus = 'F')")
def store_read_genes(spark, d):
    data = bind(spark, d)
    store = _store(spark, data)
    store.build_gene_major()
    store.mark_deleted(data.obs.filter("o_orderstatus = 'F'").select("cell_ix"))
    return store.read_genes([17, 3, 45])


@query("SELECT vec_id AS cell_ix, label FROM embeddings WHERE vec_id >= 40 AND vec_id < 90", base=False)
def store_read_embedding(spark, d):
    return _store(spark, bind(spark, d)).read_obsm("X_emb", 40, 90).select("cell_ix", "label")


@query(", k AS (SELECT cell_ix FROM obs LEFT JOIN x USING (cell_ix) GROUP BY 1 HAVING count(x.cell_ix) >= 3), s AS (SELECT cell_ix, gene_ix, ln(1 + value * 10000.0 / sum(value) OVER (PARTITION BY cell_ix)) AS v FROM x SEMI JOIN k USING (cell_ix)) SELECT cell_ix, gene_ix, round(v, 6) AS value FROM s")
def store_preprocess(spark, d):
    target = Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    _store(spark, bind(spark, d)).preprocess(target, [("filter_cells", {"min_nnz": 3}), ("normalize_total", {"target": 1e4}), ("log1p", {})])
    return target.open().x.withColumn("value", r("value"))


@query(", l AS (SELECT cell_ix, row_number() OVER (ORDER BY o_orderstatus NULLS FIRST, cell_ix) - 1 AS new_ix FROM obs WHERE c_mktsegment <> 'BUILDING') SELECT CAST(new_ix AS BIGINT) AS cell_ix, gene_ix, value FROM x JOIN l USING (cell_ix)")
def store_optimize(spark, d):
    data = bind(spark, d)
    store = _store(spark, data)
    store.mark_deleted(data.obs.filter("c_mktsegment = 'BUILDING'").select("cell_ix"))
    store.optimize(["o_orderstatus"])
    return store.open().x


@query("SELECT CAST((SELECT count(*) FROM obs WHERE o_orderstatus = 'F') AS BIGINT) AS n_cells, CAST((SELECT count(*) FROM genes WHERE p_size < 10) AS BIGINT) AS n_genes, CAST(count(*) AS BIGINT) AS n_values FROM x SEMI JOIN (SELECT * FROM obs WHERE o_orderstatus = 'F') USING (cell_ix) SEMI JOIN (SELECT * FROM genes WHERE p_size < 10) USING (gene_ix)")
def subset_dry_run(spark, d):
    return O.dry_run(bind(spark, d), F.col("o_orderstatus") == "F", F.col("p_size") < 10)


# ---- changes with graphs, orders, row sets


def _with_graph(spark, d):
    data = bind(spark, d)
    ring = data.obs.select(F.col("cell_ix").alias("src"), (F.col("cell_ix") + 1).alias("dst"), F.lit(1.0).alias("weight"))
    ring = ring.join(data.obs.select(F.col("cell_ix").alias("dst")), "dst", "left_semi").select("src", "dst", "weight")
    return replace(data, obsp={"ring": ring}, varm={"PCs": data.var.select("gene_ix", F.col("p_size").alias("loading"))})


@query(", f AS (SELECT cell_ix FROM obs WHERE o_orderstatus <> 'P') SELECT a.cell_ix AS src, b.cell_ix AS dst FROM f a JOIN f b ON b.cell_ix = a.cell_ix + 1")
def subset_graph(spark, d):
    return O.subset(_with_graph(spark, d), F.col("o_orderstatus") != "P").obsp["ring"].select("src", "dst")


@query(", f AS (SELECT cell_ix, 0 AS o FROM obs WHERE o_orderstatus = 'F'), g AS (SELECT cell_ix, 1000000 AS o FROM obs WHERE o_orderstatus = 'O') SELECT a.cell_ix + a.o AS src, b.cell_ix + b.o AS dst FROM f a JOIN f b ON b.cell_ix = a.cell_ix + 1 UNION ALL SELECT a.cell_ix + a.o, b.cell_ix + b.o FROM g a JOIN g b ON b.cell_ix = a.cell_ix + 1")
def merge_graph(spark, d):
    data = _with_graph(spark, d)
    return O.merge([O.subset(data, F.col("o_orderstatus") == s) for s in ("F", "O")], [0, 1_000_000]).obsp["ring"].select("src", "dst")


@query(", p AS (SELECT cell_ix, o_totalprice, CASE o_orderstatus WHEN 'F' THEN 0 ELSE 1000000 END + cell_ix AS moved FROM obs WHERE o_orderstatus IN ('F', 'O')), n AS (SELECT cell_ix, row_number() OVER (ORDER BY o_totalprice NULLS FIRST, moved) - 1 AS new_ix FROM p) SELECT CAST(new_ix AS BIGINT) AS cell_ix, gene_ix, value FROM x JOIN n USING (cell_ix)")
def merge_sorted(spark, d):
    data = bind(spark, d)
    return O.merge([O.subset(data, F.col("o_orderstatus") == s) for s in ("F", "O")], [0, 1_000_000], sort_by=["o_totalprice"]).x.select("cell_ix", "gene_ix", "value")


@query("SELECT CAST(i AS INT) AS part, quantile_disc(o_totalprice, i / 8.0) AS cut FROM obs, (SELECT unnest(generate_series(1, 7)) AS i) GROUP BY i", base=True)
def range_cuts(spark, d):
    return O.cut_points(bind(spark, d).obs, "o_totalprice", 8)


ORACLES["range_cuts"] = ORACLES["range_cuts"].rsplit("SELECT CAST(i AS INT)", 1)[0] + " UNION ALL ".join(f"SELECT CAST({i} AS INT) AS part, quantile_disc(o_totalprice, {i / 8!r}) AS cut FROM obs" for i in range(1, 8))


@query("SELECT cell_ix FROM obs WHERE o_orderstatus = 'F' ORDER BY cell_ix LIMIT 100")
def rowset_take_first(spark, d):
    return O.take_first(bind(spark, d).obs.filter("o_orderstatus = 'F'"), 100)


@query("SELECT i AS cell_ix FROM (SELECT unnest(generate_series(0, 59999)) AS i) WHERE i NOT IN (SELECT cell_ix FROM obs)")
def rowset_universe_complement(spark, d):
    return O.complement(bind(spark, d).obs, 60_000)


@query(", rw AS (SELECT cell_ix, row_number() OVER (ORDER BY cell_ix) - 1 AS p FROM obs), cl AS (SELECT gene_ix, row_number() OVER (ORDER BY gene_ix) - 1 AS p, count(*) OVER () AS n FROM genes) SELECT CAST((rw.p - 10) // 3 AS BIGINT) AS row, CAST(v.o AS BIGINT) AS \"column\", value FROM x JOIN rw USING (cell_ix) JOIN cl USING (gene_ix) JOIN (VALUES (0, -1), (1, 0), (2, 5), (3, 16)) v(o, q) ON cl.p = CASE WHEN q < 0 THEN q + n ELSE q END WHERE rw.p >= 10 AND (rw.p - 10) % 3 = 0")
def handle_slices(spark, d):
    return H.Handle.of(bind(spark, d))[10::3, [-1, 0, 5, 16]]


@query("SELECT cell_ix, gene_ix, value FROM x SEMI JOIN (SELECT * FROM obs WHERE o_orderpriority = '5-LOW') USING (cell_ix)")
def read_reference(spark, d):
    return bind(spark, d).query().read_reference("o_orderpriority", "5-LOW")


# ---- tokens and plans


@query("SELECT cell_ix, gene_ix, value, CAST((value > 10)::INT + (value > 20)::INT + (value > 20)::INT + (value > 40)::INT AS BIGINT) AS bin FROM x WHERE value > 0")
def bin_values_edges(spark, d):
    return K.bin_values(bind(spark, d).matrix(), 5, [10.0, 20.0, 20.0, 40.0], "right")


_SETS = ", st AS (SELECT cell_ix % 7 AS set_id, cell_ix FROM obs), qu AS (SELECT s AS set_id, p AS pos, 1 + (s * 13 + p * 29) % 150 AS gene_ix FROM (SELECT unnest(generate_series(0, 6)) AS s), (SELECT unnest(generate_series(0, 11)) AS p))"


@query(_SETS + """
, lib AS (SELECT cell_ix, sum(value) AS l FROM x GROUP BY 1), hid AS (SELECT DISTINCT set_id, gene_ix FROM qu WHERE pos % 4 = 0),
en AS (SELECT set_id, cell_ix, gene_ix, value, row_number() OVER (PARTITION BY set_id, cell_ix ORDER BY value DESC, gene_ix) AS rn FROM st JOIN x USING (cell_ix) ANTI JOIN hid USING (set_id, gene_ix)),
ej AS (SELECT set_id, cell_ix, string_agg(gene_ix || ':' || CAST(round(ln(1 + value * 1e4 / l) * 1e6) AS BIGINT), ',' ORDER BY rn) AS enc FROM en JOIN lib USING (cell_ix) WHERE rn <= 3 GROUP BY 1, 2),
de AS (SELECT set_id, cell_ix, string_agg(CAST(coalesce(value, 0) AS BIGINT), ',' ORDER BY pos) AS target FROM st JOIN qu USING (set_id) LEFT JOIN x USING (cell_ix, gene_ix) GROUP BY 1, 2)
SELECT set_id, cell_ix, coalesce(l, 0.0) AS library_size, coalesce(enc, '') AS enc, CAST(3 - (CASE WHEN enc IS NULL THEN 0 ELSE 1 + length(enc) - length(replace(enc, ',', '')) END) AS INT) AS n_pad, target FROM st LEFT JOIN lib USING (cell_ix) LEFT JOIN ej USING (set_id, cell_ix) JOIN de USING (set_id, cell_ix)""")
def collate_query_sets(spark, d):
    data = bind(spark, d)
    sets = data.obs.select((F.col("cell_ix") % 7).alias("set_id"), "cell_ix")
    grid = spark.range(7).select(F.col("id").alias("set_id")).crossJoin(spark.range(12).select(F.col("id").alias("pos")))  # 84 rows
    queries = grid.withColumn("gene_ix", 1 + (F.col("set_id") * 13 + F.col("pos") * 29) % 150)
    out = K.collate_queries(data.matrix(), sets, queries, 3, "normalize_log1p", hidden=queries.filter("pos % 4 = 0"))
    shown = F.filter(F.zip_with("enc_ids", "enc_values", lambda g, v: F.when(g >= 0, F.concat(g.cast("string"), F.lit(":"), F.round(v * 1e6).cast("long").cast("string")))), lambda t: t.isNotNull())
    return out.select("set_id", "cell_ix", "library_size", F.array_join(shown, ",").alias("enc"), F.size(F.filter("enc_padded", lambda p: p)).alias("n_pad"), F.array_join(F.transform("target", lambda v: v.cast("long").cast("string")), ",").alias("target"))


_XY = "(SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings)"


@query(f"SELECT src, CAST(rank AS BIGINT) AS rank, dst, round(distance, 6) AS distance FROM (SELECT a.vec_id AS src, b.vec_id AS dst, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS distance, row_number() OVER (PARTITION BY a.vec_id ORDER BY sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), b.vec_id) AS rank FROM {_XY} a JOIN {_XY} b ON a.vec_id <> b.vec_id) WHERE rank <= 6", base=False)
def spatial_neighbours(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("cell_ix"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return K.spatial_neighbours(e, ["x", "y"], 6).withColumn("distance", r("distance"))


# ---- aggregates and metrics


@query(", n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM obs), m AS (SELECT gene_ix, sum(value) / any_value(n) AS mean, sum(value * value) AS q, count(*) AS k, any_value(n) AS n FROM x, n GROUP BY 1), v AS (SELECT gene_ix, any_value(mean) AS mean, (sum((value - mean) * (value - mean)) + (any_value(n) - any_value(k)) * any_value(mean) * any_value(mean)) / any_value(n) AS var, any_value(q) / any_value(n) - any_value(mean) * any_value(mean) AS closed FROM x JOIN m USING (gene_ix) GROUP BY 1) SELECT gene_ix, round(coalesce(mean, 0.0), 9) AS mean, round(coalesce(var, 0.0), 9) AS var, round(coalesce(closed, 0.0), 9) AS closed, false AS cancelled FROM genes LEFT JOIN v USING (gene_ix)")
def stable_moments(spark, d):
    out = A.stable_moments(bind(spark, d))
    return out.withColumns({c: r(c, 9) for c in ("mean", "var", "closed")})


_E = "e AS (SELECT label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), dd AS (SELECT a.label AS a, b.label AS b, avg(list_distance(a.v, b.v)) AS m FROM e a, e b GROUP BY 1, 2)"


@query(f"WITH {_E} SELECT o.a AS label, round(o.m, 6) AS across, round(s.m, 6) AS within, round(z.m, 6) AS within_control, round(2 * o.m - s.m - z.m, 6) AS energy_distance FROM dd o JOIN dd s ON s.a = o.a AND s.b = o.a JOIN dd z ON z.a = 1 AND z.b = 1 WHERE o.b = 1 AND o.a <> 1", base=False)
def energy_distance_details(spark, d):
    e = bind(spark, d).obsm["X_emb"].select("label", "vec")
    out = M.energy_distance_details(e, "label", 1)
    return out.select("label", *[r(c).alias(c) for c in out.columns if c != "label"])


@query("WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), z AS (SELECT a.vec_id AS a, b.vec_id AS b, list_filter(list_zip(a.v, b.v), lambda p: p[1] + p[2] > 0) AS z FROM e a JOIN e b ON b.vec_id = a.vec_id + 1) SELECT a, b, round(sqrt(list_sum(list_transform(z, lambda p: (p[1] - p[2]) * (p[1] - p[2])))), 6) AS euclidean, round(list_sum(list_transform(z, lambda p: abs(p[1] - p[2]))), 6) AS l1 FROM z", base=False)
def masked_distances(spark, d):
    e = bind(spark, d).obsm["X_emb"]
    j = e.select(F.col("cell_ix").alias("a"), F.col("vec").alias("x")).join(e.select(F.col("cell_ix").alias("b"), F.col("vec").alias("y")), F.col("b") == F.col("a") + 1)
    j = j.withColumn("mask", F.zip_with("x", "y", lambda p, q: p + q > 0))
    return j.select("a", "b", *[r(M.masked_distance(F.col("x"), F.col("y"), F.col("mask"), m)).alias(m) for m in ("euclidean", "l1")])


ORACLES["adjusted_mutual_information"] = ORACLES["clustering_agreement"].rsplit("SELECT round(mi, 9)", 1)[0] + """, ex AS (
  SELECT sum(k / nn * ln(nn * k / (na * nb)) * exp(lgamma(na + 1) + lgamma(nb + 1) + lgamma(nn - na + 1) + lgamma(nn - nb + 1) - lgamma(nn + 1) - lgamma(k + 1) - lgamma(na - k + 1) - lgamma(nb - k + 1) - lgamma(nn - na - nb + k + 1))) AS expected
  FROM (SELECT na, nb, nn, CAST(unnest(generate_series(CAST(greatest(1, na + nb - nn) AS BIGINT), CAST(least(na, nb) AS BIGINT))) AS DOUBLE) AS k FROM ra, cb, nn))
SELECT round((mi - expected) / ((ha.h + hb.h) / 2 - expected), 8) AS ami FROM mi, ha, hb, ex"""


@query("SELECT doc_id AS barcode, CAST(quality AS DOUBLE) AS k_score, toxic = 1 AS k_predicted FROM labels", base=False)
def doublet_import(spark, d):
    t = spark.read.parquet(f"{d}/labels.parquet").select(F.col("doc_id").alias("barcode"), F.col("quality").alias("scDblFinder.score"), F.when(F.col("toxic") == 1, "Doublet").otherwise("singlet").alias("scDblFinder.class"))
    return normalise(t, "scdblfinder", "k", "barcode")


@query(_DENSE + ", tg AS (SELECT * FROM (VALUES ('1-URGENT', 17), ('2-HIGH', 3), ('3-MEDIUM', 45)) v(o_orderpriority, gene_ix)), ds AS (SELECT p.o_orderpriority, r.o_orderpriority AS other, round(1 - sum(p.e * r.e) / sqrt(sum(p.e * p.e) * sum(r.e * r.e)), 9) AS dist FROM (SELECT * FROM pe ANTI JOIN tg USING (o_orderpriority, gene_ix)) p JOIN re r USING (gene_ix) GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY dist, other) - 1 AS place, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM ds) SELECT o_orderpriority, CAST(place AS BIGINT) AS rank, 1 - place / n AS score FROM k WHERE o_orderpriority = other")
def discrimination_cosine(spark, d):
    own = spark.createDataFrame([("1-URGENT", 17), ("2-HIGH", 3), ("3-MEDIUM", 45)], f"{GROUP} string, gene_ix long")
    return M.discrimination(*_bulks(spark, d), GROUP, REF, "cosine", own)


# ---- without SQL: tested against plain versions


@query()
def highly_variable_paper(spark, d):
    return V.variance_stabilised(bind(spark, d), n_top=200, batch="c_mktsegment", flavor="seurat_v3_paper")


@query()
def approximate_neighbours(spark, d):
    return E.approximate_neighbours(bind(spark, d).obsm["X_emb"].select("cell_ix", "vec"), 10)


@query()
def randomized_pca_scores(spark, d):
    data = bind(spark, d)
    return E.pca(data, 5, data.var, data.query().with_normalize(1e4).with_log1p().x(), method="randomized", rounds=4)[0]


@query()
def pca_neighbour_graph(spark, d):
    data = bind(spark, d)
    return E.pca_neighbours(data, 5, 10, data.var.filter("p_size < 5"), approximate_above=0)["connectivities"]
