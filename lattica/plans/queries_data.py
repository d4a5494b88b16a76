"""Queries of joins, orders, set operations, dataset changes and token sequences."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from lattica.operators import attach as J
from lattica.operators import order as O
from lattica.operators import tokens as K
from lattica.plans.dataset import bind
from lattica.plans.registration import ORACLES, query, r


def _table(spark, d, t):
    return spark.read.parquet(f"{d}/{t}.parquet")


# ---- joins


@query("SELECT doc_id, lang, quality AS label_quality, toxic AS label_toxic, CASE WHEN l.doc_id IS NULL THEN 'absent' ELSE 'present' END AS label_status FROM documents LEFT JOIN labels l USING (doc_id)", base=False)
def attach_annotations(spark, d):
    docs = _table(spark, d, "documents").select("doc_id", "lang")
    return J.attach(docs, _table(spark, d, "labels"), ["doc_id"], {"quality": "label_quality", "toxic": "label_toxic"}, status="label_status")


@query("SELECT doc_id, coalesce(quality, 0) AS label_quality FROM documents LEFT JOIN labels USING (doc_id)", base=False)
def attach_missing_zero(spark, d):
    return J.attach(_table(spark, d, "documents").select("doc_id"), _table(spark, d, "labels"), ["doc_id"], {"quality": "label_quality"}, missing="zero")


@query("SELECT l_orderkey, l_linenumber, q FROM (SELECT l_orderkey, l_linenumber FROM lineitem) LEFT JOIN (SELECT l_orderkey, l_linenumber, l_quantity AS q FROM lineitem WHERE l_returnflag = 'R') USING (l_orderkey, l_linenumber)", base=False)
def attach_composite_key(spark, d):
    lines = _table(spark, d, "lineitem")
    target = lines.select("l_orderkey", "l_linenumber")
    return J.attach(target, lines.filter("l_returnflag = 'R'"), ["l_orderkey", "l_linenumber"], {"l_quantity": "q"}, check=False)


@query("SELECT CAST(count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) AS BIGINT) AS matched, CAST(count(*) FILTER (WHERE b IS NULL) AS BIGINT) AS target_only, CAST(count(*) FILTER (WHERE a IS NULL) AS BIGINT) AS source_only FROM (SELECT DISTINCT doc_id AS a FROM documents) FULL JOIN (SELECT DISTINCT doc_id AS b FROM labels) ON a = b", base=False)
def attach_coverage(spark, d):
    return J.coverage(_table(spark, d, "documents"), _table(spark, d, "labels"), ["doc_id"])


@query("SELECT 'c_custkey' AS column, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(*) - count(c_custkey) AS BIGINT) AS n_null, CAST(count(DISTINCT c_custkey) AS BIGINT) AS n_distinct, count(DISTINCT c_custkey) = count(*) AS is_unique FROM customer UNION ALL SELECT 'c_name', count(*), count(*) - count(c_name), count(DISTINCT c_name), count(DISTINCT c_name) = count(*) FROM customer UNION ALL SELECT 'c_mktsegment', count(*), count(*) - count(c_mktsegment), count(DISTINCT c_mktsegment), count(DISTINCT c_mktsegment) = count(*) FROM customer", base=False)
def key_candidates(spark, d):
    return J.key_candidates(_table(spark, d, "customer"), ["c_custkey", "c_name", "c_mktsegment"])


@query("SELECT gene_ix, gene_id, s AS total_price FROM genes LEFT JOIN (SELECT 'g' || l_partkey AS gene_id, round(sum(l_extendedprice), 2) AS s FROM lineitem GROUP BY 1) USING (gene_id)")
def attach_var_columns(spark, d):
    source = _table(spark, d, "lineitem").groupBy(F.concat(F.lit("g"), F.col("l_partkey").cast("string")).alias("gene_id")).agg(r(F.sum("l_extendedprice"), 2).alias("s"))
    return J.attach(bind(spark, d).var.select("gene_ix", "gene_id"), source, ["gene_id"], {"s": "total_price"})


@query("SELECT cell_ix, p AS payload FROM (SELECT cell_ix, row_number() OVER (ORDER BY cell_ix) - 1 AS pos FROM obs) LEFT JOIN (SELECT c_custkey - 1 AS pos, c_acctbal AS p FROM customer) USING (pos)")
def attach_by_position(spark, d):
    source = _table(spark, d, "customer").select((F.col("c_custkey") - 1).alias("position"), F.col("c_acctbal").alias("payload"))
    return J.attach_positional(bind(spark, d).read_obs("o_orderstatus"), source, ["payload"]).select("cell_ix", "payload")


@query(", n AS (SELECT 'o' || cell_ix AS barcode, 'g' || gene_ix AS gene, value FROM (SELECT l_orderkey AS cell_ix, l_partkey AS gene_ix, round(sum(l_extendedprice), 2) AS value FROM lineitem GROUP BY 1, 2)) SELECT cell_ix, gene_ix, value FROM n JOIN obs ON barcode = 'o' || cell_ix JOIN genes ON gene = gene_id WHERE o_orderstatus = 'F'")
def import_layer(spark, d):
    data = bind(spark, d)
    named = data.matrix("price").withColumn("value", r("value", 2)).select(F.concat(F.lit("o"), F.col("cell_ix").cast("string")).alias("barcode"), F.concat(F.lit("g"), F.col("gene_ix").cast("string")).alias("gene"), "value")
    obs = data.obs.filter("o_orderstatus = 'F'").withColumn("barcode_", F.concat(F.lit("o"), F.col("cell_ix").cast("string")))
    return J.import_layer(named, obs, data.var, "barcode_", "gene_id")


# ---- order


@query(", k AS (SELECT cell_ix, quality, o_totalprice FROM obs LEFT JOIN labels ON cell_ix = doc_id) SELECT cell_ix, CAST(row_number() OVER (ORDER BY quality DESC NULLS FIRST, o_totalprice DESC NULLS FIRST, cell_ix) - 1 AS BIGINT) AS new_ix, quality, o_totalprice FROM k")
def sort_cells_reverse(spark, d):
    data = bind(spark, d)
    labels = _table(spark, d, "labels").select(F.col("doc_id").alias("cell_ix"), "quality")
    return O.sort_cells(replace(data, obs=data.obs.join(labels, "cell_ix", "left")), ["quality", "o_totalprice"], reverse=True)


@query("""
, s AS (SELECT n_name, count(*) AS n, n_name <> 'NATION_3' AS other FROM obs GROUP BY 1)
SELECT n_name, CAST(n AS BIGINT) AS n_cells FROM s""")
def group_block_sizes(spark, d):
    return O.group_shards(bind(spark, d), "n_name", "NATION_3", 1500).select("n_name", "n_cells")


@query("""
, s AS (SELECT n_name, n, n_name <> 'NATION_3' AS other, row_number() OVER (ORDER BY n_name <> 'NATION_3', n_name) AS i FROM (SELECT n_name, count(*) AS n FROM obs GROUP BY 1)),
t AS (SELECT i, n_name, n, other, CAST(0 AS BIGINT) AS shard, n AS used FROM s WHERE i = 1
  UNION ALL SELECT s.i, s.n_name, s.n, s.other, CASE WHEN s.other <> t.other OR t.used + s.n > 1500 THEN t.shard + 1 ELSE t.shard END, CASE WHEN s.other <> t.other OR t.used + s.n > 1500 THEN s.n ELSE t.used + s.n END FROM t JOIN s ON s.i = t.i + 1)
SELECT n_name, CAST(n AS BIGINT) AS n_cells, shard FROM t""")
def group_shard_plan(spark, d):
    return O.group_shards(bind(spark, d), "n_name", "NATION_3", 1500)


@query()
def shuffle_cells(spark, d):
    return O.shuffle_cells(bind(spark, d), 42)


@query("SELECT cell_ix, gene_ix AS id, value, CAST(rn AS BIGINT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY cell_ix ORDER BY value DESC, gene_ix) AS rn FROM x) WHERE rn <= 3")
def top_k_crop(spark, d):
    top = O.top_k(bind(spark, d).matrix(), 3)
    z = F.posexplode(F.arrays_zip("ids", "values")).alias("p", "e")
    return top.select("cell_ix", z).select("cell_ix", F.col("e")["ids"].alias("id"), F.col("e")["values"].alias("value"), (F.col("p") + 1).cast("long").alias("place"))


@query("SELECT cell_ix, CAST(greatest(0, 4 - count(*)) AS BIGINT) AS n_pad FROM x GROUP BY 1")
def top_k_padding(spark, d):
    top = O.top_k(bind(spark, d).matrix(), 4, pad=-1)
    return top.select("cell_ix", F.size(F.filter("ids", lambda g: g == -1)).cast("long").alias("n_pad"))


# ---- row sets


def _sets(spark, d):
    obs = bind(spark, d).obs
    return obs.filter("o_orderstatus = 'F'").select("cell_ix"), obs.filter("o_totalprice > 200000").select("cell_ix")


_A, _B = "SELECT cell_ix FROM obs WHERE o_orderstatus = 'F'", "SELECT cell_ix FROM obs WHERE o_totalprice > 200000"


@query(f"{_A} UNION {_B}")
def rowset_union(spark, d):
    return O.set_operation(*_sets(spark, d), "union")


@query(f"{_A} INTERSECT {_B}")
def rowset_intersect(spark, d):
    return O.set_operation(*_sets(spark, d), "intersect")


@query(f"{_A} EXCEPT {_B}")
def rowset_difference(spark, d):
    return O.set_operation(*_sets(spark, d), "difference")


@query(f"SELECT cell_ix FROM obs EXCEPT {_A}")
def rowset_complement(spark, d):
    return O.set_operation(bind(spark, d).obs, _sets(spark, d)[0], "difference")


@query(f"SELECT min(cell_ix) AS start, max(cell_ix) + 1 AS stop FROM (SELECT cell_ix, cell_ix - row_number() OVER (ORDER BY cell_ix) AS run FROM ({_A})) GROUP BY run")
def rowset_ranges(spark, d):
    return O.ranges_of(_sets(spark, d)[0])


# ---- changes


@query("SELECT cell_ix, gene_ix, value FROM x SEMI JOIN (SELECT * FROM obs WHERE NOT (o_orderstatus = 'F')) USING (cell_ix)")
def delete_then_read(spark, d):
    return O.delete_cells(bind(spark, d), F.col("o_orderstatus") == "F").query().x()


@query(", live AS (SELECT cell_ix, row_number() OVER (ORDER BY cell_ix) - 1 AS new_ix FROM obs WHERE o_orderstatus <> 'F') SELECT CAST(new_ix AS BIGINT) AS cell_ix, gene_ix, value FROM x JOIN live USING (cell_ix)")
def compact_dataset(spark, d):
    return O.compact(O.delete_cells(bind(spark, d), F.col("o_orderstatus") == "F")).x.select("cell_ix", "gene_ix", "value")


@query("SELECT cell_ix, gene_ix, value FROM x WHERE cell_ix IN (SELECT cell_ix FROM obs WHERE c_mktsegment = 'BUILDING') AND gene_ix IN (SELECT gene_ix FROM genes WHERE p_size < 10)")
def subset_dataset(spark, d):
    return O.subset(bind(spark, d), F.col("c_mktsegment") == "BUILDING", F.col("p_size") < 10).x


@query(", f AS (SELECT * FROM obs WHERE o_orderstatus = 'F'), p AS (SELECT * FROM obs WHERE o_orderstatus = 'P'), t AS (SELECT max(cell_ix) + 1 AS o FROM f) SELECT cell_ix, gene_ix, value FROM x SEMI JOIN f USING (cell_ix) UNION ALL SELECT cell_ix + o, gene_ix, value FROM x SEMI JOIN p USING (cell_ix), t")
def append_dataset(spark, d):
    data = bind(spark, d)
    return O.append(O.subset(data, F.col("o_orderstatus") == "F"), O.subset(data, F.col("o_orderstatus") == "P")).x


@query("SELECT cell_ix + o AS cell_ix, o_orderstatus FROM obs JOIN (VALUES ('F', 0), ('P', 1000000), ('O', 2000000)) v(s, o) ON o_orderstatus = s")
def merge_datasets(spark, d):
    data = bind(spark, d)
    parts = [O.subset(data, F.col("o_orderstatus") == s) for s in ("F", "P", "O")]
    return O.merge(parts, [0, 1_000_000, 2_000_000]).obs.select("cell_ix", "o_orderstatus")


@query("SELECT CAST(0 AS BIGINT) AS stored_zeros, CAST(0 AS BIGINT) AS repeated_coordinates, CAST(count(*) FILTER (WHERE cell_ix NOT IN (SELECT cell_ix FROM obs)) AS BIGINT) AS unknown_cells, CAST(count(*) FILTER (WHERE gene_ix NOT IN (SELECT gene_ix FROM genes)) AS BIGINT) AS unknown_genes, CAST(0 AS BIGINT) AS repeated_cells, CAST(0 AS BIGINT) AS repeated_genes FROM x")
def validate_dataset(spark, d):
    from lattica.sources.store import validate

    return validate(bind(spark, d))


@query("SELECT user_id AS cell_ix, event_type, round(sum(value), 6) AS value, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 2", base=False)
def second_matrix(spark, d):
    return _table(spark, d, "events").groupBy(F.col("user_id").alias("cell_ix"), "event_type").agg(r(F.sum("value")).alias("value"), F.count("*").alias("n"))


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, round(sum(value), 6) AS total, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 2", base=False)
def windowed_totals(spark, d):
    from lattica.streaming.append import windowed_totals as totals

    return totals(_table(spark, d, "events"), "ts", "value", ["event_type"]).withColumn("total", r("total"))


# ---- tokens and plans


@query(", g AS (SELECT gene_ix, median(value) AS stat FROM x GROUP BY 1), l AS (SELECT cell_ix, sum(value) AS lib FROM x GROUP BY 1), s AS (SELECT cell_ix, gene_ix, CAST(value * 10000.0 / lib / stat AS FLOAT) AS s FROM x JOIN g USING (gene_ix) JOIN l USING (cell_ix)) SELECT cell_ix, string_agg(gene_ix, ',' ORDER BY rn) AS tokens FROM (SELECT *, row_number() OVER (PARTITION BY cell_ix ORDER BY s DESC, gene_ix) AS rn FROM s WHERE s > 0) WHERE rn <= 4 GROUP BY 1")
def rank_tokens(spark, d):
    x = bind(spark, d).matrix()
    stats = x.groupBy("gene_ix").agg(F.median("value").alias("stat"))
    return K.rank_tokens(x, stats, 1e4, 4).select("cell_ix", F.array_join("tokens", ",").alias("tokens"))


@query(", e AS (SELECT cell_ix, quantile_cont(value, [0.0, 0.25, 0.5, 0.75, 1.0]) AS e FROM x GROUP BY 1) SELECT cell_ix, gene_ix, value, CAST(len(list_filter(e, lambda v: v <= value)) AS BIGINT) AS bin FROM x JOIN e USING (cell_ix)")
def bin_values(spark, d):
    return K.bin_values(bind(spark, d).matrix(), 6)


@query(", plan AS (SELECT cell_ix AS ord, cell_ix AS cell, cell_ix + 1 AS control FROM obs) SELECT ord, cell, control, gene_ix, sum(x) AS x, sum(y) AS x_paired FROM (SELECT ord, cell, control, gene_ix, value AS x, 0.0 AS y FROM plan JOIN x ON cell = cell_ix UNION ALL SELECT ord, cell, control, gene_ix, 0.0, value FROM plan JOIN x ON control = cell_ix) GROUP BY 1, 2, 3, 4")
def index_plan(spark, d):
    data = bind(spark, d)
    plan = data.obs.select(F.col("cell_ix").alias("ord"), F.col("cell_ix").alias("cell"), (F.col("cell_ix") + 1).alias("control"))
    return K.index_plan(data.matrix(), plan)


def _edges(spark, d):
    x = bind(spark, d).matrix()
    return x.select(F.col("cell_ix").alias("src"), F.col("gene_ix").alias("dst"), F.col("value").alias("weight"))


@query("SELECT centre, string_agg(dst, ',' ORDER BY rn) AS cells FROM (SELECT cell_ix AS centre, gene_ix AS dst, row_number() OVER (PARTITION BY cell_ix ORDER BY value DESC, gene_ix) AS rn FROM x) WHERE rn <= 2 GROUP BY 1")
def graph_neighbourhoods(spark, d):
    got = K.graph_neighbourhoods(_edges(spark, d), 2)
    return got.select("centre", F.array_join(F.slice("cells", 2, 10), ",").alias("cells"))


@query("SELECT a.vec_id AS src, b.vec_id AS dst, round(sqrt((CAST(a.embedding[1] AS DOUBLE) - b.embedding[1]) ** 2 + (CAST(a.embedding[2] AS DOUBLE) - b.embedding[2]) ** 2), 6) AS distance FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND sqrt((CAST(a.embedding[1] AS DOUBLE) - b.embedding[1]) ** 2 + (CAST(a.embedding[2] AS DOUBLE) - b.embedding[2]) ** 2) <= 0.02", base=False)
def radius_pairs(spark, d):
    e = _table(spark, d, "embeddings").select(F.col("vec_id").alias("cell_ix"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return K.radius_pairs(e, ["x", "y"], 0.02).withColumn("distance", r("distance"))


@query("SELECT conv_id, turn, CAST((row_number() OVER (ORDER BY conv_id, turn) - 1) // 16 AS BIGINT) AS batch FROM conversations", base=False)
def batch_plans(spark, d):
    return K.batch_plans(_table(spark, d, "conversations").select("conv_id", "turn"), 16, ["conv_id", "turn"]).select("conv_id", "turn", "batch")


@query("SELECT cell_ix, gene_ix, round(sum(ln(1 + value)) OVER (PARTITION BY cell_ix ORDER BY gene_ix) / sum(ln(1 + value)) OVER (PARTITION BY cell_ix), 6) AS cdf FROM x")
def inverse_cdf(spark, d):
    w = bind(spark, d).matrix().withColumn("w", F.log1p("value"))
    return K.inverse_cdf(w, "cell_ix", "gene_ix", "w").withColumn("cdf", r("cdf"))


@query()
def sample_genes(spark, d):
    return K.sample_genes(bind(spark, d).matrix(), 8, 1)


@query()
def downsample_counts(spark, d):
    return K.downsample(bind(spark, d).matrix(), 50, 1)


@query(", t AS (SELECT cell_ix, gene_ix, value, row_number() OVER (PARTITION BY cell_ix ORDER BY value DESC, gene_ix) AS rn FROM x) SELECT cell_ix % 100 AS set_id, cell_ix, string_agg(gene_ix, ',' ORDER BY rn) || repeat(',-1', CAST(4 - count(*) AS INT)) AS ids, string_agg(CAST(round(ln(1 + value) * 1e6) AS BIGINT), ',' ORDER BY rn) || repeat(',0', CAST(4 - count(*) AS INT)) AS micros, CAST(4 - count(*) AS INT) AS n_padded FROM t SEMI JOIN obs USING (cell_ix) WHERE rn <= 4 GROUP BY cell_ix")
def collate_cell_sets(spark, d):
    data = bind(spark, d)
    sets = data.obs.select((F.col("cell_ix") % 100).alias("set_id"), "cell_ix")
    out = K.collate_sets(data.matrix(), sets, 4, -1)
    micros = F.transform("values", lambda v: F.round(v * 1e6).cast("long").cast("string"))
    return out.select("set_id", "cell_ix", F.array_join(F.transform("ids", lambda g: g.cast("string")), ",").alias("ids"), F.array_join(micros, ",").alias("micros"), F.size(F.filter("padded", lambda p: p)).alias("n_padded"))


ORACLES["group_shard_plan"] = ORACLES["group_shard_plan"].replace("WITH obs", "WITH RECURSIVE obs", 1)
