"""Row-local sequences for model training: rank tokens, value bins, samples, cell sets, plans and batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.plans.dataset import Dataset
from lattica.sources.shared import ship


def rank_tokens(x: DataFrame, gene_stats: DataFrame, target: float, l_max: int) -> DataFrame:
    """Per cell the genes by normalised value over the gene's statistic (positive only), best first, ties to the smaller gene.

    gene_stats: gene_ix, stat. The library size is over all of a cell's positive values.
    """
    x = x.withColumn("value", F.greatest("value", F.lit(0.0)))
    lib = x.groupBy("cell_ix").agg(F.sum("value").alias("lib"))
    s = x.join(lib, "cell_ix").join(gene_stats, "gene_ix").select("cell_ix", "gene_ix", F.try_divide(F.col("value") * F.lit(float(target)) / F.nullif("lib", F.lit(0.0)), F.col("stat")).cast("float").alias("s")).filter("s > 0")
    e = F.struct((-F.col("s")).alias("k"), F.col("gene_ix").alias("g"))
    return s.groupBy("cell_ix").agg(F.transform(F.slice(F.array_sort(F.collect_list(e)), 1, l_max), lambda r: r["g"]).alias("tokens"))


def bin_values(x: DataFrame, n_bins: int, edges: list[float] | None = None, tie: str = "left", seed: int = 0) -> DataFrame:
    """Per cell bins of positive values: by the cell's own n_bins - 1 evenly spaced quantiles (linear), or by given edges
    (not falling, the same for all cells).

    tie says where a value on an edge goes: left counts the edges <= value (the upper bound), right those < value (the
    lower bound), seeded draws between the two, by the seed, the cell and the gene.
    """
    x = x.filter("value > 0")
    if edges is None:
        probs = [float(p) for p in np.linspace(0, 1, n_bins - 1)]
        own = x.groupBy("cell_ix").agg(F.percentile("value", F.array(*map(F.lit, probs))).alias("edges"))
        x = x.join(own, "cell_ix")
    else:
        if list(edges) != sorted(edges):
            raise ValueError("edges must not fall")
        x = x.withColumn("edges", F.array(*[F.lit(float(e)) for e in edges]))
    upper, lower = F.size(F.filter("edges", lambda e: e <= F.col("value"))), F.size(F.filter("edges", lambda e: e < F.col("value")))
    if tie == "seeded":
        u = F.pmod(F.xxhash64("cell_ix", "gene_ix", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
        place = F.ceil(u * (upper - lower) + lower)
    else:
        place = {"left": upper, "right": lower}[tie]
    return x.select("cell_ix", "gene_ix", "value", place.cast("long").alias("bin"))


def _rng(seed: int, key: int) -> np.random.Generator:
    return np.random.Generator(np.random.PCG64([seed & 0xFFFFFFFF, key & 0xFFFFFFFF, key >> 32 & 0xFFFFFFFF]))


def sample_genes(x: DataFrame, n: int, seed: int, weight: str = "log1p") -> DataFrame:
    """Per cell n genes with replacement, by log1p or raw weight (inverse of the cumulative weights), seeded by the cell."""
    ship(x.sparkSession)
    w = F.log1p("value") if weight == "log1p" else F.col("value")
    rows = x.filter("value > 0").groupBy("cell_ix").agg(F.array_sort(F.collect_list(F.struct(F.col("gene_ix").cast("long").alias("g"), w.alias("w")))).alias("e"))
    rows = rows.select("cell_ix", F.col("e")["g"].alias("genes"), F.col("e")["w"].alias("weights"))

    def draw(batches):
        for t in batches:
            out = []
            for c, g, v in zip(t["cell_ix"], t["genes"], t["weights"]):
                cum = np.cumsum(v)
                at = np.searchsorted(cum, _rng(seed, int(c)).random(n) * cum[-1], side="right")
                out.append(np.asarray(g)[np.minimum(at, len(g) - 1)].tolist())
            yield pd.DataFrame({"cell_ix": t["cell_ix"], "genes": out})

    return rows.mapInPandas(draw, "cell_ix long, genes array<bigint>")


def downsample(x: DataFrame, target: float, seed: int, mode: str = "binomial") -> DataFrame:
    """Counts thinned to a library of `target` per cell, seeded by the cell; smaller libraries stay. binomial draws each
    count for itself, so the library is `target` on average; multinomial (without replacement) hits it exactly."""
    if mode not in ("binomial", "multinomial"):
        raise ValueError(f"no mode {mode!r}")
    ship(x.sparkSession)
    rows = x.groupBy("cell_ix").agg(F.array_sort(F.collect_list(F.struct(F.col("gene_ix").cast("long").alias("g"), F.col("value").cast("double").alias("v")))).alias("e"))
    rows = rows.select("cell_ix", F.col("e")["g"].alias("genes"), F.col("e")["v"].alias("values"))

    def draw(batches):
        for t in batches:
            cells, genes, values = [], [], []
            for c, g, v in zip(t["cell_ix"], t["genes"], t["values"]):
                counts = np.rint(np.maximum(0, np.asarray(v))).astype(np.int64)
                total = counts.sum()
                if total > target:
                    r = _rng(seed, int(c))
                    counts = r.binomial(counts, target / total) if mode == "binomial" else r.multivariate_hypergeometric(counts, int(target), method="marginals")
                keep = np.flatnonzero(counts)
                cells += [c] * len(keep)
                genes += np.asarray(g)[keep].tolist()
                values += counts[keep].astype(float).tolist()
            yield pd.DataFrame({"cell_ix": cells, "gene_ix": genes, "value": values})

    return rows.mapInPandas(draw, "cell_ix long, gene_ix long, value double")


def index_plan(x: DataFrame, plan: DataFrame) -> DataFrame:
    """For each (ord, cell, control) of a plan, both cells' values per gene; absent ones are zero."""
    a = plan.join(x, F.col("cell") == F.col("cell_ix")).select("ord", "cell", "control", "gene_ix", F.col("value").alias("x"), F.lit(0.0).alias("x_paired"))
    b = plan.join(x, F.col("control") == F.col("cell_ix")).select("ord", "cell", "control", "gene_ix", F.lit(0.0).alias("x"), F.col("value").alias("x_paired"))
    return a.unionByName(b).groupBy("ord", "cell", "control", "gene_ix").agg(F.sum("x").alias("x"), F.sum("x_paired").alias("x_paired"))


def graph_neighbourhoods(edges: DataFrame, k: int) -> DataFrame:
    """Each centre's k heaviest edges (ties to the smaller neighbour) as an array, centre first."""
    e = F.struct((-F.col("weight")).alias("w"), F.col("dst").alias("d"))
    got = edges.groupBy("src").agg(F.transform(F.slice(F.array_sort(F.collect_list(e)), 1, k), lambda r: r["d"]).alias("near"))
    return got.select(F.col("src").alias("centre"), F.concat(F.array("src"), "near").alias("cells"))


def radius_pairs(points: DataFrame, axes: list[str], radius: float, key: str = "cell_ix", sources: DataFrame | None = None) -> DataFrame:
    """All ordered pairs within a radius in 1 to 3 dimensions: a grid of cells of that size, neighbour cells, exact test.
    sources: the points whose pairs are asked for (all by default)."""
    cell = [F.floor(F.col(a) / radius).cast("long").alias(f"_g{i}") for i, a in enumerate(axes)]
    here = (points if sources is None else sources).select(F.col(key).alias("src"), *[F.col(a).alias(f"_a{i}") for i, a in enumerate(axes)], *cell)
    there = points.select(F.col(key).alias("dst"), *[F.col(a).alias(f"_b{i}") for i, a in enumerate(axes)], *[F.floor(F.col(a) / radius).cast("long").alias(f"_h{i}") for i, a in enumerate(axes)])
    for i in range(len(axes)):
        there = there.withColumn(f"_h{i}", F.explode(F.array(*[F.col(f"_h{i}") + s for s in (-1, 0, 1)])))
    on = F.col("_g0") == F.col("_h0")
    for i in range(1, len(axes)):
        on &= F.col(f"_g{i}") == F.col(f"_h{i}")
    sq = sum(((F.col(f"_a{i}") - F.col(f"_b{i}")) * (F.col(f"_a{i}") - F.col(f"_b{i}")) for i in range(len(axes))), F.lit(0.0))
    return here.join(there, on).filter(F.col("src") != F.col("dst")).withColumn("distance", F.sqrt(sq)).filter(F.col("distance") <= radius).select("src", "dst", "distance")


def spatial_neighbours(points: DataFrame, axes: list[str], k: int, key: str = "cell_ix") -> DataFrame:
    """src, rank, dst, distance: each point's k nearest in 1 to 3 dimensions, exactly; ties to the smaller key.

    Rounds of a grid: a point with k others within the radius is done, the others go on with twice the radius. The first
    radius would hold some k points if they were spread evenly. Points with a null coordinate take no part.
    """
    from lattica.sources.shared import discard, materialize

    rows = points.select(key, *axes).dropna()
    span = rows.agg(F.count("*").alias("n"), *[(F.max(a) - F.min(a)).alias(a) for a in axes]).first()
    widest = max([span[a] or 0.0 for a in axes])
    place = F.row_number().over(Window.partitionBy("src").orderBy("distance", "dst"))
    radius = max(widest * (2 * (k + 1) / max(1, span["n"])) ** (1 / len(axes)) / 2, widest * 1e-6, 1e-12)
    left, out = rows, None
    while True:
        last = radius >= 2 * widest
        near = radius_pairs(rows, axes, radius, key, left).withColumn("rank", place.cast("long")).filter(F.col("rank") <= k)
        near = materialize(near, "spatial")
        done = near if last else near.join(near.filter(F.col("rank") == k).select("src"), "src", "left_semi")
        out = done if out is None else out.unionByName(done)
        if last:
            return out.select("src", "rank", "dst", "distance")
        rest = materialize(left.join(near.filter(F.col("rank") == k).select(F.col("src").alias(key)), key, "left_anti"), "spatial-left")
        if hasattr(left, "written_to"):
            discard(left)
        left = rest
        if left.isEmpty():
            return out.select("src", "rank", "dst", "distance")
        radius *= 2


def batch_plans(sets: DataFrame, per_batch: int, order: list[str], shuffle_seed: int | None = None) -> DataFrame:
    """Sets in order, or in seeded random order, per_batch to a batch; the last batch may be short."""
    from lattica.operators.order import with_position

    if shuffle_seed is not None:
        placed = with_position(sets.withColumn("_h", F.xxhash64(*order, F.lit(shuffle_seed))), ["_h", *order]).drop("_h")
    else:
        placed = with_position(sets, order)
    return placed.withColumn("batch", F.floor(F.col("position") / per_batch).cast("long"))


def collate_queries(x: DataFrame, sets: DataFrame, queries: DataFrame, k_enc: int, mode: str = "log1p_raw", pad: int = -1, hidden: DataFrame | None = None, target: float = 1e4, alpha: float = 0.05) -> DataFrame:
    """Encoder and decoder inputs of cell sets: set_id, cell_ix, library_size, enc_ids, enc_values, enc_padded, target.

    sets: set_id, cell_ix; queries: set_id, pos, gene_ix, the decoder's genes of each set in order. The encoder sees each
    cell's k_enc largest raw values (ties to the smaller gene) under a value mode of transform_values, padded; genes at
    `hidden` positions (set_id, pos) of the queries are kept from it. target: the raw values of the query genes, 0 where
    absent. The library size is over all of the cell's positive values.
    """
    from lattica.operators.handle import transform_values

    raw = x.filter("value > 0")
    lib = raw.groupBy("cell_ix").agg(F.sum("value").alias("library_size"))
    shown = transform_values(raw, mode, target, alpha).withColumnRenamed("value", "shown").join(raw, ["cell_ix", "gene_ix"])
    rows = sets.select("set_id", "cell_ix").join(shown, "cell_ix")
    if hidden is not None:
        away = queries.join(hidden.select("set_id", "pos"), ["set_id", "pos"]).select("set_id", "gene_ix").distinct()
        rows = rows.join(away, ["set_id", "gene_ix"], "left_anti")
    entry = F.struct((-F.col("value")).alias("k"), F.col("gene_ix").cast("long").alias("g"), F.col("shown").alias("s"))
    enc = rows.groupBy("set_id", "cell_ix").agg(F.slice(F.array_sort(F.collect_list(entry)), 1, k_enc).alias("e"))
    dec = sets.select("set_id", "cell_ix").join(queries, "set_id").join(raw, ["cell_ix", "gene_ix"], "left")
    dec = dec.groupBy("set_id", "cell_ix").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("value", F.lit(0.0)).alias("v")))), lambda s: s["v"]).alias("target"))
    none = F.expr("cast(array() as array<struct<k:double,g:bigint,s:double>>)")
    out = sets.select("set_id", "cell_ix").join(enc, ["set_id", "cell_ix"], "left").join(dec, ["set_id", "cell_ix"], "left").join(lib, "cell_ix", "left")
    out = out.withColumn("e", F.coalesce("e", none))
    short = k_enc - F.size("e")
    return out.select(
        "set_id", "cell_ix", F.coalesce("library_size", F.lit(0.0)).alias("library_size"),
        F.concat(F.transform("e", lambda s: s["g"]), F.array_repeat(F.lit(pad).cast("long"), short)).alias("enc_ids"),
        F.concat(F.transform("e", lambda s: s["s"]), F.array_repeat(F.lit(0.0), short)).alias("enc_values"),
        F.concat(F.transform("e", lambda s: F.lit(False)), F.array_repeat(F.lit(True), short)).alias("enc_padded"),
        F.coalesce("target", F.array().cast("array<double>")).alias("target"),
    )


def training_batches(d: Dataset, genes: DataFrame, size: int, seed: int, target: float = 1e4):
    """An iterator of dense batches {X, cell_ix} in seeded order over chosen genes, normalised by full depth and log1p.

    Cells are dealt by hash into partitions and read one partition at a time; the driver holds one partition's rows.
    """
    from lattica.operators.transform import normalize_total

    chosen = genes.select("gene_ix").orderBy("gene_ix").collect()  # the width of a batch
    at = {r[0]: i for i, r in enumerate(chosen)}
    x = normalize_total(d, target).join(genes.select("gene_ix"), "gene_ix", "left_semi").withColumn("value", F.log1p("value"))
    rows = d.read_obs().select("cell_ix").join(x.groupBy("cell_ix").agg(F.collect_list("gene_ix").alias("g"), F.collect_list("value").alias("v")), "cell_ix", "left")
    rows = rows.withColumn("h", F.xxhash64("cell_ix", F.lit(seed))).repartitionByRange("h").sortWithinPartitions("h", "cell_ix")
    cells, matrix = [], []
    for r in rows.toLocalIterator(prefetchPartitions=True):
        dense = np.zeros(len(at), np.float32)
        for g, v in zip(r["g"] or (), r["v"] or ()):
            dense[at[g]] = v
        cells.append(r["cell_ix"])
        matrix.append(dense)
        if len(cells) == size:
            yield {"X": np.stack(matrix), "cell_ix": np.array(cells)}
            cells, matrix = [], []
    if cells:
        yield {"X": np.stack(matrix), "cell_ix": np.array(cells)}


def collate_sets(x: DataFrame, sets: DataFrame, k: int, pad: int) -> DataFrame:
    """Cell sets (set_id, cell_ix) with each cell's k largest genes by raw value, log1p values, and a pad mask."""
    from lattica.operators.order import top_k

    top = top_k(x, k, pad)
    return sets.join(top, "cell_ix").select("set_id", "cell_ix", "ids", F.transform("values", F.log1p).alias("values"), F.transform("ids", lambda g: g == pad).alias("padded"))


def inverse_cdf(weights: DataFrame, by: str, order: str, weight: str) -> DataFrame:
    """Cumulative weight share of each row within its group: what seeded draws are looked up in."""
    w = Window.partitionBy(by)
    run = F.sum(weight).over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return weights.select(by, order, (run / F.sum(weight).over(w)).alias("cdf"))
