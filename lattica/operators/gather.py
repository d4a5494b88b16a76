"""Reads over several datasets: vocabulary remaps, cell sets, pairwise graphs, multimodal batches; agreement sweeps."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.plans.dataset import Dataset


def remap(d: Dataset, vocabulary: DataFrame, source: str, gene: str = "gene_id") -> DataFrame:
    """A dataset's values on a common gene axis (vocabulary: gene_id, global_ix); genes outside it are left out."""
    table = d.var.select("gene_ix", F.col(gene).alias("_name")).join(vocabulary, F.col("_name") == F.col("gene_id")).select("gene_ix", "global_ix")
    return d.matrix().join(table, "gene_ix").select(F.lit(source).alias("source"), "cell_ix", F.col("global_ix").alias("gene_ix"), "value")


def gather_sets(parts: dict[str, Dataset], vocabulary: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows of a plan (set_id, ord, source, cell_ix) over several datasets, on the common gene axis."""
    stacked = None
    for name, d in sorted(parts.items()):
        x = remap(d, vocabulary, name)
        stacked = x if stacked is None else stacked.unionByName(x)
    return plan.join(stacked, ["source", "cell_ix"]).select("set_id", "ord", "source", "cell_ix", "gene_ix", "value")


def graph_rows(edges: DataFrame, rows: DataFrame) -> DataFrame:
    """The edges of chosen rows (cell_ix) of a pairwise graph."""
    return edges.join(rows.select(F.col("cell_ix").alias("src")), "src", "left_semi")


def multimodal_batches(parts: dict[str, DataFrame], widths: dict[str, int], cells: DataFrame, size: int, seed: int):
    """Batches {name: dense matrix, cell_ix} of the same cells in every modality, in seeded order.

    parts: name -> (cell_ix, gene_ix, value) with gene_ix below widths[name]. The driver holds one partition's rows.
    """
    rows = cells.select("cell_ix")
    for name, x in sorted(parts.items()):
        got = x.groupBy("cell_ix").agg(F.collect_list(F.struct("gene_ix", "value")).alias(name))
        rows = rows.join(got, "cell_ix", "left")
    rows = rows.withColumn("h", F.xxhash64("cell_ix", F.lit(seed))).repartitionByRange("h").sortWithinPartitions("h", "cell_ix")

    def batch(run):
        out = {"cell_ix": np.array([r["cell_ix"] for r in run])}
        for name in parts:
            m = np.zeros((len(run), widths[name]), np.float32)
            for i, r in enumerate(run):
                for e in r[name] or ():
                    m[i, e["gene_ix"]] = e["value"]
            out[name] = m
        return out

    run = []
    for r in rows.toLocalIterator(prefetchPartitions=True):
        run.append(r)
        if len(run) == size:
            yield batch(run)
            run = []
    if run:
        yield batch(run)


def agreement_sweep(real: DataFrame, pred: DataFrame, by: str, metric: str = "ami", resolutions: tuple[float, ...] = (0.3, 0.6, 1.0, 1.5), k: int = 5) -> DataFrame:
    """One row: the best agreement of clusterings of real and predicted group centroids over a resolution sweep.

    real, pred: by, vec. Centroids are few (one a group), so each sweep step clusters a small graph.
    """
    from lattica.operators.embedding import connectivities, exact_neighbours, leiden
    from lattica.operators.metrics import adjusted_mutual_information, mutual_information

    def clusters(points: DataFrame, resolution: float, names: dict) -> dict:
        ix = points.select(F.col("_ix").alias("cell_ix"), "vec")
        knn = exact_neighbours(ix, min(k, max(1, len(names) - 1)))
        return {r["cell_ix"]: r["cluster"] for r in leiden(connectivities(knn, max(2, k)), resolution).collect()}

    names = sorted(r[0] for r in real.select(by).distinct().collect())
    at = {n: i for i, n in enumerate(names)}
    spark = real.sparkSession
    table = spark.createDataFrame([(n, i) for n, i in at.items()], f"{by} {real.schema[by].dataType.simpleString()}, _ix long")

    def centroids(f: DataFrame) -> DataFrame:
        z = f.join(table, by).select("_ix", F.posexplode("vec").alias("j", "v")).groupBy("_ix", "j").agg(F.avg("v").alias("v"))
        return z.groupBy("_ix").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "v"))), lambda s: s["v"]).alias("vec"))

    a, b = centroids(real), centroids(pred)
    best = (-2.0, 0.0)
    for r in resolutions:
        ca, cb = clusters(a, r, at), clusters(b, r, at)
        pairs = spark.createDataFrame([(ca.get(i, -1 - i), cb.get(i, -1 - i)) for i in at.values()], "a long, b long")
        score = adjusted_mutual_information(pairs, "a", "b") if metric == "ami" else float(mutual_information(pairs, "a", "b").first()[metric])
        best = max(best, (score, r))
    return spark.createDataFrame(pd.DataFrame([{"metric": metric, "score": best[0], "resolution": best[1]}]))


def pdex_nb_glm(d: Dataset, by: str, reference: str, replicate: str, min_cells: int = 10) -> DataFrame:
    """NB regression of every group against the reference over pseudobulk replicates, in the pairwise tests' columns."""
    from lattica.operators.aggregates import pseudobulk
    from lattica.operators.nb_glm import pseudobulk_dex
    from lattica.operators.ranking import benjamini_hochberg
    from lattica.sources.shared import materialize

    bulk = materialize(pseudobulk(d, [replicate, by], total=True, min_cells=min_cells), "bulk")
    out = None
    for g in sorted(r[0] for r in d.read_obs(by).select(by).distinct().collect() if r[0] not in (None, reference)):
        one = pseudobulk_dex(bulk, replicate, by, reference, g).select(F.lit(g).alias("target"), F.col("gene").alias("feature"), "base_mean", F.col("log2fc").alias("fold_change"), F.col("stat").alias("statistic"), "pval")
        out = one if out is None else out.unionByName(one)
    return benjamini_hochberg(out, ["target"], tie="feature")


def copy_matching(d: Dataset, store, where) -> int:
    """A filtered copy of a dataset into a store: only the matching cells' rows are written."""
    from lattica.operators.order import subset

    return store.save(subset(d, where), "pull")
