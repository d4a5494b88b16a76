"""Gene selection and scoring: highly variable genes, filters, gene-set scores."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.operators.aggregates import axis_stats, clipped_sums, sample_moments
from lattica.plans.dataset import Dataset


def filter_axis(d: Dataset, axis: str, min_counts: float | None = None, max_counts: float | None = None, min_nnz: int | None = None, max_nnz: int | None = None) -> DataFrame:
    """Keys of the cells (genes) within the inclusive bounds on total and detected genes (cells)."""
    own = "cell_ix" if axis == "cell" else "gene_ix"
    out = axis_stats(d, axis)
    for c, low, high in (("sum", min_counts, max_counts), ("nnz", min_nnz, max_nnz)):
        if low is not None:
            out = out.filter(F.col(c) >= low)
        if high is not None:
            out = out.filter(F.col(c) <= high)
    return out.select(own, "sum", "nnz")


def dispersion_bins(moments: DataFrame, n_bins: int = 20) -> DataFrame:
    """Genes with dispersion, equal-width bin of log mean, and the dispersion's z-score in its bin (singletons get 1)."""
    m = moments.filter("mean > 0")
    log_mean = F.log1p("mean")
    disp = F.log(F.when(F.col("var") > 0, F.col("var") / F.col("mean")))
    m = m.select("gene_ix", log_mean.alias("log_mean"), disp.alias("dispersion"))
    edge = m.agg(F.min("log_mean").alias("lo"), F.max("log_mean").alias("hi"))
    m = m.join(F.broadcast(edge), F.lit(True))  # one row
    width = (F.col("hi") - F.col("lo")) / n_bins
    m = m.withColumn("bin", F.when(width > 0, F.greatest(F.lit(1), F.least(F.lit(n_bins), F.ceil((F.col("log_mean") - F.col("lo")) / width)))).otherwise(1).cast("long"))
    w = Window.partitionBy("bin")
    m = m.withColumns({"bin_mean": F.avg("dispersion").over(w), "bin_std": F.stddev_samp("dispersion").over(w), "bin_n": F.count("dispersion").over(w)})
    z = F.when(F.col("bin_n") == 1, F.lit(1.0)).otherwise(F.try_divide(F.col("dispersion") - F.col("bin_mean"), F.col("bin_std")))
    return m.select("gene_ix", "log_mean", "dispersion", "bin", z.alias("dispersion_norm"))


def _moved(m: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Sums of powers (row r: of the r-th power) of differences from a centre, turned into those from a centre d before it."""
    for i in range(1, len(m)):
        m[i:] += d * m[i - 1 : -1]
    return m


def loess(x: np.ndarray, y: np.ndarray, span: float = 0.3, count: np.ndarray | None = None) -> np.ndarray:
    """Local quadratic regression with tricube weights over each point's nearest span of the points, solved at every x.

    count: how many points stand for each (x, mean y). The tricube is a polynomial on either side of a point, so a fit
    needs sums of powers only: a tree over the sorted points holds them about each node's own middle, and a window is at
    most two nodes a level. Windows aren't walked through: n points take n log n steps. All terms stay within the
    window's width, so no digits cancel. Points at the window's very edge have no weight.
    """
    if not len(x):
        return np.zeros(0)
    count = np.ones(len(x), np.int64) if count is None else np.asarray(count, np.int64)
    xs, back = np.unique(x, return_inverse=True)
    size, total = np.bincount(back, count), np.bincount(back, count * y)
    group = np.repeat(np.arange(len(xs)), size.astype(np.int64))
    n, m, low = len(group), len(xs), xs[0]
    scale = xs[-1] - low or 1.0
    xs = (xs - low) / scale
    k = min(n, max(4, int(np.ceil(span * n))))
    # the window of the k nearest begins where the next point above is no nearer than the first one
    start = np.searchsorted(xs[group[k:]] + xs[group[: n - k]], 2 * xs)
    first, last = group[start], group[start + k - 1]
    below, above = xs - xs[first], xs[last] - xs
    far = np.maximum(below, above)
    first = first + ((below >= far) & (far > 0))
    last = last - ((above >= far) & (far > 0))
    h = np.maximum(far, 1e-12) * 1.000001

    levels = [(xs, np.zeros((14, m)), np.zeros((12, m)))]  # middle, sums of powers, and of y times powers
    levels[0][1][0], levels[0][2][0] = size, total
    left, right = xs, xs
    while len(levels[-1][0]) > 1:
        mid, p, q = levels[-1]
        odd = len(mid) % 2
        up_left, up_right = left[::2], np.append(right[1::2], right[-1:]) if odd else right[1::2]
        up = (up_left + up_right) / 2
        a, b = [_moved(z[:, ::2].copy(), mid[::2] - up) for z in (p, q)], [_moved(z[:, 1::2].copy(), mid[1::2] - up[: len(mid) // 2]) for z in (p, q)]
        for one, other in zip(a, b):
            one[:, : other.shape[1]] += other
        levels.append((up, *a))
        left, right = up_left, up_right

    out, places = np.empty(m), np.arange(m)
    for i in range(0, m, 8192):
        part = slice(i, min(m, i + 8192))
        moments = np.zeros((5, part.stop - i)), np.zeros((3, part.stop - i))
        for lo, hi, sign in ((first[part], places[part], 1), (places[part], last[part] + 1, -1)):
            lo, hi = lo.copy(), hi.copy()
            sums = np.zeros((14, len(lo))), np.zeros((12, len(lo)))
            for mid, *held in levels:
                live = lo < hi
                if not live.any():
                    break
                for at, node in ((np.flatnonzero(live & (lo % 2 == 1)), lo), (np.flatnonzero(live & (hi % 2 == 1)), hi - 1)):
                    if len(at):
                        w, d = h[part][at], (mid[node[at]] - xs[part][at]) / h[part][at]
                        for s, z in zip(sums, held):
                            s[:, at] += _moved(z[:, node[at]] / w ** np.arange(len(z))[:, None], d)
                lo, hi = (lo + 1) // 2, hi // 2
            for got, s in zip(moments, sums):
                got += s[: len(got)] + 3 * sign * s[3 : 3 + len(got)] + 3 * s[6 : 6 + len(got)] + sign * s[9 : 9 + len(got)]
        u = moments[0]
        matrix = np.stack([u[[0, 1, 2]], u[[1, 2, 3]], u[[2, 3, 4]]]).transpose(2, 0, 1)
        # few distinct places: the solution of least length
        out[part] = (np.linalg.pinv(matrix, rcond=1e-10, hermitian=True) @ moments[1].T[:, :, None])[:, 0, 0]
    return out[back]


def variance_stabilised(d: Dataset, n_top: int = 2000, span: float = 0.3, batch: str | None = None, flavor: str = "seurat_v3") -> DataFrame:
    """Highly variable genes by standardised variance after a loess fit of log variance on log mean.

    The fit runs on the driver over one row a batch and distinct mean, with the number of genes that have it; both passes
    over values are aggregations. With batches, genes are ordered by the median of their ranks, then by the number of
    batches they are among the top in; with flavor seurat_v3_paper by that number first.
    """
    import pyarrow as pa

    from lattica.sources.shared import materialize

    keys = ["gene_ix"] if batch is None else ["gene_ix", batch]
    own = keys[1:]
    moments = sample_moments(d, batch=batch).filter("var > 0").select(*keys, "n_cells", "mean", "var")
    # the means are read twice and must be the same
    moments = materialize(moments.dropna(subset=own) if own else moments, "moments")
    points = moments.groupBy(*own, "mean").agg(F.count("*").alias("k"), F.avg(F.log10("var")).alias("y")).toArrow()
    mean, k, y = (points[c].to_numpy() for c in ("mean", "k", "y"))
    code = points[batch].combine_chunks().dictionary_encode().indices.to_numpy() if own else np.zeros(len(mean), int)
    std = np.empty(len(mean))
    for c in np.unique(code):
        at = code == c
        std[at] = np.sqrt(10 ** loess(np.log10(mean[at]), y[at], span, k[at]))
    curve = d.spark.createDataFrame(points.select([*own, "mean"]).append_column("reg_std", pa.array(std)))
    fit = moments.join(curve, [*own, "mean"]).withColumn("clip", F.col("reg_std") * F.sqrt("n_cells") + F.col("mean"))
    x = d.matrix() if batch is None else d.matrix().join(d.read_obs(batch), "cell_ix")
    c = F.least("value", "clip")
    sums = x.join(fit.select(*keys, "clip"), keys).groupBy(*keys).agg(F.sum(c).alias("s"), F.sum(c * c).alias("q"))
    n = F.col("n_cells").cast("double")
    norm = (n * F.col("mean") * F.col("mean") + F.col("q") - 2 * F.col("mean") * F.col("s")) / ((n - 1) * F.col("reg_std") * F.col("reg_std"))
    out = materialize(fit.join(sums, keys).select(*keys, norm.alias("variance_norm")), "variances")
    order = F.desc("variance_norm"), F.col("gene_ix")
    best = out if own else out.orderBy(*order).limit(n_top)
    top = best.withColumn("r", F.row_number().over(Window.partitionBy(*own).orderBy(*order))).filter(F.col("r") <= n_top)
    top = top.groupBy("gene_ix").agg(F.median(F.col("r") - 1).alias("median_rank"), F.count("*").alias("n_batches"))
    rank, often = F.col("median_rank").asc_nulls_last(), F.desc("n_batches")
    # n_top rows a batch at most, and never fewer than are marked
    final = Window.orderBy(*{"seurat_v3": (rank, often), "seurat_v3_paper": (often, rank)}[flavor], "gene_ix")
    top = top.withColumn("highly_variable", F.row_number().over(final) <= n_top)
    every = out.groupBy("gene_ix").agg(F.avg("variance_norm").alias("variance_norm")).join(top, "gene_ix", "left")
    return every.select("gene_ix", "median_rank", F.coalesce("n_batches", F.lit(0)).alias("n_batches"), "variance_norm", F.coalesce("highly_variable", F.lit(False)).alias("highly_variable"))


def expression_bins(moments: DataFrame, n_bins: int = 25) -> DataFrame:
    """Genes with their expression bin: min-rank of the mean over items per bin."""
    r = F.rank().over(Window.orderBy("mean"))
    n = moments.agg(F.greatest(F.lit(1.0), F.round(F.count("*") / (n_bins - 1))).alias("per_bin"))
    return moments.withColumn("r", r).join(F.broadcast(n), F.lit(True)).select("gene_ix", "mean", F.floor(F.col("r") / F.col("per_bin")).cast("long").alias("bin"))


def score_genes_mean(d: Dataset, genes: DataFrame, control: DataFrame) -> DataFrame:
    """Mean over the gene list minus mean over the control list, absent entries zero: one weighted sum a cell."""
    k, c = genes.agg(F.count("*").alias("k")), control.agg(F.count("*").alias("c"))
    weights = genes.select("gene_ix").join(F.broadcast(k), F.lit(True)).select("gene_ix", (1 / F.col("k")).alias("w"))
    weights = weights.unionByName(control.select("gene_ix").join(F.broadcast(c), F.lit(True)).select("gene_ix", (-1 / F.col("c")).alias("w")))
    weights = weights.groupBy("gene_ix").agg(F.sum("w").alias("w"))
    got = d.matrix().join(weights, "gene_ix").groupBy("cell_ix").agg(F.sum(F.col("value") * F.col("w")).alias("s"))
    return d.read_obs().select("cell_ix").join(got, "cell_ix", "left").select("cell_ix", F.coalesce("s", F.lit(0.0)).alias("score"))


def score_genes_zscore(d: Dataset, genes: DataFrame) -> DataFrame:
    """Sum of the genes' z-scores over sqrt(genes); a gene without spread contributes nothing."""
    m = sample_moments(d).join(genes.select("gene_ix"), "gene_ix", "left_semi").filter("var > 0").select("gene_ix", "mean", F.sqrt("var").alias("sd"))
    k = genes.agg(F.count("*").alias("k"))
    offset = m.agg(F.sum(F.col("mean") / F.col("sd")).alias("offset"))
    got = d.matrix().join(m, "gene_ix").groupBy("cell_ix").agg(F.sum(F.col("value") / F.col("sd")).alias("s"))
    out = d.read_obs().select("cell_ix").join(got, "cell_ix", "left").join(F.broadcast(offset), F.lit(True)).join(F.broadcast(k), F.lit(True))
    return out.select("cell_ix", ((F.coalesce("s", F.lit(0.0)) - F.coalesce("offset", F.lit(0.0))) / F.sqrt("k")).alias("score"))


def control_genes(bins: DataFrame, genes: DataFrame, size: int, seed: int = 0) -> DataFrame:
    """Up to `size` seeded-random control genes from each bin that a listed gene falls in, listed ones excluded."""
    used = bins.join(genes.select("gene_ix"), "gene_ix", "left_semi").select("bin").distinct()
    pool = bins.join(used, "bin", "left_semi").join(genes.select("gene_ix"), "gene_ix", "left_anti")
    r = F.row_number().over(Window.partitionBy("bin").orderBy(F.xxhash64("gene_ix", F.lit(seed)), "gene_ix"))
    return pool.withColumn("r", r).filter(F.col("r") <= size).select("gene_ix", "bin")


__all__ = ["clipped_sums", "control_genes", "dispersion_bins", "expression_bins", "filter_axis", "loess", "score_genes_mean", "score_genes_zscore", "variance_stabilised"]
