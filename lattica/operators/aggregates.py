"""Aggregates over either axis of a sparse matrix; an absent entry counts as zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.plans.dataset import Dataset


def axis_stats(d: Dataset, axis: str, x: DataFrame | None = None) -> DataFrame:
    """sum, nnz, min, max, sum_sq, var (population, zeros included) of every cell or gene, empty ones too.

    The extent of the other axis is a scalar subquery-like single-row join, so the plan is one partial aggregation of x
    and one join with the axis table.
    """
    own, other = ("cell_ix", "gene_ix") if axis == "cell" else ("gene_ix", "cell_ix")
    x = d.matrix() if x is None else x
    frame = d.read_obs() if axis == "cell" else d.var
    extent = (d.var if axis == "cell" else d.read_obs()).agg(F.count("*").alias("extent"))
    v = F.col("value").cast("double")
    got = x.groupBy(own).agg(F.sum(v).alias("s"), F.count("*").alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi"), F.sum(v * v).alias("q"))
    out = frame.select(own).join(got, own, "left").join(F.broadcast(extent), F.lit(True))
    zero = F.lit(0.0)
    s, n, q = F.coalesce("s", zero), F.coalesce("n", F.lit(0)), F.coalesce("q", zero)
    full = n >= F.col("extent")
    mean = s / F.col("extent")
    return out.select(
        own, s.alias("sum"), n.cast("long").alias("nnz"),
        F.when(full, F.col("lo")).otherwise(F.least(F.coalesce("lo", zero), zero)).alias("min"),
        F.when(full, F.col("hi")).otherwise(F.greatest(F.coalesce("hi", zero), zero)).alias("max"),
        q.alias("sum_sq"), F.greatest(q / F.col("extent") - mean * mean, zero).alias("var"),
    )


def sample_moments(d: Dataset, x: DataFrame | None = None, batch: str | None = None, ddof: int = 1) -> DataFrame:
    """Mean and variance (ddof) of every gene over cells, by batch of cells if given."""
    x = d.matrix() if x is None else x
    keys = ["gene_ix"] if batch is None else [batch, "gene_ix"]
    if batch is not None:
        x = x.join(d.read_obs(batch), "cell_ix")
    got = x.groupBy(*keys).agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
    n = d.read_obs().groupBy(*([] if batch is None else [batch])).agg(F.count("*").alias("n_cells"))
    full = d.var.select("gene_ix").crossJoin(n)  # the size of the result: genes x batches
    out = full.join(got, keys, "left")
    s, q, m = F.coalesce("s", F.lit(0.0)), F.coalesce("q", F.lit(0.0)), F.col("n_cells")
    mean = s / m
    return out.select(*keys, "n_cells", mean.alias("mean"), ((q - m * mean * mean) / F.nullif(m - ddof, F.lit(0))).alias("var"))


def clipped_sums(x: DataFrame, clip: DataFrame) -> DataFrame:
    """For each gene, sum and sum of squares of min(value, clip of the gene)."""
    c = F.least(F.col("value"), F.col("clip"))
    return x.join(clip, "gene_ix").groupBy("gene_ix").agg(F.sum(c).alias("clip_sum"), F.sum(c * c).alias("clip_sum_sq"))


def count_where(d: Dataset, axis: str, op: str, threshold: float) -> DataFrame:
    """How many entries of each cell or gene compare true with a threshold; absent entries compare as zero."""
    own = "cell_ix" if axis == "cell" else "gene_ix"
    table: dict[str, tuple[Column, bool]] = {
        ">": (F.col("value") > threshold, 0 > threshold), ">=": (F.col("value") >= threshold, 0 >= threshold),
        "<": (F.col("value") < threshold, 0 < threshold), "<=": (F.col("value") <= threshold, 0 <= threshold),
        "==": (F.col("value") == threshold, threshold == 0), "!=": (F.col("value") != threshold, threshold != 0),
    }
    test, at_zero = table[op]
    frame = d.read_obs() if axis == "cell" else d.var
    extent = (d.var if axis == "cell" else d.read_obs()).agg(F.count("*").alias("extent"))
    got = d.matrix().groupBy(own).agg(F.sum(test.cast("long")).alias("t"), F.count("*").alias("n"))
    out = frame.select(own).join(got, own, "left").join(F.broadcast(extent), F.lit(True))
    t, n = F.coalesce("t", F.lit(0)), F.coalesce("n", F.lit(0))
    return out.select(own, (t + (F.col("extent") - n if at_zero else F.lit(0))).cast("long").alias("n_true"))


def qc_obs(d: Dataset, marked: Column, name: str = "marked", top: tuple[int, ...] = (2,)) -> DataFrame:
    """Per cell: detected genes, total, log totals, total and percentage of marked genes, percentage in the top n genes."""
    from pyspark.sql import Window

    genes = d.var.select("gene_ix", marked.alias("is_marked"))
    x = d.matrix().join(genes, "gene_ix")
    rank = F.row_number().over(Window.partitionBy("cell_ix").orderBy(F.desc("value"), "gene_ix"))
    x = x.withColumn("place", rank)
    parts = [F.sum(F.when(F.col("place") <= n, F.col("value")).otherwise(0.0)).alias(f"top_{n}") for n in top]
    got = x.groupBy("cell_ix").agg(
        F.count("*").alias("n"), F.sum("value").alias("t"), F.sum(F.when(F.col("is_marked"), F.col("value")).otherwise(0.0)).alias("m"), *parts
    )
    out = d.read_obs().select("cell_ix").join(got, "cell_ix", "left")
    total, m = F.coalesce("t", F.lit(0.0)), F.coalesce("m", F.lit(0.0))
    share = lambda c: F.when(total > 0, 100 * c / total).otherwise(0.0)
    n = F.coalesce("n", F.lit(0)).cast("long")
    return out.select(
        "cell_ix", n.alias("n_genes_by_counts"), F.log1p(n.cast("double")).alias("log1p_n_genes_by_counts"), total.alias("total_counts"), F.log1p(total).alias("log1p_total_counts"),
        m.alias(f"total_counts_{name}"), F.log1p(m).alias(f"log1p_total_counts_{name}"), share(m).alias(f"pct_counts_{name}"),
        *[share(F.coalesce(f"top_{k}", F.lit(0.0))).alias(f"pct_counts_in_top_{k}_genes") for k in top],
    )


def qc_var(d: Dataset) -> DataFrame:
    """Per gene: cells detected in, mean, dropout percentage, total, with logs."""
    n_cells = d.read_obs().agg(F.count("*").alias("n_cells"))
    got = d.matrix().groupBy("gene_ix").agg(F.count("*").alias("n"), F.sum("value").alias("t"))
    out = d.var.select("gene_ix").join(got, "gene_ix", "left").join(F.broadcast(n_cells), F.lit(True))
    n, t = F.coalesce("n", F.lit(0)).cast("long"), F.coalesce("t", F.lit(0.0))
    mean = t / F.col("n_cells")
    return out.select(
        "gene_ix", n.alias("n_cells_by_counts"), mean.alias("mean_counts"), F.log1p(mean).alias("log1p_mean_counts"),
        (100 * (1 - n / F.col("n_cells"))).alias("pct_dropout_by_counts"), t.alias("total_counts"), F.log1p(t).alias("log1p_total_counts"),
    )


#: (transform before the mean, transform after it) of each way to average.
MEANS = {
    "arith_raw": (lambda v: v, lambda m: m),
    "arith_log1p": (F.expm1, F.log1p),
    "geom_raw": (F.log1p, F.expm1),
    "geom_log1p": (lambda v: v, lambda m: m),
}


def pseudobulk(d: Dataset, by: list[str], mode: str = "arith_raw", total: bool = False, min_cells: int = 1, x: DataFrame | None = None, dense: bool = False) -> DataFrame:
    """Mean (or total) of each gene over each group of cells; the divisor is the group's cells, not its nonzeros.

    dense adds genes that a group lacks, as zero.
    """
    x = d.matrix() if x is None else x
    before, after = MEANS[mode]
    groups = d.read_obs(*by).groupBy(*by).agg(F.count("*").alias("n_cells")).filter(F.col("n_cells") >= min_cells)
    got = x.join(d.read_obs(*by), "cell_ix").groupBy(*by, "gene_ix").agg(F.sum(before(F.col("value"))).alias("s"))
    if dense:
        frame = d.var.select("gene_ix").crossJoin(groups)  # genes x groups, the size of the result
        out = frame.join(got, [*by, "gene_ix"], "left")
    else:
        out = got.join(groups, by)
    s = F.coalesce("s", F.lit(0.0))
    return out.select(*by, "gene_ix", F.col("n_cells").cast("long").alias("n_cells"), (s if total else after(s / F.col("n_cells"))).alias("value"))


def expressing_fractions(d: Dataset, by: str) -> DataFrame:
    """Share of a group's cells, and of all other cells, that hold each gene."""
    groups = d.read_obs(by).groupBy(by).agg(F.count("*").alias("n_group"))
    everyone = d.read_obs().agg(F.count("*").alias("n_all"))
    own = d.matrix().join(d.read_obs(by), "cell_ix").groupBy(by, "gene_ix").agg(F.count("*").alias("k"))
    every = own.groupBy("gene_ix").agg(F.sum("k").alias("k_all"))
    out = every.crossJoin(groups).join(own, [by, "gene_ix"], "left").join(F.broadcast(everyone), F.lit(True))
    k = F.coalesce("k", F.lit(0))
    rest = F.nullif(F.col("n_all") - F.col("n_group"), F.lit(0))
    return out.select(by, "gene_ix", (k / F.col("n_group")).alias("pts"), ((F.col("k_all") - k) / rest).alias("pts_rest"))


def median_library(d: Dataset) -> DataFrame:
    """The exact median of the positive cell totals."""
    return d.matrix().groupBy("cell_ix").agg(F.sum("value").alias("t")).filter("t > 0").agg(F.median("t").alias("target_sum"))


def stable_moments(d: Dataset, axis: str = "gene", tolerance: float = 1e-6) -> DataFrame:
    """mean and population variance by a second pass over the differences from the mean, the closed form E[x^2] - E[x]^2,
    and whether the closed form has lost its digits: less is left of it than tolerance x E[x^2]."""
    own, frame, other = ("gene_ix", d.var, d.read_obs()) if axis == "gene" else ("cell_ix", d.read_obs(), d.var)
    v = F.col("value").cast("double")
    x = d.matrix()
    extent = other.agg(F.count("*").cast("double").alias("n"))
    first = x.groupBy(own).agg(F.sum(v).alias("s"), F.sum(v * v).alias("q"), F.count("*").cast("double").alias("k")).join(F.broadcast(extent), F.lit(True))  # one row
    first = first.withColumn("mean", F.col("s") / F.col("n"))
    gap = v - F.col("mean")
    second = x.join(first.select(own, "mean"), own).groupBy(own).agg(F.sum(gap * gap).alias("d"))
    both = first.join(second, own)
    exact = (F.col("d") + (F.col("n") - F.col("k")) * F.col("mean") * F.col("mean")) / F.col("n")
    closed = F.col("q") / F.col("n") - F.col("mean") * F.col("mean")
    got = both.select(own, "mean", exact.alias("var"), closed.alias("closed"), (F.abs(closed) < tolerance * F.col("q") / F.col("n")).alias("cancelled"))
    zero = F.lit(0.0)
    return frame.select(own).join(got, own, "left").select(own, F.coalesce("mean", zero).alias("mean"), F.coalesce("var", zero).alias("var"), F.coalesce("closed", zero).alias("closed"), F.coalesce("cancelled", F.lit(False)).alias("cancelled"))
