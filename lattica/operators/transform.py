"""Value transforms: normalisation by three denominators, row factors, PFlog, arithmetic, comparison, products."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.operators.aggregates import median_library, sample_moments
from lattica.plans.dataset import Dataset


def depth(d: Dataset) -> DataFrame:
    """Library size of each cell that has values."""
    return d.matrix().groupBy("cell_ix").agg(F.sum("value").alias("depth"))


def normalize_total(d: Dataset, target_sum: float | None = None, x: DataFrame | None = None) -> DataFrame:
    """Values scaled to a total per cell over the full transcriptome; target_sum None: the median of positive totals.

    x restricts which values are returned, not what they are divided by.
    """
    if x is None:  # rows are dealt by cell: a window needs no second look at them
        out = d.matrix().withColumn("depth", F.sum("value").over(Window.partitionBy("cell_ix")))
    else:
        out = x.join(depth(d), "cell_ix")
    if target_sum is None:
        out, target = out.join(F.broadcast(median_library(d)), F.lit(True)), F.col("target_sum")  # one row
    else:
        target = F.lit(float(target_sum))
    return out.select("cell_ix", "gene_ix", F.when(F.col("depth") > 0, F.col("value") * target / F.col("depth")).otherwise(F.col("value")).alias("value"))


def row_scale(x: DataFrame, factors: DataFrame, factor: str, divide: bool = False) -> DataFrame:
    """Each cell's values times (or divided by) its factor; cells without one keep their values."""
    f = F.coalesce(F.col(factor), F.lit(1.0))
    return x.join(factors.select("cell_ix", factor), "cell_ix", "left").select("cell_ix", "gene_ix", (F.try_divide("value", f) if divide else F.col("value") * f).alias("value"))


def elementwise(x: DataFrame, op: str, operand: float | None = None) -> DataFrame:
    """Zero-preserving scalar operations on stored values."""
    v = F.col("value")
    table = {
        "log1p": lambda: F.log1p(v), "expm1": lambda: F.expm1(v), "sqrt": lambda: F.sqrt(v), "multiply": lambda: v * operand,
        "power": lambda: F.pow(v, F.lit(operand)), "clip_negatives": lambda: F.greatest(F.nanvl(v, F.lit(0.0)), F.lit(0.0)), "abs": lambda: F.abs(v),
    }
    return x.withColumn("value", table[op]()).filter("value <> 0")


def add(a: DataFrame, b: DataFrame, sign: int = 1) -> DataFrame:
    """a + b or a - b over the union of their entries: one aggregation, no join."""
    both = a.unionByName(b.withColumn("value", sign * F.col("value")))
    return both.groupBy("cell_ix", "gene_ix").agg(F.sum("value").alias("value")).filter("value <> 0")


def matmul(x: DataFrame, weights: DataFrame) -> DataFrame:
    """x @ weights, where weights has gene_ix, component, weight: cell_ix, component, value."""
    return x.join(weights, "gene_ix").groupBy("cell_ix", "component").agg(F.sum(F.col("value") * F.col("weight")).alias("value"))


def gather_rows(x: DataFrame, request: DataFrame) -> DataFrame:
    """Rows in the order asked for (request: ord, cell_ix), repeated if asked for twice."""
    return request.join(x, "cell_ix").select("ord", "cell_ix", "gene_ix", "value")


def pflog(d: Dataset, alpha: float) -> tuple[DataFrame, DataFrame]:
    """delta = log1p(4 alpha x) of the stored entries, and per cell the baseline -sum(delta) / genes; Z = delta + baseline."""
    delta = d.matrix().withColumn("value", F.log1p(4 * alpha * F.col("value")))
    genes = d.var.agg(F.count("*").alias("genes"))
    base = d.read_obs().select("cell_ix").join(delta.groupBy("cell_ix").agg(F.sum("value").alias("s")), "cell_ix", "left").join(F.broadcast(genes), F.lit(True))
    return delta, base.select("cell_ix", (-F.coalesce("s", F.lit(0.0)) / F.col("genes")).alias("baseline"))


def estimate_alpha(d: Dataset, least_mean: float = 0.0) -> DataFrame:
    """Median over genes of (var - mean) / mean^2, negative ones too."""
    m = sample_moments(d).filter(F.col("mean") > least_mean)
    return m.agg(F.median((F.col("var") - F.col("mean")) / (F.col("mean") * F.col("mean"))).alias("alpha"))


def pflog_reconstruct(d: Dataset, alpha: float, cells: DataFrame, genes: DataFrame) -> DataFrame:
    """Dense Z over chosen cells and genes (the result has cells x genes rows)."""
    delta, base = pflog(d, alpha)
    frame = cells.select("cell_ix").crossJoin(genes.select("gene_ix"))
    return frame.join(delta, ["cell_ix", "gene_ix"], "left").join(base, "cell_ix").select("cell_ix", "gene_ix", (F.coalesce("value", F.lit(0.0)) + F.col("baseline")).alias("value"))
