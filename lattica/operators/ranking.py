"""Rank-based differential testing over sparse values: absent entries are one run of tied zeros, never materialised."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from lattica.plans.dataset import Dataset
from lattica.sources.shared import materialize


@F.pandas_udf(DoubleType())
def two_sided_p(z: pd.Series) -> pd.Series:
    """Two-sided p of a standard normal deviate; null and NaN give 1."""
    return z.map(lambda v: 1.0 if v is None or v != v else math.erfc(abs(v) / math.sqrt(2)))


def tie_averaged_ranks(x: DataFrame, n: DataFrame, keys: list[str]) -> DataFrame:
    """x (positive values) with mid-ranks within keys, zeros included: n has n_pool for each key.

    Zeros hold ranks 1..N-m, so a stored value's rank is N - m plus its mid-rank among stored ones.
    """
    order = Window.partitionBy(*keys).orderBy("value")
    same = Window.partitionBy(*keys, "value")
    everyone = Window.partitionBy(*keys)
    ranked = x.withColumns({"r": F.rank().over(order), "ties": F.count("*").over(same), "m": F.count("*").over(everyone)})
    shared = [k for k in keys if k in n.columns]
    pooled = ranked.join(n, shared) if shared else ranked.join(F.broadcast(n), F.lit(True))  # without keys n is one row
    return pooled.withColumn("rank", F.col("n_pool") - F.col("m") + F.col("r") + (F.col("ties") - 1) / 2)


def _log2fc(group: str, rest: str, epsilon: float, logged: bool):
    g, r = (F.expm1(F.col(c)) if logged else F.col(c) for c in (group, rest))
    return F.log2((g + epsilon) / (r + epsilon))


def ranked_counts(x: DataFrame, keys: list[str], by: str) -> DataFrame:
    """One row a (keys, value, by) with its count k; over keys: the value's count t, the entries before it, and all entries m.

    The counts are added up before the shuffle, so a key that holds a large share of all entries isn't gathered entry by
    entry; the windows then run over distinct values, in one clustering by the keys.
    """
    fine = x.groupBy(*keys, "value", by).agg(F.count("*").alias("k"))
    upto = F.sum("k").over(Window.partitionBy(*keys).orderBy("value").rangeBetween(Window.unboundedPreceding, 0))
    t = F.sum("k").over(Window.partitionBy(*keys, "value"))
    return fine.withColumns({"t": t, "upto": upto, "m": F.sum("k").over(Window.partitionBy(*keys))}).withColumn("before", F.col("upto") - F.col("t")).drop("upto")


def rank_sum(d: Dataset, by: str, tie_correct: bool = False, logged: bool = False, strata: tuple[str, ...] = (), min_cells: int = 1) -> DataFrame:
    """Wilcoxon rank-sum of each group against all other cells, for every expressed gene: z, log2 fold change, means.

    Normal approximation without continuity correction; cells without a label join the rest. With strata (columns of
    cells), every stratum of at least min_cells cells is tested by itself.
    """
    keys = list(strata)
    labels = d.read_obs(by, *keys)
    if keys:
        kept = labels.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") >= min_cells)
        labels = labels.join(kept.select(*keys), keys, "left_semi")
    pool = labels.groupBy(*keys).agg(F.count("*").alias("n"))
    sizes = labels.filter(F.col(by).isNotNull()).groupBy(*keys, by).agg(F.count("*").alias("n1"))
    ranked = ranked_counts(d.matrix().join(labels, "cell_ix"), [*keys, "gene_ix"], by)
    t = F.col("t").cast("double")
    # ranks among the stored entries; the zeros before them are added below. Each of a value's t entries brings t^2 - 1.
    own = ranked.groupBy(*keys, "gene_ix", by).agg(
        F.sum((F.col("before") + (t + 1) / 2) * F.col("k")).alias("stored_w"), F.sum("k").alias("k"), F.sum(F.col("value") * F.col("k")).alias("s"),
        F.sum(F.col("k") * (t * t - 1)).alias("tie_part"), F.first("m").alias("m"),
    )
    own = materialize(own, "rank-sums")  # genes x groups rows, read twice below
    per_gene = own.groupBy(*keys, "gene_ix").agg(F.first("m").alias("m"), F.sum("s").alias("all_sum"), F.sum("tie_part").alias("tie_stored"))
    per_gene = per_gene.join(pool, keys) if keys else per_gene.join(F.broadcast(pool), F.lit(True))  # without strata one row
    own = own.filter(F.col(by).isNotNull()).select(*keys, by, "gene_ix", "stored_w", "k", "s")
    grid = per_gene.join(sizes, keys) if keys else per_gene.crossJoin(sizes)  # genes x groups, the size of the result
    out = grid.join(own, [*keys, by, "gene_ix"], "left")
    out = out.withColumn("w", F.col("stored_w") + (F.col("n") - F.col("m")) * F.col("k"))
    zero = F.lit(0.0)
    z0 = F.col("n") - F.col("m")
    w = F.coalesce("w", zero) + (F.col("n1") - F.coalesce("k", F.lit(0))) * (z0 + 1) / 2
    n, n1 = F.col("n").cast("double"), F.col("n1").cast("double")
    n2 = n - n1
    tie = F.col("tie_stored") + z0.cast("double") * z0 * z0 - z0
    spread = n1 * n2 / 12 * (n + 1 - (tie / F.nullif(n * (n - 1), zero) if tie_correct else zero))
    z = F.try_divide(w - n1 * (n + 1) / 2, F.sqrt(F.when(spread > 0, spread)))
    out = out.withColumns({"z": z, "mean_group": F.coalesce("s", zero) / n1, "mean_rest": F.try_divide(F.col("all_sum") - F.coalesce("s", zero), n2)})
    return out.select(*keys, by, "gene_ix", F.col("z").alias("score"), _log2fc("mean_group", "mean_rest", 1e-9, logged).alias("logfoldchange"), "mean_group", "mean_rest")


def benjamini_hochberg(tests: DataFrame, by: list[str], p: str = "pval", tie: str = "gene_ix") -> DataFrame:
    """tests with pval_adj: p n / rank, made monotone from the largest p down, at most 1."""
    w = Window.partitionBy(*by)
    up = w.orderBy(p, tie)
    out = tests.withColumns({"_rn": F.row_number().over(up), "_n": F.count("*").over(w)})
    down = w.orderBy(F.desc("_rn")).rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("pval_adj", F.least(F.lit(1.0), F.min(F.col(p) * F.col("_n") / F.col("_rn")).over(down))).drop("_rn", "_n")


def rank_genes_groups(d: Dataset, by: str, tie_correct: bool = False, logged: bool = False, by_abs: bool = False, strata: tuple[str, ...] = (), min_cells: int = 50, groups: list | None = None, pts: bool = False) -> DataFrame:
    """rank_sum with p, adjusted p and each group's ranking (score descending, ties to the smaller gene, missing last)."""
    tests = rank_sum(d, by, tie_correct, logged, strata, min_cells)
    if groups is not None:
        tests = tests.filter(F.col(by).isin(groups))
    if pts:
        from lattica.operators.aggregates import expressing_fractions

        tests = tests.join(expressing_fractions(d, by), [by, "gene_ix"], "left")
    tests = benjamini_hochberg(tests.withColumn("pval", two_sided_p("score")), [*strata, by])
    key = F.abs("score") if by_abs else F.col("score")
    place = F.row_number().over(Window.partitionBy(*strata, by).orderBy(key.desc_nulls_last(), "gene_ix"))
    return tests.withColumn("rank", place.cast("long"))


def pairwise_reference(d: Dataset, by: str, reference: str, epsilon: float = 1e-9, geometric: bool = True, cpm_filter: float | None = None) -> DataFrame:
    """Each group against the reference group only: U, z with continuity and tie correction, means, fold and percent change.

    The pool of a test is the group and the reference; ranks are taken over distinct values with their counts.
    cpm_filter keeps genes above that many counts per million in the target or in the reference.
    """
    labels = d.read_obs(by).filter(F.col(by).isNotNull())
    sizes = labels.groupBy(by).agg(F.count("*").alias("n1"))
    ref_n = sizes.filter(F.col(by) == reference).select(F.col("n1").alias("n2"))
    targets = sizes.filter(F.col(by) != reference).join(F.broadcast(ref_n), F.lit(True))  # ref_n is one row
    counted = d.matrix().join(labels, "cell_ix").groupBy("gene_ix", "value", by).agg(F.count("*").alias("k"))
    # the reference's entries are cumulated once a gene; every target looks its values up in them
    is_ref, k = F.col(by) == reference, F.col("k")
    of_ref = F.when(is_ref, k).otherwise(F.lit(0).cast("long"))
    same = F.sum(of_ref).over(Window.partitionBy("gene_ix", "value"))
    upto = F.sum(of_ref).over(Window.partitionBy("gene_ix").orderBy("value").rangeBetween(Window.unboundedPreceding, 0))
    placed = counted.withColumns({"b": same, "upto": upto})
    mid = F.log1p("value") if geometric else F.col("value")
    b, a = F.col("b").cast("double"), k.cast("double")
    cube = lambda t: t * t * t - t
    per = placed.groupBy("gene_ix", F.col(by).alias("target")).agg(
        F.sum(a * (F.col("upto") - b / 2)).alias("above"), F.sum("k").alias("k"), F.sum(mid * k).alias("s1"),
        F.sum(cube(a + b) - cube(b)).alias("tie_more"), F.sum(cube(a)).alias("tie_own"),
    )
    per = materialize(per, "pair-sums")  # genes x groups rows, read for the targets and for the reference
    own = per.filter(F.col("target") != reference).drop("tie_own")
    ref = per.filter(F.col("target") == reference).select("gene_ix", F.col("k").alias("m"), F.col("s1").alias("s2"), F.col("tie_own").alias("tie_ref"))
    # genes of either side; targets x genes is the size of the result
    pairs = ref.select("gene_ix").crossJoin(targets.select(F.col(by).alias("target"))).unionByName(own.select("gene_ix", "target")).distinct()
    got = pairs.join(own, ["gene_ix", "target"], "left").join(ref, "gene_ix", "left").join(F.broadcast(targets.withColumnRenamed(by, "target")), "target").na.fill(0, ["above", "k", "s1", "tie_more", "m", "s2", "tie_ref"])
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    zero_ref, zero_own = n2 - F.col("m"), n1 - F.col("k")
    u = F.col("above") + F.col("k") * zero_ref + zero_own * zero_ref / 2
    z0 = zero_ref + zero_own
    tie = F.col("tie_ref") + F.col("tie_more") + cube(z0)
    spread = n1 * n2 / 12 * (n + 1 - tie / (n * (n - 1)))
    top = F.greatest(u, n1 * n2 - u)
    z = F.try_divide(top - n1 * n2 / 2 - 0.5, F.sqrt(F.when(spread > 0, spread)))
    back = F.expm1 if geometric else (lambda c: c)
    t, r = back(F.col("s1") / n1), back(F.col("s2") / n2)
    fold = F.log2((t + epsilon) / (r + epsilon))
    if cpm_filter is not None:
        depth = d.matrix().join(labels, "cell_ix").groupBy(F.col(by).alias("target")).agg(F.sum("value").alias("depth"))
        base = depth.filter(F.col("target") == reference).select(F.col("depth").alias("ref_depth"))
        sums = counted.groupBy(F.col(by).alias("target"), "gene_ix").agg(F.sum(F.col("value") * F.col("k")).alias("total"))
        refs = sums.filter(F.col("target") == reference).select("gene_ix", F.col("total").alias("ref_total"))
        got = got.join(sums, ["target", "gene_ix"], "left").join(refs, "gene_ix", "left").join(depth, "target").join(F.broadcast(base), F.lit(True))  # base is one row
        cpm = lambda a, b: 1e6 * F.coalesce(a, F.lit(0.0)) / F.col(b)
        got = got.filter((cpm("total", "depth") > cpm_filter) | (cpm("ref_total", "ref_depth") > cpm_filter))
    return got.select("target", "gene_ix", u.alias("statistic"), z.alias("z"), t.alias("target_mean"), r.alias("reference_mean"), F.nanvl(fold, F.lit(0.0)).alias("fold_change"), ((t - r) / (r + epsilon)).alias("percent_change"))


def extract(tests: DataFrame, pval_cutoff: float | None = None, log2fc_min: float | None = None, log2fc_max: float | None = None) -> DataFrame:
    """Rows of a ranking within the bounds."""
    if pval_cutoff is not None:
        tests = tests.filter(F.col("pval_adj") < pval_cutoff)
    if log2fc_min is not None:
        tests = tests.filter(F.col("logfoldchange") > log2fc_min)
    return tests if log2fc_max is None else tests.filter(F.col("logfoldchange") < log2fc_max)
