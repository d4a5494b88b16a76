"""Evaluation metrics: perturbation effects, discrimination, distances, clustering agreement, knockdown, consensus."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.plans.dataset import Dataset


def effects(bulk: DataFrame, by: str, control: str) -> DataFrame:
    """Dense group means (by, gene_ix, value) minus the control's."""
    base = bulk.filter(F.col(by) == control).select("gene_ix", F.col("value").alias("base"))
    return bulk.filter(F.col(by) != control).join(base, "gene_ix").select(by, "gene_ix", "value", (F.col("value") - F.col("base")).alias("delta"))


def perturbation_metrics(real: DataFrame, pred: DataFrame, by: str, control: str) -> DataFrame:
    """Per perturbation: Pearson of effects, squared and absolute errors of means and of effects."""
    a = effects(real, by, control)
    b = effects(pred, by, control).withColumnsRenamed({"value": "pv", "delta": "pd"})
    j = a.join(b, [by, "gene_ix"])
    e, f = F.col("value") - F.col("pv"), F.col("delta") - F.col("pd")
    # means of products, so that a constant vector gives null
    n = F.count("*")
    mx, my = F.avg("delta"), F.avg("pd")
    cov = F.avg(F.col("delta") * F.col("pd")) - mx * my
    vx, vy = F.avg(F.col("delta") * F.col("delta")) - mx * mx, F.avg(F.col("pd") * F.col("pd")) - my * my
    corr = F.when((vx > 1e-18) & (vy > 1e-18), cov / F.sqrt(F.when(vx * vy > 0, vx * vy)))
    return j.groupBy(by).agg(n.alias("n_genes"), corr.alias("pearson_delta"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.avg(f * f).alias("mse_delta"), F.avg(F.abs(f)).alias("mae_delta"))


def discrimination(real: DataFrame, pred: DataFrame, by: str, control: str, metric: str = "l1", exclude: DataFrame | None = None) -> DataFrame:
    """1 - rank / P, where rank counts the real effects nearer to a predicted effect than its own; ties by name.

    metric: l1, l2 or cosine (1 where an effect is zero). exclude (by, gene_ix): genes left out of a prediction's own
    comparisons, such as its target. A prediction that is left without genes is an error.
    """
    a = effects(real, by, control).select(F.col(by).alias("other"), "gene_ix", "delta")
    b = effects(pred, by, control).select(by, "gene_ix", F.col("delta").alias("pd"))
    if exclude is not None:
        kept = b.join(exclude.select(by, "gene_ix"), [by, "gene_ix"], "left_anti")
        if not b.select(by).distinct().join(kept.select(by).distinct(), by, "left_anti").isEmpty():
            raise ValueError("a prediction has no genes left")
        b = kept
    p, d = F.col("pd"), F.col("delta")
    norm = F.sqrt(F.sum(p * p) * F.sum(d * d))
    far = {"l1": F.sum(F.abs(p - d)), "l2": F.sqrt(F.sum((p - d) * (p - d))), "cosine": F.when(norm > 0, 1 - F.sum(p * d) / norm).otherwise(F.lit(1.0))}[metric]
    gaps = b.join(a, "gene_ix").groupBy(by, "other").agg(F.round(far, 9).alias("dist"))
    w = Window.partitionBy(by)
    place = F.row_number().over(w.orderBy("dist", "other")) - 1
    return gaps.withColumns({"place": place, "p": F.count("*").over(w)}).filter(F.col(by) == F.col("other")).select(by, F.col("place").cast("long").alias("rank"), (1 - F.col("place") / F.col("p")).alias("score"))


def distance(a: Column, b: Column, metric: str) -> Column:
    """Distance of two array columns: euclidean, l1 or cosine (1 - cos; 1 if either is zero)."""
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda x, y: x + y)
    if metric == "l1":
        return total(F.zip_with(a, b, lambda x, y: F.abs(x - y)))
    if metric == "euclidean":
        return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))
    dot = total(F.zip_with(a, b, lambda x, y: x * y))
    norm = F.sqrt(total(F.transform(a, lambda x: x * x)) * total(F.transform(b, lambda x: x * x)))
    return F.when(norm > 0, 1 - dot / norm).otherwise(F.lit(1.0))


def masked_distance(a: Column, b: Column, mask: Column, metric: str) -> Column:
    """Distance over the places where a mask (array of booleans) is true."""
    pick = lambda v: F.transform(F.filter(F.arrays_zip(v.alias("v"), mask.alias("m")), lambda e: e["m"]), lambda e: e["v"])
    return distance(pick(a), pick(b), metric)


def group_distances(points: DataFrame, by: str, block: int = 2048, control=None) -> DataFrame:
    """For every two groups the mean Euclidean distance of their points (a point with itself counts as 0); with a control,
    only for each group with itself and with the control.

    Groups are cut into blocks of about `block` points; each pair of blocks is one task's matrix product, and only sums
    leave it. The cut is by a row number that is written once, so every read and every retry sees the same blocks.
    points: by, vec.
    """
    from lattica.sources.shared import materialize, ship

    ship(points.sparkSession)
    rows = materialize(points.select(by, "vec").withColumn("_row", F.monotonically_increasing_id()), "distances")
    sizes = rows.groupBy(by).agg(F.count("*").alias("n"))
    cut = rows.join(F.broadcast(sizes), by).withColumn("part", F.pmod(F.xxhash64("_row"), F.ceil(F.col("n") / block)))
    blocks = materialize(cut.groupBy(by, "part").agg(F.collect_list("vec").alias("vecs"), F.first("n").alias("n")), "distance-blocks")
    a = blocks.select(F.col(by).alias("a"), F.col("part").alias("pa"), F.col("vecs").alias("va"), F.col("n").alias("na"))
    b = blocks.select(F.col(by).alias("b"), F.col("part").alias("pb"), F.col("vecs").alias("vb"), F.col("n").alias("nb"))
    pairs = a.join(b, (F.col("a") == F.col("b")) & (F.col("pa") <= F.col("pb")))
    if control is None:
        pairs = pairs.unionByName(a.join(b, F.col("a") < F.col("b")))
    else:
        pairs = pairs.unionByName(a.filter(F.col("a") != control).join(b.filter(F.col("b") == control), F.lit(True)))  # the control's blocks

    def work(batches):
        import pandas as pd

        for t in batches:
            out = []
            for r in t.itertuples(index=False):
                x, y = np.stack(r.va).astype(float), np.stack(r.vb).astype(float)
                sq = np.maximum(0, (x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T)
                if r.a == r.b and r.pa == r.pb:
                    np.fill_diagonal(sq, 0)
                total = float(np.sqrt(sq).sum()) * (2 if r.a == r.b and r.pa != r.pb else 1)
                out.append((r.a, r.b, total / (r.na * r.nb)))
            yield pd.DataFrame(out, columns=["a", "b", "part"])

    kind = f"a {points.schema[by].dataType.simpleString()}, b {points.schema[by].dataType.simpleString()}, part double"
    return pairs.mapInPandas(work, kind).groupBy("a", "b").agg(F.sum("part").alias("mean_distance"))


def energy_distance_details(points: DataFrame, by: str, control) -> DataFrame:
    """Of every other group: the mean distance to the control, within itself and within the control, and
    2 D(group, control) - D(group, group) - D(control, control)."""
    d = group_distances(points, by, control=control)
    own = d.filter("a = b").select(F.col("a").alias(by), F.col("mean_distance").alias("within"))
    base = own.filter(F.col(by) == control).select(F.col("within").alias("within_control"))
    across = d.filter(F.col("a") != F.col("b")).select(F.col("a").alias(by), F.col("mean_distance").alias("across"))
    out = across.join(own, by).join(F.broadcast(base), F.lit(True))  # base is one row
    return out.select(by, "across", "within", "within_control", (2 * F.col("across") - F.col("within") - F.col("within_control")).alias("energy_distance"))


def energy_distance(points: DataFrame, by: str, control) -> DataFrame:
    """2 D(group, control) - D(group, group) - D(control, control) of every other group."""
    return energy_distance_details(points, by, control).select(by, "energy_distance")


def energy_agreement(real: DataFrame, pred: DataFrame, by: str, control) -> DataFrame:
    """One row: Pearson correlation of the groups' energy distances in real and predicted points."""
    a, b = energy_distance(real, by, control), energy_distance(pred, by, control).withColumnRenamed("energy_distance", "other")
    return a.join(b, by).agg(F.count("*").alias("n_groups"), F.corr("energy_distance", "other").alias("pearson"))


def contingency(labels: DataFrame, a: str, b: str) -> DataFrame:
    return labels.groupBy(a, b).agg(F.count("*").alias("n"))


def mutual_information(labels: DataFrame, a: str, b: str) -> DataFrame:
    """One row: mutual information, both entropies, NMI (arithmetic mean; 1 if both are one cluster), ARI."""
    t = contingency(labels, a, b)
    rows, cols = t.groupBy(a).agg(F.sum("n").alias("na")), t.groupBy(b).agg(F.sum("n").alias("nb"))
    total = t.agg(F.sum("n").alias("nn"))
    j = t.join(rows, a).join(cols, b).join(F.broadcast(total), F.lit(True))
    pair = lambda c: F.col(c) * (F.col(c) - 1) / 2
    mi = j.agg(F.sum(F.col("n") / F.col("nn") * F.log(F.col("n").cast("double") * F.col("nn") / (F.col("na").cast("double") * F.col("nb")))).alias("mi"), F.sum(pair("n")).alias("both"), F.first("nn").alias("nn"))
    h = lambda f, c: f.join(F.broadcast(total), F.lit(True)).agg(F.sum(-F.col(c) / F.col("nn") * F.log(F.col(c) / F.col("nn"))).alias(f"h_{c}"), F.sum(pair(c)).alias(f"pairs_{c}"))
    one = mi.join(h(rows, "na"), F.lit(True)).join(h(cols, "nb"), F.lit(True))
    mean = (F.col("h_na") + F.col("h_nb")) / 2
    pairs = F.col("nn") * (F.col("nn") - 1) / 2
    chance = F.col("pairs_na") * F.col("pairs_nb") / pairs
    top = (F.col("pairs_na") + F.col("pairs_nb")) / 2
    return one.select(
        F.greatest(F.col("mi"), F.lit(0.0)).alias("mutual_information"), F.col("h_na").alias("entropy_a"), F.col("h_nb").alias("entropy_b"),
        F.when(mean > 0, F.greatest(F.col("mi"), F.lit(0.0)) / mean).otherwise(1.0).alias("nmi"),
        F.when(top != chance, (F.col("both") - chance) / (top - chance)).otherwise(1.0).alias("ari"),
    )


def adjusted_mutual_information(labels: DataFrame, a: str, b: str) -> float:
    """AMI with the arithmetic mean; the expectation runs over the two margins (one number a cluster)."""
    t = contingency(labels, a, b).toPandas()
    if not len(t):
        return 0.0
    ra, rb = t.groupby(a)["n"].sum().to_numpy(), t.groupby(b)["n"].sum().to_numpy()
    n = int(ra.sum())
    if len(ra) == len(rb) == 1:
        return 1.0
    lg = math.lgamma
    expected = 0.0
    for x in ra:
        for y in rb:
            for k in range(max(1, x + y - n), min(x, y) + 1):
                p = math.exp(lg(x + 1) + lg(y + 1) + lg(n - x + 1) + lg(n - y + 1) - lg(n + 1) - lg(k + 1) - lg(x - k + 1) - lg(y - k + 1) - lg(n - x - y + k + 1))
                expected += k / n * math.log(n * k / (x * y)) * p
    na, nb = t.groupby(a)["n"].transform("sum"), t.groupby(b)["n"].transform("sum")
    mi = float((t["n"] / n * np.log(t["n"] * n / (na.astype(float) * nb))).sum())
    h = lambda v: -float((v / n * np.log(v / n)).sum())
    mean = (h(ra) + h(rb)) / 2
    return (mi - expected) / (mean - expected) if mean != expected else 1.0


def knockdown(d: Dataset, by: str, control: str, targets: DataFrame, epsilon: float = 1e-9) -> DataFrame:
    """Per cell: 1 - x_target / (control mean + eps) of its perturbation's target gene; control cells have none.

    targets: by, gene_ix.
    """
    labels = d.read_obs(by)
    n = labels.filter(F.col(by) == control).agg(F.count("*").alias("n"))
    base = d.matrix().join(labels.filter(F.col(by) == control), "cell_ix", "left_semi").groupBy("gene_ix").agg(F.sum("value").alias("s"))
    t = targets.join(base, "gene_ix", "left").join(F.broadcast(n), F.lit(True)).select(by, "gene_ix", (F.coalesce("s", F.lit(0.0)) / F.col("n")).alias("mu"))
    cells = labels.filter(F.col(by) != control).join(t, by)
    out = cells.join(d.matrix(), ["cell_ix", "gene_ix"], "left")
    x = F.coalesce("value", F.lit(0.0))
    return out.select("cell_ix", by, (1 - x / (F.col("mu") + epsilon)).alias("efficiency"), (F.log1p(x) - F.log1p("mu")).alias("log_deviation"))


def vote_consensus(votes: list[Column], method: str = "majority") -> Column:
    """Doublet votes of several tools (nullable booleans): null if none voted; a tie is False."""
    yes = sum((F.coalesce(v.cast("int"), F.lit(0)) for v in votes), F.lit(0))
    said = sum((v.isNotNull().cast("int") for v in votes), F.lit(0))
    decided = {"majority": yes * 2 > said, "any": yes > 0, "all": yes == said}[method]
    return F.when(said > 0, decided)


def mean_rank(frame: DataFrame, scores: list[str], key: str = "cell_ix") -> DataFrame:
    """Each tool's scores as percent ranks among the cells it covers, averaged over the tools that cover a cell."""
    out = frame
    for s in scores:
        w = Window.partitionBy(F.col(s).isNull()).orderBy(s)
        out = out.withColumn(f"_{s}", F.when(F.col(s).isNotNull(), F.percent_rank().over(w)))
    ranks = [F.col(f"_{s}") for s in scores]
    total = sum((F.coalesce(r, F.lit(0.0)) for r in ranks), F.lit(0.0))
    said = sum((r.isNotNull().cast("int") for r in ranks), F.lit(0))
    return out.select(key, F.when(said > 0, total / said).alias("mean_rank"))
