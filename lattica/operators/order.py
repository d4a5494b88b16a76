"""Sorts, positions, samples, set operations and the operations that change datasets."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.plans.dataset import Dataset


def sort_keys(by: list[str], reverse: bool = False) -> list[Column]:
    """Nulls first in both directions; reverse turns all keys."""
    return [F.col(c).desc_nulls_first() if reverse else F.col(c).asc_nulls_first() for c in by]


def with_position(frame: DataFrame, order: list, name: str = "position") -> DataFrame:
    """frame with each row's place (from 0) in a total order, without gathering all rows in one task.

    A range sort deals the rows; each partition numbers its own, and the sizes of the partitions before it (one number a
    partition) are added. The dealt rows are written in between: both reads must see the same partitions.
    """
    from lattica.sources.shared import materialize

    ordered = frame.sort(*order).withColumn("_part", F.spark_partition_id())
    local = materialize(ordered.withColumn("_in", F.monotonically_increasing_id() % F.lit(1 << 33)), "positions")
    sizes = local.groupBy("_part").agg(F.count("*").alias("_size"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return local.join(F.broadcast(before.select("_part", "_before")), "_part").withColumn(name, F.col("_before") + F.col("_in")).drop("_part", "_in", "_before")


def sort_cells(d: Dataset, by: list[str], reverse: bool = False) -> DataFrame:
    """cell_ix -> new_ix of the live cells in sorted order, stable by cell_ix."""
    return with_position(d.read_obs(*by), [*sort_keys(by, reverse), F.col("cell_ix").asc()], "new_ix").select("cell_ix", "new_ix", *by)


def group_shards(d: Dataset, by: str, reference: str, budget: int) -> DataFrame:
    """Group blocks (reference first, then by label) and their shards: a block is never split, a new shard starts after
    the reference or when the block would exceed the budget. One row a group, so the scan over them is small."""
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    sizes = d.read_obs(by).groupBy(by).agg(F.count("*").alias("n_cells"))
    kind = StructType([StructField(by, StringType()), StructField("n_cells", LongType()), StructField("shard", LongType())])

    def plan(groups):
        import pandas as pd

        for g in groups:
            g = g.assign(other=g[by] != reference).sort_values(["other", by])
            shard, used, was, out = -1, 0, None, []
            for label, n, other in zip(g[by], g["n_cells"], g["other"]):
                if shard < 0 or other != was or used + n > budget:
                    shard, used = shard + 1, 0
                used, was = used + n, other
                out.append((label, n, shard))
            yield pd.DataFrame(out, columns=[by, "n_cells", "shard"])

    return sizes.coalesce(1).mapInPandas(plan, kind)


def shuffle_cells(d: Dataset, seed: int) -> DataFrame:
    """A seeded permutation of the live cells: cell_ix -> new_ix."""
    return with_position(d.read_obs().select("cell_ix").withColumn("h", F.xxhash64("cell_ix", F.lit(seed))), ["h", "cell_ix"], "new_ix").select("cell_ix", "new_ix")


def _edges_of(edges: DataFrame, pair: DataFrame) -> DataFrame:
    """Edges whose both ends are in pair (cell_ix, new_ix), with the new keys."""
    a, b = pair.select(F.col("cell_ix").alias("src"), F.col("new_ix").alias("_s")), pair.select(F.col("cell_ix").alias("dst"), F.col("new_ix").alias("_d"))
    return edges.join(a, "src").join(b, "dst").drop("src", "dst").withColumnsRenamed({"_s": "src", "_d": "dst"}).select(*edges.columns)


def apply_order(d: Dataset, order: DataFrame) -> Dataset:
    """The dataset with cells renumbered by cell_ix -> new_ix; cells outside it go."""
    pair = order.select("cell_ix", "new_ix")
    move = lambda f: f.join(pair, "cell_ix").drop("cell_ix").withColumnRenamed("new_ix", "cell_ix")
    each = lambda m, f: {k: f(v) for k, v in m.items()}
    return replace(d, obs=move(d.obs), x=move(d.x), layers=each(d.layers, move), obsm=each(d.obsm, move), obsp=each(d.obsp, lambda e: _edges_of(e, pair)), tombstones=None, raw={})


def delete_cells(d: Dataset, where: Column) -> Dataset:
    """Marks cells as deleted; earlier marks stay."""
    new = d.obs.filter(where).select("cell_ix")
    return replace(d, tombstones=new if d.tombstones is None else d.tombstones.unionByName(new).distinct())


def compact(d: Dataset) -> Dataset:
    """Applies deletions and renumbers the live cells from 0 in their order."""
    return apply_order(d, with_position(d.read_obs().select("cell_ix"), ["cell_ix"], "new_ix"))


def subset(d: Dataset, obs_where: Column | None = None, var_where: Column | None = None) -> Dataset:
    """All members restricted to matching cells and genes, keys kept: values, layers, embeddings and loadings lose the rows
    of other cells and genes, graphs the edges with an end outside."""
    obs = d.read_obs() if obs_where is None else d.read_obs().filter(obs_where)
    var = d.var if var_where is None else d.var.filter(var_where)
    kept = obs.select("cell_ix")
    cells = lambda f: f.join(kept, "cell_ix", "left_semi")
    genes = lambda f: f.join(var.select("gene_ix"), "gene_ix", "left_semi")
    each = lambda m, f: {k: f(v) for k, v in m.items()}
    edges = lambda f: f.join(kept.withColumnRenamed("cell_ix", "src"), "src", "left_semi").join(kept.withColumnRenamed("cell_ix", "dst"), "dst", "left_semi").select(*f.columns)
    some = obs if obs_where is not None or d.tombstones is not None else None
    cut = lambda layer: d.selected(layer, some, None if var_where is None else var)
    return replace(
        d, obs=obs, var=var, x=cut(None), layers={k: cut(k) for k in d.layers}, obsm=each(d.obsm, cells), obsp=each(d.obsp, edges), varm=each(d.varm, genes), tombstones=None,
        raw=each(d.raw, lambda f: genes(cells(f))),
    )


def dry_run(d: Dataset, obs_where: Column | None = None, var_where: Column | None = None) -> DataFrame:
    """One row: cells, genes and stored values that a subset would keep, without making it."""
    cut = subset(d, obs_where, var_where)
    n = lambda f, name: f.agg(F.count("*").alias(name))
    return n(cut.obs, "n_cells").crossJoin(n(cut.var, "n_genes")).crossJoin(n(cut.x, "n_values"))  # single rows


class MergeError(ValueError):
    """Inputs don't agree in genes, columns or members."""


def merge(parts: list[Dataset], offsets: list[int], sort_by: list[str] | None = None, reverse: bool = False) -> Dataset:
    """Cells of all parts one after another, keys moved by the offsets; genes, obs columns and the names of all members
    must be the same. Graphs of the parts stay apart; gene loadings must agree; uns is the first part's, others must not
    hold another value under one of its keys. With sort_by the cells are renumbered from 0 in that order, as sort_cells
    has it, ties by moved key, then in order of the parts; there moved keys of different parts may be the same."""
    head = parts[0]
    differ = lambda a, b: not a.exceptAll(b).unionAll(b.exceptAll(a)).isEmpty()
    for p in parts[1:]:
        if p.obs.schema != head.obs.schema or p.var.columns != head.var.columns:
            raise MergeError("obs or var columns differ")
        for member in ("obsm", "layers", "obsp", "varm"):
            if set(getattr(p, member)) != set(getattr(head, member)):
                raise MergeError(f"names in {member} differ")
        if differ(p.var, head.var):
            raise MergeError("genes differ")
        if any(differ(p.varm[k], v) for k, v in head.varm.items()):
            raise MergeError("gene loadings differ")
        if any(p.uns[k] != v for k, v in head.uns.items() if k in p.uns):
            raise MergeError("uns differs")

    if sort_by is not None:  # each part gets its new keys by its own: moved ones may meet
        places = None
        for i, (p, o) in enumerate(zip(parts, offsets)):
            f = p.read_obs(*sort_by).withColumns({"_moved": F.col("cell_ix") + o, "_source": F.lit(i)})
            places = f if places is None else places.unionByName(f)
        places = with_position(places, [*sort_keys(sort_by, reverse), "_moved", "_source"], "new_ix").select("_source", "cell_ix", "new_ix")
        parts, offsets = [apply_order(p, places.filter(F.col("_source") == i)) for i, p in enumerate(parts)], [0] * len(parts)

    def stack(get, keys=("cell_ix",)):
        out = None
        for p, o in zip(parts, offsets):
            f = get(p)
            for k in keys:
                f = p.live(f.withColumnRenamed(k, "cell_ix")).withColumnRenamed("cell_ix", k) if p.tombstones is not None else f
                f = f.withColumn(k, F.col(k) + o)
            out = f if out is None else out.unionByName(f)
        return out

    return replace(
        head, obs=stack(lambda p: p.obs), x=stack(lambda p: p.x), tombstones=None, raw={}, uns={k: v for p in reversed(parts) for k, v in p.uns.items()},
        layers={k: stack(lambda p, k=k: p.layers[k]) for k in head.layers}, obsm={k: stack(lambda p, k=k: p.obsm[k]) for k in head.obsm},
        obsp={k: stack(lambda p, k=k: p.obsp[k], ("src", "dst")) for k in head.obsp},
    )


def carry_audit(before: Dataset, after: Dataset) -> DataFrame:
    """One row a named member (layers, obsm, obsp, varm, uns, and the columns of obs and var): whether an operation has
    kept, lost or added it."""
    of = lambda d: {("obs", c) for c in d.obs.columns} | {("var", c) for c in d.var.columns} | {(m, k) for m in ("layers", "obsm", "obsp", "varm", "uns") for k in getattr(d, m)}
    had, has = of(before), of(after)
    rows = [(m, k, "kept" if (m, k) in had & has else "lost" if (m, k) in had else "added") for m, k in sorted(had | has)]
    return before.spark.createDataFrame(rows, "member string, name string, status string")


def append(target: Dataset, source: Dataset) -> Dataset:
    """source's cells after target's: keys move past target's largest one."""
    top = target.obs.agg(F.coalesce(F.max("cell_ix"), F.lit(-1))).first()[0]
    return merge([target, source], [0, top + 1])


# ---- row sets: frames of half-open ranges (start, stop)


def ranges_of(rows: DataFrame, key: str = "cell_ix") -> DataFrame:
    """Row numbers as maximal ranges: rows whose number minus position agree are one run."""
    placed = with_position(rows.select(key).distinct(), [key])
    return placed.groupBy((F.col(key) - F.col("position")).alias("run")).agg(F.min(key).alias("start"), (F.max(key) + 1).alias("stop")).drop("run")


def rows_of(ranges: DataFrame, key: str = "cell_ix") -> DataFrame:
    return ranges.filter("stop > start").select(F.explode(F.sequence("start", F.col("stop") - 1)).alias(key))


def set_operation(a: DataFrame, b: DataFrame, op: str, key: str = "cell_ix") -> DataFrame:
    """union, intersect or difference of two sets of row numbers."""
    a, b = a.select(key), b.select(key)
    return {"union": lambda: a.union(b).distinct(), "intersect": lambda: a.intersect(b), "difference": lambda: a.subtract(b)}[op]()


def cut_points(frame: DataFrame, key: str, parts: int) -> DataFrame:
    """part, cut: the values of key that cut its rows into `parts` ranges of about equal size (no interpolation); a cut that
    repeats stays: one value holds more than a part."""
    shares = [i / parts for i in range(1, parts)]
    one = frame.agg(*[F.expr(f"percentile_disc({s!r}) WITHIN GROUP (ORDER BY {key})").alias(f"c{i}") for i, s in enumerate(shares, 1)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(i).alias("part"), F.col(f"c{i}").alias("cut")) for i in range(1, parts)])).alias("e")).select("e.*")


def take_first(rows: DataFrame, n: int, key: str = "cell_ix") -> DataFrame:
    """The n smallest row numbers of a set."""
    return rows.select(key).distinct().orderBy(key).limit(n)


def universe(n: int, spark, key: str = "cell_ix") -> DataFrame:
    """All row numbers below n."""
    return spark.range(n).select(F.col("id").alias(key))


def complement(rows: DataFrame, n: int, key: str = "cell_ix") -> DataFrame:
    """The row numbers below n that a set lacks."""
    return universe(n, rows.sparkSession, key).join(rows.select(key), key, "left_anti")


def top_k(x: DataFrame, k: int, pad: int | None = None) -> DataFrame:
    """Per cell the k largest values (value descending, gene ascending) as arrays, padded with id `pad` and value 0."""
    entry = F.struct((-F.col("value")).alias("v"), F.col("gene_ix").alias("g"))
    got = x.groupBy("cell_ix").agg(F.slice(F.array_sort(F.collect_list(entry)), 1, k).alias("e"))
    ids, values = F.transform("e", lambda s: s["g"]), F.transform("e", lambda s: -s["v"])
    if pad is not None:
        short = F.greatest(F.lit(0), k - F.size("e"))
        ids, values = F.concat(ids, F.array_repeat(F.lit(pad).cast("long"), short)), F.concat(values, F.array_repeat(F.lit(0.0), short))
    return got.select("cell_ix", ids.alias("ids"), values.alias("values"))
