"""The lazy query builder: predicates on cells and genes, projection, normalisation, limit, terminal reads."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.plans.dataset import Dataset, canonical
from lattica.plans.predicate import compile_predicate


class UnknownNames(KeyError):
    """Names that the axis doesn't have."""


@dataclass(frozen=True)
class Query:
    """Order of evaluation: cells by predicate and deletion, genes by projection, normalise over the projected genes,
    log1p, limit. Nothing runs before a terminal read."""

    data: Dataset
    obs_where: tuple[Column, ...] = ()
    var_where: tuple[Column, ...] = ()
    genes: tuple[str, ...] | None = None
    target: float | None = None
    log: bool = False
    first: int | None = None
    layer: str | None = None
    gene_key: str = "gene_id"

    def filter_obs(self, text: str, null_mode: str = "sql") -> Query:
        return replace(self, obs_where=(*self.obs_where, compile_predicate(text, self.data.obs.schema, null_mode)))

    def filter_var(self, text: str, null_mode: str = "sql") -> Query:
        return replace(self, var_where=(*self.var_where, compile_predicate(text, self.data.var.schema, null_mode)))

    def select_genes(self, names: list[str], check: bool = True) -> Query:
        """In the order asked for; a name asked for twice counts once, where it first stands."""
        names = list(dict.fromkeys(names))
        if check and names:
            known = {r[0] for r in self.data.var.filter(F.col(self.gene_key).isin(names)).select(self.gene_key).collect()}  # at most the names given
            if missing := [n for n in names if n not in known]:
                raise UnknownNames(missing)
        return replace(self, genes=tuple(names))

    def from_layer(self, name: str) -> Query:
        return replace(self, layer=name)

    def with_normalize(self, target_sum: float) -> Query:
        return replace(self, target=float(target_sum))

    def with_log1p(self) -> Query:
        return replace(self, log=True)

    def limit(self, n: int) -> Query:
        if n < 0:
            raise ValueError("a limit can't be negative")
        return replace(self, first=n)

    # ---- parts of the plan

    def matching(self) -> DataFrame:
        """All matching live cells, whatever the limit."""
        out = self.data.read_obs()
        for c in self.obs_where:
            out = out.filter(c)
        return out

    def cells(self) -> DataFrame:
        """Matching live cells, the first n in physical order if limited."""
        out = self.matching()
        return out if self.first is None else out.orderBy("cell_ix").limit(self.first)

    def selected_var(self) -> DataFrame:
        """Selected genes with their order (ord)."""
        out = self.data.var
        for c in self.var_where:
            out = out.filter(c)
        if self.genes is None:
            return out.withColumn("ord", F.col("gene_ix").cast("long"))
        wanted = self.data.spark.createDataFrame([(n, i) for i, n in enumerate(self.genes)], f"{self.gene_key} string, ord long")
        return out.join(F.broadcast(wanted), self.gene_key)

    def x(self) -> DataFrame:
        """cell_ix, gene_ix, value of the selection, transformed as asked."""
        genes = self.selected_var() if self.genes is not None or self.var_where else None
        cells = self.cells() if self.obs_where or self.first is not None or self.data.tombstones is not None else None
        out = self.data.selected(self.layer, cells, genes)
        if self.target is not None:
            # rows are dealt by cell already: the window over cells needs no shuffle
            depth = F.sum("value").over(Window.partitionBy("cell_ix"))
            out = out.withColumn("value", F.when(depth > 0, F.col("value") * F.lit(self.target) / depth).otherwise(F.col("value")))
        if self.log:
            out = out.withColumn("value", F.log1p("value"))
        return out.select("cell_ix", "gene_ix", "value")

    # ---- terminal reads

    def collect(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """x, cells and genes of the selection, all lazy."""
        return self.x(), self.cells(), self.selected_var()

    def collect_as(self, kind: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        """collect with exact whole values of a narrower type (int or long). A transform on the way, a value that isn't
        whole, or one beyond the type's range is an error."""
        if self.target is not None or self.log:
            raise ValueError("values are exact only without normalisation and logarithm")
        top = {"int": (1 << 31) - 1, "long": (1 << 53)}[kind]
        v = F.col("value")
        wrong = F.raise_error(F.concat(F.lit("a value isn't whole or too large: "), v.cast("string")))
        x = self.x().withColumn("value", F.when((v == F.floor(v)) & (F.abs(v) <= top), v.cast(kind)).otherwise(wrong.cast(kind)))
        return x, self.cells(), self.selected_var()

    def count(self) -> int:
        """Matching cells; a limit doesn't change it, and x isn't read."""
        return self.matching().count()

    def exists(self) -> bool:
        return not self.matching().isEmpty()

    def read_row_range(self, start: int, stop: int) -> DataFrame:
        """Values of the cells in [start, stop); a negative or turned range is an error."""
        if start < 0 or stop < start:
            raise ValueError(f"[{start}, {stop}) isn't a range of rows")
        inside = (F.col("cell_ix") >= start) & (F.col("cell_ix") < stop)
        source = self.data.raw.get(self.layer)
        return self.data.matrix(self.layer).filter(inside) if source is None else canonical(self.data.live(source.filter(inside)))

    def group_labels(self, column: str) -> DataFrame:
        return self.data.read_obs(column).groupBy(column).agg(F.count("*").alias("n_cells"))

    def read_group(self, column: str, label: str) -> DataFrame:
        """Values of one group's cells; an unknown label is an error that names the closest labels."""
        own = self.data.read_obs(column).filter(F.col(column) == label)
        if own.isEmpty():
            near = suggest(self.data.read_obs(column), column, [label]).select("suggestion").collect()
            raise UnknownNames(f"no group {label!r}; did you mean {[r[0] for r in near]}?")
        return self.data.selected(self.layer, own)

    def read_reference(self, column: str, reference: str) -> DataFrame:
        """Values of the reference group's cells."""
        return self.read_group(column, reference)

    def iter_group_shards(self, column: str, reference: str, budget: int):
        """(labels, values) of one shard of groups after the other, the reference first, as group_shards plans them."""
        from lattica.operators.order import group_shards

        plan = group_shards(self.data, column, reference, budget).groupBy("shard").agg(F.array_sort(F.collect_list(column)).alias("labels"))
        for row in plan.orderBy("shard").collect():  # one row a shard
            cells = self.data.read_obs(column).filter(F.col(column).isin(row["labels"]))
            yield row["labels"], self.data.selected(self.layer, cells.select("cell_ix"))


def suggest(obs: DataFrame, column: str, wanted: list[str], n: int = 3) -> DataFrame:
    """wanted values that the column lacks, with the n closest ones it has (edit distance, then order)."""
    from pyspark.sql import Window

    have = obs.select(F.col(column).alias("suggestion")).filter("suggestion is not null").distinct()
    asked = obs.sparkSession.createDataFrame([(w,) for w in wanted], "wanted string")
    missing = asked.join(have, F.col("wanted") == F.col("suggestion"), "left_anti")
    # `wanted` has as many rows as the caller typed
    pairs = have.join(F.broadcast(missing), F.lit(True)).withColumn("distance", F.levenshtein("wanted", "suggestion").cast("long"))
    best = F.row_number().over(Window.partitionBy("wanted").orderBy("distance", "suggestion"))
    return pairs.withColumn("place", best.cast("long")).filter(F.col("place") <= n)
