"""A lazy handle on a matrix: chained transforms, aggregates through them, comparisons, indexing."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.operators import aggregates as A
from lattica.operators import transform as T
from lattica.plans.dataset import Dataset

_OWN = {0: "gene_ix", 1: "cell_ix"}  # axis 0 sums over cells, as scipy has it


@dataclass(frozen=True)
class Handle:
    """Values of a dataset under zero-preserving transforms; nothing runs before a result is read."""

    data: Dataset

    @classmethod
    def of(cls, d: Dataset, layer: str | None = None) -> Handle:
        return cls(d if layer is None else d.with_x(d.layers[layer]))

    @property
    def x(self) -> DataFrame:
        return self.data.matrix()

    def _map(self, x: DataFrame) -> Handle:
        return Handle(self.data.with_x(x))

    def __mul__(self, other: float) -> Handle:
        return self._map(T.elementwise(self.x, "multiply", float(other)))

    __rmul__ = __mul__

    def __truediv__(self, other: float) -> Handle:
        return self * (1 / other)

    def __add__(self, other: Handle) -> Handle:
        return self._map(T.add(self.x, other.x))

    def __sub__(self, other: Handle) -> Handle:
        return self._map(T.add(self.x, other.x, -1))

    def power(self, n: float) -> Handle:
        return self._map(T.elementwise(self.x, "power", float(n)))

    def log1p(self) -> Handle:
        return self._map(T.elementwise(self.x, "log1p"))

    def normalize_total(self, target_sum: float | None = None) -> Handle:
        return self._map(T.normalize_total(self.data, target_sum))

    def scale_rows(self, factors: DataFrame, factor: str, divide: bool = False) -> Handle:
        return self._map(T.row_scale(self.x, factors, factor, divide))

    def dot(self, weights: DataFrame) -> DataFrame:
        return T.matmul(self.x, weights)

    def _request(self, axis: str, key) -> DataFrame | None:
        """(ord, key) rows of an index: a frame, a slice, a list of places (negative ones from the end) or of booleans.
        Places are those of the sorted live keys."""
        if key is None or isinstance(key, DataFrame):
            return key
        from lattica.operators.order import with_position

        frame = self.data.read_obs().select(axis) if axis == "cell_ix" else self.data.var.select(axis)
        placed, n = with_position(frame, [axis]), frame.count()
        if isinstance(key, slice):
            start, stop, step = key.indices(n)
            inside = range(start, stop, step)
            if not len(inside):
                return placed.limit(0).select(F.col("position").alias("ord"), axis)
            low, high = min(inside[0], inside[-1]), max(inside[0], inside[-1])
            place = F.col("position")
            return placed.filter((place >= low) & (place <= high) & ((place - start) % step == 0)).select(((place - start) / step).cast("long").alias("ord"), axis)
        values = [key] if isinstance(key, int) and not isinstance(key, bool) else list(key)
        if values and all(isinstance(v, bool) for v in values):
            if len(values) != n:
                raise IndexError(f"a mask of {len(values)} for {n} places")
            values = [i for i, v in enumerate(values) if v]
        if wrong := [v for v in values if not -n <= v < n]:
            raise IndexError(f"no place {wrong[0]} among {n}")
        asked = frame.sparkSession.createDataFrame([(i, v % n) for i, v in enumerate(values)], "ord long, position long")
        return placed.join(F.broadcast(asked), "position").select("ord", axis)  # as many rows as the caller named

    def __getitem__(self, key) -> DataFrame:
        """X[rows, columns] in the order asked for: frames of (ord, cell_ix) and (ord, gene_ix), slices, masks, places."""
        rows, columns = key if isinstance(key, tuple) else (key, None)
        rows, columns = self._request("cell_ix", rows), self._request("gene_ix", columns)
        out = self.x
        if rows is not None:
            out = out.join(rows.select(F.col("ord").alias("row"), "cell_ix"), "cell_ix")
        if columns is not None:
            out = out.join(columns.select(F.col("ord").alias("column"), "gene_ix"), "gene_ix")
        return out.select(F.col("row" if rows is not None else "cell_ix").alias("row"), F.col("column" if columns is not None else "gene_ix").alias("column"), "value")

    def _axis(self, axis: int | None, column: Column, name: str) -> DataFrame:
        if axis is not None:
            return A.axis_stats(self.data, "gene" if axis == 0 else "cell").select(_OWN[axis], column.alias(name))
        raise ValueError("axis must be 0 or 1")

    def sum(self, axis: int | None = None) -> DataFrame:
        if axis is None:
            return self.x.agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("sum"))
        return self._axis(axis, F.col("sum"), "sum")

    def mean(self, axis: int) -> DataFrame:
        n = (self.data.read_obs() if axis == 0 else self.data.var).agg(F.count("*").alias("n"))
        return self.sum(axis).join(F.broadcast(n), F.lit(True)).select(_OWN[axis], (F.col("sum") / F.col("n")).alias("mean"))

    def var(self, axis: int) -> DataFrame:
        return self._axis(axis, F.col("var"), "var")

    def max(self, axis: int) -> DataFrame:
        return self._axis(axis, F.col("max"), "max")

    def min(self, axis: int) -> DataFrame:
        return self._axis(axis, F.col("min"), "min")

    def getnnz(self, axis: int) -> DataFrame:
        return self._axis(axis, F.col("nnz"), "nnz")

    def compare(self, op: str, value: float) -> Comparison:
        return Comparison(self.data, op, value)


@dataclass(frozen=True)
class Comparison:
    """A matrix compared with a number; only sums and counts of it are read, so absent entries need no rows."""

    data: Dataset
    op: str
    value: float

    def sum(self, axis: int) -> DataFrame:
        return A.count_where(self.data, "gene" if axis == 0 else "cell", self.op, self.value)


# ---- row-wise value modes of the tokenizers


def transform_values(x: DataFrame, mode: str, target: float = 1e4, alpha: float = 0.05) -> DataFrame:
    """pass_through, log1p_raw, normalize_log1p (by the row's own library) or pflog_raw."""
    v = F.greatest("value", F.lit(0.0))
    if mode == "normalize_log1p":
        lib = x.groupBy("cell_ix").agg(F.sum(v).alias("lib"))
        x = x.join(lib, "cell_ix")
        v = F.log1p(F.when(F.col("lib") > 0, v * target / F.col("lib")).otherwise(0.0))
    else:
        v = {"pass_through": v, "log1p_raw": F.log1p(v), "pflog_raw": F.log1p(4 * alpha * v)}[mode]
    return x.select("cell_ix", "gene_ix", v.alias("value"))


def measured_mask(frame: DataFrame, panel: DataFrame) -> DataFrame:
    """gene_ix with whether the panel measures it: absent and not measured aren't the same."""
    return frame.select("gene_ix").join(panel.select("gene_ix").distinct().withColumn("m", F.lit(True)), "gene_ix", "left").select("gene_ix", F.coalesce("m", F.lit(False)).alias("measured"))


def min_counts_mask(d: Dataset, least: float) -> DataFrame:
    """Cells whose total reaches a bound, for exports."""
    return A.axis_stats(d, "cell").filter(F.col("sum") >= least).select("cell_ix")


@dataclass(frozen=True)
class Modalities:
    """Several matrices over one cell axis; each has its own genes and values."""

    obs: DataFrame
    parts: dict[str, Dataset]

    def query(self, modality: str | None = None):
        if modality is None and len(self.parts) != 1:
            raise ValueError(f"name one of the modalities {sorted(self.parts)}")
        name = modality or next(iter(self.parts))
        if name not in self.parts:
            raise KeyError(f"no modality {name!r}; there are {sorted(self.parts)}")
        return replace(self.parts[name], obs=self.obs).query()

    def aligned(self) -> DataFrame:
        """cells in all modalities, with each modality's entries and total."""
        out = self.obs.select("cell_ix")
        for name, d in sorted(self.parts.items()):
            got = d.matrix().groupBy("cell_ix").agg(F.count("*").alias(f"{name}_n"), F.sum("value").alias(f"{name}_total"))
            out = out.join(got, "cell_ix")
        return out
