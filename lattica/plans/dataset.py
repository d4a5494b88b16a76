"""The annotated sparse matrix as relations, and its binding to the warehouse tables."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.sources.shared import ship


def canonical(coo: DataFrame) -> DataFrame:
    """Coordinates with duplicates summed and zeros dropped: each (cell, gene) at most once, dealt by cell.

    The rows are shuffled by cell alone, which groups by (cell, gene) as well: what follows per cell (depths, joins with
    cells) needs no other shuffle. An entry that a cell repeats often is added up after the shuffle.
    """
    return coo.repartition("cell_ix").groupBy("cell_ix", "gene_ix").agg(F.sum("value").alias("value")).filter("value <> 0")


@dataclass(frozen=True)
class Dataset:
    """Cells (obs, key cell_ix), genes (var, key gene_ix) and values (x: cell_ix, gene_ix, value; absent means 0).

    All members are lazy. layers have x's shape; obsm/varm map names to (key, vec); obsp to (src, dst, weight).
    tombstones (cell_ix) marks logically deleted cells, which every reader leaves out.
    """

    obs: DataFrame
    var: DataFrame
    x: DataFrame
    layers: dict[str, DataFrame] = field(default_factory=dict)
    obsm: dict[str, DataFrame] = field(default_factory=dict)
    obsp: dict[str, DataFrame] = field(default_factory=dict)
    varm: dict[str, DataFrame] = field(default_factory=dict)
    uns: dict = field(default_factory=dict)
    tombstones: DataFrame | None = None
    #: Coordinates that may repeat, of x (None) and of layers: where they are given, filters on keys run before the sums.
    raw: dict[str | None, DataFrame] = field(default_factory=dict)

    def __post_init__(self) -> None:
        ship(self.obs.sparkSession)  # operators in Python find the package wherever they run

    @property
    def spark(self) -> SparkSession:
        return self.obs.sparkSession

    def live(self, frame: DataFrame) -> DataFrame:
        """Rows of a cell-keyed frame whose cell isn't deleted."""
        return frame if self.tombstones is None else frame.join(self.tombstones, "cell_ix", "left_anti")

    def read_obs(self, *columns: str) -> DataFrame:
        frame = self.live(self.obs)
        return frame.select("cell_ix", *columns) if columns else frame

    def read_var(self, *columns: str) -> DataFrame:
        return self.var.select("gene_ix", *columns) if columns else self.var

    def matrix(self, layer: str | None = None) -> DataFrame:
        return self.live(self.x if layer is None else self.layers[layer])

    def selected(self, layer: str | None = None, cells: DataFrame | None = None, genes: DataFrame | None = None) -> DataFrame:
        """Values of some cells and genes (frames with their keys). Key filters commute with the sum of duplicates, so they
        reach the source where raw coordinates are known."""
        source = self.raw.get(layer)
        out = self.matrix(layer) if source is None else source
        if genes is not None:
            out = out.join(genes.select("gene_ix"), "gene_ix", "left_semi")
        if cells is not None:
            out = out.join(cells.select("cell_ix"), "cell_ix", "left_semi")
        elif source is not None:
            out = self.live(out)
        return out if source is None else canonical(out)

    def query(self):
        from lattica.plans.query import Query

        return Query(self)

    def with_x(self, x: DataFrame) -> Dataset:
        return replace(self, x=x, raw={k: v for k, v in self.raw.items() if k is not None})


def bind(spark: SparkSession, sf_dir: str) -> Dataset:
    """Orders as cells, parts as genes, summed line quantities as values; a second layer sums prices."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    nation = read("nation").select("n_nationkey", "n_name")
    customer = read("customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    obs = (
        read("orders").join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(F.col("o_orderkey").alias("cell_ix"), "o_orderstatus", "o_orderpriority", "o_totalprice", "o_orderdate", "c_mktsegment", "n_name")
    )
    var = read("part").select(F.col("p_partkey").alias("gene_ix"), F.concat(F.lit("g"), F.col("p_partkey").cast("string")).alias("gene_id"), "p_name", "p_brand", "p_type", "p_size")
    line = read("lineitem")
    key = F.col("l_orderkey").alias("cell_ix"), F.col("l_partkey").alias("gene_ix")
    raw = {None: line.select(*key, F.col("l_quantity").alias("value")), "price": line.select(*key, F.col("l_extendedprice").alias("value"))}
    emb = read("embeddings").select(F.col("vec_id").alias("cell_ix"), F.col("embedding").cast("array<double>").alias("vec"), F.col("label").alias("label"))
    return Dataset(obs, var, canonical(raw[None]), layers={"price": canonical(raw["price"])}, obsm={"X_emb": emb}, raw=raw)
