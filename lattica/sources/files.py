"""File sources and sinks: MatrixMarket, annotation tables, in-memory matrices, optional HDF5 readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.plans.dataset import Dataset, canonical

#: Integers beyond this lose exactness in 32-bit floats, which MatrixMarket writers often use.
EXACT_FLOAT = 1 << 24


def read_mtx(spark: SparkSession, matrix: str, barcodes: str, features: str, allow_lossy: bool = False) -> Dataset:
    """genes x cells coordinates (1-based) with barcode and feature lists, one a line; lines are dealt to all tasks.

    The size line is the first that isn't a comment: it is told apart by holding the matrix's own extent.
    """
    lines = spark.read.text(matrix).filter(~F.col("value").startswith("%") & (F.trim("value") != ""))
    part = F.split(F.trim("value"), r"\s+")
    rows = lines.select(part[0].cast("long").alias("g"), part[1].cast("long").alias("c"), part[2].cast("double").alias("v"), F.monotonically_increasing_id().alias("line"))
    first = rows.agg(F.min("line").alias("l"))
    rows = rows.join(F.broadcast(first), F.lit(True)).filter("line <> l")  # one row
    x = canonical(rows.select((F.col("c") - 1).alias("cell_ix"), (F.col("g") - 1).alias("gene_ix"), F.col("v").alias("value")))
    if not allow_lossy and not x.filter((F.abs("value") > EXACT_FLOAT) & (F.floor("value") == F.col("value"))).isEmpty():
        raise ValueError("integers beyond 2^24; pass allow_lossy=True to read them")
    number = lambda path, key, name: spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), F.split("value", "\t")[0].alias(name)).transform(lambda f: _numbered(f, key)).select(key, name)
    return Dataset(number(barcodes, "cell_ix", "barcode"), number(features, "gene_ix", "gene_id"), x)


def _numbered(frame: DataFrame, name: str) -> DataFrame:
    from lattica.operators.order import with_position

    return with_position(frame, ["line"], name)


def write_mtx(d: Dataset, path: str) -> None:
    """A directory with matrix, barcodes and features text tables in order; keys must run from 0."""
    n, m, k = d.var.count(), d.read_obs().count(), d.matrix().count()
    head = d.spark.createDataFrame([(0, "%%MatrixMarket matrix coordinate real general"), (1, f"{n} {m} {k}")], "o long, line string").coalesce(1)
    body = d.matrix().select((F.col("cell_ix") + 2).alias("o"), F.concat_ws(" ", F.col("gene_ix") + 1, F.col("cell_ix") + 1, F.col("value")).alias("line"))
    head.unionByName(body).sort("o", "line").select(F.col("line").alias("value")).write.text(f"{path}/matrix")
    key = lambda f, c: [x for x in f.columns if x != c][0]
    d.read_obs().sort("cell_ix").select(F.col(key(d.obs, "cell_ix")).cast("string").alias("value")).write.text(f"{path}/barcodes")
    d.var.sort("gene_ix").select(F.col(key(d.var, "gene_ix")).cast("string").alias("value")).write.text(f"{path}/features")


def read_annotations(spark: SparkSession, path: str, delimiter: str | None = None) -> DataFrame:
    """A CSV or TSV table with a header; the delimiter is the commonest of tab, comma, semicolon in the header."""
    if delimiter is None:
        head = spark.read.text(path).first()
        delimiter = max("\t,;", key=(head[0] if head else "").count)
    return spark.read.option("sep", delimiter).csv(path, header=True, inferSchema=True)


def from_arrays(spark: SparkSession, obs, var, indptr, indices, data) -> Dataset:
    """A dataset from pandas tables and compressed rows held by the caller."""
    import numpy as np
    import pandas as pd

    cells = np.repeat(np.arange(len(indptr) - 1), np.diff(indptr))
    x = spark.createDataFrame(pd.DataFrame({"cell_ix": cells.astype("int64"), "gene_ix": np.asarray(indices, "int64"), "value": np.asarray(data, float)}))
    number = lambda t, key: spark.createDataFrame(t.reset_index(drop=True).assign(**{key: range(len(t))}))
    return Dataset(number(obs, "cell_ix"), number(var, "gene_ix"), canonical(x))


def to_arrays(x: DataFrame, n_cells: int):
    """Compressed rows (indptr, indices, data) on the driver: for results that fit there."""
    import numpy as np

    t = x.orderBy("cell_ix", "gene_ix").toPandas()
    indptr = np.zeros(n_cells + 1, np.int64)
    np.add.at(indptr, t["cell_ix"].to_numpy() + 1, 1)
    return np.cumsum(indptr), t["gene_ix"].to_numpy(), t["value"].to_numpy()


def read_h5(spark: SparkSession, path: str) -> Dataset:
    """AnnData-like HDF5 (X as compressed rows), read on the driver; needs h5py."""
    try:
        import h5py
    except ImportError as e:
        raise RuntimeError("HDF5 files need h5py, which isn't installed") from e
    import pandas as pd

    with h5py.File(path) as f:
        text = lambda g: pd.DataFrame({k: [v.decode() if isinstance(v, bytes) else v for v in g[k][:]] for k in g if isinstance(g[k], h5py.Dataset)})
        return from_arrays(spark, text(f["obs"]), text(f["var"]), f["X/indptr"][:], f["X/indices"][:], f["X/data"][:])


def _first_bytes(spark: SparkSession, path: str, n: int = 16) -> bytes:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(p)
    try:
        out = bytearray()
        while len(out) < n and (b := stream.read()) >= 0:
            out.append(b)
        return bytes(out)
    finally:
        stream.close()


def _names(spark: SparkSession, folder: str) -> list[str] | None:
    """The names in a folder, or None if it is a file."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(folder)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.getFileStatus(p).isDirectory() else None


def detect_format(path: str, spark: SparkSession | None = None) -> str:
    """The kind of a file or folder: by its content where a session is given (folders by what is in them, files by their
    first bytes), by its name otherwise. What an HDF5 file holds is told by its name either way."""
    named = "store"
    for end, kind in ((".h5ad", "h5ad"), (".h5mu", "h5mu"), (".h5", "10x"), (".mtx", "mtx"), (".mtx.gz", "mtx"), (".csv", "table"), (".tsv", "table"), (".csv.gz", "table"), (".tsv.gz", "table"), (".parquet", "parquet")):
        if path.rstrip("/").endswith(end):
            named = kind
            break
    if spark is None:
        return named
    inside = _names(spark, path)
    if inside is not None:
        if "_manifest" in inside:
            return "store"
        if any(n in inside for n in ("matrix.mtx", "matrix.mtx.gz")):
            return "10x-mtx"
        if any(n.endswith(".parquet") for n in inside):
            return "parquet"
        raise ValueError(f"no kind of dataset is in {path}: {inside[:10]}")
    head = _first_bytes(spark, path)
    if head.startswith(b"\x89HDF\r\n\x1a\n"):
        return named if named in ("h5ad", "h5mu", "10x") else "hdf5"
    if head.startswith(b"PAR1"):
        return "parquet"
    if head.startswith(b"%%MatrixMarket"):
        return "mtx"
    if head.startswith(b"\x1f\x8b"):
        return named if named in ("mtx", "table") else "gzip"
    return "table"


def read_10x(spark: SparkSession, folder: str, feature_type: str | None = None, allow_lossy: bool = False) -> Dataset:
    """A folder of matrix.mtx, barcodes.tsv and features.tsv (or genes.tsv), plain or gzipped.

    features have an id, a name and, in newer folders, a type; feature_type keeps the genes of one type, renumbered from 0.
    A gzipped matrix can't be split: one task unpacks it, and the rows are then dealt by cell.
    """
    have = _names(spark, folder) or []
    find = lambda *names: next((f"{folder.rstrip('/')}/{n}{z}" for n in names for z in ("", ".gz") if n + z in have), None)
    matrix, barcodes, features = find("matrix.mtx"), find("barcodes.tsv"), find("features.tsv", "genes.tsv")
    if None in (matrix, barcodes, features):
        raise ValueError(f"matrix, barcodes or features are missing in {folder}: {have}")
    d = read_mtx(spark, matrix, barcodes, features, allow_lossy)
    part = F.split("value", "\t")
    lines = _numbered(spark.read.text(features).select(F.monotonically_increasing_id().alias("line"), "value"), "gene_ix")
    var = lines.select("gene_ix", part[0].alias("gene_id"), F.coalesce(F.get(part, 1), part[0]).alias("gene_name"), F.coalesce(F.get(part, 2), F.lit("Gene Expression")).alias("feature_type"))
    if feature_type is None:
        return Dataset(d.obs, var, d.x)
    kept = var.filter(F.col("feature_type") == feature_type)
    from lattica.operators.order import with_position

    pair = with_position(kept.select("gene_ix"), ["gene_ix"], "new_ix")
    move = lambda f: f.join(pair, "gene_ix").drop("gene_ix").withColumnRenamed("new_ix", "gene_ix")
    return Dataset(d.obs, move(kept).select("gene_ix", "gene_id", "gene_name", "feature_type"), move(d.x).select("cell_ix", "gene_ix", "value"))


def read_10x_modalities(spark: SparkSession, folder: str):
    """Every feature type of a 10x folder as a modality over the same cells."""
    from lattica.operators.handle import Modalities

    whole = read_10x(spark, folder)
    kinds = [r[0] for r in whole.var.select("feature_type").distinct().orderBy("feature_type").collect()]  # a handful
    return Modalities(whole.obs, {k: read_10x(spark, folder, k) for k in kinds})
