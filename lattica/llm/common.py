"""Shared plumbing of the training-data operators: code shipping, shared storage, Arrow column helpers."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from lattica.sources.shared import discard, materialize, shared_dir, ship  # noqa: F401

#: Rows of an Arrow batch while the session has Spark's default: whole texts make wide rows, and a batch is held
#: by the JVM and by Python at once.
BATCH_ROWS = 1000
_SPARK_BATCH_ROWS = "10000"
_BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship_package(spark: SparkSession) -> None:
    """The package on every executor, and small Arrow batches while the session has Spark's default size."""
    if spark.conf.get(_BATCH_SETTING) == _SPARK_BATCH_ROWS:
        spark.conf.set(_BATCH_SETTING, str(BATCH_ROWS))
    ship(spark)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def as_text(column: pa.Array) -> list[str]:
    """Strings of a column; null counts as empty."""
    return ["" if x is None else x for x in column.to_pylist()]


def private(df: DataFrame, *names: str) -> list[str]:
    """Names for columns of our own that df doesn't have (in any case of letters)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        n = f"_{n}"
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def append_columns(df: DataFrame, fields: list[StructField], make) -> DataFrame:
    """df with new columns, computed batch by batch without a shuffle.

    make() is called once a task and returns batch -> list of Arrow arrays, one for each of fields.
    A column of df whose name is among fields (in any case of letters) is replaced.
    """
    ship_package(df.sparkSession)
    new = {f.name.lower() for f in fields}
    kept = [f for f in df.schema.fields if f.name.lower() not in new]
    schema = StructType(kept + fields)
    keep = [i for i, f in enumerate(df.schema.fields) if f.name.lower() not in new]
    names = [f.name for f in schema.fields]

    def run(batches):
        work = make()
        for batch in batches:
            made = work(batch)
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in keep] + list(made), names=names)
            del batch, made
        del work
        pa.default_memory_pool().release_unused()  # the worker lives on between tasks

    return df.mapInArrow(run, schema)


def hot_lookup(rows: DataFrame, table: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """rows joined with table (one row a key). hot: the keys (column `key`) that many rows share, a bounded number of them:
    these are looked up in a broadcast table, so that no task gets all rows of one key."""
    few = F.broadcast(table.join(F.broadcast(hot.select(key)), key, "left_semi"))
    apart = F.broadcast(hot.select(key))
    return rows.join(apart, key, "left_anti").join(table, key).unionByName(rows.join(few, key))


def hash_order(key: str) -> Column:
    """A number below 2^30 that deals keys at random, the same way each time."""
    return F.pmod(F.xxhash64(key), F.lit(1 << 30))


def smallest_hashes(rows: DataFrame, key: str, want: int, total: int, *ties: str) -> DataFrame:
    """The `want` rows of smallest hash_order(key) of `total`. Rows whose hash is far too large to be among them are left
    out before the sort, so each task brings about 2 x want / total of its own rows and not `want`."""
    share = min(1.0, (2 * want + 1000) / max(1, total))
    return rows.filter(hash_order(key) < int(share * (1 << 30))).orderBy(hash_order(key), key, *ties).limit(want)
