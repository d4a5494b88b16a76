"""Keyed annotation joins with policies, and their diagnosis."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEPARATOR = "\x1f"


class AttachError(ValueError):
    """Keys repeat, or rows aren't covered where the policy asks for it."""


def composite_key(frame: DataFrame, columns: list[str], name: str = "_key") -> DataFrame:
    """frame with one string key of several columns; a null part makes the key null."""
    if len(columns) == 1:
        return frame.withColumn(name, F.col(columns[0]).cast("string"))
    parts = [F.col(c).cast("string") for c in columns]
    whole = parts[0].isNotNull()
    for p in parts[1:]:
        whole &= p.isNotNull()
    return frame.withColumn(name, F.when(whole, F.concat_ws(SEPARATOR, *parts)))


def repeated_keys(frame: DataFrame, columns: list[str]) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return composite_key(frame, columns).groupBy("_key").agg(F.count("*").alias("n")).filter("n > 1 AND _key IS NOT NULL")


def attach(target: DataFrame, source: DataFrame, on: list[str], columns: dict[str, str], source_on: list[str] | None = None, missing: str = "null", extra: str = "ignore", status: str | None = None, check: bool = True) -> DataFrame:
    """target with columns of source (source name -> result name), joined on unique keys.

    missing: null, zero (numeric columns) or error for target rows without a source row; extra: ignore or error for
    source rows without a target row; status names a present/absent column. check=False trusts the keys to be unique.
    """
    source_on = source_on or on
    if check:
        for side, keys, name in ((target, on, "target"), (source, source_on, "source")):
            if not repeated_keys(side, keys).isEmpty():
                raise AttachError(f"keys repeat in the {name}")
    left = composite_key(target, on)
    right = composite_key(source, source_on).select("_key", F.lit(True).alias("_here"), *[F.col(a).alias(b) for a, b in columns.items()]).filter("_key IS NOT NULL")
    if extra == "error" and not right.join(left, "_key", "left_anti").isEmpty():
        raise AttachError("source rows without a target row")
    out = left.join(right, "_key", "left")
    if missing == "error" and not out.filter("_here IS NULL").isEmpty():
        raise AttachError("target rows without a source row")
    if missing == "zero":
        out = out.withColumns({b: F.when(F.col("_here"), F.col(b)).otherwise(F.lit(0)) for b in columns.values()})
    if status:
        out = out.withColumn(status, F.when(F.col("_here"), "present").otherwise("absent"))
    return out.drop("_key", "_here")


def coverage(target: DataFrame, source: DataFrame, on: list[str], source_on: list[str] | None = None) -> DataFrame:
    """One row: how many keys both sides share, and how many only one side has (a dry run of attach)."""
    a = composite_key(target, on).select("_key").filter("_key IS NOT NULL").distinct().withColumn("t", F.lit(True))
    b = composite_key(source, source_on or on).select("_key").filter("_key IS NOT NULL").distinct().withColumn("s", F.lit(True))
    both = a.join(b, "_key", "full_outer")
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0)).cast("long")
    return both.agg(n(F.col("t").isNotNull() & F.col("s").isNotNull()).alias("matched"), n(F.col("s").isNull()).alias("target_only"), n(F.col("t").isNull()).alias("source_only"))


def key_candidates(frame: DataFrame, columns: list[str]) -> DataFrame:
    """For each column: rows, nulls, distinct values, and whether it could be a key. One pass over the table."""
    aggs = [F.count("*").alias("_n")]
    for c in columns:
        aggs += [F.count(c).alias(f"{c}_rows"), F.count_distinct(c).alias(f"{c}_distinct")]
    one = frame.agg(*aggs)
    rows = [F.struct(F.lit(c).alias("column"), F.col("_n").alias("n_rows"), (F.col("_n") - F.col(f"{c}_rows")).alias("n_null"), F.col(f"{c}_distinct").alias("n_distinct")) for c in columns]
    out = one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    return out.withColumn("is_unique", (F.col("n_null") == 0) & (F.col("n_distinct") == F.col("n_rows")))


def attach_positional(target: DataFrame, source: DataFrame, columns: list[str], ord_col: str = "cell_ix") -> DataFrame:
    """target with source's columns by position: the k-th row in key order gets the source row of position k."""
    from lattica.operators.order import with_position

    left = with_position(target, [ord_col], "_pos")
    return left.join(source.select(F.col("position").alias("_pos"), *columns), "_pos", "left").drop("_pos")


def import_layer(x: DataFrame, obs: DataFrame, var: DataFrame, barcode: str, gene: str) -> DataFrame:
    """Values keyed by names (barcode, gene, value) as a layer keyed by indices; unknown names are left out."""
    return x.join(obs.select("cell_ix", F.col(barcode).alias("_b")), F.col("barcode") == F.col("_b")).join(var.select("gene_ix", F.col(gene).alias("_g")), F.col("gene") == F.col("_g")).select("cell_ix", "gene_ix", "value")
