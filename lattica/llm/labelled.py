"""The bounded, documented sample of labelled documents that classifiers learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.common import hash_order, materialize, smallest_hashes

#: So many labelled documents are learned from at most: those with the smallest hash of their id.
MAX_LABELLED = 6000
#: So many bytes of text they have together at most; in order of the hash, documents beyond it are left out.
MAX_BYTES = 24_000_000


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document's label is never learned: crc32 of its id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, target: str, limit: int = MAX_LABELLED, max_bytes: int = MAX_BYTES) -> DataFrame:
    """doc_id, text, y of the learnable labelled documents: one row an id, at most `limit` ids and `max_bytes` of text.

    With conflicting labels 1 counts; of documents that share an id, the text that sorts first (null as empty).
    """
    known = (
        labels.select("doc_id", F.col(target).cast("int").alias("y"))
        .filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out())
        .groupBy("doc_id").agg(F.max("y").alias("y"))
    )
    known = smallest_hashes(known, "doc_id", limit, known.count())
    # at most `limit` rows of two numbers are broadcast
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(known), "doc_id")
    one = materialize(rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y")), "labelled")
    # numbers of at most `limit` rows in one window
    so_far = F.sum(F.octet_length("text")).over(Window.orderBy(hash_order("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    fits = one.select("doc_id", so_far.alias("total")).filter(F.col("total") <= max_bytes).select("doc_id")
    return one.join(F.broadcast(fits), "doc_id", "left_semi").select("doc_id", "text", "y")
