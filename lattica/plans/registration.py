"""How queries are registered, and the SQL that all twins share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: obs, genes and x (canonical values) of the bound dataset.
BASE = """
WITH obs AS (
  SELECT o_orderkey AS cell_ix, o_orderstatus, o_orderpriority, o_totalprice, o_orderdate, c_mktsegment, n_name
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
),
genes AS (SELECT p_partkey AS gene_ix, 'g' || p_partkey AS gene_id, p_name, p_brand, p_type, p_size FROM part),
x AS (SELECT l_orderkey AS cell_ix, l_partkey AS gene_ix, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2 HAVING sum(l_quantity) <> 0)
"""


def query(sql: str | None = None, base: bool = True):
    """Registers a function under its name, with its SQL (after the shared CTEs) if it has any."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = (BASE + sql) if base else sql
        return f

    return put


def r(c, digits: int = 6) -> Column:
    """A rounded double: sums of doubles depend on their order in the last digits."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits)
