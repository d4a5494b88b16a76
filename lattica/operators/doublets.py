"""Annotations of doublet callers: finding their columns, normalising calls, consensus columns, exports by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators.metrics import vote_consensus

#: Each tool's score and call columns (the first one there is used; a name that ends in _ is a prefix), and
#: the words of a call that mean a doublet and a single cell (None: the call is a boolean or 0 and 1).
PROFILES = {
    "scdblfinder": {"score": ("scDblFinder.score",), "call": ("scDblFinder.class",), "words": ("doublet", "singlet")},
    "scrublet": {"score": ("doublet_score",), "call": ("predicted_doublet",), "words": ("true", "false")},
    "doubletfinder": {"score": ("pANN_",), "call": ("DF.classifications_",), "words": ("doublet", "singlet")},
    "doubletdetection": {"score": ("doublet_score",), "call": ("doublet_label",), "words": None},
    "solo": {"score": ("softmax_score", "score"), "call": ("prediction",), "words": ("doublet", "singlet")},
    "scds": {"score": ("hybrid_score", "cxds_score", "bcds_score"), "call": (), "words": None},
    "generic": {"score": (), "call": (), "words": None},
}
#: Texts that stand for a missing call.
MISSING = ("", "na", "nan", "null", "none")


class DoubletError(ValueError):
    """A tool's column is missing or ambiguous, or a call is none of the tool's words."""


def _column(table: DataFrame, tool: str, role: str, given: str | None, names: tuple[str, ...]) -> str | None:
    have = table.columns
    if given is not None:
        if given not in have:
            raise DoubletError(f"{role} column {given!r} isn't among {have}")
        return given
    for n in names:
        hits = [c for c in have if c.startswith(n)] if n.endswith("_") else [c for c in have if c == n]
        if len(hits) > 1:
            raise DoubletError(f"several {role} columns of {tool}: {hits}; name the one to use")
        if hits:
            return hits[0]
    if names:
        raise DoubletError(f"no {role} column of {tool} ({', '.join(names)}) among {have}")
    return None


def normalise(table: DataFrame, tool: str, key: str, barcode: str, score_column: str | None = None, call_column: str | None = None, words: tuple[str, str] | None = None, score_only: bool = False) -> DataFrame:
    """barcode, <key>_score and, where the tool calls, <key>_predicted (null where the call is missing).

    A missing score or call column, several that fit, and a call that is neither of the tool's two words are errors; the
    last one when rows are read. score_only leaves the call out on purpose.
    """
    if tool not in PROFILES:
        raise DoubletError(f"no tool {tool!r}; there are {sorted(PROFILES)}")
    p = PROFILES[tool]
    score = _column(table, tool, "score", score_column, p["score"])
    if score is None:
        raise DoubletError(f"{tool} needs a score column by name")
    call = None if score_only else _column(table, tool, "call", call_column, p["call"])
    out = [F.col(f"`{barcode}`"), F.col(f"`{score}`").cast("double").alias(f"{key}_score")]
    if call is not None:
        yes, no = words or p["words"] or ("true", "false")
        raw = F.col(f"`{call}`")
        kind = table.schema[call].dataType.simpleString()
        if kind == "boolean":
            value = raw
        else:
            c = F.lower(F.trim(raw.cast("string")))
            wrong = F.raise_error(F.concat(F.lit(f"{call} holds a call that is neither {yes} nor {no}: "), raw.cast("string")))
            ones, zeros = ([yes.lower()], [no.lower()]) if words or p["words"] else (["true", "1", "1.0"], ["false", "0", "0.0"])
            value = F.when(c.isNull() | c.isin(*MISSING), F.lit(None).cast("boolean")).when(c.isin(*ones), F.lit(True)).when(c.isin(*zeros), F.lit(False)).otherwise(wrong.cast("boolean"))
        out.append(value.alias(f"{key}_predicted"))
    return table.select(*out)


def consensus(obs: DataFrame, keys: list[str], method: str = "majority", added: str = "doublet") -> DataFrame:
    """obs with <added>_predicted, how many tools call and how many vote."""
    if missing := [k for k in keys if f"{k}_predicted" not in obs.columns]:
        raise DoubletError(f"no calls of {missing}")
    votes = [F.col(f"{k}_predicted") for k in keys]
    count = lambda cs: sum((F.coalesce(c.cast("int"), F.lit(0)) for c in cs), F.lit(0))
    return obs.withColumns({f"{added}_predicted": vote_consensus(votes, method), f"{added}_n_tools_calling": count(votes), f"{added}_n_tools_voting": count([v.isNotNull() for v in votes])})


def export_batches(frame: DataFrame, batch: str, key: str, path: str) -> None:
    """One folder a batch; a key that repeats within a batch is an error."""
    if not frame.groupBy(batch, key).count().filter("count > 1").isEmpty():
        raise DoubletError(f"{key} repeats within a batch")
    frame.write.partitionBy(batch).parquet(path)
