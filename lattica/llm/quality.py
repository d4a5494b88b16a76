"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are computed from the whole text; the trees are learned on the driver from a bounded sample of labelled
documents (labelled.MAX_LABELLED) and applied in Arrow batches, all rows of a batch at once.

Defined cases: null and empty texts have all statistics zero and get the score that the trees give such texts; without
labels every score is 0.5; repeated rows get equal scores; a null doc_id isn't held out; empty tables give
no rows; `score` replaces columns with a result's name, `accept` keeps all columns as they are.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField

from lattica.llm import gbdt
from lattica.llm.common import append_columns, as_bytes, private
from lattica.llm.labelled import MAX_LABELLED, held_out, sample

_UPPER = np.arange(ord("A"), ord("Z") + 1)
_LOWER = np.arange(ord("a"), ord("z") + 1)
_DIGIT = np.arange(ord("0"), ord("9") + 1)
_MARKS = np.array([ord(c) for c in ",.;:?'\"-()"])
_SYMBOLS = np.array([ord(c) for c in "|&%$#*@^~<>=+_/\\{}[]`"])
#: A symbol that ends a word.
_ENDS = re.compile(rb"[|&%$#*!](?!\S)")

NAMES = [
    "log_bytes", "log_words", "mean_word", "distinct_words", "log_lines", "mean_line", "distinct_lines", "upper", "lower", "digit",
    "other_bytes", "marks", "symbols", "bangs", "most_frequent_symbol", "entropy", "distinct_sentences", "short_lines", "words_ending_in_symbol", "longest_word",
]


def statistics(text: bytes) -> list[float]:
    """The document statistics named in NAMES."""
    n = len(text)
    if not n:
        return [0.0] * len(NAMES)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words = text.split()
    lines = [x for x in text.split(b"\n") if x]
    sentences = [x for x in text.split(b". ") if x]
    share = counts / n
    seen = share[share > 0]
    m, k = max(1, len(words)), max(1, len(lines))
    symbols = counts[_SYMBOLS]
    return [
        np.log1p(n), np.log1p(len(words)), (n - len(words)) / m, len(set(words)) / m * min(1.0, np.sqrt(m / 50)),
        np.log1p(len(lines)), n / k, len(set(lines)) / k, share[_UPPER].sum(), share[_LOWER].sum(), share[_DIGIT].sum(),
        share[128:].sum(), share[_MARKS].sum(), symbols.sum() / n, share[ord("!")], symbols.max() / n, float(-(seen * np.log2(seen)).sum()),
        len(set(sentences)) / max(1, len(sentences)), sum(len(x) < 20 for x in lines) / k,
        len(_ENDS.findall(text)) / m, float(max(map(len, words), default=0)),
    ]


def _matrix(texts: list[bytes]) -> np.ndarray:
    return np.array([statistics(t) for t in texts], float).reshape(len(texts), len(NAMES))


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality", limit: int = MAX_LABELLED) -> gbdt.Forest:
    """Trees learned from the labelled documents that aren't held out."""

    def make():
        def work(batch):
            return [pa.array([list(map(float, r)) for r in _matrix(as_bytes(batch.column(1)))], pa.list_(pa.float64()))]

        return work

    rows = append_columns(sample(docs, labels, target, limit), [StructField("x", ArrayType(DoubleType()))], make).select("x", "y").collect()
    x = np.array([r["x"] for r in rows], float).reshape(len(rows), len(NAMES))
    y = np.array([r["y"] for r in rows], float)
    order = np.lexsort(np.vstack([x.T, y]))  # the same trees whatever order the rows come in
    return gbdt.fit(x[order], y[order])


def score(docs: DataFrame, forest: gbdt.Forest, text_col: str = "text", threshold: float = 0.5, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 from the threshold up), under the names given."""
    shared = docs.sparkSession.sparkContext.broadcast(forest)
    at = docs.columns.index(text_col)

    def make():
        trees = shared.value

        def work(batch):
            p = trees.predict(_matrix(as_bytes(batch.column(at))))
            return [pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32), pa.int32())]

        return work

    return append_columns(docs, [StructField(names[0], DoubleType()), StructField(names[1], IntegerType())], make)


def accept(docs: DataFrame, forest: gbdt.Forest, threshold: float = 0.5) -> DataFrame:
    """The documents that the classifier accepts, with their columns as given, whatever the names of these."""
    p, yes = private(docs, "score", "predicted")
    return score(docs, forest, threshold=threshold, names=(p, yes)).filter(F.col(yes) == 1).drop(p, yes)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The query's columns."""
    found = score(docs.select("doc_id", "text"), fit(docs, labels))
    return found.select("doc_id", held_out().alias("held_out"), "score", "predicted")
