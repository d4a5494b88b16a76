"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index, distance-weighted votes.

Terms are words and word prefixes; every term of the labelled sample is in the vocabulary. A term's weight in a text is
(1 + log tf) x idf x relevance. idf counts all documents. Relevance is the square of log2(2 + the ratio of the term's
share among toxic examples to that among the others), at least 1: the cosine is then drawn by the words that tell the
classes apart, while all others still count. A term's share counts its different surroundings (previous and next word)
instead of documents, which keeps copies of one document from making its words look telling.

A text's neighbours are the labelled examples of largest cosine, found exactly: inverted lists hold the examples of each
term in blocks, with the largest weight of each block. Terms that a large share of the examples holds have plain rows
instead of lists; what they add is computed first, for many texts at once. It is a lower bound of each cosine; its k-th
largest value is the floor. To it the lists' block maxima are summed as upper bounds of whole blocks, and only blocks
whose bound reaches the floor are scored. Votes are weighted by cosine over distance. They are
calibrated on examples whose labels had no part in the weights or the neighbours (two folds).

Defined cases: a text without any term of the vocabulary (null and empty texts too) has no neighbours and gets the share
of toxic ones among such examples, drawn to the base rate; without labels, or with one class only, every score is the
smoothed base rate (0.5 without labels); repeated rows get equal scores; ties in cosine go to the smaller id; columns of
the tables beyond those named are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

from lattica.llm.bpe import groups
from lattica.llm.common import append_columns, as_bytes, ship_package
from lattica.llm.decontam import TO_WORDS, words_of
from lattica.llm.gbdt import sigmoid
from lattica.llm.labelled import held_out, sample

#: Lengths of the word prefixes (characters) that are terms too.
PREFIXES = (4, 6)
#: So many labelled examples are indexed at most, of so many bytes of text together: this bounds the vocabulary too.
MAX_EXAMPLES, MAX_BYTES = 2000, 12_000_000
NEIGHBOURS = 15
BLOCK = 32
#: A term that at least this share of the examples holds is stored as a row with a weight for each example.
DENSE_SHARE = 1 / 16
#: Texts whose dense terms are multiplied together.
TOGETHER = 128
#: Texts whose words are told apart together.
GROUP_BYTES = 4_000_000


def terms_of(word: bytes) -> list[bytes]:
    """The terms of a word: itself and, for words with other characters than digits, its proper prefixes."""
    if word.isdigit():
        return [word]
    if word.isascii():
        return [word, *[word[:k] + b"*" for k in PREFIXES if len(word) > k]]
    text = word.decode("utf-8", "replace")
    return [word, *[text[:k].encode() + b"*" for k in PREFIXES if len(text) > k]]


def ranges(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of [start, end) of every pair, one pair after the other, and how many each pair gives."""
    n = end - start
    return np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum()), n


class Examples:
    """Labelled examples (id, label, text) as arrays: of each (example, term) pair the term's number, count, and a hash of
    the surroundings of its first place."""

    def __init__(self, rows: list[tuple[int, int, bytes]]):
        from xxhash import xxh64_intdigest

        rows = sorted(rows)
        self.vocabulary: dict[bytes, int] = {}
        number, term, counts, near, sizes = self.vocabulary.setdefault, [], [], [], []
        for _, _, text in rows:
            words = words_of(text)
            count: dict[int, int] = {}
            around: dict[int, int] = {}
            known: dict[bytes, list[int]] = {}
            for i, w in enumerate(words):
                terms = known.get(w)
                if terms is None:
                    terms = known[w] = [number(t, len(self.vocabulary)) for t in terms_of(w)]
                    here = xxh64_intdigest(b" ".join(words[max(0, i - 1) : i + 2])) >> 1
                    for t in terms:
                        around.setdefault(t, here)
                for t in terms:
                    count[t] = count.get(t, 0) + 1
            term += count
            counts += count.values()
            near += [around[t] for t in count]
            sizes.append(len(count))
        self.ids, self.y = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], float)
        self.sizes, self.term, self.near = np.array(sizes, np.int64), np.array(term, np.int64), np.array(near, np.int64)
        self.tf = 1 + np.log(np.array(counts, float))
        self.at = np.concatenate([[0], np.cumsum(self.sizes)])
        self.owner = np.repeat(np.arange(len(rows)), self.sizes)

    def relevance(self, chosen: np.ndarray) -> np.ndarray:
        """Each term's relevance, from the examples chosen (a mask)."""
        rows = np.flatnonzero(chosen[self.owner])
        places = np.stack([self.term[rows], self.y[self.owner[rows]].astype(np.int64), self.near[rows]])
        places = places[:, np.lexsort(places)]
        new = np.ones(places.shape[1], bool)
        new[1:] = (places[:, 1:] != places[:, :-1]).any(0)
        term, label = places[0, new], places[1, new]
        toxic, other = (np.bincount(term[label == c], minlength=len(self.vocabulary)) for c in (1, 0))
        pos, neg = self.y[chosen].sum(), (1 - self.y[chosen]).sum()
        return np.log2(2 + toxic / (pos + 1) / ((other + 1) / (neg + 1))) ** 2

    def of(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """An example's term numbers and 1 + log counts."""
        at = slice(self.at[i], self.at[i + 1])
        return self.term[at], self.tf[at]


class BlockMaxIndex:
    """Inverted lists of the chosen examples' unit vectors: of each term its blocks with their largest weight, of each
    block of a term its examples with their weights."""

    def __init__(self, examples: Examples, chosen: np.ndarray, weight: np.ndarray, block: int = BLOCK):
        rows = np.flatnonzero(chosen[examples.owner])
        term, owner = examples.term[rows], examples.owner[rows]
        w = examples.tf[rows] * weight[term]
        w /= np.sqrt(np.bincount(owner, w * w, len(examples.ids)))[owner]
        heavy = np.zeros(len(examples.ids), np.int64)
        by = np.lexsort((term, w))
        heavy[owner[by]] = term[by]  # the last one written is the heaviest
        order = np.flatnonzero(chosen & (examples.sizes > 0))
        order = order[np.lexsort((examples.ids[order], heavy[order]))]  # like examples share blocks: tight bounds
        place = np.zeros(len(examples.ids), np.int64)
        place[order] = np.arange(len(order))
        self.n, self.block, self.blocks = len(order), block, -(-len(order) // block)
        self.ids, self.y = examples.ids[order], examples.y[order]
        self.weight = weight
        at = place[owner]
        held = np.bincount(term, minlength=len(weight))
        often = held >= max(2.0, DENSE_SHARE * self.n)
        self.row = np.where(often, np.cumsum(often) - 1, -1)  # a dense term's row
        self.dense = np.zeros((int(often.sum()), self.blocks * block))
        self.dense[self.row[term[often[term]]], at[often[term]]] = w[often[term]]
        rare = np.flatnonzero(~often[term])
        by = rare[np.lexsort((at[rare], term[rare]))]
        term, at, w = term[by], at[by], w[by]
        self.example, self.value = at.astype(np.int32), w
        group = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (at[1:] // block != at[:-1] // block)])) if len(term) else np.zeros(0, np.int64)
        self.first = np.concatenate([group, [len(term)]])  # the postings of each (term, block)
        self.of_block = (at[group] // block).astype(np.int32)
        self.top = np.maximum.reduceat(w, group) if len(group) else np.zeros(0)
        self.lists = np.searchsorted(term[group], np.arange(len(weight) + 1))  # the (term, block) pairs of each term

    def search_many(self, texts: list[tuple[np.ndarray, np.ndarray]], k: int = NEIGHBOURS):
        """For each text (its terms, 1 + log counts) the places in this index and cosines of the k nearest examples of
        cosine above 0, nearest first; ties go to the smaller id."""
        for begin in range(0, len(texts), TOGETHER):
            some = texts[begin : begin + TOGETHER]
            weights = [w / np.sqrt((w * w).sum()) for w in (tf * self.weight[terms] for terms, tf in some)]
            matrix = np.zeros((len(some), len(self.dense)))
            for i, ((terms, _), w) in enumerate(zip(some, weights)):
                row = self.row[terms]
                matrix[i, row[row >= 0]] = w[row >= 0]
            for (terms, _), w, sure in zip(some, weights, matrix @ self.dense):
                rare = self.row[terms] < 0
                yield self._search(terms[rare], w[rare], sure, k)

    def _search(self, terms: np.ndarray, w: np.ndarray, sure: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        entry, n = ranges(self.lists[terms], self.lists[terms + 1])
        w, block = np.repeat(w, n), self.of_block[entry]
        sums = sure.reshape(self.blocks, self.block)
        opened = np.bincount(block, w * self.top[entry], self.blocks) + sums.max(1)
        # no weight is negative, so the k-th cosine is no smaller than the k-th of these sums
        least = np.partition(sure, len(sure) - k)[len(sure) - k] if len(sure) >= k else 0.0
        opened = (opened >= least - 1e-9) & (opened > 0)
        rows = np.flatnonzero(opened[block])
        e = entry[rows]
        posting, m = ranges(self.first[e], self.first[e + 1])
        c = sure + np.bincount(self.example[posting], np.repeat(w[rows], m) * self.value[posting], len(sure))
        places = np.flatnonzero(np.repeat(opened, self.block) & (c > 0) & (c >= least - 1e-9))
        cosines = np.round(c[places], 9)
        if len(places) > 4 * k:
            few = np.partition(cosines, len(places) - k)[len(places) - k]
            places, cosines = places[cosines >= few], cosines[cosines >= few]
        best = np.lexsort((self.ids[places], -cosines))[:k]
        return places[best], cosines[best]


def vote(y: np.ndarray, cosines: np.ndarray, prior: float) -> float:
    """Log odds of the neighbours' distance-weighted vote."""
    c = np.minimum(cosines, 1)
    weight = c / (1.02 - c)
    share = min(max(float((weight @ y + 0.5 * prior) / (weight.sum() + 0.5)), 0.005), 0.995)
    return float(np.log(share / (1 - share)))


class Model:
    """The vocabulary's weights, the index of all examples, and the calibration of the votes."""

    def __init__(self, examples: Examples, frequency: np.ndarray, n_docs: int):
        y, n = examples.y, len(examples.y)
        self.prior = float((y.sum() + 0.5) / (n + 1))
        bare = y[examples.sizes == 0]
        self.without = float((bare.sum() + self.prior) / (len(bare) + 1))
        self.vocabulary = vocabulary_array(examples.vocabulary)
        self.usable = bool(n and y.min() < y.max())
        if not self.usable:
            return
        idf = np.log((1 + n_docs) / (1 + frequency)) + 1
        everything = np.ones(n, bool)
        self.index = BlockMaxIndex(examples, everything, idf * examples.relevance(everything))
        # two folds by text, so that copies of one text share a fold
        fold = np.array([int(examples.near[examples.at[i] : examples.at[i + 1]].sum()) >> 3 & 1 for i in range(n)])
        votes, labels = [], []
        for f in (0, 1):
            known = fold != f
            if known.any() and y[known].min() < y[known].max():
                index = BlockMaxIndex(examples, known, idf * examples.relevance(known))
                others = np.flatnonzero(~known & (examples.sizes > 0))
                votes += [vote(index.y[p], c, self.prior) for p, c in index.search_many([examples.of(i) for i in others])]
                labels += y[others].tolist()
        self.line = calibrate(np.array(votes), np.array(labels))

    def score_many(self, texts: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[float, str]]:
        """Calibrated scores, and the evidence: the nearest examples with their labels and cosines."""
        out = [(self.without if self.usable else self.prior, "")] * len(texts)
        if not self.usable:
            return out
        with_terms = [i for i, (terms, _) in enumerate(texts) if len(terms)]
        for i, (places, cosines) in zip(with_terms, self.index.search_many([texts[i] for i in with_terms])):
            if len(places):
                v = vote(self.index.y[places], cosines, self.prior)
                p = float(sigmoid(np.array([self.line[0] + self.line[1] * v]))[0])
                out[i] = p, ",".join(f"{self.index.ids[j]}:{int(self.index.y[j])}:{c:.3f}" for j, c in zip(places[:3], cosines[:3]))
        return out


def calibrate(votes: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression of the label on the vote's log odds, with a small penalty (Newton steps)."""
    if not len(votes) or y.min() == y.max():
        return np.array([0.0, 1.0])
    x = np.stack([np.ones_like(votes), votes], 1)
    b = np.zeros(2)
    for _ in range(40):
        p = sigmoid(x @ b)
        hess = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2)
        b += np.linalg.solve(hess, x.T @ (y - p) - 0.1 * b)
    return b


def vocabulary_array(vocabulary: dict[bytes, int]) -> pa.Array:
    """The terms in order of their numbers."""
    return pa.array([t.decode("utf-8", "replace") for t in vocabulary], pa.large_string())


def _numbers(words: pa.Array, vocabulary: pa.Array) -> np.ndarray:
    """The numbers of each distinct word's terms (words x terms, -1 where it has none or the vocabulary hasn't)."""
    try:
        text = words.cast(pa.large_string())
    except pa.ArrowInvalid:  # bytes that aren't UTF-8
        text = pa.array([w.decode("utf-8", "replace") for w in words.to_pylist()], pa.large_string())
    length, digits = pc.utf8_length(text).to_numpy(), pc.ascii_is_decimal(text).to_numpy(zero_copy_only=False)
    out = [pc.index_in(text, value_set=vocabulary).fill_null(-1).to_numpy()]
    for k in PREFIXES:
        start = pc.binary_join_element_wise(pc.utf8_slice_codeunits(text, 0, k), pa.scalar("*", pa.large_string()), pa.scalar("", pa.large_string()))
        out.append(np.where((length > k) & ~digits, pc.index_in(start, value_set=vocabulary).fill_null(-1).to_numpy(), -1))
    return np.stack(out, 1).astype(np.int64)


def count_terms(texts: list[bytes], vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The vocabulary's terms in some texts: where each text's part begins (and the last one ends), the distinct term
    numbers in order, and their counts. All words of the texts are told apart at once, and each distinct one is looked
    up once."""
    raw = b" ".join([t.translate(TO_WORDS) for t in texts])
    begins = np.cumsum([0] + [len(t) + 1 for t in texts])
    letters = np.frombuffer(raw, np.uint8)
    inside = letters != 0x20
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    start, end = edge[::2], edge[1::2]
    if not len(start) or not len(vocabulary):
        return np.zeros(len(texts) + 1, np.int64), np.zeros(0, np.int64), np.zeros(0)
    offsets = np.concatenate([[0], np.cumsum(end - start)])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(letters[inside])]).dictionary_encode()
    found = _numbers(words.dictionary, vocabulary)
    owner = np.searchsorted(begins, start, side="right") - 1
    pair, n = np.unique(owner * len(found) + words.indices.to_numpy(), return_counts=True)
    owner, word = np.divmod(pair, len(found))
    row, column = np.nonzero(found[word] >= 0)
    key, count = owner[row] * len(vocabulary) + found[word[row], column], n[row]
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    owner, term = np.divmod(key[new], len(vocabulary))
    return np.searchsorted(owner, np.arange(len(texts) + 1)), term, np.add.reduceat(count, new).astype(float) if len(new) else np.zeros(0)


def document_frequency(docs: DataFrame, vocabulary: pa.Array, text_col: str = "text") -> tuple[np.ndarray, int]:
    """In how many documents each term of the vocabulary is, and how many documents there are; counted over all of docs.

    Every task adds up its own documents and gives one row a term it met; only those rows are shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    kinds = StructType([StructField("term", IntegerType()), StructField("n", LongType())])

    def run(batches):
        known = shared.value
        n, seen = 0, np.zeros(len(known), np.int64)
        for batch in batches:
            for run in groups(as_bytes(batch.column(0)), GROUP_BYTES):
                n += len(run)
                seen += np.bincount(count_terms(run, known)[1], minlength=len(known))
        met = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1], met]).astype(np.int32)), pa.array(np.concatenate([[n], seen[met]]))], names=kinds.names)

    rows = docs.select(text_col).mapInArrow(run, kinds).groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    term, n = rows["term"].to_numpy(), rows["n"].to_numpy()
    out = np.zeros(len(vocabulary), np.int64)
    out[term[term >= 0]] = n[term >= 0]
    return out, int(n[term < 0].sum())


def detect(docs: DataFrame, labels: DataFrame, target: str = "toxic", limit: int = MAX_EXAMPLES, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence of each document."""
    spark = docs.sparkSession
    ship_package(spark)
    rows = sample(docs, labels, target, limit, MAX_BYTES).select("doc_id", "y", "text").collect()  # at most MAX_BYTES of text
    examples = Examples([(r["doc_id"], r["y"], r["text"].encode()) for r in rows])
    frequency, n_docs = document_frequency(docs, vocabulary_array(examples.vocabulary))
    shared = spark.sparkContext.broadcast(Model(examples, frequency, n_docs))

    def make():
        model = shared.value

        def work(batch):
            texts = as_bytes(batch.column(1))
            found = {}
            for run in groups(list(dict.fromkeys(texts)), GROUP_BYTES):  # copies in a batch are scored once
                at, terms, counts = count_terms(run, model.vocabulary)
                tf = 1 + np.log(counts)
                found.update(zip(run, model.score_many([(terms[a:b], tf[a:b]) for a, b in zip(at[:-1], at[1:])])))
            p, why = [found[t][0] for t in texts], [found[t][1] for t in texts]
            return [pa.array(p, pa.float64()), pa.array([int(x >= threshold) for x in p], pa.int32()), pa.array(why, pa.string())]

        return work

    fields = [StructField("score", DoubleType()), StructField("predicted", IntegerType()), StructField("evidence", StringType())]
    found = append_columns(docs.select("doc_id", "text"), fields, make)
    return found.select("doc_id", held_out().alias("held_out"), "score", "predicted", "evidence")
