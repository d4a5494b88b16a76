"""Benchmark decontamination: windows of consecutive benchmark words found in training texts.

Words are runs of ASCII letters, digits and non-ASCII characters after lower-casing A-Z. Every `n` consecutive words
of a benchmark item are a window; an item of fewer words is one window of its own length; an item without words has
none. A document word inside any occurrence of a window is hit.

The windows of the benchmark go to the executors as a hash set, if the benchmark's text is within `broadcast_bytes`;
a larger benchmark is matched by a shuffled join on windows. The hash of a window is a polynomial over its bytes (words
joined by spaces), so those of all windows of a text come from one running sum; a hit is verified byte by byte.

Defined cases: null and empty texts have no words and no hits; repeated item rows count as one item per item_id;
a null item_id is left out of the list of items but its windows count as hits; extra columns are passed through by
`find_hits` (those with a result's name are replaced), and kept as they are, whatever their names, by `remove_hits`.
"""

from __future__ import annotations

import hashlib
import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StringType, StructField

from lattica.llm.common import append_columns, as_bytes, materialize, private, ship_package

WINDOW = 10
#: Benchmarks of up to so many bytes of text are broadcast. The index takes the text and 28 bytes a word: at most 15 times
#: the text, with one-letter words; some 5 times with ordinary ones (measured by WindowIndex.nbytes).
BROADCAST_BYTES = 8_000_000
#: Words of a long text that are hashed at a time.
PART = 200_000

_SEPARATORS = bytes(c for c in range(128) if not (0x30 <= c <= 0x39 or 0x41 <= c <= 0x5A or 0x61 <= c <= 0x7A))
TO_WORDS = bytes(
    0x20 if bytes([c]) in [bytes([s]) for s in _SEPARATORS] else c + 32 if 0x41 <= c <= 0x5A else c for c in range(256)
)

_WORD = re.compile(rb"[^ ]+")


def words_of(text: bytes) -> list[bytes]:
    """The words of a UTF-8 text."""
    return text.translate(TO_WORDS).split()


class Rolling:
    """Hashes of parts of a byte string: sums of byte x base^place modulo 2^64, moved to place 0, and mixed."""

    def __init__(self, seed: int = 0):
        self.base = (0x9E3779B97F4A7C15 + 2 * seed) & (1 << 64) - 1  # odd, so it has an inverse
        self.inverse = pow(self.base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            run = lambda b: np.concatenate([[np.uint64(1)], np.cumprod(np.full(n - 1, b, np.uint64))])
            with np.errstate(over="ignore"):
                self.up, self.down = run(self.base), run(self.inverse)

    def hashes(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of raw[start:end] for each pair."""
        self._powers(len(raw) + 1)
        with np.errstate(over="ignore"):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw + np.uint64(1)) * self.up[: len(raw)])])
            h = (total[end] - total[start]) * self.down[start]
            h ^= h >> np.uint64(31)
            h *= np.uint64(0xD6E8FEB86659FD93)
            return h ^ (h >> np.uint64(32))


def _bounds(joined: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of space-joined words, and where each word starts and ends."""
    raw = np.frombuffer(joined, np.uint8)
    gaps = np.flatnonzero(raw == 32)
    return raw, np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(raw)]])


class WindowIndex:
    """Hash set of benchmark windows by length, in flat arrays; built on the driver, read by the workers."""

    def __init__(self, items: list[tuple[str | None, bytes]], n: int = WINDOW):
        self.n = n
        cut = [(item, words) for item, words in ((i, words_of(t)) for i, t in items) if words]
        self.names = sorted({i for i, _ in cut if i is not None})
        number = {i: k for k, i in enumerate(self.names)} | {None: -1}
        self.blob = b"".join(b" ".join(words) + b" " for _, words in cut)
        sizes = np.array([len(words) for _, words in cut], np.int64)
        owner = np.array([number[i] for i, _ in cut], np.int32)
        seed = 0
        while not self._build(sizes, owner, seed):  # two windows of equal hash: another base
            seed += 1

    def _build(self, sizes: np.ndarray, owner: np.ndarray, seed: int) -> bool:
        self.rolling, self.tables = Rolling(seed), {}
        if not len(sizes):
            return True
        raw, start, end = _bounds(self.blob[:-1])
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        for size in np.unique(np.minimum(sizes, self.n)).tolist():
            of = np.flatnonzero(np.minimum(sizes, self.n) == size)
            count = sizes[of] - size + 1
            word = np.repeat(first[of] - np.cumsum(count) + count, count) + np.arange(count.sum())
            item = np.repeat(owner[of], count)
            parts = [self.rolling.hashes(raw[start[w[0]] : end[w[-1] + size - 1]], start[w] - start[w[0]], end[w + size - 1] - start[w[0]]) for w in np.array_split(word, -(-len(word) // PART))]
            h = np.concatenate(parts)
            by = np.lexsort((item, h))
            h, word, item = h[by], word[by], item[by]
            new = np.concatenate([[True], h[1:] != h[:-1]])
            group = np.cumsum(new) - 1
            at = start[word]
            for k in np.flatnonzero(~new).tolist():
                a, b = int(at[k]), int(at[k - 1])
                length = int(end[word[k] + size - 1]) - a + 1
                if self.blob[a : a + length] != self.blob[b : b + length]:
                    return False
            pair = new.copy()
            pair[1:] |= item[1:] != item[:-1]
            self.tables[size] = h[new], at[new], np.searchsorted(group[pair], np.arange(int(new.sum()) + 1)), item[pair]
        self.rolling.up = self.rolling.down = np.ones(1, np.uint64)  # grown again where it is used
        return True

    @property
    def nbytes(self) -> int:
        return len(self.blob) + sum(a.nbytes for t in self.tables.values() for a in t)

    def hits(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Which words are hit, and the items with occurring windows."""
        hit = np.zeros(len(words), bool)
        found: set[int] = set()
        for begin in range(0, len(words), PART):
            some = words[begin : begin + PART + self.n - 1]
            joined = b" ".join(some)
            raw, start, end = _bounds(joined)
            for size, (known, at, owners, item) in self.tables.items():
                m = min(len(some) - size + 1, PART)
                if m < 1:
                    continue
                h = self.rolling.hashes(raw, start[:m], end[size - 1 : size - 1 + m])
                place = np.minimum(np.searchsorted(known, h), len(known) - 1)
                met = np.flatnonzero(known[place] == h)
                for i, g in zip(met.tolist(), place[met].tolist()):
                    text = joined[start[i] : end[i + size - 1]] + b" "
                    if self.blob[at[g] : at[g] + len(text)] == text:
                        hit[begin + i : begin + i + size] = True
                        found.update(item[owners[g] : owners[g + 1]].tolist())
        return hit, {self.names[k] for k in found if k >= 0}


FIELDS = [
    StructField("n_words", LongType()),
    StructField("hit_from", ArrayType(LongType())),
    StructField("hit_to", ArrayType(LongType())),
    StructField("items", ArrayType(StringType())),
]


def _runs(hit: np.ndarray) -> tuple[list[int], list[int]]:
    """Starts and ends (exclusive) of the runs of hit words."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return edge[::2].tolist(), edge[1::2].tolist()


def _text_bytes(benchmark: DataFrame) -> int:
    return benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def _broadcast_index(docs: DataFrame, items: DataFrame, n: int):
    """The window index on all executors. items: within the bound, as the caller has counted."""
    ship_package(docs.sparkSession)
    rows = items.collect()
    return docs.sparkSession.sparkContext.broadcast(WindowIndex([(None if r[0] is None else str(r[0]), (r[1] or "").encode()) for r in rows], n))


def _broadcast_hits(docs: DataFrame, items: DataFrame, n: int, text_col: str) -> DataFrame:
    index = _broadcast_index(docs, items, n)
    at = docs.columns.index(text_col)

    def make():
        windows = index.value

        def work(batch):
            out = [], [], [], []
            for text in as_bytes(batch.column(at)):
                words = words_of(text)
                hit, found = windows.hits(words)
                a, b = _runs(hit)
                for o, v in zip(out, (len(words), a, b, sorted(found))):
                    o.append(v)
            kinds = pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string())
            return [pa.array(o, k) for o, k in zip(out, kinds)]

        return work

    return append_columns(docs, FIELDS, make)


def _joined_hits(docs: DataFrame, items: DataFrame, n: int, text_col: str) -> DataFrame:
    """The way beyond the broadcast bound: windows of both sides meet in a shuffled join (AQE splits hot windows)."""
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    lower = lambda c: F.translate(F.coalesce(c, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = lambda c: F.regexp_extract_all(lower(c), F.lit(pattern), F.lit(0))
    known = items.select(F.col(items.columns[0]).cast("string").alias("item"), words(F.col(items.columns[1])).alias("w"))
    known = known.filter(F.size("w") > 0).withColumn("size", F.least(F.lit(n), F.size("w")))
    windows = (
        known.select("item", "size", "w", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("size"))).alias("i"))
        .select("item", "size", F.array_join(F.slice("w", F.col("i") + 1, F.col("size")), " ").alias("window"))
        .groupBy("size", "window").agg(F.collect_set("item").alias("found"))
    )
    sizes = [r[0] for r in windows.select("size").distinct().collect()]  # at most n values
    row, = private(docs, "row")
    numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "decontam-docs")
    base = numbered.select(F.col(row).alias("row"), words(F.col(text_col)).alias("w"))
    none = F.array().cast("array<bigint>")
    counts = base.select("row", F.size("w").cast("long").alias("n_words"))
    if sizes:
        probe = reduce(
            DataFrame.unionAll,
            [
                base.filter(F.size("w") >= s)
                .select("row", "w", F.explode(F.sequence(F.lit(0), F.size("w") - s)).alias("i"))
                .select("row", "i", F.lit(s).alias("size"), F.array_join(F.slice("w", F.col("i") + 1, s), " ").alias("window"))
                for s in sizes
            ],
        )
        met = probe.join(windows, ["size", "window"]).select("row", "i", "size", "found")
        merged = met.groupBy("row").agg(
            F.array_sort(F.collect_list(F.struct(F.col("i").cast("long").alias("a"), (F.col("i") + F.col("size")).cast("long").alias("b")))).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("found")))).alias("items"),
        )
        grow = F.aggregate(
            "spans",
            F.expr("cast(array() as array<struct<a:bigint,b:bigint>>)"),
            lambda acc, x: F.when(
                (F.size(acc) > 0) & (F.element_at(acc, -1)["b"] >= x["a"]),
                F.concat(
                    F.slice(acc, 1, F.size(acc) - 1),
                    F.array(F.struct(F.element_at(acc, -1)["a"].alias("a"), F.greatest(F.element_at(acc, -1)["b"], x["b"]).alias("b"))),
                ),
            ).otherwise(F.concat(acc, F.array(x))),
        )
        merged = merged.select("row", grow.alias("runs"), "items")
        counts = counts.join(merged, "row", "left").select(
            "row", "n_words", F.coalesce(F.col("runs")["a"], none).alias("hit_from"), F.coalesce(F.col("runs")["b"], none).alias("hit_to"),
            F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        )
    else:
        counts = counts.select("row", "n_words", none.alias("hit_from"), none.alias("hit_to"), F.array().cast("array<string>").alias("items"))
    results = {f.name for f in FIELDS}
    kept = [c for c in docs.columns if c.lower() not in results]
    out = numbered.select(F.col(row).alias("row"), F.struct(*[f"`{c}`" for c in kept]).alias("own")) if kept else numbered.select(F.col(row).alias("row"))
    return out.join(counts, "row").select(*(["own.*"] if kept else []), *[f.name for f in FIELDS])


def find_hits(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, text_col: str = "text", item_col: str = "item_id", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """docs with n_words, the runs of hit words (hit_from, hit_to, ends exclusive) and the sorted items found."""
    ship_package(docs.sparkSession)
    items = benchmark.select(item_col, "text")
    if _text_bytes(benchmark) <= broadcast_bytes:
        return _broadcast_hits(docs, items, n, text_col)
    return _joined_hits(docs, items, n, text_col)


def cut_runs(text: str, starts: list[int], ends: list[int]) -> str:
    """text without the words of the given runs (and what stands between a run's words)."""
    raw = text.encode("utf-8", "surrogatepass")
    places = [m.span() for m in _WORD.finditer(raw.translate(TO_WORDS))]
    keep, last = [], 0
    for x, y in zip(starts, ends):
        keep.append(raw[last : places[x][0]])
        last = places[y - 1][1]
    return b"".join([*keep, raw[last:]]).decode("utf-8", "surrogatepass")


def remove_hits(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, drop_share: float = 0.5, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """docs (columns as given, whatever their names) with every hit run cut out of the text; documents with a hit share of
    at least drop_share go. n_chars, where present, follows the new text. Documents without hits stay as they are."""
    clean, share, hit = private(docs, "clean", "share", "hit")
    size = _text_bytes(benchmark)
    fields = [StructField(clean, StringType()), StructField(share, DoubleType()), StructField(hit, BooleanType())]
    columns = [f"`{c}`" for c in docs.columns]
    if size <= broadcast_bytes:
        source, index, at = docs, _broadcast_index(docs, benchmark.select("item_id", "text"), n), docs.columns.index("text")

        def make():
            windows = index.value

            def work(batch):
                out = [], [], []
                for text in batch.column(at).to_pylist():
                    words = words_of((text or "").encode("utf-8", "surrogatepass"))
                    cut, _ = windows.hits(words)
                    some = bool(cut.any())
                    for o, v in zip(out, (cut_runs(text, *_runs(cut)) if some else text, float(cut.mean()) if some else 0.0, some)):
                        o.append(v)
                return [pa.array(o, t) for o, t in zip(out, (pa.string(), pa.float64(), pa.bool_()))]

            return work

    else:
        own, text = private(docs, "own", "text")
        found = find_hits(docs.select(F.col("text").alias(text), F.struct(*columns).alias(own)), benchmark, n, text, broadcast_bytes=broadcast_bytes)
        source = found.select(text, "n_words", "hit_from", "hit_to", own)

        def make():
            def work(batch):
                out = [], [], []
                for t, words, a, b in zip(*(batch.column(i).to_pylist() for i in range(4))):
                    for o, v in zip(out, (cut_runs(t, a, b) if a else t, (sum(b) - sum(a)) / words if a else 0.0, bool(a))):
                        o.append(v)
                return [pa.array(o, t) for o, t in zip(out, (pa.string(), pa.float64(), pa.bool_()))]

            return work

    after = append_columns(source, fields, make).filter(F.col(share) < drop_share)
    new = {c: F.col(f"`{c}`" if source is docs else f"{own}.`{c}`") for c in docs.columns}
    new["text"] = F.col(clean)
    if "n_chars" in new:
        new["n_chars"] = F.when(F.col(hit), F.char_length(clean).cast(docs.schema["n_chars"].dataType)).otherwise(new["n_chars"])
    return after.select(*[v.alias(c) for c, v in new.items()])


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The query's columns: counts, the digest of the items found, and whether anything was hit."""
    found = find_hits(docs.select("doc_id", "text"), benchmark)
    hit = F.aggregate(F.zip_with("hit_from", "hit_to", lambda a, b: b - a), F.lit(0).cast("long"), lambda x, y: x + y)
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def brute(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]], n: int = WINDOW) -> list[tuple]:
    """Plain reference for tests."""
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    cut = lambda t: pattern.findall((t or "").translate(low))
    out = []
    for doc, text in docs:
        w, hit, found = cut(text), set(), set()
        for item, body in items:
            v = cut(body)
            size = min(n, len(v))
            for i in range(len(v) - size + 1) if v else ():
                for j in range(len(w) - size + 1):
                    if w[j : j + size] == v[i : i + size]:
                        hit |= set(range(j, j + size))
                        found.add(str(item))
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out
