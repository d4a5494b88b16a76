"""Approximate nearest neighbours by inner product with randomly rotated one-bit codes in inverted lists.

Index: a bounded sample of the vectors gives centroids; every vector goes to the list of its nearest centroid. What it
differs from the centroid by is scaled to length 1 and rotated by one random orthogonal matrix; only the signs are kept,
as packed bits, with two correction scalars, the difference's length and the inner product of the code with it. The
index is written once, in order of its lists.

A query is rotated too and rounded to 4-bit steps, whose bit planes meet the packed codes by AND and population count.
With the centroid's own inner product that gives an unbiased estimate of each inner product, and an error bound that
holds with high probability. Only vectors whose upper bound reaches the query's floor are computed exactly from the
original vectors: the floor is the k-th best exact value so far, at first that of a bounded sample of the vectors.

A query visits the lists of its `probes` best centroids. How many these must be is measured in each run: the exact
neighbours of CALIBRATION queries are found by brute force, and enough lists are visited to hold LISTED of them. With
probes=0 every list is visited, but for those that the Cauchy-Schwarz inequality excludes: the exact way, up to the
codes' bounds.

Queries are taken in blocks of bounded size: each is broadcast, and every task scans its own lists against those of the
block's queries that visit them, keeping the k best of each query. Only those meet in a shuffle, of which each task keeps
k rows a query. No vector is left out of the index; no cap is set on candidates. Of equal vectors in a task those of the
k + 1 smallest ids are scanned: the others can't be among the k nearest.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part, nor rows without an id;
vectors of unlike lengths are apart from each other, each length is searched for itself; with fewer than k candidates
all are returned; equal scores are ordered by the smaller vec_id; repeated rows are candidates each for itself, a
repeated query is answered once (with the vector that sorts first); empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, LongType, StructField, StructType

from lattica.llm.common import discard, materialize, ship_package, smallest_hashes

#: Bytes of query vectors that are broadcast at a time.
QUERY_BYTES = 16_000_000
#: Standard deviations of the error bound: how far an estimate may be off before a near vector is missed.
EPSILON = 1.9
SEED = 20_240_501
#: Inverted lists at most; the square root of the vectors, otherwise.
MAX_LISTS = 4096
#: Bytes of vectors that centroids are learned from, and that floors are found with, at most.
SAMPLE_BYTES = 32_000_000
FLOOR_ROWS = 4096
#: Queries whose exact neighbours are found, and the share of these that the visited lists must hold.
CALIBRATION = 200
LISTED = 0.96
#: Rows of a list and queries that are met at a time.
ROWS, QUERIES = 2048, 256


def rotation(d: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def padded(d: int) -> int:
    return -(-d // 64) * 64


def _pack(bits: np.ndarray) -> np.ndarray:
    """Rows of 0/1 (a multiple of 64 wide) as unsigned 64-bit words."""
    return np.packbits(bits, axis=1).view(np.uint64)


class Codes:
    """One-bit codes of the rows of a matrix, as differences from a centroid."""

    def __init__(self, bits: np.ndarray, length: np.ndarray, match: np.ndarray):
        self.bits, self.length, self.match = bits, length, match
        self.width = bits.shape[1] * 64
        self.ones = np.bitwise_count(bits).sum(1).astype(float)
        self.slack = np.sqrt(np.maximum(0, 1 - match**2)) / match * EPSILON / np.sqrt(max(1, self.width - 1))

    @classmethod
    def of(cls, differences: np.ndarray, turn: np.ndarray) -> Codes:
        length = np.sqrt((differences * differences).sum(1))
        turned = (differences / np.where(length > 0, length, 1)[:, None]) @ turn[: differences.shape[1]]
        match = np.abs(turned).sum(1) / np.sqrt(len(turn))  # inner product of the unit code with the unit vector
        return cls(_pack((turned > 0).astype(np.uint8)), length, np.where(length > 0, match, 1.0))


class Queries:
    """Rotated queries in 4-bit steps, as bit planes."""

    def __init__(self, vectors: np.ndarray, turn: np.ndarray):
        q = vectors @ turn[: vectors.shape[1]]
        self.low = q.min(1)
        self.step = np.maximum((q.max(1) - self.low) / 15, 1e-300)
        levels = np.clip(np.rint((q - self.low[:, None]) / self.step[:, None]), 0, 15).astype(np.uint8)
        self.planes = np.stack([_pack(levels >> p & 1) for p in range(4)], 1)
        self.total = levels.sum(1, dtype=np.int64).astype(float)
        self.size = np.sqrt((vectors * vectors).sum(1))

    def estimate(self, chosen: np.ndarray, codes: Codes, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimated inner products (chosen queries x coded rows) and their error bounds. centre: the queries' inner
        products with the centroid that the codes differ from."""
        n = np.zeros((len(chosen), len(codes.bits)))
        for p in range(4):
            count = np.zeros(n.shape, np.uint16)
            for w in range(codes.bits.shape[1]):
                count += np.bitwise_count(self.planes[chosen, p, w][:, None] & codes.bits[:, w][None])
            n += count * float(1 << p)
        low, step = self.low[chosen][:, None], self.step[chosen][:, None]
        # the code's components are +-1/sqrt(D): 2 * (sum over set bits) - (sum over all)
        dot = (2 * (low * codes.ones + step * n) - (low * codes.width + step * self.total[chosen][:, None])) / np.sqrt(codes.width)
        bound = codes.length * (self.size[chosen][:, None] * codes.slack + step / 2 / codes.match)
        return centre[:, None] + codes.length * dot / codes.match, bound


class Best:
    """The k best (score, id) of each query so far, and the floors that follow from them."""

    def __init__(self, k: int, floor: np.ndarray):
        self.k, self.floor = k, floor.copy()
        self.query, self.id, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self._new: list[tuple] = []
        self._pending = 0

    def add(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        self._new.append((query, ids, score))
        self._pending += len(query)
        if self._pending > 50_000 + len(self.query):
            self.settle()

    def settle(self) -> None:
        if not self._new:
            return
        q, i, s = (np.concatenate([own, *(n[j] for n in self._new)]) for j, own in enumerate((self.query, self.id, self.score)))
        self._new, self._pending = [], 0
        by = np.lexsort((i, -s, q))
        q, i, s = q[by], i[by], s[by]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        kept = place < self.k
        self.query, self.id, self.score = q[kept], i[kept], s[kept]
        last = place == self.k - 1
        self.floor[q[last]] = np.maximum(self.floor[q[last]], s[last])


def exact(vectors: np.ndarray, rows: np.ndarray, queries: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Inner products of pairs; the same rounding for equal vectors wherever they stand."""
    out = np.empty(len(rows))
    for k in range(0, len(rows), 20_000):
        at = slice(k, k + 20_000)
        out[at] = (vectors[rows[at]] * queries[chosen[at]]).sum(1)
    return out


def valid(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id and vec of the vectors that take part."""
    v = F.col(vec_col)
    fine = v.isNotNull() & F.col(id_col).isNotNull() & (F.size(v) > 0)
    fine &= F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.cast("array<double>").alias("vec")).filter(F.coalesce(fine, F.lit(False)))


def _matrix(column) -> np.ndarray:
    return np.asarray(column.flatten(), float).reshape(len(column), -1)


def _table_matrix(table: pa.Table, name: str, d: int) -> np.ndarray:
    return np.asarray(table[name].combine_chunks().flatten(), float).reshape(-1, d) if table.num_rows else np.zeros((0, d))


def centroids(sample: np.ndarray, lists: int, rounds: int = 6) -> np.ndarray:
    """Lloyd's rounds on a sample; a list that gets nothing keeps its centroid."""
    c = sample[np.random.default_rng(SEED).permutation(len(sample))[:lists]].copy()
    for _ in range(rounds):
        near = nearest_list(sample, c)
        n = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, sample)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def nearest_list(vectors: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = (c * c).sum(1) / 2
    parts = [np.argmin(half - vectors[k : k + 4096] @ c.T, 1) for k in range(0, len(vectors), 4096)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


INDEX = StructType([
    StructField("list", IntegerType()), StructField("vec_id", LongType()), StructField("vec", ArrayType(DoubleType())),
    StructField("bits", BinaryType()), StructField("length", DoubleType()), StructField("match", DoubleType()),
])
HITS = StructType([StructField("query_id", LongType()), StructField("vec_id", LongType()), StructField("score", DoubleType()), StructField("list", IntegerType())])


def build(pool: DataFrame, d: int, c: np.ndarray) -> DataFrame:
    """The index: every vector's list and code, in order of the lists. Hot lists are cut by the range partitioner."""
    shared = pool.sparkSession.sparkContext.broadcast(c)

    def code(batches):
        turn, middle = rotation(padded(d)), shared.value
        for batch in batches:
            if batch.num_rows:
                v = _matrix(batch.column(1))
                near = nearest_list(v, middle)
                codes = Codes.of(v - middle[near], turn)
                bits = pa.array([x.tobytes() for x in codes.bits], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), batch.column(0), batch.column(1), bits, pa.array(codes.length), pa.array(codes.match)], names=INDEX.names)

    coded = materialize(pool.mapInArrow(code, INDEX), "ann-codes")
    out = materialize(coded.repartitionByRange("list", F.xxhash64("vec_id")).sortWithinPartitions("list", "vec_id"), "ann-index")
    discard(coded)
    return out


def _chunks(batches, k: int):
    """(list, ids, vectors, codes) of at most ROWS rows of one list. Of equal vectors (by a 128-bit hash) in a task's part of
    a list the first k + 1 only: rows come in order of their ids."""
    from xxhash import xxh3_128_digest

    current, seen = -1, {}
    for batch in batches:
        if not batch.num_rows:
            continue
        lists, ids, length, match = (batch.column(j).to_numpy(zero_copy_only=False) for j in (0, 1, 4, 5))
        v = _matrix(batch.column(2))
        bits = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint64).reshape(len(ids), -1)
        edge = np.flatnonzero(np.concatenate([[True], lists[1:] != lists[:-1], [True]]))
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
            if lists[a] != current:
                current, seen = int(lists[a]), {}
            keep = []
            for r in range(a, b):
                key = xxh3_128_digest(v[r].tobytes())
                n = seen[key] = seen.get(key, 0) + 1
                if n <= k + 1:
                    keep.append(r)
            for s in range(0, len(keep), ROWS):
                rows = np.array(keep[s : s + ROWS])
                yield current, ids[rows], v[rows], Codes(bits[rows], length[rows], match[rows])


def _top(hits: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query; every task keeps k a query before the shuffle."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id", "list"))
    return hits.withColumn("rank", place).filter(F.col("rank") <= k)


def _brute(index: DataFrame, ids: np.ndarray, queries: np.ndarray, k: int) -> DataFrame:
    """The exact k nearest of a bounded number of queries among all rows of the index."""
    shared = index.sparkSession.sparkContext.broadcast((ids, queries))

    def scan(batches):
        own, q = shared.value
        best, of = Best(k, np.full(len(own), -np.inf)), {}
        for current, vec_ids, v, _ in _chunks(batches, k):
            scores = q @ v.T
            scores[own[:, None] == vec_ids] = -np.inf
            at, rows = np.nonzero(scores >= np.maximum(best.floor, -1e300)[:, None])
            of.update(zip(vec_ids[rows].tolist(), [current] * len(rows)))
            best.add(at, vec_ids[rows], scores[at, rows])
        best.settle()
        lists = np.array([of[i] for i in best.id.tolist()], np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(own[best.query]), pa.array(best.id), pa.array(best.score), pa.array(lists)], names=HITS.names)

    return _top(index.mapInArrow(scan, HITS), k)


def probes_for(index: DataFrame, ids: np.ndarray, queries: np.ndarray, c: np.ndarray, k: int, share: float = LISTED) -> int:
    """How many of its best lists a query must visit to meet `share` of its exact neighbours, measured by brute force."""
    rows = _brute(index, ids, queries, k).select("query_id", "list").toArrow()  # at most k a query
    at = {int(i): j for j, i in enumerate(ids)}
    q = np.array([at[i] for i in rows["query_id"].to_pylist()], np.int64)
    if not len(q):
        return len(c)
    order = np.argsort(np.argsort(-(queries @ c.T), 1, kind="stable"), 1)
    ranks = np.sort(order[q, rows["list"].to_numpy()])
    return int(ranks[min(len(ranks) - 1, int(np.ceil(share * len(ranks))))]) + 1


def least_score(queries: np.ndarray, c: np.ndarray, probes: int) -> np.ndarray:
    """The inner product that a centroid must reach for its list to be visited."""
    least = np.full(len(queries), -np.inf)
    if 0 < probes < len(c):
        for a in range(0, len(queries), 4096):
            s = queries[a : a + 4096] @ c.T
            least[a : a + 4096] = np.partition(s, len(c) - probes, 1)[:, len(c) - probes] - 1e-9
    return least


def _floors(ids: np.ndarray, queries: np.ndarray, sample_ids: np.ndarray, sample: np.ndarray, c: np.ndarray, probes: int, k: int) -> np.ndarray:
    """A value that at least k rows of the lists visited reach: the 2k-th best of those in a sample. Twice k, as the bounds
    miss some; where they miss more, the query is searched again without a floor."""
    out = np.full(len(ids), -np.inf)
    if len(sample) > 2 * k:
        near = nearest_list(sample, c)
        least = least_score(queries, c, probes)
        for a in range(0, len(ids), 512):
            q = queries[a : a + 512]
            s = q @ sample.T
            s[(ids[a : a + 512, None] == sample_ids) | ((q @ c.T) < least[a : a + 512, None])[:, near]] = -np.inf
            kth = np.partition(s, len(sample) - 2 * k, 1)[:, len(sample) - 2 * k]
            out[a : a + 512] = kth
    return out


def _scan_block(index: DataFrame, ids: np.ndarray, queries: np.ndarray, floor: np.ndarray, c: np.ndarray, radius: np.ndarray, probes: int, k: int) -> DataFrame:
    """Every task's k best of each query of a block."""
    shared = index.sparkSession.sparkContext.broadcast((ids, queries, floor, c, radius))

    def scan(batches):
        own, q, start, middle, far = shared.value
        turn = rotation(padded(q.shape[1]))
        asked, best = Queries(q, turn), Best(k, start)
        least = least_score(q, middle, probes)
        current, visit, centre = -1, np.zeros(0, np.int64), np.zeros(0)
        for lst, vec_ids, v, codes in _chunks(batches, k):
            if lst != current:
                current, s = lst, (q * middle[lst]).sum(1)
                visit = np.flatnonzero((s >= least) & (s + asked.size * far[lst] * (1 + 1e-9) >= best.floor))
                centre = s[visit]
            for a in range(0, len(visit), QUERIES):
                some = visit[a : a + QUERIES]
                guess, bound = asked.estimate(some, codes, centre[a : a + QUERIES])
                at, rows = np.nonzero(guess + bound >= best.floor[some][:, None])
                at = some[at]
                other = own[at] != vec_ids[rows]
                at, rows = at[other], rows[other]
                scores = exact(v, rows, q, at)
                near = scores >= best.floor[at]
                best.add(at[near], vec_ids[rows[near]], scores[near])
        best.settle()
        if len(best.query):
            none = pa.array(np.zeros(len(best.query), np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(own[best.query]), pa.array(best.id), pa.array(best.score), none], names=HITS.names)

    return index.mapInArrow(scan, HITS)


def _search(pool: DataFrame, d: int, every: int, k: int, probes: int | None, query_bytes: int) -> DataFrame | None:
    """Hits among the vectors of one length."""
    spark = pool.sparkSession
    queries = materialize(pool.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("vec").alias("vec"), F.count("*").alias("rows")), "ann-queries")
    n, asked = pool.count(), queries.count()
    if not asked:
        return None
    most = max(1, SAMPLE_BYTES // (8 * d))
    lists = max(1, min(MAX_LISTS, int(n**0.5), most // 16))
    sample = smallest_hashes(pool, "vec_id", min(most, 16 * lists + FLOOR_ROWS), n, "vec").toArrow()  # at most SAMPLE_BYTES
    known, known_ids = _table_matrix(sample, "vec", d), sample["vec_id"].to_numpy()
    c = centroids(known, lists)
    index = build(pool, d, c)
    radius = np.zeros(len(c))
    for r in index.groupBy("list").agg(F.max("length").alias("r")).collect():  # at most MAX_LISTS rows
        radius[r["list"]] = r["r"]
    if probes is None:
        some = smallest_hashes(queries, "vec_id", CALIBRATION, asked).toArrow()
        probes = probes_for(index, some["vec_id"].to_numpy(), _table_matrix(some, "vec", d), c, k)
    blocks = max(1, -(-asked * 8 * d // query_bytes))
    parts = []
    for b in range(blocks):
        rows = queries.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).toArrow()  # about query_bytes
        if rows.num_rows:
            ids, q = rows["vec_id"].to_numpy(), _table_matrix(rows, "vec", d)
            floor = _floors(ids, q, known_ids[:FLOOR_ROWS], known[:FLOOR_ROWS], c, probes, k)
            hits = materialize(_top(_scan_block(index, ids, q, floor, c, radius, probes, k), k), "ann-block")
            got = hits.groupBy("query_id").count().toArrow()  # one row a query of the block
            have = dict(zip(got["query_id"].to_pylist(), got["count"].to_pylist()))
            lacks = np.array([have.get(i, 0) < min(k, n - own) for i, own in zip(ids.tolist(), rows["rows"].to_pylist())], bool)
            if lacks.any():
                again = spark.createDataFrame([(i,) for i in ids[lacks].tolist()], "query_id long")
                rest = _scan_block(index, ids[lacks], q[lacks], np.full(int(lacks.sum()), -np.inf), c, radius, 0, k)
                hits = hits.join(F.broadcast(again), "query_id", "left_anti").unionByName(_top(rest, k))
            parts.append(hits)
    if not parts:
        return None
    found = parts[0]
    for p in parts[1:]:
        found = found.unionAll(p)
    return found.select("query_id", "rank", "vec_id", "score")


def search(vectors: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", probes: int | None = None, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score for queries whose id is divisible by `every`, against all rows.

    probes: lists that a query visits; None: as many as calibration asks for, 0: all that can hold a neighbour.
    """
    ship_package(vectors.sparkSession)
    pool = valid(vectors, id_col, vec_col)
    lengths = sorted(r[0] for r in pool.select(F.size("vec")).distinct().collect())
    found = None
    for d in lengths:
        part = _search(pool.filter(F.size("vec") == d), d, every, k, probes, query_bytes)
        if part is not None:
            found = part if found is None else found.unionAll(part)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return found
