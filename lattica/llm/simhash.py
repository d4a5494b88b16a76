"""SimHash near-duplicates by fuzzy hashing with the perfect Golay code.

A document's fingerprint has 64 bits, each the majority of that bit in the XXH64 hashes of its word shingles. Two
fingerprints link at `bits` (3) or fewer differing bits. Candidate pairs come from keys: cut the 64 bits into four
segments of 16. At most three bits differ, so one segment is equal in both; of the two 24-bit halves of the other 48
bits, one has at most one differing bit. 23 bits of a half are decoded by the [23, 12] Golay code: the index of the
codeword within distance 3 of one fingerprint's half is among the indices within distance 4 of the other's, which are
one or six. So the equal segment and a codeword index make a key: 8 keys to be found under, 8 to 48 to look with. Every
candidate is verified on all 64 bits. Within a key, links are followed from one fingerprint to those not yet reached, so
only the edges of a spanning forest leave it, never all pairs of a group; components are then found with joins.

A key of more than HOT_KEY rows is split first: of the other 48 bits' six bytes, three at least are equal in a linked pair, so
each of its rows goes under 20 finer keys, one for each three of the bytes. A finer key leaves 24 bits free, and among
fingerprints that agree in all others at most 7,220 are pairwise unlinked: what one task closes stays bounded.

Equal fingerprints are one node, so copies add no links; fingerprints that many documents share are looked up in a broadcast
table of bounded size. Defined cases: null and empty texts have the zero fingerprint,
which links like any other; fewer words than a shingle make one shingle of the whole sequence; repeated rows share their
component; a group of rows without any id has no component_id, and deduplicate keeps rows without an id; an empty
table gives an empty result.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from lattica.llm.common import append_columns, as_bytes, hot_lookup, materialize, private, ship_package
from lattica.llm.components import components

SHINGLE = 3
BITS = 3
_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
_BLOCK = 200_000
#: Rows of a key beyond which it is split.
HOT_KEY = 20_000


def fingerprint(text: bytes, shingle: int = SHINGLE) -> bytes:
    """The 8 bytes of a text's fingerprint, most significant first."""
    from xxhash import xxh64_digest

    words = text.translate(_LOWER).split()
    if not words:
        return bytes(8)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxh64_digest(joined, 42)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-1]])
    total, n = np.zeros(64, np.int64), len(words) - shingle + 1
    for k in range(0, n, _BLOCK):  # a bounded part of a long text at a time
        a = starts[k : min(n, k + _BLOCK)].tolist()
        b = (ends[k + shingle - 1 : min(n, k + _BLOCK) + shingle - 1] - 1).tolist()
        hashes = b"".join([xxh64_digest(joined[x:y], 42) for x, y in zip(a, b)])
        total += np.unpackbits(np.frombuffer(hashes, np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return np.packbits(total * 2 > n).tobytes()


def with_fingerprints(docs: DataFrame, text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """docs with fp, the fingerprint as a signed 64-bit number."""
    at = docs.columns.index(text_col)

    def make():
        def work(batch):
            raw = b"".join(fingerprint(t, shingle) for t in as_bytes(batch.column(at)))
            return [pa.array(np.frombuffer(raw, ">u8").astype(np.uint64).view(np.int64))]

        return work

    return append_columns(docs, [StructField("fp", LongType())], make)


@cache
def _golay() -> np.ndarray:
    """For each 23-bit word, the 12-bit index of the codeword within distance 3 (bits 0 to 11), and its distance (12, 13)."""
    generator = 0b110001110101  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
    words = np.zeros(4096, np.int64)
    for m in range(4096):
        rest = m << 11
        for k in range(22, 10, -1):
            if rest >> k & 1:
                rest ^= generator << (k - 11)
        words[m] = m << 11 | rest
    table = np.zeros(1 << 23, np.uint16)
    index = np.arange(4096, dtype=np.uint16)
    one = 1 << np.arange(23)
    errors = {0: [0], 1: one.tolist()}
    errors[2] = [int(a | b) for i, a in enumerate(one) for b in one[i + 1 :]]
    errors[3] = [int(one[i] | one[j] | one[k]) for i in range(23) for j in range(i + 1, 23) for k in range(j + 1, 23)]
    for d, patterns in errors.items():
        for e in patterns:
            table[words ^ e] = index | np.uint16(d << 12)
    return table


def keys_of(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers and keys to be found under, row numbers and keys to look with, for fingerprints (uint64)."""
    table = _golay()
    rows = np.arange(len(fp))
    found_row, found_key, look_row, look_key = [], [], [], []
    for s in range(4):
        segment = (fp >> np.uint64(16 * s)) & np.uint64(0xFFFF)
        low = fp & np.uint64((1 << 16 * s) - 1)
        high = fp >> np.uint64(16 * s) >> np.uint64(16)
        rest = (high << np.uint64(16 * s)) | low
        for half in range(2):
            w = ((rest >> np.uint64(24 * half)) & np.uint64(0x7FFFFF)).astype(np.int64)
            mark = ((2 * s + half) << 28) | (segment.astype(np.int64) << 12)
            own = table[w]
            found_row.append(rows)
            found_key.append(mark | (own & 0xFFF))
            near = np.stack([own & 0xFFF, *(table[w ^ (1 << k)] & 0xFFF for k in range(23))], 1)
            near.sort(1)
            new = np.ones(near.shape, bool)
            new[:, 1:] = near[:, 1:] != near[:, :-1]
            r, c = np.nonzero(new)
            look_row.append(r)
            look_key.append(mark[r] | near[r, c])
    return tuple(map(np.concatenate, (found_row, found_key, look_row, look_key)))


def _with_keys(batches):
    """(key, fp, look): each fingerprint under all its keys."""
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        for k in range(0, len(fp), 20_000):
            part = fp[k : k + 20_000]
            fr, fk, lr, lk = keys_of(part.view(np.uint64))
            key = np.concatenate([fk << 1, lk << 1 | 1])  # the last bit: to look with
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[np.concatenate([fr, lr])])], names=["key", "fp"])


_TRIPLES = [(i, j, k) for i in range(6) for j in range(i + 1, 6) for k in range(j + 1, 6)]


def finer_keys(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and finer keys of (key, fingerprint as uint64) rows; the last bit still tells what the row is for."""
    segment = (key >> 30 & 3).astype(np.uint64) * np.uint64(16)  # where the segment that is equal begins
    low = fp & ((np.uint64(1) << segment) - np.uint64(1))
    # 48 bits: shifting in two steps, as one of 64 bits isn't defined
    rest = (fp >> segment >> np.uint64(16)) << segment | low
    part = [(rest >> np.uint64(8 * i) & np.uint64(0xFF)).astype(np.int64) for i in range(6)]
    out = [1 << 62 | n << 56 | (key >> 1) << 25 | part[i] << 17 | part[j] << 9 | part[k] << 1 | key & 1 for n, (i, j, k) in enumerate(_TRIPLES)]
    return np.tile(np.arange(len(key)), len(out)), np.concatenate(out)


def _with_finer_keys(batches):
    for batch in batches:
        key, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        rows, finer = finer_keys(key, fp.view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(finer), pa.array(fp[rows])], names=["key", "fp"])


def spanning_links(fp: np.ndarray, bits: int = BITS) -> tuple[list[int], list[int]]:
    """Edges of a spanning forest of the links among distinct fingerprints (uint64)."""
    a, b = [], []
    left = fp
    while len(left) > 1:
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            x = todo.pop()
            near = np.bitwise_count(left ^ x) <= bits
            if near.any():
                new = left[near]
                a += [int(x)] * len(new)
                b += new.tolist()
                todo += list(new)
                left = left[~near]
    return a, b


def _links(batches):
    """Spanning edges within each key; rows come sorted by key."""

    def close(key, fp):
        """Edges among the rows of whole keys."""
        base = key >> 1
        edge = np.flatnonzero(np.concatenate([[True], base[1:] != base[:-1], [True]]))
        a, b = [], []
        for s, e in zip(edge[:-1], edge[1:]):
            # a key without rows of both kinds links nothing
            if e - s > 1 and not key[s] & 1 and key[e - 1] & 1:
                x, y = spanning_links(np.unique(fp[s:e]).view(np.uint64))
                a += x
                b += y
        pair = [pa.array(np.array(v, np.uint64).view(np.int64)) for v in (a, b)]
        return pa.RecordBatch.from_arrays(pair, names=["a", "b"])

    keys, fps = np.zeros(0, np.int64), np.zeros(0, np.int64)
    parts = []
    for batch in batches:
        k, f = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
        if not len(k):
            continue
        parts.append((k, f))
        if k[-1] >> 1 == parts[0][0][0] >> 1 and len(parts) < 1000:  # one key so far
            continue
        keys, fps = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        whole = np.searchsorted(keys, keys[-1] >> 1 << 1)
        if whole:
            yield close(keys[:whole], fps[:whole])
        parts = [(keys[whole:], fps[whole:])]
    if parts:
        yield close(*(np.concatenate([p[i] for p in parts]) for i in (0, 1)))


def fingerprint_components(fps: DataFrame, bits: int = BITS, hot_key: int = HOT_KEY) -> DataFrame:
    """node, root: components of the linked fingerprints among distinct ones (column fp); unlinked ones don't appear."""
    if bits > 3:
        raise ValueError("the keys find pairs of at most 3 differing bits")
    ship_package(fps.sparkSession)
    key = StructType([StructField("key", LongType()), StructField("fp", LongType())])
    pair = StructType([StructField("a", LongType()), StructField("b", LongType())])
    keyed = fps.select("fp").mapInArrow(_with_keys, key)
    place = F.shiftright("key", 1)
    hot = materialize(keyed.groupBy(place.alias("hot")).count().filter(F.col("count") > hot_key).select("hot"), "simhash-hot-keys")
    if not hot.isEmpty():
        # hot keys are as many as rows / hot_key at most: they grow with the input and aren't broadcast
        split = keyed.join(hot.hint("shuffle_hash"), place == F.col("hot"), "left_semi").mapInArrow(_with_finer_keys, key)
        keyed = keyed.join(hot.hint("shuffle_hash"), place == F.col("hot"), "left_anti").unionAll(split)
    met = keyed.repartition(F.shiftright("key", 1)).sortWithinPartitions("key")
    return components(met.mapInArrow(_links, pair).distinct())


def group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """id, fingerprint (16 hexadecimal digits) and component_id, the smallest id reachable over links."""
    marked = materialize(with_fingerprints(docs.select(id_col, text_col), text_col, shingle).drop(text_col), "simhash")
    fps = materialize(marked.groupBy("fp").agg(F.min(id_col).alias("first"), F.count("*").alias("copies")), "simhash-fingerprints")
    roots = fingerprint_components(fps)
    placed = fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    of = placed.join(smallest, "root").select("fp", "component_id")
    hot = fps.filter(F.col("copies") > F.greatest(F.lit(1000), F.lit(marked.count() / 1000))).select("fp")  # under 1,000 rows
    out = hot_lookup(marked, of, "fp", hot)
    return out.select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """docs (columns as given) with the document of smallest id of each group; of rows that share that id, the one whose
    columns (maps aside) sort first."""
    found = group(docs, id_col, text_col, shingle)
    name, = private(docs, "keep")
    keep = found.filter(F.col(id_col) == F.col("component_id")).groupBy(F.col(id_col).alias(name)).agg(F.count("*").alias("rows"))
    keep = materialize(keep, "simhash-kept")
    named = docs[id_col] == F.col(name)
    # texts are dealt by id at every size: the kept ids grow with the input, so they are never broadcast
    out = docs.join(keep.select(name).hint("merge"), named, "left_semi")
    repeated = keep.filter("rows > 1").select(name)
    if not repeated.isEmpty():
        ordered = [f"`{f.name}`" for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
        again = out.join(repeated, named, "left_semi").select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("row"), F.struct(*ordered).alias("by"), F.col(id_col).alias("id"))
        again = again.groupBy("id").agg(F.min_by("row", "by").alias("row")).select("row.*")
        out = out.join(repeated, named, "left_anti").unionByName(again)
    return out.unionByName(docs.filter(F.col(id_col).isNull())).select(*[f"`{c}`" for c in docs.columns])


def brute(docs: list[tuple[int, str | None]]) -> list[tuple[int, str, int]]:
    """Plain reference for tests."""
    import re

    import xxhash

    fps = []
    for _, text in docs:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
        fps.append(sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)))
    root = list(range(len(docs)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                root[top(i)] = top(j)
    smallest: dict[int, int] = {}
    for i, (d, _) in enumerate(docs):
        smallest[top(i)] = min(d, smallest.get(top(i), d))
    return [(d, f"{fps[i]:016x}", smallest[top(i)]) for i, (d, _) in enumerate(docs)]
