"""The pipeline against a plain version of each stage."""

from __future__ import annotations

import hashlib
import re
from array import array

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as C
from lattica.llm import decontam, quality, secrets, simhash
from lattica.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_match_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    # quality
    forest = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    keep = {d: t for d, t in rows.items() if forest.predict(np.array([quality.statistics(t.encode())]))[0] >= 0.5}
    got = C.quality(spark, docs, SF)
    assert got.columns == COLUMNS and {r["doc_id"]: r["text"] for r in got.collect()} == keep
    # near duplicates
    keep = {d: keep[d] for d, _, c in simhash.brute(sorted(keep.items())) if d == c}
    got = C.near_duplicates(spark, got, SF)
    assert got.columns == COLUMNS and {r["doc_id"]: r["text"] for r in got.collect()} == keep
    # decontamination
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    index = decontam.WindowIndex([(str(i), t.encode()) for i, t in items])
    after = {}
    for d, t in keep.items():
        hit, _ = index.hits(decontam.words_of(t.encode()))
        places = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(LOW))]
        assert len(places) == len(hit)
        if len(hit) and hit.mean() >= 0.5:
            continue
        for a, b in reversed(list(zip(*decontam._runs(hit)))):
            t = t[: places[a][0]] + t[places[b - 1][1] :]
        after[d] = t
    got = C.decontamination(spark, got, SF)
    assert got.columns == COLUMNS and {r["doc_id"]: r["text"] for r in got.collect()} == after
    assert any(after[d] != keep[d] for d in after)
    # secrets
    net = secrets.trained_network()
    for d, t in after.items():
        end = len(t) + 1
        for a, b, _ in reversed(secrets.scan_text(t, net)[1]):
            if b <= end:
                t, end = t[:a] + "[SECRET]" + t[b:], a
        after[d] = t
    got = C.secrets(spark, got, SF)
    assert got.columns == COLUMNS
    found = {r["doc_id"]: (r["text"], r["n_chars"]) for r in got.collect()}
    assert {d: t for d, (t, _) in found.items()} == after and all(n == len(t) for t, n in found.values())
    # tokens
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    want = {d: hashlib.sha256(array("I", library.encode(t, add_special_tokens=False).ids).tobytes()).hexdigest() for d, t in after.items()}
    assert {r["doc_id"]: r["ids_sha256"] for r in C.run(spark, SF).collect()} == want


def test_stages_take_odd_documents(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "a b c " * 400, "en", "s", 2400), (3, "a b c " * 400, "en", "s", 2400), (None, "x y z", None, None, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for frame in (docs, docs.limit(0)):
        for name, stage in C.STAGES:
            out = stage(spark, frame, SF)
            assert (out.columns == COLUMNS) == (name != "tokens") and out.count() <= frame.count()


def test_stages_keep_clashing_columns(spark):
    own = ["score", "predicted", "fp", "_keep", "component_id", "n_words", "items", "hit_from", "hit_to", "spans", "n_assign", "_score", "_clean", "_own", "_row", "_id"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    for c in own:
        docs = docs.withColumn(c, F.lit("mine"))
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert out.count() == out.filter(" AND ".join(f"{c} = 'mine'" for c in own)).count() > 0, name
    assert C.STAGES[-1][1](spark, docs, SF).count() == 60
