"""License scan, decontamination, SimHash, BPE: against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from array import array

import numpy as np
import pytest

from pyspark.sql import functions as F

from lattica.llm import bpe, decontam, licenses, simhash
from lattica.llm.components import components
from lattica.llm.queries import tokenizer_path

from helpers import DOCS, docs, edge_rows, keyed

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


# ---- licenses


def license_base(text):
    w = WORD.findall((text or "").translate(LOW))
    table = {("gnu", "general", "public", "license"): "gpl", ("apache", "license"): "apache", ("cc", "by"): "cc-by", ("mit", "license"): "mit"}
    places = [(i, label) for i in range(len(w)) for p, label in table.items() if tuple(w[i : i + len(p)]) == p]
    at = [i for i, _ in places]
    return len(w), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def test_license_base_matches_brute_force(spark):
    r = random.Random(3)
    pieces = ["Apache", "License", "MIT", "license,", "CC", "by", "BY-NC", "GNU", "General", "Public", "x", "apache-license", "4.0", "\n", "ÄCC", "cc/by"]
    rows = edge_rows() + [(100 + i, " ".join(r.choice(pieces) for _ in range(r.randint(0, 40)))) for i in range(300)]
    got = licenses.scan(docs(spark, rows)).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert keyed(got) == sorted(((d, *license_base(t)) for d, t in rows), key=repr)


def test_license_templates():
    s = licenses.Scanner()
    label = lambda t: s.scan(t.encode())[5]
    assert label("Licensed under the Apache License, Version 2.0.") == "apache,apache-2.0"
    assert label("under the GNU General Public License as published by the Free Software Foundation; either version 3") == "gpl,gpl-3.0"
    assert label("GNU General Public License version 2") == "gpl,gpl-2.0"
    assert label("Licensed under CC BY-NC 4.0.") == "cc-by,cc-by-nc-4.0"
    assert label("Licensed under a CC BY 4.0") == "cc-by,cc-by-4.0"
    assert label("Licensed under the Apache License, Version 1.1") == "apache"
    assert label("neither the name of Big Corp nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission") == "bsd-3-clause"
    assert label("neither the name of nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission") == ""
    assert label("a permit to mitigate") == ""
    scores = [s.scan(t)[6] for t in (b"", b"mit license", b"under the mit license")]
    assert scores[0] == 0 and 0 < scores[1] < scores[2] <= 1


def test_license_words_between_any_separators():
    s = licenses.Scanner()
    assert s.scan(b"CC, BY 4.0")[1:6] == (1, 0, 0, "cc-by", "cc-by,cc-by-4.0")
    assert s.scan(b"under CC\n   by terms")[1:6] == (1, 1, 1, "cc-by", "cc-by")
    assert s.scan(b"Creative\n    Commons Attribution 4.0")[5] == "cc-by-4.0"
    assert s.scan(b"released into the public\n\tdomain")[5] == "" and s.scan(b"this is free and unencumbered software released into the public -- domain")[5] == "unlicense"
    own = licenses.Scanner({"house": ["[all] rights {who:1-2} reserved"]})
    assert own.scan(b"All rights of Acme reserved")[5] == "house" and own.scan(b"all rights reserved")[5] == ""


def test_automaton_regions():
    a = licenses.Automaton("a [b c] {x:0-2} d")
    match = lambda t: a.match(t.encode().split(), 0)
    assert match("a d") == 2 and match("a b c d") == 4 and match("a q r d") == 4 and match("a b d") == 3
    assert match("a q r s d") == -1 and match("b c d") == -1
    with pytest.raises(ValueError):
        licenses.Automaton("a [b")


def test_templates_that_start_with_any_words():
    s = licenses.Scanner({"grant": ["{who:1-3} grants you a license"], "asis": ["this software is provided as is {how:0-2} without warranty"]})
    assert s.scan(b"Big Corp grants you a license")[5] == "grant" and s.scan(b"grants you a license")[5] == ""
    assert s.scan(b"This software is provided AS IS, without warranty")[5] == "asis"
    assert licenses.Scanner({"none": ["[maybe] {x:0-2}"]}).scan(b"maybe so")[5] == ""


def test_license_scan_takes_linear_time():
    import time

    start = time.time()
    s = licenses.Scanner()
    out = s.scan(b"mit license " * 320_000)
    assert out[1] == 320_000 and out[2:4] == (0, 639_998) and time.time() - start < 10
    s.scan(b"under the mit permission is hereby granted " * 40_000)
    assert time.time() - start < 20


def test_license_scan_of_clashing_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "MIT License", "mine", "x"), (1, "MIT License", "mine", "x"), (2, None, None, None)], "doc_id long, text string, labels string, extra string")
    out = licenses.scan(df)
    assert sorted(((r["doc_id"], r["labels"], r["extra"]) for r in out.collect()), key=repr) == [(1, "mit", "x"), (1, "mit", "x"), (2, "", None)]
    assert licenses.scan(df.limit(0)).count() == 0


# ---- decontamination


def _decontam_fixture():
    r = random.Random(5)
    words = [f"w{i}" for i in range(25)]
    items = [(i, " ".join(r.choice(words) for _ in range(r.choice([0, 1, 3, 10, 14])))) for i in range(12)] + [(50, None), (3, "w1 w2 w3")]
    texts = []
    for i in range(120):
        t = [r.choice(words + ["zz", "Q,q"]) for _ in range(r.randint(0, 30))]
        if i % 4 == 0:
            t += (r.choice(items)[1] or "").upper().split()
        texts.append((i, " ".join(t)))
    items = [(i, t) for i, t in items if t is None or len(t.split()) != 1]
    return items, texts + [(900, None), (901, ""), (902, "w1-w2_w3"), (5, "w1 w2 w3")]


@pytest.mark.parametrize("bound", [decontam.BROADCAST_BYTES, 0])
def test_decontamination_matches_brute_force(spark, bound):
    items, texts = _decontam_fixture()
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.find_hits(docs(spark, texts), bench, broadcast_bytes=bound).collect()
    out = []
    for r in got:
        hit = sum(b - a for a, b in zip(r["hit_from"], r["hit_to"]))
        out.append((r["doc_id"], r["n_words"], hit, len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), hit > 0))
    assert sorted(out, key=repr) == sorted(decontam.brute(texts, items), key=repr)


def test_decontamination_edges(spark):
    bench = spark.createDataFrame([(1, "one"), (None, "two words")], "item_id long, text string")
    rows = {r["doc_id"]: r for r in decontam.digest(docs(spark, edge_rows()), bench).collect()}
    assert rows[4]["n_hit"] == 1 and rows[5]["n_hit"] == 2 and rows[5]["n_items"] == 0 and rows[1]["n_words"] == 0
    assert decontam.digest(docs(spark, edge_rows()), bench.limit(0)).filter("contaminated").count() == 0
    assert decontam.digest(docs(spark, []), bench).count() == 0


def test_windows_of_long_texts_and_large_benchmarks(monkeypatch):
    """Parts of long texts overlap, so windows across their borders are found; the index stays within its stated size."""
    monkeypatch.setattr(decontam, "PART", 50)
    r = random.Random(6)
    items = [(i, " ".join(f"w{r.randint(0, 400)}" for _ in range(r.choice([4, 10, 60])))) for i in range(80)]
    index = decontam.WindowIndex([(str(i), t.encode()) for i, t in items])
    text = " ".join(" ".join(f"v{k}" for k in range(r.randint(0, 30))) + " " + r.choice(items)[1] for _ in range(40))
    hit, found = index.hits(decontam.words_of(text.encode()))
    ((_, n, cut, m, _, _),) = decontam.brute([(1, text)], items)
    assert (len(hit), int(hit.sum()), len(found)) == (n, cut, m)
    assert index.nbytes <= 15 * sum(len(t) + 1 for _, t in items)
    same = decontam.WindowIndex([(str(i), b"a b c d e f g h i j k") for i in range(500)])
    assert len(same.hits(b"x a b c d e f g h i j".split())[1]) == 500


def test_equal_hashes_of_different_windows(monkeypatch):
    """With a hash that can't tell windows apart, another base is tried; here the first is made to fail."""
    made = decontam.Rolling.hashes
    monkeypatch.setattr(decontam.Rolling, "hashes", lambda self, raw, a, b: made(self, raw, a, b) & np.uint64(3) if self.base == decontam.Rolling(0).base else made(self, raw, a, b))
    index = decontam.WindowIndex([("1", b"one two three"), ("2", b"four five six"), ("3", b"seven eight nine"), ("4", b"ten ten ten"), ("5", b"six six six")])
    assert index.rolling.base != decontam.Rolling(0).base and index.hits([b"four", b"five", b"six"])[1] == {"2"}


@pytest.mark.parametrize("bound", [decontam.BROADCAST_BYTES, 0])
def test_removal_keeps_columns(spark, bound):
    passage = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    df = spark.createDataFrame([(1, "a b c d e f g h i j k l m " + passage, "mine", 5, 9), (2, "clean", "mine", 5, 9), (2, "clean", "mine", 5, 9)], "doc_id long, text string, items string, N_Words int, hit_from int")
    df = df.withColumn("row", F.lit("mine")).withColumn("_row", F.lit("mine")).withColumn("own", F.lit("mine")).withColumn("_text", F.lit("mine"))
    out = decontam.remove_hits(df, bench, broadcast_bytes=bound)
    assert out.columns == df.columns and out.count() == 3
    for r in out.collect():
        assert (r["items"], r["N_Words"], r["hit_from"], r["row"], r["_row"], r["own"], r["_text"]) == ("mine", 5, 9, "mine", "mine", "mine", "mine")
        assert r["text"] == ("a b c d e f g h i j k l m " if r["doc_id"] == 1 else "clean")
    assert decontam.remove_hits(df.limit(0), bench, broadcast_bytes=bound).count() == 0


def test_removal_cuts_only_hits(spark):
    passage = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    wide = "doc_id long, text string, lang string, source string, n_chars long, n_words string"
    clean = "Keep this, all of it: ünchanged words here, and more words than the passage has so that most of it stays."
    rows = [(1, f"{clean} {passage.upper()} End.", "en", "s", 999, "x"), (2, clean, "en", "s", 7, "x"), (3, passage, "en", "s", 1, "x"), (4, None, None, None, None, None)]
    df = spark.createDataFrame(rows, wide)
    out = {r["doc_id"]: r for r in decontam.remove_hits(df.drop("n_words"), bench).collect()}
    assert set(out) == {1, 2, 4}
    assert out[1]["text"] == f"{clean}  End." and out[1]["n_chars"] == len(out[1]["text"])
    assert out[2]["text"] == clean and out[2]["n_chars"] == 7 and out[4]["text"] is None


# ---- SimHash


def test_golay_table():
    t = simhash._golay()
    assert (t >> 12).max() == 3 and len(np.unique(t & 0xFFF)) == 4096
    assert [int((t >> 12 == d).sum()) for d in range(4)] == [4096, 4096 * 23, 4096 * 253, 4096 * 1771]


def test_every_near_pair_shares_a_key():
    r = random.Random(1)
    for _ in range(400):
        a = r.getrandbits(64)
        b = a
        for bit in r.sample(range(64), r.randint(0, 3)):
            b ^= 1 << bit
        fp = np.array([a, b], np.uint64)
        fr, fk, lr, lk = simhash.keys_of(fp)
        assert set(fk[fr == 0]) & set(lk[lr == 1]) and set(fk[fr == 1]) & set(lk[lr == 0])


def test_simhash_matches_brute_force(spark):
    r = random.Random(2)
    base = [" ".join(r.choice("ab cd ef gh ij kl".split()) + str(r.randint(0, 40)) for _ in range(60)) for _ in range(25)]
    rows = edge_rows()
    for i in range(260):
        w = r.choice(base).split(" ")
        for _ in range(r.choice([0, 0, 1, 2])):
            w[r.randrange(len(w))] = r.choice(["Q", "z9"])
        rows.append((1000 + i, " ".join(w).title() if r.random() < 0.2 else " ".join(w)))
    rows = [x for x in rows if x[0] is not None]
    got = keyed(simhash.group(docs(spark, rows).repartition(5)))
    assert got == sorted(simhash.brute(rows), key=repr)
    assert simhash.group(docs(spark, [])).count() == 0


def test_linked_pairs_share_finer_keys():
    r = random.Random(3)
    for _ in range(300):
        a = r.getrandbits(64)
        b = a
        for bit in r.sample(range(64), r.randint(0, 3)):
            b ^= 1 << bit
        fp = np.array([a, b], np.uint64)
        fr, fk, lr, lk = simhash.keys_of(fp)
        for key in set(fk[fr == 0]) & set(lk[lr == 1]):
            _, x = simhash.finer_keys(np.array([key << 1]), fp[:1])
            _, y = simhash.finer_keys(np.array([key << 1 | 1]), fp[1:])
            assert set(x >> 1) & set(y >> 1) and (x > 0).all()


def test_hot_keys_lose_no_link(spark):
    """Fingerprints that differ in few places, so that most keys are hot."""
    r = random.Random(4)
    fps = list({0x0123456789ABCDEF ^ sum(1 << b for b in r.sample(range(0, 64, 3), r.randint(0, 9))) for _ in range(400)})
    frame = spark.createDataFrame([(x if x < 1 << 63 else x - (1 << 64),) for x in fps], "fp long").repartition(4)
    roots = lambda hot: {r["node"]: r["root"] for r in simhash.fingerprint_components(frame, hot_key=hot).collect()}
    assert roots(5) == roots(10**9) != {}


def test_hot_fingerprints_and_roots(spark):
    """One text holds most rows; one component most fingerprints."""
    rows = [(i, "the same text as all the others have") for i in range(3000)] + [(5000 + i, f"word{i} alone") for i in range(40)] + [(7000 + i, None) for i in range(50)]
    got = {r["doc_id"]: r["component_id"] for r in simhash.group(docs(spark, rows)).collect()}
    assert all(got[i] == 0 for i in range(3000)) and all(got[7000 + i] == 7000 for i in range(50))
    star = spark.range(1, 4000).selectExpr("0L AS a", "id AS b")
    assert {r["root"] for r in components(star).collect()} == {0}


def test_deduplicate_keeps_one_of_each_group(spark):
    text = " ".join(f"t{i}" for i in range(50))
    other = " ".join(f"u{i}" for i in range(50))
    rows = [(3, text, "a"), (1, text, "b"), (1, text, "b"), (2, other, "c"), (7, None, "d"), (9, "", "e"), (None, text, "f")]
    out = simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string, fp string"))
    assert out.columns == ["doc_id", "text", "fp"]
    assert keyed(out.select("doc_id", "fp")) == [(1, "b"), (2, "c"), (7, "d"), (None, "f")]
    unlike = spark.createDataFrame([(1, text, "z"), (1, text, "b"), (1, text, None)], "doc_id long, text string, source string")
    assert {simhash.deduplicate(unlike.repartition(n)).first()["source"] for n in (1, 2, 3)} == {None}


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (5, 5)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- BPE


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def test_bpe_matches_the_library(spark, library):
    r = random.Random(4)
    some = [x.text for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()]
    odd = ["".join(r.choice("ab eé's\n  .,12!<|endoftext|>日՘\tĀ  'RE") for _ in range(r.randint(0, 80))) for _ in range(1500)]
    rows = [(i, t) for i, t in enumerate(some + odd)] + edge_rows()
    got = keyed(bpe.encode(docs(spark, rows), tokenizer_path()).drop("text"))
    want = []
    for d, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want.append((d, len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert got == sorted(want, key=repr)


def test_bpe_cache_starts_anew(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 40)
    c = bpe.Codec(open(tokenizer_path(), encoding="utf-8").read())
    texts = [f"some words number {i} <|endoftext|> again{i}" for i in range(60)]
    for t in texts:
        assert array("I", c.encode_many([t])[0]).tolist() == library.encode(t, add_special_tokens=False).ids


def test_bpe_ids_column_and_clash(spark, library):
    df = spark.createDataFrame([(1, "hello world", "old")], "doc_id long, text string, n_tokens string")
    r = bpe.encode(df, tokenizer_path(), with_ids=True).first()
    assert r["token_ids"] == library.encode("hello world").ids and r["n_tokens"] == 2
    assert bpe.encode(df.limit(0), tokenizer_path(), with_ids=True).count() == 0
