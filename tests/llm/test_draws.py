"""Fingerprints and importance resampling against brute force."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tests.llm.common import docs_of, prose
from tests.llm.test_dedup import brute_classes, near_corpus
from tilegraph.llm import bagminhash, fingerprints, importance
from tilegraph.llm.common import Words

# ---------------------------------------------------------------- fingerprints


def cut(fingerprint):
    return [fingerprint[i : i + 4] for i in range(0, len(fingerprint), 4)]


def share(a, b):
    return sum(x == y for x, y in zip(cut(a), cut(b), strict=True)) / len(cut(a))


def shingles(text):
    w = re.findall("[a-z0-9\x80-\U0010ffff]+", (text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def hold(rows, texts):
    """What each fingerprint row must say, of documents in the order of their ids."""
    for k, r in enumerate(rows):
        text, following = texts[k] or "", texts[(k + 1) % len(texts)] or ""
        q = len(text) // 4
        changed = text[: len(text) - q] + following[:q]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert abs(r["near_edited"] - share(r["fingerprint"], r["edited_fingerprint"])) < 1e-12
        assert abs(r["near_next"] - share(r["fingerprint"], rows[(k + 1) % len(rows)]["fingerprint"])) < 1e-12


def test_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "CHUNK", 3000)
    texts = [*near_corpus(), "é" * 9, "ß und " * 400]
    rows = fingerprints.fingerprint(docs_of(spark, texts).repartition(5)).orderBy("doc_id").collect()
    hold(rows, texts)
    sets = [shingles(t) for t in texts]
    near = lambda i, j: bool(sets[i] and sets[j]) and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8
    assert [r["class_id"] for r in rows] == brute_classes(len(texts), near)
    for i, j in itertools.combinations(range(len(texts)), 2):
        if (texts[i] or "") == (texts[j] or ""):
            assert rows[i]["fingerprint"] == rows[j]["fingerprint"]


def test_fingerprint_tables(spark):
    for texts in ([], ["a b c d e f g h"], [None], [None, "x y z"]):
        rows = fingerprints.fingerprint(docs_of(spark, texts)).orderBy("doc_id").collect()
        assert len(rows) == len(texts)
        hold(rows, texts)
    few = docs_of(spark, ["one two three four five six", None, ""]).withColumn("doc_id", F.expr("nullif(doc_id, 1)"))
    clash = few.union(few).withColumns({c: F.lit(1) for c in ("part", "side", "registers", "n_shingles", "__doc", "leader")})
    rows = fingerprints.fingerprint(clash).collect()
    assert len(rows) == 6 and sorted(r["class_id"] for r in rows if r["doc_id"] is not None) == [0, 0, 2, 2]
    assert sum(r["doc_id"] is None and r["class_id"] is None for r in rows) == 2


def test_likeness_estimates_jaccard():
    rng = random.Random(3)
    base = prose(rng, 400).split()
    errors = []
    for part in np.linspace(0, 1, 21):
        n = int(len(base) * part)
        a, b = " ".join(base), " ".join(base[:n] + prose(rng, len(base) - n).split())
        r = fingerprints.registers(Words([a, b]))
        x, y = shingles(a), shingles(b)
        errors.append(fingerprints.likeness(r[:1], r[1:])[0] - len(x & y) / len(x | y))
    assert np.abs(errors).max() < 0.2 and abs(np.mean(errors)) < 0.04


def test_bands_lose_nothing():
    """A pair at the threshold shares no band once in some 300,000 cases."""
    assert (1 - 0.8**bagminhash.ROWS) ** bagminhash.BANDS < 4e-6


# ---------------------------------------------------------------- resampling


def drawn(docs, target):
    """(n_features, weight, score, rank, n_words) of each (doc_id, text)."""

    def of(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
        return w, [zlib.crc32(f.encode()) % 10000 for f in w + [" ".join(p) for p in itertools.pairwise(w)]]

    docs = [(i, *of(t)) for i, t in docs]
    s, t = Counter(b for _, _, f in docs for b in f), Counter(b for text in target for b in of(text)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000))))
    out = []
    for i, w, f in docs:
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    best = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0]))
    for k, r in enumerate(best[: 25 * len(best) // 100]):
        r[4] = k + 1
    return sorted(map(tuple, out))


def test_resampling(spark):
    rng = random.Random(9)
    texts = [prose(rng, rng.randint(1, 60)) for _ in range(150)] + [None, "", "...", "ÉÀ Éa? b-C 3d\x00e " * 30, "long " * 20_000, "Bench mark text " * 9]
    target = ["bench mark text", "Mark, text!", None, ""]
    bench = spark.createDataFrame(list(enumerate(target)), "item_id long, text string")
    got = sorted(map(tuple, importance.query(docs_of(spark, texts).repartition(3), bench).collect()))
    assert got == drawn(list(enumerate(texts)), target)
    none = bench.limit(0)
    assert sorted(map(tuple, importance.query(docs_of(spark, texts), none).collect())) == drawn(list(enumerate(texts)), [])
    assert importance.query(docs_of(spark, []), bench).count() == 0


def test_resampling_repeated_rows(spark):
    docs = docs_of(spark, ["alpha beta " * 15, "gamma delta " * 15, None]).withColumn("doc_id", F.expr("nullif(doc_id, 2)"))
    clash = docs.union(docs).withColumns({c: F.lit("x") for c in ("row", "pos", "w", "bucket", "gain", "score", "place")})
    bench = spark.createDataFrame([(1, "gamma delta")], "item_id long, text string")
    rows = importance.query(clash, bench).collect()
    assert len(rows) == 6 and [r["rank"] for r in rows if r["rank"] is not None] == [1]
    assert {(r["doc_id"], r["weight"]) for r in rows if r["doc_id"] == 1} == {(1, max(r["weight"] for r in rows if r["n_features"]))}


def test_higher_orders(spark):
    table = importance.position_table(docs_of(spark, ["a b c", None]), orders=3, buckets=97).orderBy("doc_id", "pos").collect()
    code = lambda f: zlib.crc32(f.encode()) % 97
    assert [(r["pos"], r["b1"], r["b2"], r["b3"]) for r in table] == [(0, code("a"), code("a b"), code("a b c")), (1, code("b"), code("b c"), None), (2, code("c"), None, None), (None, None, None, None)]
