"""Line dedup, repeat removal, near-duplicate texts and vectors against brute force."""

import hashlib
import itertools
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.common import docs_of, prose
from tests.oracle import connect, rows_of, sql_rows
from tilegraph.llm import bagminhash, embed_dedup, line_dedup, queries, rindex
from tilegraph.llm.common import Words


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, sf_dir, name):
    assert rows_of(queries.queries()[name](spark, sf_dir)) == sql_rows(connect(sf_dir), queries.oracle_sql()[name])


# ---------------------------------------------------------------- lines


@pytest.mark.parametrize("most_keys", [line_dedup.MOST_KEYS, 0])
def test_lines_by_site(spark, monkeypatch, most_keys):
    from tilegraph.functions import storage

    monkeypatch.setattr(line_dedup, "MOST_KEYS", most_keys)
    monkeypatch.setattr(storage, "HOT_ROWS", 5)
    texts = [f"menu\nown {i}\n  menu  \nfoot" for i in range(8)] + ["menu\nmine", None, "", "\n\n", "menu"]
    docs = docs_of(spark, texts, lambda i: None if i == 12 else "b" if i == 8 else "a")
    got = {r["doc_id"]: r for r in line_dedup.query(docs).collect()}
    assert got[0]["text"] == "own 0" and (got[0]["n_lines"], got[0]["n_dropped"]) == (4, 3)
    assert got[8]["text"] == "menu\nmine"  # another site
    assert got[9]["text"] is None and got[10]["text"] == "" and got[11]["text"] == "\n\n" and got[12]["text"] == "menu"
    staged = line_dedup.stage(docs)
    assert staged.columns == docs.columns and staged.where("n_chars <> length(text)").isEmpty() and staged.count() == len(texts)
    assert line_dedup.query(docs.limit(0)).count() == 0
    clash = docs.withColumnsRenamed({"lang": "pages"}).withColumn("keys", docs["doc_id"]).withColumn("h", docs["source"])
    assert line_dedup.stage(clash).columns == clash.columns
    # pages of one host, by their URLs
    urls = docs_of(spark, [f"menu\nown {i}" for i in range(8)] + ["menu"], lambda i: "http://b.org/menu" if i == 8 else f"https://me@A.org:80/p{i}?q")
    assert [r["text"] for r in line_dedup.query(urls).orderBy("doc_id").collect()] == [*(f"own {i}" for i in range(8)), "menu"]
    twice = line_dedup.query(docs.union(docs)).where("doc_id = 0").collect()
    assert [(r["n_lines"], r["n_dropped"]) for r in twice] == [(4, 3)] * 2


def test_a_host_with_very_many_boilerplate_lines(spark):
    """100,000 of them, each on a quarter of the host's 20 pages: a page meets its own lines, not the host's."""
    texts = ["\n".join([f"own {p}", *(f"line {k}" for k in range(100_000) if (k + p) % 4 == 0)]) for p in range(20)]
    began = time.time()
    rows = line_dedup.query(docs_of(spark, [*texts, "line 3"], lambda i: "a" if i < 20 else "b")).collect()
    assert {(r["doc_id"], r["text"], r["n_dropped"]) for r in rows} == {*((p, f"own {p}", 25_000) for p in range(20)), (20, "line 3", 0)}
    assert time.time() - began < 60


def test_lines_of_long_texts(spark):
    texts = ["line %d\n" % k * 50_000 for k in range(6)] + ["x" * 2_000_000 + "\nmenu"] * 6
    got = line_dedup.query(docs_of(spark, texts)).orderBy("doc_id").collect()
    assert [r["n_dropped"] for r in got] == [0] * 6 + [2] * 6 and all(r["text"] == t for r, t in zip(got[:6], texts, strict=False))


# ---------------------------------------------------------------- repeats


def brute_repeats(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r), dtype=bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((len(r), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(r, dtype=np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def corpus(seed=1):
    rng = random.Random(seed)
    base = [prose(rng, rng.randint(20, 300), "abcdé") for _ in range(20)]
    line = prose(rng, 45)
    texts = [*base, *base[:4], *(prose(rng, 30) + line + prose(rng, 30) for _ in range(25))]
    for b in base[4:10]:
        w = b.split()
        for _ in range(3):
            w[rng.randrange(len(w))] = "x" * rng.randint(1, 5)
        texts.append(" ".join(w))
    return [*texts, "a" * 1000, "a" * 150, "ab" * 400, ("xyz" * 50 + "q") * 5, prose(rng, 60) * 2, "", None, "é" * 300, base[3][:250], base[3][100:420]]


@pytest.mark.parametrize("most_bytes", [rindex.MOST_BYTES, 2000, 0])
def test_repeats(spark, most_bytes):
    texts = corpus()
    rows = rindex.remove_repeats(docs_of(spark, texts), most_bytes=most_bytes).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in rows] == brute_repeats(texts, 200)


def test_repeats_in_slabs(spark, monkeypatch):
    texts = corpus(7)
    monkeypatch.setattr(rindex, "SLAB", 777)
    monkeypatch.setattr(rindex, "LONG_RUN", 300)
    routed = [b for b in rindex._routed([(t or "").encode() for t in texts], *(np.arange(len(texts)) for _ in range(4)), 200, 64)]
    covered = [np.zeros(max(len((t or "").encode()) - 199, 0), dtype=int) for t in texts]
    for b in routed:
        for uid, start, offset, n in zip(*(b.column(c).to_pylist() for c in ("uid", "start", "weight", "n")), strict=True):
            covered[uid][start - offset : start - offset + n] += 1
    assert all((c == 1).all() for c in covered)  # each window is routed once
    assert rindex.remove_repeats(docs_of(spark, [])).count() == 0


def test_repeats_of_repeated_rows(spark):
    docs = docs_of(spark, ["k" + prose(random.Random(3), 80)]).withColumns({c: F.lit(1) for c in ("key", "uid", "h", "mark", "spans", "first", "n")})
    rows = rindex.remove_repeats(docs.union(docs)).collect()
    assert len(rows) == 2 and all(r["n_removed"] == r["n_bytes"] for r in rows)


def test_repeats_with_null_and_repeated_ids(spark):
    one, two, three = (prose(random.Random(k), 90) for k in (1, 2, 3))
    texts = [one, two, one + two, three, three, None]
    docs = docs_of(spark, texts).withColumn("doc_id", F.expr("element_at(array(null, null, 7, 7, 8, null), cast(doc_id + 1 as int))"))
    rows = rindex.remove_repeats(docs).collect()
    want = brute_repeats(texts, 200)
    ids = [None, None, 7, 7, 8, None]
    assert sorted(map(repr, (tuple(r) for r in rows))) == sorted(repr((i, *w)) for i, w in zip(ids, want, strict=True))


def test_a_long_periodic_text_stays_small(spark):
    line = "a line that comes again and again, always the same, " + prose(random.Random(4), 30) + "\n"
    text = line * (3_000_000 // len(line))
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    batches = list(rindex._routed([raw.tobytes()], *(np.zeros(1, dtype=np.int64) for _ in range(4)), 200, 64))
    pieces = {(k, m): n for b in batches for k, m, n in zip(b.column("key").to_pylist(), b.column("mark").to_pylist(), b.column("n").to_pylist(), strict=True)}
    assert sum(pieces.values()) < 50_000  # what differs among the pieces is a few periods
    (row,) = rindex.remove_repeats(docs_of(spark, [text])).collect()
    assert (row["n_removed"], row["n_spans"]) == (len(raw), 1)


def test_index_is_as_large_as_its_runs():
    rng = random.Random(5)
    base = prose(rng, 600).encode()
    strings = [base[: rng.randint(300, len(base))] for _ in range(80)]
    index = rindex.RunLengthIndex(strings, 200)
    assert index.n > 50_000 and len(index.starts) < index.n / 20
    kept = sum(v.nbytes for v in vars(index).values() if isinstance(v, np.ndarray))
    assert kept < index.n * 4


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", min_size=1, max_size=60), min_size=1, max_size=6), st.integers(8, 20))
def test_index_marks_all_repeats(strings, length):
    strings = [s.encode() for s in strings]
    seen = Counter(s[i : i + length] for s in strings for i in range(len(s) - length + 1))
    want = [seen[s[i : i + length]] > 1 if i + length <= len(s) else False for s in strings for i in range(len(s))]
    assert rindex.RunLengthIndex(strings, length).repeated().tolist() == want


# ---------------------------------------------------------------- near duplicates


def bag(text):
    w = re.findall(r"[a-z0-9\u0080-\U0010ffff]+", (text or "").lower())
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def jaccard(a, b):
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both) if both else 0.0


def brute_classes(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(n), 2):
        if linked(i, j):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [find(i) for i in range(n)]


def near_corpus():
    rng = random.Random(2)
    words = prose(rng, 500).split()
    base = [[rng.choice(words) for _ in range(rng.randint(8, 200))] for _ in range(30)]
    texts = [" ".join(b) for b in base]
    for b in base * 4:
        w = list(b)
        for _ in range(max(1, int(len(w) * rng.choice([0.005, 0.01, 0.02, 0.03, 0.05])))):
            w[rng.randrange(len(w))] = rng.choice(words)
        texts.append(" ".join(w))
    return [*texts, "", "  ", None, "one two", "One, two", "a b c d e " * 50, "a b c d e " * 45, "a b c d e " * 30, "p q p q p q", "q p q p q p"]


def test_near_duplicates(spark):
    texts = near_corpus()
    bags = [bag(t) for t in texts]
    want = brute_classes(len(texts), lambda i, j: jaccard(bags[i], bags[j]) >= 0.8)
    rows = bagminhash.near_duplicates(docs_of(spark, texts)).orderBy("doc_id").collect()
    assert [r["class_id"] for r in rows] == want
    assert [r["kept"] for r in rows] == [w == i for i, w in enumerate(want)]
    kept = bagminhash.drop_near_duplicates(docs_of(spark, texts))
    assert kept.columns == docs_of(spark, []).columns and {r["doc_id"] for r in kept.collect()} == set(want)
    assert bagminhash.near_duplicates(docs_of(spark, [])).count() == 0
    few = docs_of(spark, texts[:3] + [None])
    twice = bagminhash.drop_near_duplicates(few.union(few))
    assert sorted(r["doc_id"] for r in twice.collect()) == [0, 1, 2, 3]


def test_near_duplicates_of_hot_groups(spark, monkeypatch):
    """A text that very many others resemble: its members are dealt out and none is lost."""
    from tilegraph.functions import storage

    monkeypatch.setattr(storage, "HOT_ROWS", 10)
    monkeypatch.setattr(bagminhash, "PAIRS", 7)
    monkeypatch.setattr(bagminhash, "BLOCK", 16)
    monkeypatch.setattr(bagminhash, "TEXT_BLOCK", 16)
    rng = random.Random(6)
    words = prose(rng, 400).split()
    base = [rng.choice(words) for _ in range(120)]
    texts = [" ".join(base)] * 60
    for k in range(120):
        w = list(base)
        for _ in range(k % 6):
            w[rng.randrange(len(w))] = rng.choice(words)
        texts.append(" ".join(w))
    texts += [" ".join(rng.choice(words) for _ in range(40)) for _ in range(20)]
    bags = [bag(t) for t in texts]
    want = brute_classes(len(texts), lambda i, j: jaccard(bags[i], bags[j]) >= 0.8)
    rows = bagminhash.near_duplicates(docs_of(spark, texts)).orderBy("doc_id").collect()
    assert [r["class_id"] for r in rows] == want


def test_near_duplicates_without_ids(spark):
    docs = docs_of(spark, ["a b c d e f", "a b c d e f", "a b c d e f", None]).withColumn("doc_id", F.expr("nullif(nullif(doc_id, 1), 3)"))
    clash = docs.withColumns({c: F.lit("x") for c in ("band", "first", "component", "size", "n_shingles", "__doc", "group")})
    rows = sorted(((r["doc_id"], r["class_id"], r["kept"]) for r in bagminhash.near_duplicates(clash).collect()), key=repr)
    assert rows == sorted([(0, 0, True), (None, None, True), (2, 0, False), (None, None, True)], key=repr)
    kept = bagminhash.drop_near_duplicates(clash)
    assert kept.columns == clash.columns and sorted((r["doc_id"] for r in kept.collect()), key=repr) == [0, None, None]


def test_registers_rule_out_little():
    from math import comb

    least = bagminhash.least_agreeing(0.8)
    missed = sum(comb(96, k) * 0.8**k * 0.2 ** (96 - k) for k in range(least))
    assert missed <= bagminhash.MISS < missed + comb(96, least) * 0.8**least * 0.2 ** (96 - least)


def test_signatures_are_unbiased():
    rng = random.Random(5)
    base = prose(rng, 300).split()
    for share in (0.02, 0.1):
        other = list(base)
        for _ in range(int(len(base) * share)):
            other[rng.randrange(len(base))] = "zz"
        texts = [" ".join(base), " ".join(other), "x y z w v " * 20, "x y z w v " * 10, "k l m n o " * 7, "k l m n o " * 6]
        h, doc = Words(texts).shingles()
        sig = bagminhash.signatures(*bagminhash.counted(h, doc), len(texts), m=4096)
        for a, b in ((0, 1), (2, 3), (4, 5)):
            assert abs((sig[a] == sig[b]).mean() - jaccard(bag(texts[a]), bag(texts[b]))) < 0.035


# ---------------------------------------------------------------- vectors


def vectors():
    rng = np.random.default_rng(4)
    rows = []
    for k in range(150):
        v = rng.standard_normal(64)
        rows.append((v, k % 3))
        for _ in range(k % 4):
            rows.append((v + rng.standard_normal(64) * rng.choice([0.05, 0.1, 0.14, 0.2]), k % 3))
    rows += [(rows[0][0], 0), (rows[0][0] * 2.5, 0), (rows[0][0], 1), (np.zeros(64), 0), (np.zeros(64), 0)]
    hot = rng.standard_normal(64)
    rows += [(hot + rng.standard_normal(64) * 0.04, 2) for _ in range(60)]
    out = [(i, v.tolist(), int(c)) for i, (v, c) in enumerate(rows)]
    n = len(out)
    bad = [float("nan"), *[1.0] * 63], [None, *[1.0] * 63], [float("inf"), *[1.0] * 63], None, [], [1.0] * 63
    return [*out, *((n + k, v, 0) for k, v in enumerate(bad)), (n + 6, out[0][1], None)]


@pytest.mark.parametrize("block", [1024, 16])
def test_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(embed_dedup, "BLOCK", block)
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")

    def unit(v):
        ok = v and all(x is not None and np.isfinite(x) for x in v) and any(v)
        return np.asarray(v) / np.linalg.norm(v) if ok else None

    units = [unit(v) for _, v, _ in rows]

    def linked(i, j):
        a, b = units[i], units[j]
        return a is not None and b is not None and len(a) == len(b) and rows[i][2] == rows[j][2] and rows[i][2] is not None and float(a @ b) >= 0.98

    want = brute_classes(len(rows), linked)
    links = [sum(linked(i, j) for j in range(len(rows)) if j != i) for i in range(len(rows))]
    got = embed_dedup.near_duplicates(df).orderBy("vec_id").collect()
    assert [r["n_links"] for r in got] == links
    assert [r["component_id"] for r in got] == want
    assert [r["kept"] for r in got] == [w == i for i, w in enumerate(want)]
    assert embed_dedup.near_duplicates(df.limit(0)).count() == 0


def test_vectors_of_labels_and_ids_of_any_kind(spark):
    rng = np.random.default_rng(9)
    v = rng.standard_normal((3, 32))
    rows = [(1, v[0], 1.2), (2, v[0], 1.7), (3, v[0] * 1.001, 1.2), (4, v[1], -0.0), (5, v[1] + 1e-3, 0.0), (6, v[2], 1.2), (6, v[1], 1.2), (None, v[2], 1.7)]
    df = spark.createDataFrame([(i, x.tolist(), c) for i, x, c in rows], "vec_id long, embedding array<float>, label double")
    clash = df.withColumns({c: F.lit("x") for c in ("id", "h", "g", "key", "band", "weight", "component", "size")})
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["copies"]) for r in embed_dedup.near_duplicates(clash).collect()), key=repr)
    assert got == sorted([(1, 1, 1, 1), (2, 0, 2, 1), (3, 1, 1, 1), (4, 1, 4, 1), (5, 1, 4, 1), (6, 0, 6, 1), (6, 0, 6, 1), (None, 0, None, 1)], key=repr)
    words = df.withColumn("label", F.col("label").cast("string"))
    assert embed_dedup.near_duplicates(words).where("vec_id = 3").first()["component_id"] == 1
    twice = embed_dedup.near_duplicates(df.union(df)).where("vec_id = 2").collect()
    assert [(r["n_links"], r["component_id"], r["copies"]) for r in twice] == [(1, 2, 2)] * 2


@pytest.mark.parametrize(("large", "held"), [(256, 1 << 23), (20, 500)])
def test_vectors_in_a_hot_bucket(spark, monkeypatch, large, held):
    from tilegraph.functions import storage

    monkeypatch.setattr(storage, "HOT_ROWS", 20)
    monkeypatch.setattr(embed_dedup, "BLOCK", 32)
    monkeypatch.setattr(embed_dedup, "LARGE", large)
    monkeypatch.setattr(embed_dedup, "MOST_HELD", held)
    monkeypatch.setattr(embed_dedup, "LEAST_PARTS", 3)
    rng = np.random.default_rng(10)
    base = rng.standard_normal(64)
    rows = [(i, (base + rng.standard_normal(64) * rng.choice([0.02, 0.08, 0.1, 0.12])).tolist(), 0) for i in range(300)] + [(300 + i, base.tolist(), 0) for i in range(150)]
    u = np.asarray([r[1] for r in rows])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= 0.98
    want = brute_classes(len(rows), lambda i, j: near[i, j])
    got = embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).orderBy("vec_id").collect()
    assert [r["n_links"] for r in got] == (near.sum(axis=1) - 1).tolist() and [r["component_id"] for r in got] == want


def test_vectors_in_very_many_tables(spark, monkeypatch):
    """A lower threshold takes more tables than a byte can number; links are found in whichever they meet."""
    monkeypatch.setattr(embed_dedup, "plan", lambda *_: (12, 700))
    monkeypatch.setattr(embed_dedup, "LEAST_PARTS", 5)
    rng = np.random.default_rng(12)
    base = rng.standard_normal((60, 64))
    rows = [(4 * k + j, (b + rng.standard_normal(64) * 0.5 * j / 3).tolist(), k % 2) for k, b in enumerate(base) for j in range(4)]
    u = np.asarray([r[1] for r in rows])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    same = np.array([r[2] for r in rows])
    near = (u @ u.T >= 0.85) & (same[:, None] == same[None, :])
    got = embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), 0.85).orderBy("vec_id").collect()
    assert [r["n_links"] for r in got] == (near.sum(axis=1) - 1).tolist() and near.sum() > 2 * len(rows)


def test_too_many_tables_are_an_error():
    assert embed_dedup.plan(4_000_000, 0.8)[1] > 256
    with pytest.raises(ValueError, match="tables"):
        embed_dedup.plan(10**9, 0.3)


def test_estimates_stay_within_their_bounds():
    rng = np.random.default_rng(6)
    base = embed_dedup.unit(rng.standard_normal((400, 64)))
    near = embed_dedup.unit(base + rng.standard_normal((400, 64)) * 0.02)
    code, factor, *_ = embed_dedup.encode(base, 16, 20)
    count = -(-(16 * 20 + embed_dedup.SPARE) // 64)
    estimate = np.einsum("ij,ij->i", code, near @ embed_dedup.rotations(64, count)[:, :64]) / factor
    cosine = np.einsum("ij,ij->i", base, near)
    assert (np.abs(estimate - cosine) <= np.sqrt(1 - cosine**2) * np.sqrt(1 - factor**2) / factor + 1e-9).all()
    assert abs((estimate - cosine).mean()) < 0.005
