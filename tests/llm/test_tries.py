"""Conversation prefix tries and their succinct form against brute force."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tilegraph.llm import prefix_trie

TURNS = "conv_id long, turn long, role string, text string"
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    """All nodes, by lists of members of each prefix."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", hashlib.sha256((text or "").encode()).hexdigest(), text or ""))
    own = {c: [(role, text) for _, _, role, _, text in sorted(v)] for c, v in own.items()}
    paths = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        paths[c] = own.get(c - c % 5, [])[:h] + own[c][h:]
    members, kids, leaves, saved = defaultdict(list), defaultdict(int), defaultdict(int), defaultdict(int)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[tuple(p[:d])].append(c)
    for n in members:
        if n:
            kids[n[:-1]] += 1
    for n, m in members.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] += kids[n] == 0
            saved[n[:d]] += (len(m) - 1) * len(n[-1][1].encode()) if n else 0
    sha = lambda n, m: hashlib.sha256(",".join(map(str, sorted(c for c in m if len(paths[c]) == len(n)))).encode()).hexdigest()
    found = [(min(m), len(n), min(members[n[:-1]]) if n else None, len(m), kids[n], leaves[n], saved[n], sha(n, m)) for n, m in members.items()]
    return sorted(found, key=lambda r: r[:2])


def got(df):
    return sorted((tuple(r) for r in prefix_trie.prefix_trie(df).select(NAMES).collect()), key=lambda r: r[:2])


def talk(seed, convs=120, said=4):
    """Conversations with hot first turns, copies, ties, nulls and a long one."""
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        if c % 11 == 3:
            continue  # some groups have no first conversation
        for t in range(rng.randint(1, 9) if c % 7 else 2):
            text = "hello" if t == 0 and rng.random() < 0.6 else rng.choice(["é" * 3, "x", "", None, "ok then"][: said + 1])
            rows.append((c, t if rng.random() < 0.95 else None, rng.choice(["user", "user", None]), text))
    rows += [(500, t, "user", str(t % 3)) for t in range(300)] + [(501, t, "user", str(t % 3)) for t in range(300)]
    return rows + [(None, 1, "user", "lost"), (7, 2, "user", "tie"), (7, 2, "user", "tie"), (10**12 + 5, 0, "a", "b")]


@pytest.mark.parametrize(("most", "turns"), [(None, None), (1, 10), (6, 40)])
def test_nodes(spark, monkeypatch, most, turns):
    """The same nodes whatever is heavy, however many shards there are, and however ids are cut into runs."""
    if most:
        monkeypatch.setattr(prefix_trie, "MOST_PATHS", most)
        monkeypatch.setattr(prefix_trie, "SHARD_TURNS", turns)
        monkeypatch.setattr(prefix_trie, "HEAVY_SHARE", 10**9)
        monkeypatch.setattr(prefix_trie, "RUN_BYTES", 30)
    rows = talk(4)
    assert got(spark.createDataFrame(rows, TURNS)) == brute(rows)


def test_odd_tables(spark):
    none = spark.createDataFrame([], TURNS)
    assert got(none) == []
    rows = [(1, None, None, None), (1, None, None, None)]  # its first turn comes from a conversation that isn't there
    assert got(spark.createDataFrame(rows, TURNS)) == brute(rows)
    clash = spark.createDataFrame(talk(5, 30), TURNS).withColumns({c: F.lit("x") for c in ("pos", "at", "code", "node", "shard", "own", "bytes")})
    assert got(clash) == brute(talk(5, 30))
    loose = clash.where("conv_id < 500").withColumn("turn", F.col("turn").cast("int")).withColumn("conv_id", F.col("conv_id").cast("int"))
    assert got(loose) == brute([r for r in talk(5, 30) if r[0] is not None and r[0] < 500])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=6), min_size=1, max_size=25))
def test_louds(strings):
    """Bits and labels of a trie give back its parents, degrees and paths."""
    paths, seen = [], {(): bytes(16)}
    for s in strings:
        p = []
        for k in range(1, len(s) + 1):
            p.append(seen.setdefault(tuple(s[:k]), hashlib.md5(bytes(s[:k])).digest()))
        paths.append(p)
    trie, depth, size, above, end = prefix_trie.build(paths, [[1] * len(p) for p in paths], np.zeros(len(paths), dtype=np.int64))
    nodes = {tuple(s[:k]) for s in strings for k in range(1, len(s) + 1)}
    assert len(trie.labels) == len(nodes) and trie.bits.sum() == len(nodes) and (~trie.bits).sum() == len(nodes) + 1
    up = np.concatenate(([0], trie.parents()))
    assert (np.diff(up[1:]) >= 0).all() and (depth[1:] == depth[up[1:]] + 1).all() and (trie.degrees() == np.bincount(up[1:], minlength=len(up))).all()
    raw = trie.labels.astype(">u8").tobytes()
    for s, e in zip(strings, end.tolist(), strict=True):
        back = []
        while e:
            back.append(raw[16 * (e - 1) : 16 * e])
            e = int(up[e])
        assert back[::-1] == [seen[tuple(s[:k])] for k in range(1, len(s) + 1)]
    assert [s.stop - s.start for s in trie.levels(trie.parents())] == [sum(len(n) == d for n in nodes) for d in range(1, 1 + max(map(len, nodes), default=0))]
