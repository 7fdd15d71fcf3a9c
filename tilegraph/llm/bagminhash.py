"""MinHash near-dedup over multisets of five-word shingles: BagMinHash signatures, banding, exact verification.

Each (shingle, count) owns a Poisson process in time over the discretised weight axis [0, count); the axis
is cut at 1, 2, 4, 8, ... and each dyadic interval has a process of its own with a rate equal to its width,
thinned where the count ends inside the interval. A point carries a register; a signature keeps the
earliest time of each register, so two documents agree in a register with the probability of their
weighted Jaccard similarity. Points are drawn in order of time and stop at the latest register.

Documents with the same words are one class from the start. Signatures are banded; in each bucket the
members are verified against the smallest and the largest one (no pairs are expanded), links are closed
into components, and only buckets that still hold several components are looked at again: the stored registers
say which of their members may still link, and those are compared block by block while their components
are apart. Every link rests on the exact multiset overlap.

Defined cases: null or wordless text links with nothing; texts of one to four words have one shingle and
link with equal word sequences only; repeated rows and ties take the smallest doc_id; rows without a doc_id
are in no class (null) and stay; an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.closure import union_find
from .common import U64, Words, bounded_broadcast, chunks, discard, join_by_key, materialise, mix64, small, stage_docs, task
from .components import components

REGISTERS, ROWS = 96, 4
BANDS = REGISTERS // ROWS
BLOCK = 1024
TEXT_BLOCK = 256
#: Ids (8 bytes each) up to which texts are fetched by a broadcast; more are fetched by a shuffle.
BROADCAST_IDS = 1_000_000
CHUNK = 1 << 20
#: Pairs of one text that a task verifies; a text with more of them is handed to several tasks.
PAIRS = 1024
#: Chance that a pair at the threshold is ruled out by its registers.
MISS = 1e-7


def counted(shingles: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle, document, count), by document; documents are in ascending order already."""
    order = np.lexsort((shingles, doc))
    s, d = shingles[order], doc[order]
    head = np.flatnonzero(np.append(True, (s[1:] != s[:-1]) | (d[1:] != d[:-1]))[: len(s)])
    return s[head], d[head], np.diff(np.append(head, len(s)))


def signatures(shingle: np.ndarray, doc: np.ndarray, count: np.ndarray, docs: int, m: int = REGISTERS) -> np.ndarray:
    """docs x m earliest times; infinite for documents without shingles."""
    sig = np.full(docs * m, np.inf)
    parts, level, low, high = [], 0, 0, 1
    while len(at := np.flatnonzero(count > low)):
        width = np.full(len(at), high - low, dtype=np.float64)
        seed = mix64(shingle[at] ^ U64((level + 1) * 0x632BE59BD9B4E019 & ((1 << 64) - 1)))
        parts.append((seed, doc[at], width, np.full(len(at), low, dtype=np.float64), count[at]))
        level, low, high = level + 1, high, high * 2
    if not parts:
        return sig.reshape(docs, m)
    seed, owner, width, base, limit = (np.concatenate(x) for x in zip(*parts, strict=True))
    time = np.zeros(len(seed))
    while len(seed):
        seed = mix64(seed + U64(0x9E3779B97F4A7C15))
        time = time - np.log(((seed >> U64(11)).astype(np.float64) + 1.0) * (1.0 / (1 << 53))) / width
        latest = sig.reshape(docs, m).max(axis=1)
        live = time < latest[owner]
        seed, owner, width, base, limit, time = (x[live] for x in (seed, owner, width, base, limit, time))
        point = mix64(seed ^ U64(0xC2B2AE3D27D4EB4F))
        register = (point % U64(m)).astype(np.int64)
        place = base + np.floor((point >> U64(16)).astype(np.float64) * (width / float(1 << 48)))
        inside = place < limit
        np.minimum.at(sig, owner[inside] * m + register[inside], time[inside])
    return sig.reshape(docs, m)


def _sign(batches):
    for ids, texts in chunks(batches, CHUNK):
        words = Words(texts)
        h, doc = words.shingles()
        s, d, c = counted(h, doc)
        sig = signatures(s, d, c, len(ids)).view(U64)
        n = np.bincount(doc, minlength=len(ids))
        small = (mix64(sig) >> U64(48)).astype(np.uint16)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, type=pa.int64()), pa.array(n.astype(np.int64)), pa.array(words.keys()), pa.array([r.tobytes() for r in small])],
            names=["doc_id", "n_shingles", "words_key", "registers"],
        )


def overlap(a: str, b: str, k: int = 5) -> float:
    """Weighted Jaccard similarity of the two texts' shingle multisets, exactly."""
    words = Words([a, b])
    return _overlap(*_split(words, k))


def _split(words: Words, k: int = 5):
    h, doc = words.shingles(k)
    return np.sort(h[doc == 0]), np.sort(h[doc == 1])


def _multiset(text: str) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(Words([text]).shingles()[0], return_counts=True)


def _set(text: str) -> tuple[np.ndarray, np.ndarray]:
    found = np.unique(Words([text]).shingles()[0])
    return found, np.ones(len(found), dtype=np.int64)


def _shared(x, y) -> float:
    (a, m), (b, n) = x, y
    if not len(a) or not len(b):
        return 0.0
    at = np.searchsorted(b, a)
    hit = b[np.minimum(at, len(b) - 1)] == a
    both = np.minimum(m[hit], n[at[hit]]).sum()
    return both / (m.sum() + n.sum() - both)


def _overlap(a: np.ndarray, b: np.ndarray) -> float:
    return _shared(np.unique(a, return_counts=True), np.unique(b, return_counts=True))


def _verify(threshold: float, bag):
    """Links of rows (leader, salt, member, text), sorted: a leader's own text (no member) comes first, then its members'."""

    def run(batches):
        led, leaders = None, []
        for batch in small(batches, 64):
            out_a, out_b = [], []
            for leader, salt, member, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                own = bag(text)
                if (leader, salt) != led:
                    led, leaders = (leader, salt), []
                if member is None:
                    leaders.append(own)
                elif any(_shared(x, own) >= threshold for x in leaders):
                    out_a.append(leader)
                    out_b.append(member)
            yield pa.RecordBatch.from_arrays([pa.array(out_a, type=pa.int64()), pa.array(out_b, type=pa.int64())], names=["a", "b"])

    return run


def _links(pairs: DataFrame, texts: DataFrame, threshold: float, bag=_multiset) -> DataFrame:
    """(a, b) of the (leader, member) pairs that hold. A row carries one text; a leader's goes once to each task that it needs."""
    sizes = materialise(pairs.groupBy("leader").agg(F.count("*").alias("n")))
    salts = F.ceil(F.col("n") / PAIRS).cast("long")
    dealt = join_by_key(pairs, sizes, "leader", "n").withColumn("salt", F.pmod(F.xxhash64("member"), salts).cast("long")).drop("n")
    members = dealt.join(texts.select(F.col("doc_id").alias("member"), "text"), "member").select("leader", "salt", "member", "text")
    held = texts.select(F.col("doc_id").alias("leader"), "text").join(sizes, "leader")
    leaders = held.select("leader", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt"), F.lit(None).cast("long").alias("member"), "text")
    rows = members.unionByName(leaders).repartition("leader", "salt").sortWithinPartitions("leader", "salt", F.col("member").asc_nulls_first())
    return rows.mapInArrow(task(_verify(threshold, bag)), "a long, b long")


@lru_cache(maxsize=8)
def least_agreeing(threshold: float, registers: int = REGISTERS, miss: float = MISS) -> int:
    """The most registers that a pair at the threshold has in common but for `miss` of all cases."""
    chance = 0.0
    for k in range(registers + 1):
        chance += math.comb(registers, k) * threshold**k * (1 - threshold) ** (registers - k)
        if chance > miss:
            return k
    return registers


def _candidates(n, reg, comp, threshold: float):
    """For each row in turn, the later rows of other components whose sizes and registers do not rule the threshold out."""
    least = least_agreeing(threshold)

    def of(x: int, others: np.ndarray) -> np.ndarray:
        others = others[comp[others] != comp[x]]
        others = others[np.minimum(n[others], n[x]) >= threshold * np.maximum(n[others], n[x])]
        return others[(reg[others] == reg[x]).sum(axis=1) >= least]

    return of


def _columns(table, *names):
    out = [table.column(c).to_numpy() for c in names]
    return *out, np.frombuffer(b"".join(table.column("registers").to_pylist()), dtype=np.uint16).reshape(len(table), -1)


def _pairs_of_blocks(block, i, j):
    """(row, later rows or rows of the other block) of a block pair."""
    rows, cols = np.flatnonzero(block == i), np.flatnonzero(block == j)
    for k, x in enumerate(rows.tolist()):
        yield x, cols[k + 1 :] if i == j else cols


def _plausible(threshold: float):
    """Trees over the cross-component pairs of a block pair that the registers do not rule out; no pair list leaves the kernel."""

    def run(key, table):
        i, j = key[1].as_py(), key[2].as_py()
        doc, comp, block, n, reg = _columns(table, "doc_id", "component", "block", "n_shingles")
        of, a, b = _candidates(n, reg, comp, threshold), [], []
        for x, others in _pairs_of_blocks(block, i, j):
            near = of(x, others)
            a.append(np.full(len(near), x))
            b.append(near)
        a, b = np.concatenate([*a, []]).astype(np.int64), np.concatenate([*b, []]).astype(np.int64)
        nodes, roots = union_find(a, b)
        return pa.table({"a": doc[nodes], "b": doc[roots]})

    return run


def _verify_blocks(threshold: float, bag=_multiset):
    """Links between components found in a block pair; a pair is compared only while its components are apart."""

    def run(key, table):
        i, j = key[1].as_py(), key[2].as_py()
        doc, comp, block, n, reg = _columns(table, "doc_id", "component", "block", "n_shingles")
        of, texts = _candidates(n, reg, comp, threshold), table.column("text").to_pylist()
        sets: dict[int, tuple] = {}
        leader: dict[int, int] = {}

        def find(c):
            while leader.get(c, c) != c:
                c = leader[c] = leader.get(leader[c], leader[c])
            return c

        def of_row(x):
            if x not in sets:
                sets[x] = bag(texts[x])
            return sets[x]

        out_a, out_b = [], []
        for x, others in _pairs_of_blocks(block, i, j):
            for y in of(x, others).tolist():
                p, q = find(int(comp[x])), find(int(comp[y]))
                if p != q and _shared(of_row(x), of_row(y)) >= threshold:
                    leader[max(p, q)] = min(p, q)
                    out_a.append(int(doc[x]))
                    out_b.append(int(doc[y]))
        return pa.table({"a": pa.array(out_a, type=pa.int64()), "b": pa.array(out_b, type=pa.int64())})

    return run


def _in_blocks(rows: DataFrame, group: str, size: str, block: int) -> DataFrame:
    """rows dealt to pairs of blocks (i, j) of their group: each row stands once in the pairs of its block."""
    blocks = F.ceil(F.col(size) / block).cast("long")
    out = rows.withColumn("block", F.pmod(F.xxhash64("doc_id"), blocks).cast("long")).withColumn("__other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    return out.withColumns({"i": F.least("block", "__other"), "j": F.greatest("block", "__other")}).drop("__other")


def near_duplicates(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Per document: doc_id, class_id (smallest doc_id that copies and links of overlap >= threshold reach), n_shingles, copies, kept."""
    docs = stage_docs(docs)
    signed = materialise(docs.mapInArrow(task(_sign), "doc_id long, n_shingles long, words_key binary, registers binary"))
    return classes(signed, docs, threshold)


def bands() -> Column:
    """The bands of a row's registers: each is the digest of ROWS of them, two bytes each, and of its number."""
    wide = 2 * ROWS
    return F.array(*(F.xxhash64(F.lit(k), F.substring("registers", wide * k + 1, wide)) for k in range(BANDS)))


def classes(signed: DataFrame, docs: DataFrame, threshold: float = 0.8, bag=_multiset) -> DataFrame:
    """near_duplicates() of documents that are signed (doc_id, n_shingles, words_key, registers); links are verified by the overlap of `bag` of their texts."""
    worded = signed.where("n_shingles > 0 and doc_id is not null")
    firsts = materialise(worded.groupBy("words_key").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")))
    named = join_by_key(worded.select("doc_id", "n_shingles", "words_key"), firsts, "words_key", "copies").drop("words_key")
    alone = signed.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("first"), F.lit(1).cast("long").alias("copies"))
    named = materialise(named.unionByName(alone))
    leaders = named.where("doc_id = first and n_shingles > 0").select("doc_id")
    banded = worded.join(leaders, "doc_id", "left_semi").select("doc_id", "n_shingles", F.explode(bands()).alias("band"))
    sized = banded.groupBy("band").agg(F.count("*").alias("size"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("size > 1")
    members = materialise(join_by_key(banded, materialise(sized), "band", "size").select("band", "doc_id", "n_shingles", "size", "low", "high"))
    wanted = bounded_broadcast(materialise(members.select("doc_id").distinct()), BROADCAST_IDS)
    texts = materialise(docs.join(wanted, "doc_id", "left_semi"))
    ends = [members.where(f"doc_id > low and {rest}").select(F.col(hub).alias("leader"), F.col("doc_id").alias("member")) for hub, rest in (("low", "true"), ("high", "doc_id < high"))]
    linked = materialise(_links(materialise(ends[0].unionByName(ends[1]).distinct()), texts, threshold, bag))
    found = materialise(components(linked))
    placed = members.where("size > 2").join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("band", "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component"))
    placed = materialise(placed)
    discard(members)
    mixed = placed.groupBy("band").agg(F.min("component").alias("c"), F.max("component").alias("d"), F.count("*").alias("size")).where("c < d").select("band", "size")
    open_ = join_by_key(placed, materialise(mixed), "band", "size").join(signed.select("doc_id", "registers"), "doc_id").select("band", "doc_id", "n_shingles", "size", "component", "registers")
    trees = _in_blocks(open_, "band", "size", BLOCK).groupBy("band", "i", "j").applyInArrow(_plausible(threshold), "a long, b long")
    groups = materialise(components(trees).select(F.col("node").alias("doc_id"), F.col("component").alias("group")))
    groups = join_by_key(groups, materialise(groups.groupBy("group").agg(F.count("*").alias("size"))), "group", "size")
    rows = groups.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").join(signed.select("doc_id", "n_shingles", "registers"), "doc_id").join(texts, "doc_id")
    rows = rows.select("group", "size", "doc_id", F.coalesce("component", "doc_id").alias("component"), "n_shingles", "registers", "text")
    late = materialise(_in_blocks(rows, "group", "size", TEXT_BLOCK).groupBy("group", "i", "j").applyInArrow(_verify_blocks(threshold, bag), "a long, b long"))
    closed = components(linked.unionByName(late)) if not late.isEmpty() else found
    ends = named.groupBy("first").agg(F.count("*").alias("rows")).join(closed.withColumnRenamed("node", "first"), "first", "left")
    ends = materialise(ends.where("first is not null").select("first", "rows", F.coalesce("component", "first").alias("class_id")))
    out = join_by_key(named, ends, "first", "rows").select("doc_id", "class_id", "n_shingles", "copies", (F.col("class_id") == F.col("doc_id")).alias("kept"))
    return out.unionByName(named.where("first is null").select("doc_id", F.col("first").alias("class_id"), "n_shingles", "copies", F.lit(True).alias("kept")))


def drop_near_duplicates(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """docs without all but the first document of each class; columns stay as they are.

    Rows of one doc_id are one document: of those with equal text one stays, others stay together.
    """
    found = materialise(near_duplicates(docs, threshold).select(F.col("doc_id").alias("__doc"), "kept"))
    gone = bounded_broadcast(materialise(found.where("not kept").select("__doc").distinct()), BROADCAST_IDS)
    out = docs.join(gone, docs["doc_id"] == gone["__doc"], "left_anti")
    again = found.where("kept and __doc is not null").groupBy("__doc").count().where("count > 1").select("__doc")
    if again.isEmpty():
        return out
    again = materialise(again)
    once = out.join(again, out["doc_id"] == again["__doc"], "left_anti")
    return once.unionByName(out.join(again, out["doc_id"] == again["__doc"], "left_semi").dropDuplicates(["doc_id", "text"]))
