"""Embedding near-dedup: randomised-rotation binary codes with stored correction factors.

A vector is scaled to length one, rotated at random and kept as the signs of its coordinates together with
its correction factor s, the inner product of the vector and its own code. <code, other> / s estimates
the cosine without bias over rotations; at a cosine of t or more the error is at most
sqrt(1 - t^2) * sqrt(1 - s^2) / s by Cauchy and Schwarz, so a pair is dropped only if its whole confidence
interval lies below the threshold, and every other pair is recomputed in double precision.

Pairs are met in buckets of sign bits (several rotations, bits and tables chosen from the number of
vectors so that a pair at the threshold is missed once in `1 / miss` cases). What is shuffled for that is not a
row for each vector and table but blobs of 21 bytes each: bucket, table, id and SPARE more sign bits. Where they
meet, only members with another one within the distance that those bits allow at the threshold go on, and
buckets too large for that as a whole. Of these few, vectors are fetched. Equal vectors of one label are
folded into one with a weight before all that, by a 128-bit digest; buckets that hold the same vectors as an
earlier table's are left out, as all their pairs have met there. Large buckets are dealt out as pairs of
blocks. A pair is counted in the first bucket that its vectors share; links are summed and joined to trees
inside the kernel, no pair leaves it, and components are closed over those trees.

Defined cases: labels are compared by their own value, whatever their type; a null label, a null, empty or
zero vector, and null or non-finite components link with nothing and form a class of their own; vectors of
unequal size never link; repeated vec_ids are rows of their own; ties take the smallest vec_id; an empty table
gives an empty result.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.closure import union_find
from .common import U64, bounded_broadcast, discard, int64, join_by_key, materialise, mix64
from .components import components

BLOCK = 1024
ROWS_AT_ONCE = 8192
#: Sign bits beside those of the buckets.
SPARE = 64
#: Chance that a pair at the threshold meets in no bucket, and that its spare bits then rule it out.
MISS = 1e-6
#: Tables that an entry's number can tell apart.
MOST_TABLES = 1 << 16
#: Parts of the buckets: LEAST_PARTS, or as many as make PART_PAIRS entries each.
LEAST_PARTS, PART_PAIRS = 2048, 1 << 20
#: Members above which a bucket goes on as a whole, and entries of one part above which such buckets leave at once.
LARGE, MOST_HELD = 256, 1 << 23
#: Pairs whose vectors are gathered at once for the exact cosine.
GATHERED = 1 << 15
#: Digests (16 bytes each) up to which vectors with copies are told by a broadcast; more by a shuffle.
BROADCAST_COPIES = 1_000_000


def plan(n: int, threshold: float, miss: float = MISS) -> tuple[int, int]:
    """(bits of a table, tables) for n vectors of one label: eight or so meet by chance in a bucket, and a pair at the threshold met but for `miss`."""
    bits = max(8, min(24, math.ceil(math.log2(max(n, 2))) - 3))
    p = (1 - math.acos(threshold) / math.pi) ** bits
    tables = math.ceil(math.log(miss) / math.log(1 - p))
    if tables > MOST_TABLES:
        raise ValueError(f"a cosine of {threshold} takes {tables} tables for {n} vectors of one label; at most {MOST_TABLES} can be told apart")
    return bits, tables


def most_different(threshold: float, bits: int = SPARE, miss: float = MISS) -> int:
    """The most of `bits` sign bits in which a pair at the threshold differs but for `miss` of all cases."""
    p, chance = math.acos(threshold) / math.pi, 1.0
    for k in range(bits):
        chance -= math.comb(bits, k) * p**k * (1 - p) ** (bits - k)
        if chance <= miss:
            return k
    return bits


@lru_cache(maxsize=8)
def rotations(size: int, count: int) -> np.ndarray:
    """`count` random rotations of `size` dimensions, stacked: (size, size * count)."""
    rng = np.random.default_rng(20240229 + size)
    return np.hstack([np.linalg.qr(rng.standard_normal((size, size)))[0] for _ in range(count)])


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def encode(u: np.ndarray, bits: int, tables: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes (signs over root of size), correction factors, the vectors as the code sees them, the bucket number in each table, and SPARE more sign bits."""
    size = u.shape[1]
    turned = u @ rotations(size, -(-(bits * tables + SPARE) // size))
    code = np.where(turned[:, :size] >= 0, 1.0, -1.0) / math.sqrt(size)
    factor = np.einsum("ij,ij->i", code, turned[:, :size])
    sign = (turned[:, : bits * tables] >= 0).reshape(len(u), tables, bits)
    bucket = (sign * (1 << np.arange(bits, dtype=np.int64))).sum(axis=2)
    spare = (turned[:, bits * tables : bits * tables + SPARE] >= 0).astype(U64)
    return code, factor, turned[:, :size], bucket, (spare << np.arange(SPARE, dtype=U64)).sum(axis=1, dtype=U64)


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _by_size(batch, at: int):
    sizes = np.asarray(pa.compute.list_value_length(batch.column(at)).to_numpy(zero_copy_only=False))
    for size in np.unique(sizes):
        yield np.flatnonzero(sizes == size)


_ENTRY = np.dtype([("key", "<u4"), ("band", "<u2"), ("spare", "<u8"), ("id", "<i8")])


def _buckets(bits: int, tables: int, parts: int):
    """(part, entries): a blob for each part of the buckets that a batch of vectors falls into."""

    def run(batches):
        import pyarrow.compute  # noqa: F401

        for batch in batches:
            for rows in _by_size(batch, 2):
                if not len(rows):
                    continue
                table = batch.take(pa.array(rows))
                u = unit(_matrix(table.column(2)))
                *_, bucket, spare = encode(u, bits, tables)
                label = table.column(1).to_numpy().view(U64)
                key = mix64(mix64(label ^ U64(u.shape[1] << 40))[:, None] ^ (bucket.astype(U64) | (np.arange(1, tables + 1, dtype=U64) << U64(32)))).ravel()
                entry = np.empty(len(key), dtype=_ENTRY)
                entry["key"], entry["band"] = key & U64(0xFFFFFFFF), np.tile(np.arange(tables, dtype=np.uint16), len(u))
                entry["spare"], entry["id"] = np.repeat(spare, tables), np.repeat(table.column(0).to_numpy(), tables)
                part = ((key >> U64(32)) % U64(parts)).astype(np.int32)
                by = np.argsort(part, kind="stable")
                part, entry = part[by], entry[by]
                cut = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
                ends = np.append(cut, len(entry)) * _ENTRY.itemsize
                blobs = pa.Array.from_buffers(pa.binary(), len(cut), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(entry.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(part[cut]), blobs], names=["part", "entries"])

    return run


def _collide(most: int):
    """Blobs, ordered by part, to (key, id, band) of the entries that go on; see the module."""

    def out(part, entry, root=None):
        key = mix64(mix64(np.array([part], dtype=U64)) ^ place(entry))
        key = int64(key if root is None else mix64(key ^ mix64(root.astype(U64))))
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(entry["id"]), pa.array(entry["band"].astype(np.int32))], names=["key", "id", "band"])

    def place(entry):
        return entry["key"].astype(U64) << U64(16) | entry["band"].astype(U64)

    def runs(entry):
        at = place(entry)
        by = np.argsort(at, kind="stable")
        at = at[by]
        head = np.flatnonzero(np.append(True, at[1:] != at[:-1])[: len(at)])
        return entry[by], at, head, np.diff(np.append(head, len(at)))

    def settle(part, held, large):
        entry, at, head, size = runs(np.concatenate(held))
        many = np.repeat(size > LARGE, size) | np.isin(at, large)
        run, low, high = np.repeat(np.arange(len(head)), size), [], []
        live = np.flatnonzero((size[run] > 1) & ~many)
        for step in range(1, LARGE):
            live = live[live + step < len(run)]
            live = live[run[live] == run[live + step]]
            if not len(live):
                break
            near = live[np.bitwise_count(entry["spare"][live] ^ entry["spare"][live + step]) <= most]
            low.append(near)
            high.append(near + step)
        yield out(part, entry[many])
        if low and len(np.concatenate(low)):
            # unrelated groups of one bucket go on apart, so that a group is the same set in every table
            member, root = union_find(np.concatenate(low), np.concatenate(high))
            yield out(part, entry[member], entry["id"][root])

    def run(batches):
        held, count, last, large = [], 0, None, np.zeros(0, dtype=U64)
        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if part != last and held:
                    yield from settle(last, held, large)
                if part != last:
                    held, count, large, last = [], 0, large[:0], part
                held.append(np.frombuffer(blob.as_buffer(), dtype=_ENTRY).copy())
                count += len(held[-1])
                if count > MOST_HELD:  # what fills a part are large buckets: they leave, and so will the rest of them
                    entry, at, head, size = runs(np.concatenate(held))
                    large = np.union1d(large, at[head[size > LARGE]])
                    gone = np.isin(at, large)
                    yield out(part, entry[gone])
                    held = [entry[~gone]]
                    count = len(held[0]) // 2  # if this was too little, the part may grow
        if held:
            yield from settle(last, held, large)

    return run


def _join_trees(count: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Smallest index that each of `count` nodes reaches by the edges (x, y)."""
    low = np.arange(count)
    while True:
        before = low.copy()
        np.minimum.at(low, x, low[y])
        np.minimum.at(low, y, low[x])
        low = low[low]
        if (low == before).all():
            return low


def _compare(bits: int, tables: int, threshold: float):
    spread = math.sqrt(1 - threshold * threshold)

    def group(ids, weight, block, label, u, code, factor, turned, bucket, band, i, j):
        rows, cols = np.flatnonzero(block == i), np.flatnonzero(block == j)
        if not len(rows) or not len(cols):
            return None
        # entries are told apart by part, key and table: that label and bucket are equal is looked at here
        open_ = (label[rows][:, None] == label[cols][None, :]) & (bucket[rows, band][:, None] == bucket[cols, band][None, :])
        if i == j:
            open_ &= np.arange(len(rows))[:, None] < np.arange(len(cols))[None, :]
        for b in range(band):  # pairs that an earlier table has counted
            open_ &= bucket[rows, b][:, None] != bucket[cols, b][None, :]
            if not open_.any():
                return None
        estimate = (code[rows] @ turned[cols].T) / factor[rows][:, None]
        error = spread * np.sqrt(np.maximum(1 - factor[rows] ** 2, 0)) / factor[rows]
        open_ &= estimate >= (threshold - error - 1e-9)[:, None]
        x, y = np.nonzero(open_)
        if not len(x):
            return None
        cosine = [np.einsum("ij,ij->i", u[rows[x[k : k + GATHERED]]], u[cols[y[k : k + GATHERED]]]) for k in range(0, len(x), GATHERED)]
        hit = np.concatenate(cosine) >= threshold
        x, y = rows[x[hit]], cols[y[hit]]
        if not len(x):
            return None
        links = np.bincount(x, weights=weight[y], minlength=len(ids)) + np.bincount(y, weights=weight[x], minlength=len(ids))
        root = _join_trees(len(ids), x, y)
        some = np.flatnonzero(links)
        return ids[some], links[some].astype(np.int64), ids[root[some]]

    def handle(batch):
        key, i, j, ids, block, band, weight, label = (batch.column(c).to_numpy() for c in range(8))
        u = unit(_matrix(batch.column(8)))
        code, factor, turned, bucket, _ = encode(u, bits, tables)
        cut = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])))
        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(key)], strict=True):
            got = group(ids[a:b], weight[a:b], block[a:b], label[a:b], u[a:b], code[a:b], factor[a:b], turned[a:b], bucket[a:b], int(band[a]), i[a], j[a])
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in got], names=["id", "links", "root"])

    def run(batches):
        held = None
        for batch in batches:
            new = pa.Table.from_batches([batch])
            held = new if held is None else pa.concat_tables([held, new])
            if len(held) >= ROWS_AT_ONCE:
                key, i, j = (held.column(c).to_numpy() for c in range(3))
                last = np.flatnonzero((key != key[-1]) | (i != i[-1]) | (j != j[-1]))
                whole = int(last[-1]) + 1 if len(last) else 0
                if whole:
                    yield from handle(held.slice(0, whole).combine_chunks().to_batches()[0])
                    held = held.slice(whole)
        if held is not None and len(held):
            yield from handle(held.combine_chunks().to_batches()[0])

    return run


def _one_of_each(keyed: DataFrame, classes: DataFrame) -> DataFrame:
    """One row of each class (h, g); only rows that have copies are shuffled if these are few."""
    copied = bounded_broadcast(materialise(classes.where("weight > 1").select("h", "g")), BROADCAST_COPIES)
    alone = keyed.join(copied, ["h", "g"], "left_anti")
    return alone.unionByName(keyed.join(copied, ["h", "g"]).dropDuplicates(["h", "g"]))


def _members(met: DataFrame) -> DataFrame:
    """(key, id, band, size) of the buckets with several vectors, without those whose vectors are an earlier table's bucket too."""
    sized = met.groupBy("key").agg(F.count("*").alias("size"), F.min("band").alias("band"), F.bit_xor(F.xxhash64("id")).alias("p"), F.bit_xor(F.xxhash64(F.lit(7), "id")).alias("q"))
    first = sized.where("size > 1").groupBy("size", "p", "q").agg(F.min(F.struct("band", "key")).alias("at"))
    return join_by_key(met, materialise(first.select("at.key", "size")), "key", "size")


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, miss: float = MISS) -> DataFrame:
    """Per vector: vec_id, n_links, component_id, kept, copies (vectors equal to it, itself included)."""
    rows = vectors.select("vec_id", "label", "embedding")
    good = F.col("label").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    good = F.coalesce(good & fine, F.lit(False))
    keyed = rows.where(good).withColumns({"h": F.xxhash64("label", "embedding"), "g": F.xxhash64(F.lit(7), "label", "embedding")})
    classes = materialise(keyed.groupBy("h", "g").agg(F.min("vec_id").alias("first"), F.count("*").alias("weight"), F.min(F.xxhash64("label")).alias("label")))
    n, most = classes.groupBy("label").agg(F.count("*").alias("n")).agg(F.sum("n"), F.max("n")).first()
    n, (bits, tables) = n or 0, plan(most or 0, threshold, miss)
    parts = max(LEAST_PARTS, -(-n * tables // PART_PAIRS))
    firsts = _one_of_each(keyed, classes).select(F.col("h").alias("id"), F.xxhash64("label").alias("label"), "embedding")
    blobs = firsts.mapInArrow(_buckets(bits, tables, parts), "part int, entries binary")
    met = blobs.repartition("part").sortWithinPartitions("part").mapInArrow(_collide(most_different(threshold, miss=miss)), "key long, id long, band int")
    met = materialise(met)
    blocks = F.ceil(F.col("size") / BLOCK).cast("long")
    members = _members(met).withColumn("block", F.pmod(F.xxhash64("id"), blocks).cast("long")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    members = members.join(firsts, "id").join(classes.select(F.col("h").alias("id"), "weight"), "id")
    members = members.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "id", "block", "band", "weight", "label", "embedding")
    dealt = members.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "id")
    linked = materialise(dealt.mapInArrow(_compare(bits, tables, threshold), "id long, links long, root long"))
    discard(met)
    links = linked.groupBy("id").agg(F.sum("links").alias("links")).withColumnRenamed("id", "h")
    found = materialise(components(linked, "id", "root"))
    smallest = found.join(classes.select(F.col("h").alias("node"), "first"), "node").groupBy("component").agg(F.min("first").alias("smallest"), F.count("*").alias("nodes"))
    named = join_by_key(found, materialise(smallest), "component", "nodes").select(F.col("node").alias("h"), "smallest")
    folded = classes.join(links, "h", "left").join(named, "h", "left")
    folded = folded.select("h", "g", "weight", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("smallest", "first").alias("component_id"))
    paired = join_by_key(keyed.select("vec_id", "h", "g"), materialise(folded), ["h", "g"], "weight").select("vec_id", "n_links", "component_id", F.col("weight").alias("copies"))
    alone = rows.where(~good).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(1).cast("long").alias("copies"))
    return paired.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))
