"""Conversation prefix trie: succinct level-order tries per prefix shard, heavy upper levels merged separately.

A conversation is a path of turns; a prefix of it is known by a chained 128-bit digest. Conversations of equal paths
are counted once, with the number of copies. A prefix with more than MOST_PATHS different paths below it (and the root) is
heavy; what stands below the heavy prefixes is dealt out to shards of bounded size. In each shard numpy builds a
LOUDS trie (a bit vector with a 1 for each child and a 0 after each node's children, in level order, and an array of
labels), and one pass over the levels from the deepest up adds the nodes' figures to their parents. The shards' top nodes
are summed by their heavy parent in Spark; the heavy levels themselves, at most paths / MOST_PATHS nodes a level, are one
more trie of the same kind.

Defined cases: turns are ordered by turn (null first), then role, then the SHA-256 of their text; null role or text is empty;
rows without a conv_id are no conversation; an equal row repeated is a turn repeated; a conversation without turns ends at the root;
an empty table gives no node, not even a root. A path is held whole by one task (20 bytes a turn); no node's list of
conversations is: those that end at a node come as sorted runs of ids and are digested as a stream.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import numbered
from .common import join_by_key, materialise, small, task
from .sql import CRC_TABLE, crc32

ROOT = bytes(16)
#: Different paths below a prefix above which it belongs to the upper levels; of very many paths, one in HEAVY_SHARE.
MOST_PATHS, HEAVY_SHARE = 20_000, 10_000
#: Turns that a shard aims at.
SHARD_TURNS = 200_000
#: Bytes of a run of ids.
RUN_BYTES = 1 << 18
#: Turns that may come from a group's first conversation, and the size of a group.
BORROWED, GROUP = 9, 5


# ---------------------------------------------------------------- paths


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, code, bytes): each conversation's turns from 1 on; code is a digest of role and text, bytes the UTF-8 length of the text.

    Turns are numbered through the whole table in its order, so a conversation may have any number of them.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    code = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))))
    rows = rows.select("conv_id", "turn", "role", F.sha2("text", 256).alias("sha"), code.alias("code"), F.octet_length("text").cast("long").alias("bytes"))
    placed = numbered(rows, F.asc("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("sha"), name="at").select("conv_id", "at", "code", "bytes")
    first = materialise(placed.groupBy("conv_id").agg(F.min("at").alias("first"), F.count("*").alias("n_turns")))
    met = join_by_key(placed, first, "conv_id", "n_turns")
    return met.select("conv_id", (F.col("at") - F.col("first") + 1).alias("pos"), "code", "bytes")


def borrowed(conv_id: Column) -> Column:
    """How many first turns a conversation takes from its group's first one."""
    return F.crc32(conv_id.cast("string").cast("binary")) % BORROWED


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, code, bytes) of the rebuilt conversations, one row without a pos where no turn is left.

    Of a group's first conversation only the first turns travel, to the GROUP conversations at most that exist.
    """
    own = materialise(turns(conversations))
    there = own.where("pos = 1").select("conv_id", borrowed(F.col("conv_id")).alias("h"), (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base"))
    lent = own.where(F.col("pos") < BORROWED).select(F.col("conv_id").alias("base"), "pos", "code", "bytes")
    head = there.join(lent, "base", "left")
    head = head.select("conv_id", F.when(F.col("pos") <= F.col("h"), F.col("pos")).alias("pos"), "code", "bytes")
    tail = own.select("conv_id", "pos", "code", "bytes").where(F.col("pos") > borrowed(F.col("conv_id")))
    # own turns follow, wherever the borrowed ones end
    rows = head.withColumn("own", F.lit(False)).unionByName(tail.withColumn("own", F.lit(True)))
    return rows.where("own or pos is not null").unionByName(there.select("conv_id", F.lit(None).cast("long").alias("pos"), F.lit(None).cast("binary").alias("code"), F.lit(0).cast("long").alias("bytes"), F.lit(False).alias("own")))


_PATH = "conv_id long, last binary, prefixes array<binary>, sizes array<long>"


def _chain(batches):
    """A row a conversation, from rows sorted by conversation: each prefix's digest is that of the one before and the turn's code."""
    conv, digests, sizes = None, [], []
    done: list[tuple] = []

    def batch():
        cols = list(zip(*done, strict=True)) or [()] * 4
        types = (pa.int64(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, types, strict=True)], names=["conv_id", "last", "prefixes", "sizes"])

    for part in small(batches, 4096):
        for c, code, size in zip(*(part.column(k).to_pylist() for k in range(3)), strict=True):
            if c != conv:
                if conv is not None:
                    done.append((conv, digests[-1] if digests else ROOT, digests, sizes))
                conv, digests, sizes = c, [], []
            if code is not None:
                digests.append(hashlib.blake2b((digests[-1] if digests else ROOT) + code, digest_size=16).digest())
                sizes.append(size)
        yield batch()
        done = []
    if conv is not None:
        done.append((conv, digests[-1] if digests else ROOT, digests, sizes))
        yield batch()


def paths(rows: DataFrame) -> DataFrame:
    """(conv_id, last, prefixes, sizes) of each rebuilt conversation: the digests of its prefixes and the bytes of its turns, by depth."""
    sorted_ = rows.repartition("conv_id").sortWithinPartitions("conv_id", "own", "pos").select("conv_id", "code", "bytes")
    return sorted_.mapInArrow(task(_chain), _PATH)


# ---------------------------------------------------------------- tries


class Louds:
    """A trie in level order: `bits` (a 1 for each child, a 0 after each node's children) and `labels`; node 0 is a super-root."""

    def __init__(self, degrees: np.ndarray, labels: np.ndarray):
        """degrees: children of each node in level order, the super-root first; labels of the nodes below it."""
        self.labels = labels
        at = np.cumsum(degrees) + np.arange(len(degrees))  # where each node's 0 stands
        self.bits = np.ones(len(degrees) + len(labels), dtype=bool)
        self.bits[at] = False

    def parents(self) -> np.ndarray:
        """Of each node but the super-root: its parent is the number of 0s before its 1."""
        return np.cumsum(~self.bits)[self.bits]

    def degrees(self) -> np.ndarray:
        zeros = np.flatnonzero(~self.bits)
        return np.diff(zeros, prepend=-1) - 1

    def levels(self, parents: np.ndarray) -> list[slice]:
        """The nodes of each level below the super-root."""
        out, start, end = [], 1, 1 + int(self.degrees()[0])
        while start < end:
            out.append(slice(start, end))
            start, end = end, 1 + int(np.searchsorted(parents, end, "left"))  # parents ascend in level order
        return out


def rollup(trie: Louds, convs: np.ndarray, low: np.ndarray, sizes: np.ndarray, leaves: np.ndarray, saved: np.ndarray, kids: np.ndarray) -> tuple[np.ndarray, ...]:
    """(parents, children, convs, low, leaves, saved) of all nodes, the super-root first.

    convs, low, leaves, saved and kids hold what each node has besides its children in this trie: conversations that end
    at it, the smallest of them, and the figures of parts that were rolled up elsewhere.
    """
    parents = trie.parents()
    up = np.concatenate(([0], parents))
    degrees = trie.degrees() + kids
    leaves = leaves + (degrees == 0)
    for level in reversed(trie.levels(parents)):
        saved[level] += (convs[level] - 1) * sizes[level]
        for total in (convs, leaves, saved):
            np.add.at(total, up[level], total[level])
        np.minimum.at(low, up[level], low[level])
    return up, degrees, convs, low, leaves, saved


_NODE = "node binary, parent binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"
_NODE_NAMES = [c.split()[0] for c in _NODE.split(", ")]
_FAR = np.iinfo(np.int64).max


def build(prefixes: list[list[bytes]], sizes: list[list[int]], skip: np.ndarray):
    """(trie, depth of each node, its bytes, the heavy parent of tops, the node where each path ends) of paths from depth skip + 1 on."""
    length = np.fromiter(map(len, prefixes), dtype=np.int64, count=len(prefixes))
    starts = np.concatenate(([0], np.cumsum(length)))
    flat = np.frombuffer(b"".join(d for p in prefixes for d in p), dtype=">u8").reshape(-1, 2).astype(np.uint64)
    size = np.fromiter((s for p in sizes for s in p), dtype=np.int64, count=int(starts[-1]))
    current, end = np.zeros(len(prefixes), dtype=np.int64), np.zeros(len(prefixes), dtype=np.int64)
    active, step, made = np.flatnonzero(length > skip), 0, 1
    before = slice(0, 1)
    degrees, labels, depths, weights, above = [], [], [np.zeros(1, dtype=np.int64)], [np.zeros(1, dtype=np.int64)], []
    while len(active):
        place = starts[active] + skip[active] + step
        hi, lo = flat[place, 0], flat[place, 1]
        order = np.lexsort((lo, hi, current[active]))
        key = np.stack((current[active].astype(np.uint64), hi, lo))[:, order]
        new = np.append(True, (key[:, 1:] != key[:, :-1]).any(axis=0))
        ids = np.empty(len(active), dtype=np.int64)
        ids[order] = made + np.cumsum(new) - 1
        first = active[order[new]]
        degrees.append(np.bincount(key[0, new].astype(np.int64) - before.start, minlength=before.stop - before.start))
        at = starts[first] + skip[first] + step
        labels.append(flat[at])
        depths.append(skip[first] + step + 1)
        weights.append(size[at])
        if step == 0:
            above = [prefixes[k][s - 1] if s else ROOT for k, s in zip(first.tolist(), skip[first].tolist(), strict=True)]
        current[active] = ids
        before = slice(made, made + int(new.sum()))
        made = before.stop
        stops = length[active] == skip[active] + step + 1
        end[active[stops]] = ids[stops]
        active, step = active[~stops], step + 1
    degrees.append(np.zeros(before.stop - before.start, dtype=np.int64))
    found = np.concatenate(labels) if labels else np.zeros((0, 2), dtype=np.uint64)
    return Louds(np.concatenate(degrees), found), np.concatenate(depths), np.concatenate(weights), above, end


def _nodes(trie: Louds, depth, above, up, degrees, convs, low, leaves, saved) -> pa.Table:
    raw = trie.labels.astype(">u8").tobytes()
    names = [ROOT, *(raw[k : k + 16] for k in range(0, len(raw), 16))]
    tops = len(above)
    parents = [*above, *(names[p] for p in up[tops + 1 :].tolist())]
    return pa.table(
        {
            "node": pa.array(names[1:], type=pa.binary()), "parent": pa.array(parents, type=pa.binary()), "depth": depth[1:], "conv_id": low[1:],
            "parent_conv_id": pa.array(low[up[1:]], mask=np.arange(1, len(up)) <= tops), "n_convs": convs[1:], "n_children": degrees[1:], "n_leaves": leaves[1:], "saved_tokens": saved[1:],
        }
    )


def _shard(table):
    """The nodes of a shard: a forest below a super-root, whose children are the shard's tops."""
    prefixes, sizes = table.column("prefixes").to_pylist(), table.column("sizes").to_pylist()
    copies, conv, skip = (table.column(c).to_numpy() for c in ("copies", "conv_id", "skip"))
    trie, depth, size, above, end = build(prefixes, sizes, skip)
    n = len(trie.labels) + 1
    convs, low = np.zeros(n, dtype=np.int64), np.full(n, _FAR)
    np.add.at(convs, end, copies)
    np.minimum.at(low, end, conv)
    zeros = lambda: np.zeros(n, dtype=np.int64)
    return _nodes(trie, depth, above, *rollup(trie, convs, low, size, zeros(), zeros(), zeros()))


def _upper(table):
    """The heavy nodes as one trie, from (node, parent, depth, bytes) and what each has below and at itself."""
    table = table.sort_by([("depth", "ascending")])
    node, parent = table.column("node").to_pylist(), table.column("parent").to_pylist()
    depth = table.column("depth").to_numpy()
    place, order, degrees = {}, [], [1]
    for d in range(int(depth.max()) + 1):
        level = np.flatnonzero(depth == d).tolist()
        level.sort(key=lambda k: (place[parent[k]] if d else 0, node[k]))
        for k in level:
            place[node[k]] = len(order)
            order.append(k)
            degrees.append(0)
            if d:
                degrees[place[parent[k]] + 1] += 1
    table = table.take(order)
    labels = np.frombuffer(b"".join(table.column("node").to_pylist()), dtype=">u8").reshape(-1, 2).astype(np.uint64)
    own = lambda c, first=0: np.concatenate(([first], table.column(c).to_numpy()))
    trie = Louds(np.array(degrees), labels)
    kids = own("kids")
    kids[0] = 1
    got = rollup(trie, own("convs"), own("low", _FAR), own("bytes"), own("leaves"), own("saved"), kids)
    return _nodes(trie, own("depth"), [None], *got)


def _sums(rows: DataFrame, by: str, convs: str, low: str, kids, leaves, saved) -> DataFrame:
    return rows.groupBy(F.col(by).alias("node")).agg(F.sum(convs).alias("convs"), F.min(low).alias("low"), F.sum(kids).alias("kids"), F.sum(leaves).alias("leaves"), F.sum(saved).alias("saved"))


def trie(found: DataFrame, most_paths: int | None = None, shard_turns: int | None = None) -> DataFrame:
    """The columns of _NODE, a row a node, of paths() (written; read several times)."""
    most_paths, shard_turns = most_paths or MOST_PATHS, shard_turns or SHARD_TURNS
    # copies of a path are counted before the shuffle; which of them lends its arrays doesn't matter
    grouped = found.groupBy("last").agg(F.count("*").alias("copies"), F.min("conv_id").alias("conv_id"), F.first("prefixes").alias("prefixes"), F.first("sizes").alias("sizes"))
    distinct = materialise(grouped)
    n_paths, n_turns = distinct.agg(F.count("*"), F.coalesce(F.sum(F.size("prefixes")), F.lit(0))).first()
    most = max(most_paths, n_paths // HEAVY_SHARE)
    each = distinct.select("prefixes", "sizes", F.posexplode("prefixes").alias("k", "node"))
    above = F.when(F.col("k") > 0, F.get("prefixes", F.col("k") - 1)).otherwise(F.lit(ROOT))
    each = each.select("node", above.alias("parent"), (F.col("k") + 1).cast("long").alias("depth"), F.get("sizes", F.col("k")).alias("bytes"))
    heavy = each.groupBy("node").agg(F.count("*").alias("n"), F.min("parent").alias("parent"), F.min("depth").alias("depth"), F.min("bytes").alias("bytes")).where(F.col("n") > most).drop("n")
    root = distinct.limit(1).select(F.lit(ROOT).alias("node"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("bytes"))
    heavy = materialise(heavy.unionByName(root))  # at most n_paths / most nodes a level
    # heavy prefixes are closed under prefixes: a path leaves them below its deepest one
    deep = distinct.select("last", F.posexplode("prefixes").alias("k", "node")).join(F.broadcast(heavy.where("depth > 0").select("node")), "node")
    deep = deep.groupBy("last").agg((F.max("k") + 1).cast("long").alias("skip"))
    routed = distinct.join(deep, "last", "left").withColumn("skip", F.coalesce("skip", F.lit(0).cast("long")))
    routed = materialise(routed)
    shards = max(1, -(-n_turns // shard_turns))
    below = routed.where(F.size("prefixes") > F.col("skip"))
    below = below.withColumn("shard", F.pmod(F.xxhash64(F.get("prefixes", F.col("skip").cast("int"))), F.lit(shards)))
    lower = materialise(below.select("shard", "prefixes", "sizes", "copies", "conv_id", "skip").groupBy("shard").applyInArrow(_shard, _NODE))
    tops = lower.where("parent_conv_id is null")
    ends = routed.where(F.size("prefixes") == F.col("skip"))
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    parts = _sums(tops, "parent", "n_convs", "conv_id", one, "n_leaves", "saved_tokens").unionByName(_sums(ends, "last", "copies", "conv_id", zero, zero, zero))
    parts = _sums(parts, "node", "convs", "low", "kids", "leaves", "saved")
    fill = {"convs": 0, "low": int(_FAR), "kids": 0, "leaves": 0, "saved": 0}
    upper = materialise(heavy.join(parts, "node", "left").na.fill(fill).withColumn("all", F.lit(0)).groupBy("all").applyInArrow(_upper, _NODE))
    known = upper.select(F.col("node").alias("parent"), F.col("conv_id").alias("__conv"))
    tops = tops.drop("parent_conv_id").join(F.broadcast(known), "parent").withColumnRenamed("__conv", "parent_conv_id").select(*_NODE_NAMES)
    return upper.unionByName(lower.where("parent_conv_id is not null")).unionByName(tops)


# ---------------------------------------------------------------- ends


def _runs(batches):
    """(node, low, ids): runs of ascending ids of one node, as text, from rows sorted by node and id."""
    node, ids, size = None, [], 0
    done: list[tuple] = []
    for batch in small(batches, 8192):
        for n, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if n != node or size > RUN_BYTES:
                if ids:
                    done.append((node, ids[0], ",".join(map(str, ids))))
                node, ids, size = n, [], 0
            ids.append(c)
            size += 12
        yield _table(done)
        done = []
    if ids:
        yield _table([(node, ids[0], ",".join(map(str, ids)))])


def _table(rows):
    cols = list(zip(*rows, strict=True)) or [()] * 3
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], names=["node", "low", "ids"])


def _digest(batches):
    """(node, ends_sha256), from runs sorted by node and lowest id: nothing but the state of the hash is held."""
    node, state = None, None
    for batch in small(batches, 4096):
        names, shas = [], []
        for n, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if n != node:
                if node is not None:
                    names.append(node)
                    shas.append(state.hexdigest())
                node, state = n, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(shas, pa.string())], names=["node", "ends_sha256"])
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()], pa.string())], names=["node", "ends_sha256"])


def ends(found: DataFrame) -> DataFrame:
    """(node, ends_sha256) of the nodes at which conversations end: the digest of their ids, ascending, joined by commas.

    Ids are dealt out by ranges, and a range hands on one run a node, so that a node of very many ids is few rows.
    """
    runs = found.select("last", "conv_id").repartitionByRange("conv_id").sortWithinPartitions("last", "conv_id").mapInArrow(task(_runs), "node binary, low long, ids string")
    return runs.repartition("node").sortWithinPartitions("node", "low").select("node", "ids").mapInArrow(task(_digest), "node binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """Per node: conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    found = materialise(paths(rebuilt(conversations)))
    nodes = trie(found).join(ends(found), "node", "left")
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    return nodes.select(*names, F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


ORACLE_SQL = f"""WITH {CRC_TABLE}, own AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS pos,
         length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '') AS said, strlen(coalesce(text, '')) AS bytes
  FROM conversations WHERE conv_id IS NOT NULL
), groups AS (
  SELECT c, {crc32("CAST(c AS VARCHAR)")} % {BORROWED} AS h, c - c % {GROUP} AS base FROM (SELECT DISTINCT c FROM own), crc_table
), turns AS (
  SELECT g.c, 0 AS kind, pos, said, bytes FROM groups g JOIN own o ON o.c = g.base AND o.pos <= g.h
  UNION ALL SELECT o.c, 1, pos, said, bytes FROM own o JOIN groups g ON o.c = g.c AND o.pos > g.h
), built AS (
  SELECT g.c, coalesce(list(md5(said) ORDER BY kind, pos) FILTER (said IS NOT NULL), []) AS path, coalesce(list(bytes ORDER BY kind, pos) FILTER (said IS NOT NULL), []) AS bytes
  FROM groups g LEFT JOIN turns t ON t.c = g.c GROUP BY g.c
), prefixes AS (
  SELECT c, path, bytes, unnest(range(0, len(path) + 1)) AS depth FROM built
), nodes AS (
  SELECT md5(array_to_string(path[1:depth], ' ')) AS node, depth, any_value(path[1:depth]) AS path, min(c) AS conv_id, count(*) AS n_convs,
         CASE WHEN depth = 0 THEN 0 ELSE any_value(bytes[depth]) END AS size,
         sha256(coalesce(string_agg(c, ',' ORDER BY c) FILTER (len(path) = depth), '')) AS ends_sha256
  FROM prefixes GROUP BY node, depth
), children AS (
  SELECT md5(array_to_string(path[1:depth - 1], ' ')) AS node, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1
), upwards AS (
  SELECT path, depth, unnest(range(0, depth + 1)) AS d, CAST(coalesce(n, 0) = 0 AS INT) AS leaf, (n_convs - 1) * size AS saved FROM nodes LEFT JOIN children USING (node)
), below AS (
  SELECT md5(array_to_string(path[1:d], ' ')) AS node, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens FROM upwards GROUP BY 1
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children, CAST(b.n_leaves AS BIGINT) AS n_leaves,
       CAST(b.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN below b ON b.node = n.node LEFT JOIN children k ON k.node = n.node
LEFT JOIN nodes p ON n.depth > 0 AND p.node = md5(array_to_string(n.path[1:n.depth - 1], ' '))"""
