"""Suffix-array dedup: long repeats marked by a run-length (r-) index over routed text segments.

Every window of `length` bytes is routed by the smallest hash of its `gram`-byte substrings, so equal
windows, wherever they stand, meet under the same key; maximal runs of windows with one key form a
segment, which travels once (long ones are cut where their key's substring recurs, so that a periodic text
falls into equal pieces). Segments that occur more than once as a whole are settled by counting.

The different segments of a key go through `RunLengthIndex`: the Burrows-Wheeler transform as runs, with
suffix-array samples and common prefixes at run ends only; matching statistics are streamed from sample to
sample, and windows that match elsewhere for `length` bytes or more are marked. A key whose segments exceed
`most_bytes` (a common line amid ever different text) is routed again by longer substrings, in the end by
whole windows, where equal segments are equal windows and counting settles all. So an index is as large
as one task can hold, however frequent its key.

Counts are combined before each shuffle and come back to their rows by joins that deal hot keys out. Rows
are told apart by doc_id and a hash of their text.

Defined cases: null text counts as empty; a null doc_id stays null and its text is compared like any other;
texts shorter than `length` lose nothing; repeated rows are copies of each other and lose all windows; rows
of one doc_id with unequal texts are texts of their own; a repeat inside one document counts, overlaps
included; an empty table gives an empty result; only doc_id and text are read, other columns do not matter.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_CODES, U64, discard, int64, join_by_key, materialise, mix64, prefix_hash, small, span_hash

CHUNK = 1 << 18
#: Bytes that an index takes at once, and bytes of one key above which it is routed again.
INDEX_BYTES, MOST_BYTES = 1 << 20, 1 << 20
#: Windows that are routed at once, so that a text of any length needs bounded memory.
SLAB = 1 << 22
#: Windows of a segment above which it is cut where its key's substring recurs.
LONG_RUN = 2048


def _sliding(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over each run of `width` neighbours, by doubling."""
    done = 1
    while done * 2 <= width:
        x = op(x[:-done], x[done:])
        done *= 2
    if done < width:
        rest = width - done
        x = op(x[:-rest], x[rest:])
    return x


def segments(raw: np.ndarray, bounds: np.ndarray, length: int, gram: int):
    """Key, first window, number of windows, and "a key's gram recurs within" of each segment of the documents raw[bounds[i]:bounds[i+1]]."""
    none = np.zeros(0, dtype=np.int64)
    if len(raw) < length:
        return none.astype(U64), none, none, none.astype(bool)
    prefix = prefix_hash(raw)
    at = np.arange(len(raw) - gram + 1)
    h = span_hash(prefix, at, at + gram)
    w = length - gram + 1
    low = _sliding(h, w, np.minimum)
    first, last = bounds[:-1], bounds[1:] - length
    cut = np.concatenate((first, np.maximum(last + 1, first), np.flatnonzero(low[1:] != low[:-1]) + 1))
    cut = np.unique(cut[cut <= len(low)])
    start, stop = cut, np.append(cut[1:], len(low))
    doc = np.searchsorted(bounds, start, "right") - 1
    ok = (stop > start) & (start <= bounds[np.minimum(doc + 1, len(bounds) - 1)] - length)
    start, stop = start[ok], stop[ok]
    # positions that are the smallest of some window; two of one value close together mean a repeat within
    pad = np.full(w - 1, 0, dtype=U64)
    chosen = np.flatnonzero(_sliding(np.concatenate((pad, low, pad)), w, np.maximum) == h)
    again = (h[chosen[1:]] == h[chosen[:-1]]) & (np.diff(chosen) <= w)
    inner = np.zeros(len(start), dtype=bool)
    p = chosen[:-1][again]
    if len(p) and len(start):
        run = np.searchsorted(start, np.minimum(p, stop[-1] - 1), "right") - 1
        p, run = p[run >= 0], run[run >= 0]
        inner[run] = True  # the last segment that begins before p holds the window of p, or is the last of its document
    long = np.flatnonzero(stop - start > LONG_RUN)
    if len(long):
        more = []
        for a, b in zip(start[long].tolist(), stop[long].tolist(), strict=True):
            spots = chosen[np.searchsorted(chosen, a) : np.searchsorted(chosen, b)]
            spots = spots[h[spots] == low[a]]
            while (k := np.searchsorted(spots, a + LONG_RUN)) < len(spots):
                a = int(spots[k])
                more.append(a)
        pieces = np.union1d(start, np.asarray(more, dtype=start.dtype))
        owner = np.searchsorted(start, pieces, "right") - 1
        inner[long] = True
        stop = np.minimum(stop[owner], np.append(pieces[1:], stop[-1]))
        start, inner = pieces, inner[owner]
    return low[start], start, stop - start, inner


class RunLengthIndex:
    """Run-length index of a few strings, for matches of `length` bytes with other places of the same strings.

    What stays after sorting grows with the runs of the Burrows-Wheeler transform, not with the text: the
    byte and the first rank of each run, the text positions of its first and last suffix, and how many bytes
    its first suffix shares with the suffix before it. Suffixes shorter than `length` have no place in it.
    """

    def __init__(self, strings: list[bytes], length: int):
        self.length = length
        raw = np.frombuffer(b"".join(strings), dtype=np.uint8)
        sizes = np.fromiter(map(len, strings), dtype=np.int64, count=len(strings))
        self.base = np.cumsum(sizes) - sizes
        n = self.n = len(raw)
        left = np.repeat(self.base + sizes, sizes) - np.arange(n)  # bytes up to the string's end
        rank, levels = self._ranks(raw, left, length)
        whole = np.flatnonzero(left >= length)
        order = whole[np.argsort(rank[whole], kind="stable")]
        place = np.full(n + 1, -9, dtype=np.int64)
        place[order] = np.arange(len(order))
        before = np.full(n, 256, dtype=np.int16)
        before[1:] = raw[:-1]
        before[self.base[sizes > 0]] = 256  # no byte before a string: never within a run
        bwt = before[order]
        # a run goes on where the byte before is the same and the two longer suffixes are neighbours as well
        same = (bwt[1:] == bwt[:-1]) & (bwt[1:] != 256)
        same &= (place[order[1:] - 1] - place[order[:-1] - 1] == 1) & (place[order[:-1] - 1] >= 0)
        self.starts = np.flatnonzero(np.append(True, ~same)[: len(order)])
        self.heads = bwt[self.starts]
        self.first = order[self.starts]
        self.last = order[np.append(self.starts[1:], len(order)) - 1] if len(order) else self.first
        self.shared = np.zeros(len(self.starts), dtype=np.int64)
        self.shared[1:] = _common(raw, left, levels, self.last[:-1], self.first[1:])

    @staticmethod
    def _ranks(raw, left, length):
        """Ranks of all suffixes by their first `length` bytes or more, and the ranks by shorter prefixes, by doubling."""
        n = len(raw)
        key = np.zeros(n, dtype=np.int64)
        code = np.zeros(n + 7, dtype=np.int64)
        code[:n] = raw.astype(np.int64) + 1
        for j in range(7):
            key |= np.where(left > j, code[j : n + j], 0) << (9 * (6 - j))
        order = np.argsort(key)
        sorted_key = key[order]
        head = np.append(True, sorted_key[1:] != sorted_key[:-1])[:n]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
        active, levels, depth = order[~(head & np.append(head[1:], True)[:n])], [], 7
        while depth < length:
            levels.append((depth, rank.astype(np.int32)))
            if depth * 2 >= length:  # only starts of whole windows matter in the last round
                active = active[left[active] >= length]
            if len(active):
                active = RunLengthIndex._double(rank, active, depth, left)
            depth *= 2
        return rank, levels

    @staticmethod
    def _double(rank, active, depth, left):
        n = len(rank)
        follow = np.where(left[active] > depth, rank[np.minimum(active + depth, n - 1)] + 1, 0)
        key = rank[active] * (n + 2) + follow
        by = np.argsort(key)
        act, key = active[by], key[by]
        old, at = rank[act], np.arange(len(act))
        place = old + at - np.maximum.accumulate(np.where(np.append(True, old[1:] != old[:-1]), at, 0))
        head = np.append(True, key[1:] != key[:-1])
        rank[act] = place[np.maximum.accumulate(np.where(head, at, 0))]
        return act[~(head & np.append(head[1:], True))]

    def _streamed(self, at: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From a match of value[k] bytes at text position at[k] the statistics fall by one a byte up to the next sample; the spans where `length` or more is left."""
        by = np.argsort(at)
        at, value = at[by], value[by]
        stop = np.minimum(np.append(at[1:], self.n), at + value - self.length + 1)
        some = stop > at
        return at[some], stop[some]

    def spans(self) -> tuple[np.ndarray, np.ndarray]:
        """Maximal runs [low, high) of positions whose `length` bytes stand anywhere else in the strings."""
        # within a run the neighbour of a suffix is the successor of its longer suffix's neighbour: samples at run ends are enough
        one = self._streamed(self.first, self.shared)  # matches with the suffix before
        two = self._streamed(self.last, np.append(self.shared[1:], 0)[: len(self.last)])  # and with the one after
        low, high = np.concatenate((one[0], two[0])), np.concatenate((one[1], two[1]))
        by = np.argsort(low, kind="stable")
        low, reach = low[by], np.maximum.accumulate(high[by]) if len(low) else high
        # spans that meet are one run unless a string ends between them
        new = np.append(True, (low[1:] > reach[:-1]) | np.isin(low[1:], self.base))[: len(low)]
        return low[new], reach[np.append(np.flatnonzero(new)[1:], len(low)) - 1] if len(low) else reach

    def repeated(self) -> np.ndarray:
        """spans() as a flag for each position."""
        edge = np.zeros(self.n + 1, dtype=np.int64)
        low, high = self.spans()
        np.add.at(edge, low, 1)
        np.add.at(edge, high, -1)
        return np.cumsum(edge)[: self.n] > 0


def _common(raw, left, levels, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the suffixes at a and b, by the ranks of ever shorter prefixes."""
    n = len(raw)
    left, raw = np.append(left, 0), np.append(raw, 0)
    out = np.zeros(len(a), dtype=np.int64)
    live = np.arange(len(a))
    while len(live):
        x, y, full = a[live] + out[live], b[live] + out[live], np.ones(len(live), dtype=bool)
        got = np.zeros(len(live), dtype=np.int64)
        for depth, rank in reversed(levels):
            u, v = x + got, y + got
            same = np.minimum(left[u], left[v]) >= depth
            same &= rank[np.minimum(u, n - 1)] == rank[np.minimum(v, n - 1)]
            got += depth * same
            full &= same
        going = ~full
        for _ in range(6):
            u, v = x + got, y + got
            going &= (np.minimum(left[u], left[v]) > 0) & (raw[u] == raw[v])
            got += going
        out[live] += got
        live = live[full]
    return np.minimum(out, np.minimum(left[a], left[b]))  # where a string ends another begins


# ---------------------------------------------------------------- on Spark

_ROUTED = pa.schema([("key", pa.int64()), ("mark", pa.int64()), ("uid", pa.int64()), ("h", pa.int32()), ("start", pa.int32()), ("n", pa.int32()), ("inner", pa.bool_()), ("weight", pa.int32())])
_ROUTED_DDL = "key long, mark long, uid long, h int, start int, n int, inner boolean, weight int"


def _routed(raws: list[bytes], uid: np.ndarray, h: np.ndarray, offset: np.ndarray, weight: np.ndarray, length: int, gram: int):
    """The segments of some byte strings, one batch a slab."""
    joined = b"".join(raws)
    bounds = np.concatenate(([0], np.cumsum([len(r) for r in raws]))).astype(np.int64)
    whole, digest = np.frombuffer(joined, dtype=np.uint8), xxhash.xxh3_64_intdigest
    for a in range(0, len(joined), SLAB):
        raw = whole[a : a + SLAB + length - 1]
        key, start, n, inner = segments(raw, np.unique(np.clip(bounds - a, 0, len(raw))), length, gram)
        start = start + a
        doc = np.searchsorted(bounds, start, "right") - 1
        marks = np.fromiter((digest(joined[x:y]) for x, y in zip(start.tolist(), (start + n + length - 1).tolist(), strict=True)), dtype=U64, count=len(start))
        columns = int64(key), int64(marks), uid[doc], h[doc], start - bounds[doc] + offset[doc], n, inner, weight[doc]
        yield pa.RecordBatch.from_arrays([pa.array(c).cast(f.type) for c, f in zip(columns, _ROUTED, strict=True)], schema=_ROUTED)


def _route(length: int, gram: int):
    def run(batches):
        raws, ids, hs, held = [], [], [], 0

        def out():
            zero = np.zeros(len(raws), dtype=np.int64)
            return _routed(raws, np.asarray(ids, dtype=np.int64), np.asarray(hs, dtype=np.int64), zero, zero + 1, length, gram)

        for batch in small(batches):
            for uid, h, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                raws.append(text.encode("utf-8", "surrogatepass"))
                ids.append(uid)
                hs.append(h)
                held += len(raws[-1])
                if held >= CHUNK:
                    yield from out()
                    raws, ids, hs, held = [], [], [], 0
        if raws:
            yield from out()

    return run


def _route_again(length: int, gram: int):
    """Segments of hot keys to their own segments by a longer gram; what has a copy already counts twice."""

    def run(batches):
        for batch in small(batches):
            uid, h, start, single = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("uid", "h", "start", "single"))
            yield from _routed(batch.column("segment").to_pylist(), uid, h, start.astype(np.int64), np.where(single, 1, 2), length, gram)

    return run


_CUT = pa.schema([("key", pa.int64()), ("uid", pa.int64()), ("h", pa.int32()), ("start", pa.int32()), ("single", pa.bool_()), ("hot", pa.bool_()), ("segment", pa.binary())])
_CUT_DDL = "key long, uid long, h int, start int, single boolean, hot boolean, segment binary"


def _cut(length: int):
    def run(batches):
        for batch in small(batches):
            out: dict[str, list] = {f.name: [] for f in _CUT}
            for uid, h, text, wanted in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                for x in wanted:
                    out["uid"].append(uid)
                    out["h"].append(h)
                    for c in ("key", "start", "single", "hot"):
                        out[c].append(x[c])
                    out["segment"].append(raw[x["start"] : x["start"] + x["n"] + length - 1])
            yield pa.RecordBatch.from_pydict(out, schema=_CUT)

    return run


_SPANS = pa.schema([("uid", pa.int64()), ("h", pa.int32()), ("low", pa.int64()), ("high", pa.int64())])
_SPANS_DDL = "uid long, h int, low long, high long"


def _match(length: int):
    """Rows of _CUT, ordered by key, to marked windows of the single segments."""

    def marked(rows):
        uids, hs, starts, singles, strings = zip(*rows, strict=True)
        index = RunLengthIndex(list(strings), length)
        lows, highs = index.spans()
        owner = np.searchsorted(index.base, lows, "right") - 1
        keep = np.asarray(singles)[owner]
        owner, lows, highs = owner[keep], lows[keep], highs[keep]
        shift = np.asarray(starts, dtype=np.int64)[owner] - index.base[owner]
        return pa.RecordBatch.from_arrays([pa.array(np.asarray(uids, dtype=np.int64)[owner]), pa.array(np.asarray(hs, dtype=np.int32)[owner]), pa.array(lows + shift), pa.array(highs + shift)], schema=_SPANS)

    def run(batches):
        rows, held, last = [], 0, None
        for batch in small(batches):
            for key, *row in zip(*(batch.column(c).to_pylist() for c in ("key", "uid", "h", "start", "single", "segment")), strict=True):
                if key != last and held >= INDEX_BYTES:
                    yield marked(rows)
                    rows, held = [], 0
                rows.append(row)
                held += len(row[-1])
                last = key
        if rows:
            yield marked(rows)

    return run


_OTHER_CODES = mix64(BYTE_CODES ^ U64(0x5851F42D4C957F2D))


def _windows(length: int):
    """Each window of a hot segment with a 128-bit digest."""

    def run(batches):
        for batch in small(batches):
            for uid, h, start, single, raw in zip(*(batch.column(c).to_pylist() for c in ("uid", "h", "start", "single", "segment")), strict=True):
                data = np.frombuffer(raw, dtype=np.uint8)
                at = np.arange(len(data) - length + 1)
                one = span_hash(prefix_hash(data), at, at + length)
                two = span_hash(prefix_hash((_OTHER_CODES[data] >> U64(56)).astype(np.uint8)), at, at + length)
                two = mix64(two ^ (one << U64(1)))
                full = len(at)
                columns = int64(one), int64(two), np.full(full, uid), np.full(full, h), at + start, np.ones(full), np.zeros(full, dtype=bool), np.full(full, 1 if single else 2)
                yield pa.RecordBatch.from_arrays([pa.array(c).cast(f.type) for c, f in zip(columns, _ROUTED, strict=True)], schema=_ROUTED)

    return run


def _remove(length: int):
    def run(batches):
        for batch in small(batches):
            out = []
            for doc_id, text, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                kept, end, removed, runs = hashlib.sha256(), 0, 0, 0
                for span in sorted((s["low"], s["high"] + length - 1) for s in spans or ()):
                    low, high = span
                    if low > end or not runs:
                        kept.update(raw[end:low])
                        runs += 1
                    low = max(low, end)
                    if high > low:
                        removed += high - low
                        end = high
                kept.update(raw[end:])
                out.append((doc_id, len(raw), removed, runs, kept.hexdigest()))
            cols = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, uid, h, text): uid and h tell rows apart that differ in doc_id or text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    return docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.xxhash64(text)).alias("uid"), F.hash(text).alias("h"), text.alias("text"))


def _settle(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Spans of the segments that occur more than once, and (key, mark, copies, first, within) of all segments whose key has company."""
    keys = materialise(rows.groupBy("key").agg(F.count("*").alias("total"), F.max("inner").alias("within")).where("total > 1 or within"))
    live = materialise(join_by_key(rows, keys, "key", "total").drop("total", "inner"))
    discard(keys)
    marks = live.groupBy("key", "mark").agg(F.sum("weight").alias("copies"), F.count("*").alias("rows"), F.min(F.struct("uid", "h", "start", "n")).alias("first"), F.max("within").alias("within"))
    marks = materialise(marks)
    again = join_by_key(live.where("weight = 1"), marks.where("copies > 1").select("key", "mark", "rows"), ["key", "mark"], "rows")
    return again.select("uid", "h", F.col("start").cast("long").alias("low"), (F.col("start") + F.col("n")).cast("long").alias("high")), marks


def _strings(docs: DataFrame, marks: DataFrame, length: int, most_bytes: int) -> DataFrame:
    """The different segments, cut from their texts, of the keys that need an index; hot if these are too much for one."""
    groups = marks.groupBy("key").agg(F.count("*").alias("strings"), F.max("within").alias("recurs"), F.sum(F.col("first.n") + (length - 1)).alias("bytes"))
    groups = materialise(groups.where("strings > 1 or recurs"))
    chosen = join_by_key(marks, groups, "key", "strings")
    one = F.struct("key", "first.start", "first.n", (F.col("copies") == 1).alias("single"), (F.col("bytes") > most_bytes).alias("hot"))
    wanted = chosen.groupBy("first.uid", "first.h").agg(F.collect_list(one).alias("wanted"))
    return materialise(docs.join(wanted, ["uid", "h"]).select("uid", "h", "text", "wanted").mapInArrow(_cut(length), _CUT_DDL))


def repeated_spans(docs: DataFrame, length: int = 200, gram: int = 64, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(uid, h, low, high): each window that begins at byte low <= b < high of that row's text also begins elsewhere in the texts."""
    docs = _keyed(docs)
    rows = materialise(docs.select("uid", "h", "text").mapInArrow(_route(length, gram), _ROUTED_DDL))
    found = None
    while True:
        settled, marks = _settle(rows)
        discard(rows)
        found = settled if found is None else found.unionByName(settled)
        if gram >= length:  # segments are windows: counting has settled all
            return found
        cut = _strings(docs, marks, length, most_bytes)
        dealt = cut.where("not hot").repartition("key").sortWithinPartitions("key", "uid", "start")
        found = found.unionByName(dealt.mapInArrow(_match(length), _SPANS_DDL))
        hot = cut.where("hot")
        if hot.isEmpty():
            return found
        gram = 2 * gram if 2 * gram < length else length
        again = _windows(length) if gram == length else _route_again(length, gram)
        rows = materialise(hot.mapInArrow(again, _ROUTED_DDL))


def remove_repeats(docs: DataFrame, length: int = 200, gram: int = 64, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans and the digest of the bytes that stay.

    A byte goes if a window of `length` bytes that covers it begins more than once in all texts.
    """
    spans = repeated_spans(docs, length, gram, most_bytes).groupBy("uid", "h").agg(F.collect_list(F.struct("low", "high")).alias("spans"))
    return _keyed(docs).join(spans, ["uid", "h"], "left").select("doc_id", "text", "spans").mapInArrow(_remove(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
