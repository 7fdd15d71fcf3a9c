"""Making polygons valid: rings of any shape as what they cover by the even-odd rule.

The rings of a polygon are noded (cut wherever they meet, by a sweep over their segments), pieces that lie on each other
cancel in pairs, and what is left bounds the plane's parts in turn inside and outside. Walking around
each inside part gives rings that neither cross nor overlap: one that runs the other way is a hole of the smallest
part around it. A bow tie becomes two triangles, overlapping holes become one, spikes and repeated points vanish.
Polygons are rows and stay where they are; a polygon that falls apart becomes several rows.

All is done on whole numbers: coordinates in units of 2^-BITS of the polygon's extent (a power of two, so that what has fewer digits
stays as it is). Turns are exact; a cut point goes to the nearest place of that grid, and a corner within a unit of a
segment cuts it, so that noding ends.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from functools import cmp_to_key

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import IntegerType, StructField, StructType

from .vector import _apart, contains, read_wkb, ring_length, signed_area, wkb_polygon

#: Binary digits of a coordinate.
BITS = 45
#: Rounds of noding: cut points are rounded, which may make others meet.
ROUNDS = 50
#: Segments up to which pairs are sought one by one: arrays cost more than they save.
FEW = 48

Spot = tuple[int, int]


def _turn(a: Spot, b: Spot, c: Spot) -> int:
    """Above 0 if a, b, c turn to the left, below if to the right, 0 if they lie on a line."""
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def _beside(p: Spot, a: Spot, b: Spot, turn: int) -> bool:
    """Whether p lies within three quarters of a unit of the segment from a to b, and not before or behind it."""
    if p in (a, b):
        return False
    x, y = b[0] - a[0], b[1] - a[1]
    along = (p[0] - a[0]) * x + (p[1] - a[1]) * y
    length = x * x + y * y
    return 0 < along < length and 16 * turn * turn <= 9 * length


def _meetings(a: Spot, b: Spot, c: Spot, d: Spot) -> tuple[list[Spot], list[Spot]]:
    """Where (a, b) and where (c, d) have to be cut so that they meet in end points only."""
    (ax, ay), (bx, by), (cx, cy), (dx, dy) = a, b, c, d
    one, two = (bx - ax) * (cy - ay) - (by - ay) * (cx - ax), (bx - ax) * (dy - ay) - (by - ay) * (dx - ax)  # as _turn() has it
    three, four = (dx - cx) * (ay - cy) - (dy - cy) * (ax - cx), (dx - cx) * (by - cy) - (dy - cy) * (bx - cx)
    first = [p for p, t in ((c, one), (d, two)) if _beside(p, a, b, t)]
    second = [p for p, t in ((a, three), (b, four)) if _beside(p, c, d, t)]
    if not first and not second and (one > 0) != (two > 0) and (three > 0) != (four > 0) and one and two and three and four:
        below = three - four  # of the whole way from a to b, three parts of `below` lie before the crossing
        p = tuple((2 * (u * below + three * (v - u)) + below) // (2 * below) for u, v in zip(a, b, strict=True))
        first += [p] if p not in (a, b) else []
        second += [p] if p not in (c, d) else []
    return first, second


def _near(listed: list[tuple[Spot, Spot]]):
    """Pairs of segments (their lesser ends first) whose boxes meet, by a sweep from left to right."""
    if len(listed) <= FEW:
        boxes = sorted((a[0], b[0] + 1, min(a[1], b[1]), max(a[1], b[1]) + 1, k) for k, (a, b) in enumerate(listed))
        for n, (_, right, low, high, k) in enumerate(boxes):
            for x, _, y, top, other in boxes[n + 1 :]:
                if x > right:
                    break
                if y <= high and top >= low:
                    yield k, other
        return
    p, q = (np.array([s[k] for s in listed], dtype=np.int64).reshape(-1, 2) for k in (0, 1))
    by = np.argsort(np.minimum(p[:, 0], q[:, 0]), kind="stable")
    low, high = np.minimum(p, q)[by], np.maximum(p, q)[by] + 1  # with what lies within a unit
    last = np.searchsorted(low[:, 0], high[:, 0], "right")
    for k in range(len(by)):
        j = np.arange(k + 1, last[k])
        j = j[(low[j, 1] <= high[k, 1]) & (high[j, 1] >= low[k, 1])]
        for other in by[j].tolist():
            yield int(by[k]), other


def noded(segments: Counter) -> Counter:
    """Segments (pairs of spots, the lesser first, with how often each runs) cut until they meet in end points only."""
    for _ in range(ROUNDS):
        listed = list(segments)
        cuts: dict[int, set[Spot]] = defaultdict(set)
        for i, j in _near(listed):
            first, second = _meetings(*listed[i], *listed[j])
            if first:
                cuts[i].update(first)
            if second:
                cuts[j].update(second)
        if not cuts:
            return segments
        out: Counter = Counter()
        for k, (a, b) in enumerate(listed):
            way = sorted(cuts.get(k, ()), key=lambda s: (s[0] - a[0]) * (b[0] - a[0]) + (s[1] - a[1]) * (b[1] - a[1]))
            path = [a, *way, b]
            for s, t in zip(path, path[1:], strict=False):
                if s != t:
                    out[min(s, t), max(s, t)] += segments[a, b]
        segments = out
    raise ValueError("a polygon could not be noded")


def _inside_walks(edges: list[tuple[Spot, Spot]]) -> list[list[Spot]]:
    """Closed walks with the inside on their left, around each inside part of the plane; every edge has it on one side."""
    around: dict[Spot, list[Spot]] = defaultdict(list)
    for a, b in edges:
        around[a].append(b)
        around[b].append(a)
    for s, ends in around.items():
        half = lambda e: e[1] > s[1] or (e[1] == s[1] and e[0] > s[0])  # noqa: B023, E731  angles from 0 on come last
        ends.sort(key=cmp_to_key(lambda e, f: half(e) - half(f) if half(e) != half(f) else -_turn(s, e, f)))  # noqa: B023
    place = {(s, e): k for s, ends in around.items() for k, e in enumerate(ends)}
    follow = lambda a, b: (b, around[b][place[b, a] - 1])  # noqa: E731  the next way clockwise from the way back
    face, walks = {}, []
    for half in [h for a, b in edges for h in ((a, b), (b, a))]:
        if half not in face:
            walk, at = [], half
            while at not in face:
                face[at] = len(walks)
                walk.append(at[0])
                at = follow(*at)
            walks.append(walk)
    inside: dict[int, bool] = {}
    for spot in sorted(around):  # the leftmost, lowest one of each connected part comes first
        ways = around[spot]
        if face[spot, ways[0]] in inside:
            continue
        # what lies to the left of it lies outside its own edges: whether inside of others, the edges straight below tell
        x = spot[0]
        reach, todo = {spot}, [spot]
        while todo:
            for e in around[todo.pop()]:
                if e not in reach:
                    reach.add(e)
                    todo.append(e)
        below = sum(1 for a, b in edges if a not in reach and a[0] <= x < b[0] and _turn(a, b, spot) > 0)
        # all its ways lead to the right; the left side of the steepest one is outside
        steepest = ways[0]
        for e in ways[1:]:
            steepest = e if _turn(spot, steepest, e) > 0 else steepest
        todo = [(face[spot, steepest], below % 2 == 1)]
        while todo:
            f, flag = todo.pop()
            if f in inside:
                continue
            inside[f] = flag
            walk = walks[f]
            todo += [(face[b, a], not flag) for a, b in zip(walk, walk[1:] + walk[:1], strict=True)]
    return [w for k, w in enumerate(walks) if inside[k]]


def valid_polygons(rings: list[np.ndarray]) -> list[list[np.ndarray]]:
    """Polygons (an outer ring that runs to the left, then its holes) that cover what the rings cover by the even-odd rule; none if they cover nothing."""
    rings = [np.asarray(r, dtype=float) for r in rings]
    largest = max((float(np.abs(r).max()) for r in rings if len(r)), default=0.0)
    if not np.isfinite(largest):
        raise ValueError("a polygon has coordinates that are no numbers")
    digits = BITS - int(np.frexp(largest)[1])
    segments: Counter = Counter()
    for r in rings:
        path = [tuple(s) for s in np.rint(np.ldexp(r, digits)).astype(np.int64).tolist()]
        for a, b in zip(path, path[1:] + path[:1], strict=True):
            if a != b:
                segments[min(a, b), max(a, b)] += 1
    edges = [s for s, n in noded(segments).items() if n % 2]
    if not edges:
        return []
    closed = []
    for walk in _inside_walks(edges):
        closed += [np.ldexp(np.vstack((p, p[:1])).astype(float), -digits) for p in _apart(np.array(walk)) if len(p) > 2]
    outer = sorted((r for r in closed if signed_area(r) > 0), key=signed_area)
    out = [[r] for r in outer]
    for hole in (r for r in closed if signed_area(r) < 0):
        for polygon in out:  # from the smallest on
            corners = {tuple(s) for s in polygon[0].tolist()}
            free = next((s for s in hole.tolist() if tuple(s) not in corners), None)
            spot = np.asarray(free) if free is not None else (hole[0] + hole[1]) / 2
            if contains(polygon[0], spot) and signed_area(polygon[0]) > -signed_area(hole):
                polygon.append(hole)
                break
    return out


def make_valid(features: DataFrame) -> DataFrame:
    """features (wkb, ...) with valid polygons; `piece` numbers the rows that a polygon has become, from 0 on. What covers nothing has none.

    area_m2, perimeter_m and n_rings, where features have them, are measured anew. The rows are dealt out first: a table of
    one row group would be one task. Rows of equal bytes in a batch are worked out once.
    """
    names = [f.name for f in features.schema.fields]
    measured = {"area_m2": lambda p: abs(signed_area(p[0])) - sum(abs(signed_area(r)) for r in p[1:]), "perimeter_m": lambda p: sum(map(ring_length, p)), "n_rings": len}

    def made(wkb: bytes) -> list[dict]:
        polygons = valid_polygons(read_wkb(wkb)) if wkb is not None else []
        return [{"wkb": wkb_polygon(p), "piece": k} | {c: f(p) for c, f in measured.items() if c in names} for k, p in enumerate(polygons)]

    def run(batches):
        for batch in batches:
            coded = batch.column("wkb").dictionary_encode(null_encoding="encode")
            pieces = [made(w) for w in coded.dictionary.to_pylist()]
            rows = [row | piece for row, k in zip(batch.to_pylist(), coded.indices.to_pylist(), strict=True) for piece in pieces[k]]
            yield pa.RecordBatch.from_pylist(rows, schema=batch.schema.append(pa.field("piece", pa.int32())))

    spark = features.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return features.repartition(parts).mapInArrow(run, StructType([*features.schema.fields, StructField("piece", IntegerType())]))
