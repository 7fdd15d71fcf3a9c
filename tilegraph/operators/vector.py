"""Outlines of label regions: measures by counting exposed edges, polygons by tracing them.

Both work on blocks: a kernel finds the exposed edges of its own pixels, looking one pixel beyond its edge.
Polygons take from each block the edges of each region, chained by number; regions that go on in another
block are joined by their components, and the edges of a region, never its area, meet in one task, which
traces many regions at once.
"""

from __future__ import annotations

import heapq
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.storage import bounded_broadcast, materialise
from .blocks import BLOCK, Grid, in_blocks
from .closure import components as closure
from .components import label_block

IDENTITY = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)
#: Of the sides top, right, bottom and left: the neighbour behind it, and the way along it with the pixel to the right.
BEHIND = ((0, -1), (1, 0), (0, 1), (-1, 0))
ALONG = ((1, 0), (0, 1), (-1, 0), (0, -1))
#: Corner of a pixel where each side begins.
BEGINS = np.array([(0, 0), (1, 0), (1, 1), (0, 1)])
#: Edges that one tracing takes at once.
EDGES_AT_ONCE = 1 << 20


def edge_lengths(transform) -> tuple[float, float, float]:
    """(length of a horizontal pixel edge, of a vertical one, area of a pixel) in map units."""
    a, b, _, d, e, _ = transform
    return float(np.hypot(a, d)), float(np.hypot(b, e)), abs(a * e - b * d)


def _exposed(_key, table):
    grid = Grid(table)
    on = grid.own & (grid.values != 0)
    sides = [on & (grid.near(*BEHIND[k]) != grid.values) for k in range(4)]
    labels, place = np.unique(grid.values[on], return_inverse=True)
    flat = [side[on] for side in sides]
    count = lambda flags: np.bincount(place, flags, len(labels)).astype(np.int64)
    across, along = count(flat[0]) + count(flat[2]), count(flat[1]) + count(flat[3])
    return pa.table({"label": labels, "n": count(np.ones(len(place))), "across": across, "along": along})


def measures(pixels: DataFrame, label: str = "label", transform=IDENTITY, block: int = BLOCK) -> DataFrame:
    """(label, area, perimeter) of each label's pixels in map units, holes' edges included; sums of blocks."""
    across, along, unit = edge_lengths(transform)
    on = in_blocks(pixels.where(F.col(label) != 0), F.col(label), block, 1)
    parts = on.groupBy("by", "bx").applyInArrow(_exposed, "label long, n long, across long, along long")
    total = parts.groupBy("label").agg(*(F.sum(c).alias(c) for c in ("n", "across", "along")))
    return total.select("label", (F.col("n") * F.lit(unit)).alias("area"), (F.col("across") * F.lit(across) + F.col("along") * F.lit(along)).alias("perimeter"))


def edges_of(grid: Grid, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(edge, next edge, flat place of its pixel) of a grid's own pixels; an edge is 4 * (y * width + x) + side.

    The walk keeps the pixel to its right. At a corner where two pixels of a label touch by a point it turns
    towards its own pixel, as regions are connected by sides.
    """
    v, shape = grid.values, grid.values.shape
    edge, follow, place = [], [], []
    for k in range(4):
        (nx, ny), (dx, dy) = BEHIND[k], ALONG[k]
        bare = np.flatnonzero(grid.own & (v != 0) & (grid.near(nx, ny) != v))
        y, x = np.divmod(bare, shape[1])
        own, ahead, left = v.ravel()[bare], v[y + dy, x + dx], v[y + dy + ny, x + dx + nx]
        straight, outward = ahead == own, (ahead == own) & (left == own)
        to_x = x + dx * straight + nx * outward
        to_y = y + dy * straight + ny * outward
        side = np.where(outward, (k + 3) % 4, np.where(straight, k, (k + 1) % 4))
        edge.append(4 * ((y + grid.y0) * width + x + grid.x0) + k)
        follow.append(4 * ((to_y + grid.y0) * width + to_x + grid.x0) + side)
        place.append(bare)
    return tuple(np.concatenate(c).astype(np.int64) for c in (edge, follow, place))


def rings_of(edge: np.ndarray, follow: np.ndarray, owner: np.ndarray, width: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Closed rings of corners (the first again at the end), and the owner of each, from edges in cycles.

    Cycles are found by pointer doubling on all edges at once. A ring that comes to a corner twice is taken
    apart there, so that no ring touches itself.
    """
    by = np.argsort(edge)
    edge, owner = edge[by], owner[by]
    nxt = np.searchsorted(edge, follow[by])
    n = len(edge)
    if not n:
        return [], owner
    head, jump = np.arange(n), nxt.copy()
    while True:  # the smallest edge of each cycle
        low = np.minimum(head, head[jump])
        if (low == head).all():
            break
        head, jump = low, jump[jump]
    to, left = np.where(head == nxt, np.arange(n), nxt), (head != nxt).astype(np.int64)
    while (step := left[to]).any():  # steps up to the last edge of the cycle
        left, to = left + step, to[to]
    order = np.lexsort((-left, head))
    side = edge[order] % 4
    ring, before = head[order], np.empty(n, dtype=np.int64)
    before[nxt] = edge % 4
    corner = side != before[order]
    order, ring = order[corner], ring[corner]
    y, x = np.divmod(edge[order] // 4, width)
    spots = np.column_stack((x, y)) + BEGINS[edge[order] % 4]
    start = np.flatnonzero(np.append(True, ring[1:] != ring[:-1]))
    stop = np.append(start[1:], len(ring))
    twice = np.zeros(len(start), dtype=bool)
    place = np.cumsum(np.append(0, ring[1:] != ring[:-1]))
    key = np.lexsort((spots[:, 0], spots[:, 1], place))
    same = (place[key][1:] == place[key][:-1]) & (spots[key][1:] == spots[key][:-1]).all(axis=1)
    twice[place[key][1:][same]] = True
    rings, owners = [], []
    spots = spots.astype(float)
    for k, (a, b) in enumerate(zip(start.tolist(), stop.tolist(), strict=True)):
        parts = _apart(spots[a:b]) if twice[k] else [spots[a:b]]
        rings += [np.vstack((p, p[:1])) for p in parts]
        owners += [owner[order[a]]] * len(parts)
    return rings, np.asarray(owners)


def _apart(spots: np.ndarray) -> list[np.ndarray]:
    """A ring that meets itself at corners, as rings that do not."""
    out, path, seen = [], [], {}
    for spot in map(tuple, spots.tolist()):
        if spot in seen:
            at = seen[spot]
            out.append(np.asarray(path[at:]))
            for gone in path[at + 1 :]:
                del seen[gone]
            del path[at + 1 :]
        else:
            seen[spot] = len(path)
            path.append(spot)
    return [*out, np.asarray(path)]


def trace(x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Closed rings (corner coordinates, first corner last again) around pixels of one label, the outer one first."""
    grid = Grid(pa.table({"x": x, "y": y, "v": np.ones(len(x), dtype=np.int64), "own": np.ones(len(x), dtype=bool)}))
    shift = np.array((min(grid.x0, 0), min(grid.y0, 0)))
    grid.x0, grid.y0 = grid.x0 - int(shift[0]), grid.y0 - int(shift[1])
    edge, follow, _ = edges_of(grid, 1 << 31)
    rings, _ = rings_of(edge, follow, np.zeros(len(edge), dtype=np.int64), 1 << 31)
    return sorted((r + shift for r in rings), key=lambda r: -abs(signed_area(r)))


def signed_area(ring: np.ndarray) -> float:
    """Shoelace area of a closed ring; positive if it winds from x to y."""
    a, b = ring[:-1], ring[1:]
    return float((a[:, 0] * b[:, 1] - b[:, 0] * a[:, 1]).sum() / 2)


def ring_length(ring: np.ndarray) -> float:
    return float(np.hypot(*np.diff(ring, axis=0).T).sum())


def simplify(ring: np.ndarray, tolerance: float) -> np.ndarray:
    """A closed ring without points that lie within the tolerance of the line that replaces them; four points stay at least.

    Douglas and Peucker's rule on the two halves of the ring; if the ring would collapse it is returned as it is.
    """
    if tolerance <= 0 or len(ring) <= 5:
        return ring
    far = int(np.argmax(((ring - ring[0]) ** 2).sum(axis=1)))
    keep = np.zeros(len(ring), dtype=bool)
    keep[[0, far, len(ring) - 1]] = True
    stack = [(0, far), (far, len(ring) - 1)]
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        line, off = ring[b] - ring[a], ring[a + 1 : b] - ring[a]
        size = np.hypot(*line)
        away = np.abs(line[0] * off[:, 1] - line[1] * off[:, 0]) / size if size else np.hypot(*off.T)
        k = int(np.argmax(away))
        if away[k] > tolerance:
            keep[a + 1 + k] = True
            stack += [(a, a + 1 + k), (a + 1 + k, b)]
    out = ring[keep]
    return out if len(out) >= 4 and abs(signed_area(out)) > 0 else ring


def _turn(o: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sign((a[..., 0] - o[..., 0]) * (b[..., 1] - o[..., 1]) - (a[..., 1] - o[..., 1]) * (b[..., 0] - o[..., 0]))


def _meeting(p, q, r, t) -> np.ndarray:
    """Whether the segments pq and rt cross, overlap or touch other than by ends that they share."""
    one, two, three, four = _turn(p, q, r), _turn(p, q, t), _turn(r, t, p), _turn(r, t, q)

    def within(o, a, b, turn):
        inside = (np.minimum(a, b) <= o).all(axis=-1) & (o <= np.maximum(a, b)).all(axis=-1)
        return (turn == 0) & inside & ~(o == a).all(axis=-1) & ~(o == b).all(axis=-1)

    equal = ((p == r).all(axis=-1) & (q == t).all(axis=-1)) | ((p == t).all(axis=-1) & (q == r).all(axis=-1))
    return ((one * two < 0) & (three * four < 0)) | within(r, p, q, one) | within(t, p, q, two) | within(p, r, t, three) | within(q, r, t, four) | equal


def conflicts(rings: list[np.ndarray]) -> set[int]:
    """Rings that cross or overlap themselves or another, and holes that lie outside the first ring."""
    p, q = np.vstack([r[:-1] for r in rings]), np.vstack([r[1:] for r in rings])
    owner = np.repeat(np.arange(len(rings)), [len(r) - 1 for r in rings])
    by = np.argsort(np.minimum(p[:, 0], q[:, 0]), kind="stable")
    p, q, owner = p[by], q[by], owner[by]
    low, high = np.minimum(p, q), np.maximum(p, q)
    last = np.searchsorted(low[:, 0], high[:, 0], "right")  # segments from k + 1 up to here overlap k from left to right
    bad: set[int] = set()
    for a in range(0, len(p), 2048):
        k = np.arange(a, min(a + 2048, len(p)))
        n = np.maximum(last[k] - k - 1, 0)
        for part in np.array_split(np.arange(len(k)), max(1, int(n.sum()) >> 20)):
            i = np.repeat(k[part], n[part])
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n[part]) - n[part], n[part])
            near = (low[i, 1] <= high[j, 1]) & (low[j, 1] <= high[i, 1])
            i, j = i[near], j[near]
            hit = _meeting(p[i], q[i], p[j], q[j])
            bad.update(owner[i[hit]].tolist(), owner[j[hit]].tolist())
    for k, hole in enumerate(rings[1:], 1):
        if k not in bad and not contains(rings[0], (hole[0] + hole[1]) / 2):
            bad |= {0, k}
    return bad


def contains(ring: np.ndarray, spot: np.ndarray) -> bool:
    """Whether a point lies within a ring, by crossings to its right."""
    a, b = ring[:-1], ring[1:]
    over = (a[:, 1] > spot[1]) != (b[:, 1] > spot[1])
    a, b = a[over], b[over]
    return bool(((a[:, 0] + (spot[1] - a[:, 1]) / (b[:, 1] - a[:, 1]) * (b[:, 0] - a[:, 0])) > spot[0]).sum() % 2)


class Thinning:
    """Points taken out of a polygon's rings one by one, the least deviation first, as long as nothing stands in the way.

    Taking out a point replaces its two segments by one. Nothing can cross that one if no other point of any ring lies in
    the triangle of the three; a grid over the points answers that by looking at a few cells. So rings that were valid stay
    so after each step, and every ring keeps three corners. A point's deviation is the largest distance to the new
    segment of what has been taken out between its neighbours, so the tolerance bounds that of the whole ring.
    """

    def __init__(self, rings: list[np.ndarray]):
        self.rings = [r[:-1] for r in rings]
        sizes = [len(r) for r in self.rings]
        self.first = np.concatenate(([0], np.cumsum(sizes)))
        self.spot = np.vstack(self.rings)
        self.ring = np.repeat(np.arange(len(sizes)), sizes)
        n = len(self.spot)
        self.left, self.live = list(sizes), np.ones(n, dtype=bool)
        at = np.arange(n)
        self.after = np.where(np.isin(at + 1, self.first[1:]), self.first[self.ring], at + 1).tolist()
        self.before = np.where(np.isin(at, self.first[:-1]), self.first[self.ring + 1] - 1, at - 1).tolist()
        self.low = self.spot.min(axis=0)
        extent = np.maximum(self.spot.max(axis=0) - self.low, 1e-9)
        self.cell = max(float(np.sqrt(extent.prod() / n)), float(extent.max()) / 4096, 1e-9) * 2
        self.cells: dict[tuple[int, int], set[int]] = {}
        for k, (x, y) in enumerate(self._cell(self.spot).tolist()):
            self.cells.setdefault((x, y), set()).add(k)

    def _cell(self, spots: np.ndarray) -> np.ndarray:
        return np.floor((spots - self.low) / self.cell).astype(np.int64)

    def deviation(self, k: int) -> float:
        """Of what would be out between the neighbours of k, if it were."""
        p, n, ring = self.before[k], self.after[k], self.ring[k]
        lo, hi = self.first[ring], self.first[ring + 1]
        between = self.spot[p + 1 : n] if p < n else np.vstack((self.spot[p + 1 : hi], self.spot[lo:n]))
        a, way = self.spot[p], self.spot[n] - self.spot[p]
        length = float(way @ way)
        if length == 0:
            return float(np.sqrt(((between - a) ** 2).sum(axis=1).max()))
        t = np.clip(((between - a) @ way) / length, 0, 1)
        return float(np.sqrt(((between - a - t[:, None] * way) ** 2).sum(axis=1).max()))

    def free(self, k: int) -> bool:
        """Whether no other point lies in the triangle of k and its neighbours, or on its edge."""
        p, n = self.before[k], self.after[k]
        corners = self.spot[[p, k, n]]
        (x0, y0), (x1, y1) = self._cell(corners.min(axis=0)).tolist(), self._cell(corners.max(axis=0)).tolist()
        if (x1 - x0 + 1) * (y1 - y0 + 1) > len(self.cells):
            near = np.flatnonzero(self.live)
        else:
            near = np.array([j for x in range(x0, x1 + 1) for y in range(y0, y1 + 1) for j in self.cells.get((x, y), ())], dtype=np.int64)
        near = near[(near != p) & (near != k) & (near != n)]
        if not len(near):
            return True
        q = self.spot[near]
        turn = lambda a, b: (b[0] - a[0]) * (q[:, 1] - a[1]) - (b[1] - a[1]) * (q[:, 0] - a[0])
        sides = [turn(corners[i], corners[(i + 1) % 3]) for i in range(3)]
        inside = (np.minimum.reduce(sides) >= 0) | (np.maximum.reduce(sides) <= 0)
        box = ((q >= corners.min(axis=0)) & (q <= corners.max(axis=0))).all(axis=1)
        return not (inside & box).any()

    def run(self, tolerance: float) -> list[np.ndarray]:
        queue = [(d, k) for k in range(len(self.spot)) if (d := self.deviation(k)) <= tolerance]
        heapq.heapify(queue)
        due = dict((k, d) for d, k in queue)
        blocked: dict[int, set[int]] = {}
        while queue:
            d, k = heapq.heappop(queue)
            if not self.live[k] or due.get(k) != d or self.left[self.ring[k]] <= 3:
                continue
            del due[k]
            if not self.free(k):
                blocked.setdefault(int(self.ring[k]), set()).add(k)
                continue
            p, n = self.before[k], self.after[k]
            self.live[k] = False
            self.left[self.ring[k]] -= 1
            self.cells[tuple(self._cell(self.spot[k]).tolist())].discard(k)
            self.after[p], self.before[n] = n, p
            # its neighbours deviate more now; points that it may have stood in the way of are looked at again
            again = {p, n} | {j for cell in self._around(k) for j in self.cells.get(cell, ())}
            for j in again:
                if self.live[j] and (j in (p, n) or j in blocked.get(int(self.ring[j]), ())):
                    blocked.get(int(self.ring[j]), set()).discard(j)
                    if (dj := self.deviation(j)) <= tolerance:
                        due[j] = dj
                        heapq.heappush(queue, (dj, j))
                    else:
                        due.pop(j, None)
        return [np.vstack((r[keep := self.live[a:b]], r[keep][:1])) for r, a, b in zip(self.rings, self.first[:-1], self.first[1:], strict=True)]

    def _around(self, k: int):
        x, y = self._cell(self.spot[k]).tolist()
        return [(x + i, y + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]


def simplified(rings: list[np.ndarray], tolerance: float) -> list[np.ndarray]:
    """Rings simplified so that they neither cross nor leave the first: each by itself where that is well, else point by point with an eye on the others."""
    if tolerance <= 0:
        return rings
    out = [simplify(r, tolerance) for r in rings]
    return Thinning(rings).run(tolerance) if conflicts(out) else out


def wkb_polygon(rings: list[np.ndarray]) -> bytes:
    """Little-endian well-known binary of a polygon, its outer ring first."""
    out = [struct.pack("<BII", 1, 3, len(rings))]
    for ring in rings:
        out.append(struct.pack("<I", len(ring)))
        out.append(np.ascontiguousarray(ring, dtype="<f8").tobytes())
    return b"".join(out)


def read_wkb(data: bytes) -> list[np.ndarray]:
    """The rings of wkb_polygon()."""
    _, kind, n = struct.unpack_from("<BII", data)
    if kind != 3:
        raise ValueError(f"not a polygon: {kind}")
    at, rings = 9, []
    for _ in range(n):
        (k,) = struct.unpack_from("<I", data, at)
        rings.append(np.frombuffer(data, dtype="<f8", count=2 * k, offset=at + 4).reshape(k, 2))
        at += 4 + 16 * k
    return rings


def drawn_areas(features: DataFrame) -> DataFrame:
    """features with `drawn`, the area that their rings enclose, holes taken off."""

    def run(batches):
        for batch in batches:
            areas = [[signed_area(r) for r in read_wkb(w)] for w in batch.column("wkb").to_pylist()]
            drawn = [abs(a[0]) - sum(map(abs, a[1:])) for a in areas]
            yield batch.append_column("drawn", pa.array(drawn, type=pa.float64()))

    return features.mapInArrow(run, StructType([*features.schema.fields, StructField("drawn", DoubleType())]))


FEATURE = "label_id long, part_id long, wkb binary, area_m2 double, perimeter_m double, n_rings int"


_OUTLINES = "label long, comp long, edges array<long>, follow array<long>, leaves array<long>, enters array<long>"


def _outlines(width: int):
    """Each region of a block with its edges, the pixels beyond the block that it goes on to, and its own pixels that others come to."""

    def run(_key, table):
        grid = Grid(table)
        own = np.where(grid.own, grid.values, 0)
        flat = label_block(own).ravel()
        w = own.shape[1]
        number = lambda place: (place // w + grid.y0).astype(np.int64) * width + place % w + grid.x0
        edge, follow, place = edges_of(grid, width)
        regions, first = np.unique(flat[flat >= 0], return_index=True)
        by = np.argsort(flat[place], kind="stable")
        cuts = np.searchsorted(flat[place][by], np.append(regions, len(flat)))

        def listed(values, cuts):
            return pa.ListArray.from_arrays(cuts.astype(np.int32), pa.array(values, type=pa.int64()))

        def across(ways):
            """Pixel numbers by region: of neighbours beyond the block (or of own pixels beside one) with the same label."""
            spots, owners = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
            for dx, dy, out in ways:
                beyond = np.zeros_like(grid.own)
                h, w_ = beyond.shape
                inside = grid.own[max(dy, 0) : h + min(dy, 0), max(dx, 0) : w_ + min(dx, 0)]
                beyond[max(-dy, 0) : h - max(dy, 0), max(-dx, 0) : w_ - max(dx, 0)] = ~inside
                at = np.flatnonzero((own != 0) & beyond & (grid.near(dx, dy) == grid.values))
                spots.append(number(at + dy * w + dx) if out else number(at))
                owners.append(flat[at])
            spot, owner = np.concatenate(spots), np.concatenate(owners)
            order = np.argsort(owner, kind="stable")
            return listed(spot[order], np.searchsorted(owner[order], np.append(regions, len(flat))))

        leaves, enters = across(((1, 0, True), (0, 1, True))), across(((-1, 0, False), (0, -1, False)))
        label = own.ravel()[regions]
        return pa.table({"label": label, "comp": number(regions), "edges": listed(edge[by], cuts), "follow": listed(follow[by], cuts), "leaves": leaves, "enters": enters})

    return run


def _traced(width: int, transform, tolerance: float):
    a, b, c, d, e, f = map(float, transform)

    def features(table):
        region = table.column("region").to_numpy()
        sizes = pa.compute.list_value_length(table.column("edges")).to_numpy()
        edge, follow = (pa.compute.list_flatten(table.column(k)).to_numpy() for k in ("edges", "follow"))
        rings, owner = rings_of(edge, follow, np.repeat(region, sizes), width)
        label = dict(zip(region.tolist(), table.column("label").to_pylist(), strict=True))
        by = np.argsort(owner, kind="stable")
        cut = np.flatnonzero(np.append(True, owner[by][1:] != owner[by][:-1]))
        out = []
        for low, high in zip(cut.tolist(), [*cut[1:].tolist(), len(by)], strict=True):
            own = sorted((rings[k] for k in by[low:high].tolist()), key=lambda r: -abs(signed_area(r)))
            own = simplified([np.column_stack((a * r[:, 0] + b * r[:, 1] + c, d * r[:, 0] + e * r[:, 1] + f)) for r in own], tolerance)
            area = abs(signed_area(own[0])) - sum(abs(signed_area(r)) for r in own[1:])
            name = int(owner[by[low]])
            out.append((label[name], name, wkb_polygon(own), area, sum(map(ring_length, own)), len(own)))
        types = (pa.int64(), pa.int64(), pa.binary(), pa.float64(), pa.float64(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(v, type=t) for v, t in zip(zip(*out, strict=True), types, strict=True)], names=[x.split()[0] for x in FEATURE.split(", ")])

    def run(batches):
        import pyarrow.compute  # noqa: F401

        held, edges = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            edges += int(pa.compute.sum(pa.compute.list_value_length(batch.column("edges"))).as_py() or 0)
            if edges < EDGES_AT_ONCE:
                continue
            table = pa.Table.from_batches(held)
            region = table.column("region").to_numpy()
            whole = int(np.searchsorted(region, region[-1]))  # the last region may go on
            if whole:
                yield features(table.slice(0, whole))
            held = table.slice(whole).to_batches()
            edges = int(pa.compute.sum(pa.compute.list_value_length(table.slice(whole).column("edges"))).as_py() or 0)
        if held:
            yield features(pa.Table.from_batches(held))

    return run


def polygons(pixels: DataFrame, transform=IDENTITY, tolerance: float = 1.0, width: int = 1 << 31, block: int = BLOCK) -> DataFrame:
    """FEATURE rows: a valid polygon for each 4-connected region of one label, area and length after simplification.

    part_id is the region's first pixel. No ring crosses or touches itself; simplification keeps rings apart
    and holes inside. Coordinates of pixels must not be negative.
    """
    labelled = in_blocks(pixels.where("label <> 0"), F.col("label"), block, 1)
    parts = materialise(labelled.groupBy("by", "bx").applyInArrow(_outlines(width), _OUTLINES))
    here = parts.select("comp", F.explode("leaves").alias("px"))
    there = parts.select(F.col("comp").alias("other"), F.explode("enters").alias("px")).distinct()
    roots = closure(here.join(there, "px").select("comp", "other"), "comp", "other")
    roots = bounded_broadcast(materialise(roots)).select(F.col("node").alias("__node"), F.col("component").alias("__root"))
    whole = parts.join(roots, F.col("comp") == F.col("__node"), "left").select("label", F.coalesce("__root", "comp").alias("region"), "edges", "follow")
    return whole.repartition("region").sortWithinPartitions("region").mapInArrow(_traced(width, transform, tolerance), FEATURE)
