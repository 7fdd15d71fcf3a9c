"""Prompt points for all tiles in one job: mini-batch k-means over samples of each tile's valid pixels.

A tile's valid pixels meet in one task as a bit map. Samples are drawn there by rejection, in batches of random places with
replacement until enough have fallen on valid pixels; where a tile has fewer valid pixels than samples, these are all taken.
Several starts (k-means++ on a part of the samples) are refined by mini-batches, each centre at the rate of one over
the samples it has seen; the start whose centres have the least inertia over all samples wins, and each centre gives way to
its nearest sample. Every tile has a generator of its own, so a result depends on no other tile and on no partitioning.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Places drawn at once, at most; how often a centre's share of a batch must stay below this to be placed anew.
DRAWN, SPARSE = 100_000, 0.1
BATCH, STEPS, STARTS = 1000, 80, 3
#: Batches without a better moving average of inertia after which a start has settled.
PATIENCE = 15


def sample(valid: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """(y, x) of n valid pixels drawn with replacement; all of them, in raster order, if there are no more than n."""
    count = int(valid.sum())
    if count <= n:
        return np.argwhere(valid)
    size = int(min(n * min(max(2, valid.size // count + 1), 10), DRAWN))
    out, have = [], 0
    while have < n:
        y, x = rng.integers(0, valid.shape[0], size), rng.integers(0, valid.shape[1], size)
        hit = valid[y, x]
        if not hit.any() and size < valid.size:
            size = min(size * 2, valid.size)  # very sparse: larger batches, so that the draw ends
        out.append(np.stack((y[hit], x[hit]), axis=1))
        have += len(out[-1])
    return np.concatenate(out)[:n]


def _closest(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest centre, squared distance) of each point."""
    d = ((points[:, None, :] - centres[None, :, :]) ** 2).sum(axis=2)
    at = d.argmin(axis=1)
    return at, d[np.arange(len(points)), at]


def inertia(points: np.ndarray, centres: np.ndarray) -> float:
    """Sum of squared distances to the nearest centre."""
    return float(sum(_closest(points[k : k + 4096], centres)[1].sum() for k in range(0, len(points), 4096)))


def spread(points: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k of the points as first centres, each drawn in proportion to its squared distance from those before (k-means++), the best of a few candidates."""
    centres = [points[rng.integers(len(points))]]
    near = ((points - centres[0]) ** 2).sum(axis=1).astype(float)
    tries = 2 + int(np.log(k))
    for _ in range(k - 1):
        total = near.sum()
        pick = rng.integers(len(points), size=tries) if total == 0 else np.minimum(np.searchsorted(np.cumsum(near), rng.random(tries) * total), len(points) - 1)
        new = np.minimum(near, ((points[None, :, :] - points[pick][:, None, :]) ** 2).sum(axis=2))
        best = new.sum(axis=1).argmin()
        near = new[best]
        centres.append(points[pick[best]])
    return np.array(centres, dtype=float)


def minibatch(points: np.ndarray, k: int, rng: np.random.Generator, batch: int = BATCH, steps: int = STEPS) -> np.ndarray:
    """Centres of one start. Centres that hardly any sample goes to are placed anew, on samples of a batch, while they are young."""
    batch = min(batch, len(points))
    centres = spread(points[rng.integers(len(points), size=min(3 * max(batch, k), len(points)))], k, rng)
    seen = np.zeros(k)
    average, best, since = None, np.inf, 0
    for step in range(steps):
        some = points[rng.integers(len(points), size=batch)]
        at, d = _closest(some, centres)
        n = np.bincount(at, minlength=k)
        seen += n
        moved = np.stack([np.bincount(at, weights=some[:, c], minlength=k) for c in (0, 1)], axis=1) - n[:, None] * centres
        hit = n > 0
        centres[hit] += moved[hit] / seen[hit, None]
        if step % 10 == 9 and step < steps // 2:
            idle = np.flatnonzero(seen < SPARSE * seen.max())
            idle = idle[: batch // 2]
            if len(idle):
                centres[idle] = some[rng.choice(batch, len(idle), replace=False, p=d / d.sum() if (d > 0).sum() >= len(idle) else None)]
                seen[idle] = seen[seen >= SPARSE * seen.max()].min()
        average = d.mean() if average is None else average + (d.mean() - average) * min(1.0, 2 * batch / (len(points) + 1))
        best, since = (average, 0) if average < best else (best, since + 1)
        if since >= PATIENCE:
            break
    return centres


def cluster(points: np.ndarray, k: int, rng: np.random.Generator, starts: int = STARTS, batch: int = BATCH, steps: int = STEPS) -> np.ndarray:
    """The centres with the least inertia of several starts."""
    found = [minibatch(points, k, rng, batch, steps) for _ in range(starts)]
    return min(found, key=lambda c: inertia(points, c))


def eroded(valid: np.ndarray, rounds: int) -> np.ndarray:
    """Pixels whose neighbours up to `rounds` 4-steps away are valid; what is outside is not."""
    for _ in range(rounds):
        p = np.pad(valid, 1)
        valid = valid & p[:-2, 1:-1] & p[2:, 1:-1] & p[1:-1, :-2] & p[1:-1, 2:]
    return valid


def _kernel(tile: int, n: int, rounds: int, most: int, seed: int, starts: int):
    def run(key, table):
        row, col = key[0].as_py(), key[1].as_py()
        grid = np.zeros((tile, tile), dtype=bool)
        grid[table.column("y").to_numpy() - row * tile, table.column("x").to_numpy() - col * tile] = True
        inner = eroded(grid, rounds)
        rng = np.random.default_rng([seed, row, col])
        points = np.argwhere(inner) if inner.sum() <= n else sample(inner, most, rng)
        if len(points) > n:
            centres = cluster(points.astype(float), n, rng, starts)
            # ties of distance go to the first sample
            points = points[[int(((points - c) ** 2).sum(axis=1).argmin()) for c in centres]]
        m = len(points)
        ints = lambda v: pa.array(np.asarray(v, dtype=np.int32))
        return pa.table({"tile_row": ints([row] * m), "tile_col": ints([col] * m), "point_id": ints(range(m)), "x": ints(points[:, 1] + col * tile), "y": ints(points[:, 0] + row * tile)})

    return run


def tile_points(valid: DataFrame, tile: int, n: int = 64, rounds: int = 5, most: int = 10_000, seed: int = 42, starts: int = STARTS) -> DataFrame:
    """(tile_row, tile_col, point_id, x, y): at most n points of each tile that spread over its valid pixels (x, y).

    Tiles are eroded one by one, with nothing valid outside. A tile without valid pixels has no row, one with n or fewer has
    them all; else `most` samples are clustered, and two centres may share their nearest one.
    """
    px = valid.select(F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"))
    keyed = px.withColumns({"tile_row": F.floor(F.col("y") / tile).cast("int"), "tile_col": F.floor(F.col("x") / tile).cast("int")})
    return keyed.groupBy("tile_row", "tile_col").applyInArrow(_kernel(tile, n, rounds, most, seed, starts), "tile_row int, tile_col int, point_id int, x int, y int")


def residual_points(pixels: DataFrame, tile: int, n: int = 64, rounds: int = 5, most: int = 10_000, seed: int = 42) -> DataFrame:
    """tile_points() of the pixels without a label."""
    return tile_points(pixels.where("label = 0"), tile, n, rounds, most, seed)
