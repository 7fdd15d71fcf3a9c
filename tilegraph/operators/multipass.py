"""Tile kernels: proposers, greedy acceptance, and the multi-pass loop with its falling thresholds.

What one pass accepts decides what the next one proposes, so a tile is one sequential kernel in a Python
worker; tiles are what runs in parallel. Rasters reach the kernel as blocks, never as rows of pixels.
"""

from __future__ import annotations

import importlib
import logging
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..config import Segmentation, Threshold
from .components import label_block
from .masks import suppress

LEAST_GAIN = 0.1
OVERLAP = 0.5


@dataclass
class Proposal:
    mask: np.ndarray
    score: float = 1.0
    stability: float = 1.0
    point: tuple[int, int] | None = None


class Proposer(Protocol):
    """Anything that proposes masks for the points of an (h, w, 3) uint8 image."""

    def open(self) -> None: ...

    def propose(self, image: np.ndarray, points: np.ndarray, iou: float, stability: float) -> list[Proposal]: ...

    def close(self) -> None: ...


#: Makers of proposers by name: each takes the segmentation options and the least area of a mask.
PROPOSERS: dict[str, Callable[[Segmentation, int], Proposer]] = {}


def make_proposer(checkpoint: str | None, config: Segmentation, min_area: int = 100) -> Proposer:
    """The proposer that `checkpoint` names: one of PROPOSERS (the stand-in by default), or module:maker to import."""
    name = checkpoint or "flood"
    if name in PROPOSERS:
        made = PROPOSERS[name](config, min_area)
    elif ":" in name and not name.startswith((".", "/")):
        module, _, maker = name.partition(":")
        made = getattr(importlib.import_module(module), maker)(config, min_area)
    else:
        raise ValueError(f"no proposer named {name}; known are {', '.join(PROPOSERS)}, or module:maker")
    return Cropped(made, config.crop_n_layers) if config.crop_n_layers else made


class Cropped:
    """A proposer that also looks at crops: in layer k the image in 2^k x 2^k parts that overlap by an eighth."""

    def __init__(self, inner: Proposer, layers: int):
        self.inner, self.layers = inner, layers

    def open(self) -> None:
        self.inner.open()

    def close(self) -> None:
        self.inner.close()

    def propose(self, image, points, iou, stability):
        out = list(self.inner.propose(image, points, iou, stability))
        h, w = image.shape[:2]
        for layer in range(1, self.layers + 1):
            n = 2**layer
            for row in range(n):
                for col in range(n):
                    y0, x0 = max(row * h // n - h // (8 * n), 0), max(col * w // n - w // (8 * n), 0)
                    y1, x1 = min((row + 1) * h // n + h // (8 * n), h), min((col + 1) * w // n + w // (8 * n), w)
                    part = image[y0:y1, x0:x1]
                    inside = points[(points[:, 0] >= x0) & (points[:, 0] < x1) & (points[:, 1] >= y0) & (points[:, 1] < y1)]
                    if not len(inside) or not part.any():
                        continue
                    for p in self.inner.propose(part, inside - (x0, y0), iou, stability):
                        mask = np.zeros((h, w), dtype=bool)
                        mask[y0:y1, x0:x1] = p.mask
                        out.append(Proposal(mask, p.score, p.stability, None if p.point is None else (p.point[0] + x0, p.point[1] + y0)))
        return out


class FloodProposer:
    """A stand-in for a network: the area around each point whose quantised colour is the point's own.

    score is the share of the area's bounding box that it fills, stability how much of it one finer
    quantisation keeps. Deterministic; black pixels propose nothing.
    """

    def __init__(self, levels: int = 8, min_area: int = 100, nms: float = 0.7):
        self.levels, self.min_area, self.nms = levels, min_area, nms

    def open(self) -> None: ...

    def close(self) -> None: ...

    def _areas(self, image: np.ndarray, levels: int) -> np.ndarray:
        cut = image.astype(np.int64) * levels // 256
        code = cut[..., 0] * levels * levels + cut[..., 1] * levels + cut[..., 2] + 1
        return label_block(np.where(image.any(axis=2), code, 0))

    def propose(self, image, points, iou, stability):
        coarse, fine = self._areas(image, self.levels), self._areas(image, self.levels * 2)
        out, boxes = [], []
        seen: set[int] = set()
        for x, y in points:
            root = int(coarse[y, x])
            if root < 0 or root in seen:
                continue
            seen.add(root)
            mask = coarse == root
            size = int(mask.sum())
            if size < self.min_area:
                continue
            ys, xs = np.flatnonzero(mask.any(axis=1)), np.flatnonzero(mask.any(axis=0))
            score = size / ((ys[-1] - ys[0] + 1) * (xs[-1] - xs[0] + 1))
            steady = np.bincount(fine[mask] + 1).max() / size
            if score > iou and steady > stability:
                out.append(Proposal(mask, float(score), float(steady), (int(x), int(y))))
                boxes.append((xs[0], ys[0], xs[-1] + 1, ys[-1] + 1))
        if out and self.nms < 1.0:
            kept = suppress(np.asarray(boxes), np.asarray([p.score for p in out]), self.nms)
            out = [out[k] for k in np.sort(kept)]
        return out


PROPOSERS["flood"] = lambda config, min_area: FloodProposer(min_area=min_area, nms=config.box_nms_thresh)


@dataclass
class Accepted:
    """A tile's labels so far. Components of proposals are accepted in order; the first to take a pixel keeps it."""

    labels: np.ndarray
    next_label: int = 1
    min_area: int = 100
    counts: dict[str, int] = field(default_factory=lambda: {"overlap": 0, "small": 0})

    def offer(self, mask: np.ndarray) -> int:
        """Components of the mask accepted: large enough, and less than half covered already."""
        if not mask.any():
            return 0
        parts = label_block(mask.astype(np.int64))
        added = 0
        roots, place, sizes = np.unique(parts[parts >= 0], return_inverse=True, return_counts=True)
        for k, size in enumerate(sizes):
            if size < self.min_area:
                self.counts["small"] += 1
                continue
            part = parts == roots[k]
            free = part & (self.labels == 0)
            if (size - int(free.sum())) / size >= OVERLAP:
                self.counts["overlap"] += 1
                continue
            self.labels[free] = self.next_label
            self.next_label += 1
            added += 1
        return added

    def coverage(self) -> float:
        return 100.0 * np.count_nonzero(self.labels) / self.labels.size


def decay(coverages: list[float], threshold: Threshold, target: float, added: list[int] | None = None, adaptive: bool = True) -> list[tuple[float, float, bool]]:
    """(iou, stability, stopped) after each pass of a recorded series of coverages.

    Thresholds fall by a step, each to its own end, when a pass adds no mask or raises coverage by less than
    LEAST_GAIN points; a stagnant pass at the last iou stops the loop, and so does the target coverage.
    """
    iou, stability, before, out = threshold.iou_start, threshold.stability_start, 0.0, []
    for k, now in enumerate(coverages):
        stopped = now >= target
        if not stopped and adaptive and ((added is not None and added[k] == 0) or now - before < LEAST_GAIN):
            if iou <= threshold.iou_end:
                stopped = True
            else:
                iou = max(threshold.iou_end, iou - threshold.step)
                stability = max(threshold.stability_end, stability - threshold.step)
        out.append((iou, stability, stopped))
        if stopped:
            break
        before = now
    return out


def decay_by_scene(series: DataFrame, threshold: Threshold, target: float) -> DataFrame:
    """(scene, pass, iou, stability, stopped) of decay() on each scene's coverages (scene, pass, coverage)."""

    def run(key, table):
        table = table.sort_by("pass")
        steps = decay(table.column("coverage").to_pylist(), threshold, target)
        iou, stability, stopped = zip(*steps, strict=True)
        n = len(steps)
        return pa.table({"scene": pa.array([key[0].as_py()] * n, pa.int64()), "pass": table.column("pass").cast(pa.int64()).slice(0, n), "iou": iou, "stability": stability, "stopped": stopped})

    return series.groupBy("scene").applyInArrow(run, "scene long, pass long, iou double, stability double, stopped boolean")


def uniform_points(height: int, width: int, n: int) -> np.ndarray:
    """n x n points (x, y), x fastest, spaced over the whole tile and cut to integers."""
    xs, ys = (np.linspace(0, size - 1, n).astype(np.int32) for size in (width, height))
    return np.column_stack((np.tile(xs, n), np.repeat(ys, n)))


def erode(valid: np.ndarray, rounds: int) -> np.ndarray:
    """Pixels whose 4-neighbourhood is valid, `rounds` times; outside is not valid."""
    for _ in range(rounds):
        p = np.pad(valid, 1)
        valid = valid & p[:-2, 1:-1] & p[2:, 1:-1] & p[1:-1, :-2] & p[1:-1, 2:]
    return valid


def spread_points(valid: np.ndarray, n: int, seed: int, most: int = 10_000) -> np.ndarray:
    """At most n valid pixels (x, y) near the centres of n clusters of a sample of them, by some rounds of Lloyd's method."""
    ys, xs = np.nonzero(valid)
    if len(xs) <= n:
        return np.column_stack((xs, ys)).astype(np.int32)
    rng = np.random.default_rng(seed)
    pick = np.sort(rng.choice(len(xs), min(most, len(xs)), replace=False))
    spots = np.column_stack((xs[pick], ys[pick])).astype(float)
    centres = spots[rng.choice(len(spots), n, replace=False)]
    for _ in range(8):
        near = ((spots[:, None, :] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        held = np.bincount(near, minlength=n)
        moved = np.column_stack([np.bincount(near, spots[:, k], n) for k in (0, 1)])
        centres = np.where(held[:, None] > 0, moved / np.maximum(held, 1)[:, None], centres)
    near = ((spots[:, None, :] - centres[None]) ** 2).sum(axis=2).argmin(axis=0)
    return spots[near].astype(np.int32)


def next_points(labels: np.ndarray, config: Segmentation, seed: int) -> np.ndarray:
    """Points of a pass after the first: on the eroded area without a label, by the configured strategy."""
    free = erode(labels == 0, config.erosion_iterations)
    if config.point_strategy == "dense_grid":
        grid = uniform_points(*labels.shape, config.points_per_side)
        return grid[free[grid[:, 1], grid[:, 0]]]
    return spread_points(free, 64, seed)


def run_tile(image: np.ndarray, proposer: Proposer, config: Segmentation, threshold: Threshold, min_area: int = 100, seed: int = 42) -> tuple[np.ndarray, dict]:
    """(labels from 1, statistics) of a padded (h, w, 3) uint8 tile after all passes."""
    done = Accepted(np.zeros(image.shape[:2], dtype=np.int64), min_area=min_area)
    iou, stability = threshold.iou_start, threshold.stability_start
    generated, added, covered, first_pass = [], [], [], np.full(image.shape[:2], -1, dtype=np.int32)
    before, n_passes = 0.0, 0
    while config.max_passes is None or n_passes < config.max_passes:
        points = uniform_points(*image.shape[:2], config.points_per_side) if n_passes == 0 else next_points(done.labels, config, seed)
        if not len(points):
            break
        seen = image
        if n_passes and config.use_black_mask:
            seen = image.copy()
            seen[done.labels > 0] = 0
        proposals = proposer.propose(seen, points, iou, stability)
        if config.sort_by_area:
            proposals = sorted(proposals, key=lambda p: int(p.mask.sum()))
        free = done.labels == 0
        new = sum(done.offer(p.mask.astype(bool)) for p in proposals)
        first_pass[free & (done.labels > 0)] = len(covered)
        now = done.coverage()
        generated.append(len(proposals))
        added.append(new)
        covered.append(now)
        if now >= config.target_coverage:
            n_passes += 1
            break
        if config.use_adaptive_threshold and (new == 0 or now - before < LEAST_GAIN):
            if iou <= threshold.iou_end:
                break  # this pass does not count
            iou, stability = max(threshold.iou_end, iou - threshold.step), max(threshold.stability_end, stability - threshold.step)
        elif not config.use_adaptive_threshold and new == 0:
            break
        before = now
        n_passes += 1
    return done.labels, {"n_passes": n_passes, "passes_executed": len(covered), "masks_generated_per_pass": generated, "masks_per_pass": added, "coverage_per_pass": covered, "final_iou": iou, "masks_filtered_overlap": done.counts["overlap"], "masks_filtered_small": done.counts["small"], "first_pass": first_pass}


TILE_RESULT = "tile_row int, tile_col int, labels array<long>, max_label long, coverage double, coverage_padded double, n_labels int, n_passes int, passes_executed int, masks_per_pass array<int>, coverage_per_pass array<double>, masks_generated_per_pass array<int>, final_iou double, masks_filtered_overlap int, masks_filtered_small int"


def _anew(proposer: Proposer) -> None:
    """Open a proposer anew after a failure; one that outlives tasks (models.Resident) knows how."""
    if hasattr(proposer, "reset"):
        proposer.reset()
    else:
        proposer.close()
        proposer.open()


def segment_tiles(blocks: DataFrame, proposer: Proposer, config: Segmentation, threshold: Threshold, tile: int, min_area: int = 100, profile=None) -> DataFrame:
    """TILE_RESULT of blocks (tile_row, tile_col, crop_x, crop_y, width, height, rgb BINARY); tiles without any value are skipped.

    A lost worker costs its tiles only: kernels have no state beyond them. A tile whose proposer fails is tried
    once more with the proposer opened anew, then the task fails and Spark tries it elsewhere. `profile` is the
    resource profile of the kernel's stage.
    """
    import pyarrow.compute  # noqa: F401

    names = [c.strip().split(" ")[0] for c in TILE_RESULT.split(",")]

    def run(batches):
        proposer.open()
        try:
            for batch in batches:
                for row in batch.to_pylist():
                    image = np.frombuffer(row["rgb"], dtype=np.uint8).reshape(row["height"], row["width"], 3)
                    if not image.any():
                        continue
                    try:
                        labels, stats = run_tile(image, proposer, config, threshold, min_area)
                    except Exception:
                        logging.getLogger(__name__).warning("tile %s, %s failed and is tried again", row["tile_row"], row["tile_col"], exc_info=True)
                        _anew(proposer)
                        labels, stats = run_tile(image, proposer, config, threshold, min_area)
                    if hasattr(proposer, "tile_done"):
                        proposer.tile_done()
                    useful = labels[row["crop_y"] : row["crop_y"] + tile, row["crop_x"] : row["crop_x"] + tile]
                    result = {
                        "tile_row": row["tile_row"], "tile_col": row["tile_col"], "labels": useful.ravel().tolist(), "max_label": int(useful.max(initial=0)),
                        "coverage": 100.0 * np.count_nonzero(useful) / max(useful.size, 1), "coverage_padded": stats["coverage_per_pass"][-1] if stats["coverage_per_pass"] else 0.0,
                        "n_labels": max(len(np.unique(useful)) - 1, 0), **{k: stats[k] for k in names if k in stats},
                    }
                    yield pa.RecordBatch.from_pylist([{k: result[k] for k in names}], schema=_SCHEMA)
        finally:
            proposer.close()

    return blocks.select("tile_row", "tile_col", "crop_x", "crop_y", "width", "height", "rgb").mapInArrow(run, TILE_RESULT, profile=profile)


_TYPES = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64())}
_SCHEMA = pa.schema([(n, _TYPES[t]) for n, t in (c.strip().split(" ") for c in TILE_RESULT.split(","))])


def accept_masks(masks: DataFrame, width: int, height: int, min_area: int = 3) -> DataFrame:
    """(tile_id, x, y, label) of greedy acceptance over each tile's masks in order of `ord`."""

    def run(key, table):
        bits = np.asarray(table.column("bits").to_pylist(), dtype=bool).reshape(len(table), height, width)
        done = Accepted(np.zeros((height, width), dtype=np.int64), min_area=min_area)
        for k in np.argsort(table.column("ord").to_numpy(), kind="stable"):
            done.offer(bits[k])
        y, x = np.nonzero(done.labels)
        return pa.table({"tile_id": np.full(len(x), key[0].as_py(), dtype=np.int64), "x": x.astype(np.int32), "y": y.astype(np.int32), "label": done.labels[y, x]})

    return masks.groupBy("tile_id").applyInArrow(run, "tile_id long, x int, y int, label long")


def acceptance_counts(masks: DataFrame, width: int, height: int, min_area: int = 3) -> DataFrame:
    """(tile_id, accepted, filtered_small, filtered_overlap): components of each tile's masks by what the gates did with them."""

    def run(key, table):
        bits = np.asarray(table.column("bits").to_pylist(), dtype=bool).reshape(len(table), height, width)
        done = Accepted(np.zeros((height, width), dtype=np.int64), min_area=min_area)
        added = sum(done.offer(bits[k]) for k in np.argsort(table.column("ord").to_numpy(), kind="stable"))
        return pa.table({"tile_id": pa.array([key[0].as_py()], pa.int64()), "accepted": [added], "filtered_small": [done.counts["small"]], "filtered_overlap": [done.counts["overlap"]]})

    return masks.groupBy("tile_id").applyInArrow(run, "tile_id long, accepted long, filtered_small long, filtered_overlap long")
