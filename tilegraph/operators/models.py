"""Models on executors: weights that travel once, one model for a worker's lifetime, resets after so many tiles.

A proposer that costs seconds to open is wrapped in Resident. The wrapper travels with each task; the model itself stays in
the worker process, which Spark uses again for task after task, under the wrapper's key. Weights are a file of the
application (ship()): each executor fetches them once. A resource profile puts the kernel's stage on executors with GPUs.
"""

from __future__ import annotations

import os
from collections.abc import Callable

import numpy as np
from pyspark import SparkFiles
from pyspark.sql import SparkSession

from .multipass import Proposal, Proposer

#: What this worker process holds, by key: the open model, and the tiles that it has served.
_live: dict[str, list] = {}


def ship(spark: SparkSession, path: str) -> str:
    """Hand a file of weights to all executors, from any file system; the name by which Resident finds it there."""
    spark.sparkContext.addFile(path)
    return os.path.basename(path.rstrip("/"))


class Resident:
    """A proposer whose model outlives tasks: made and opened once a worker, closed and opened anew after `reset_tiles` tiles (0: never).

    `make` gets the path of the weights on the executor (None without any) and returns a Proposer. Two wrappers with one key
    share a model. A model that fails is dropped, so that the next try opens another.
    """

    def __init__(self, make: Callable[[str | None], Proposer], key: str, weights: str | None = None, reset_tiles: int = 0):
        if reset_tiles < 0:
            raise ValueError("reset_tiles must not be negative")
        self.make, self.key, self.weights, self.reset_tiles = make, key, weights, reset_tiles

    def _model(self) -> Proposer:
        if self.key not in _live:
            model = self.make(SparkFiles.get(self.weights) if self.weights else None)
            model.open()
            _live[self.key] = [model, 0]
        return _live[self.key][0]

    def open(self) -> None:
        """Tasks open the wrapper; the model is opened when a tile needs it."""

    def close(self) -> None:
        """Tasks close the wrapper; the model stays."""

    def propose(self, image: np.ndarray, points: np.ndarray, iou: float, stability: float) -> list[Proposal]:
        return self._model().propose(image, points, iou, stability)

    def tile_done(self) -> None:
        """Called after each tile: counts it, and resets the model when its number of tiles is reached."""
        if self.key in _live:
            _live[self.key][1] += 1
            if self.reset_tiles and _live[self.key][1] >= self.reset_tiles:
                self.reset()

    def reset(self) -> None:
        """Close the model and give its memory up; the next tile opens another."""
        held = _live.pop(self.key, None)
        if held:
            held[0].close()
