"""Connected components of links between documents."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import closure

#: Edges (16 bytes each) up to which one task closes a graph; larger ones take distributed rounds. Nothing reaches the driver.
ONE_TASK = 50_000


def components(edges: DataFrame, a: str = "a", b: str = "b", one_task: int = ONE_TASK) -> DataFrame:
    """(node, component) of each node with a link; component is the smallest node reachable."""
    return closure.components(edges, a, b, one_task)
