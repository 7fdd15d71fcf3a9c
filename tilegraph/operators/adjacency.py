"""The region adjacency graph of a label raster, and merging on that graph alone.

Regions are 4-connected components of equal labels. A kernel on each block finds the block's own regions, their areas
and how long they touch each other or background; blocks hand on these sums and the pixels on their rims, never
their area. Rims meet across block seams: equal labels close into regions of the whole raster, others add to a contact. What
follows (which region is enclosed by which, contraction of merged ones, further rounds) works on rows of regions and
contacts; the pixels are relabelled once, at the end, block by block.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import bounded_broadcast, discard, materialise
from .blocks import BLOCK
from .closure import components as closure
from .components import label_block

_REGION = pa.struct([("comp", pa.int64()), ("label", pa.int64()), ("area", pa.int64())])
_CONTACT = pa.struct([("a", pa.int64()), ("b", pa.int64()), ("a_label", pa.int64()), ("b_label", pa.int64()), ("n", pa.int64())])
_RIM = pa.struct([("axis", pa.int32()), ("line", pa.int64()), ("at", pa.int64()), ("first", pa.bool_()), ("comp", pa.int64()), ("label", pa.int64())])
_BLOCK = (
    "by long, bx long, x0 long, y0 long, width long, height long, places binary, regions array<struct<comp long, label long, area long>>, "
    "contacts array<struct<a long, b long, a_label long, b_label long, n long>>, rim array<struct<axis int, line long, at long, first boolean, comp long, label long>>"
)
#: In `places`: an index into the block's regions, background, no pixel at all.
BACKGROUND, MISSING = -1, -2


@dataclass(frozen=True)
class RegionGraph:
    """regions (comp, label, area, open) and contacts (a, b, a_label, b_label, length; both ways), of whole regions.

    `open` tells whether background lies beside a region; the raster's edge does not open it. `blocks` are the pixels,
    `names` (comp, root) says which region a block's region has become, if another.
    """

    blocks: DataFrame
    names: DataFrame
    regions: DataFrame
    contacts: DataFrame


def _structs(kind: pa.DataType, *columns) -> pa.Array:
    """One list of structs, given by its columns."""
    fields = [pa.array(c, type=f.type) for c, f in zip(columns, kind, strict=True)]
    return pa.ListArray.from_arrays(pa.array([0, len(fields[0])], type=pa.int32()), pa.StructArray.from_arrays(fields, fields=list(kind)))


def contact_counts(place: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(region, region or BACKGROUND, edges in common), both ways, of a grid of region indices."""
    keys = []
    for p, q in ((place[:, :-1], place[:, 1:]), (place[:-1], place[1:])):
        met = (p != q) & (p != MISSING) & (q != MISSING)
        p, q = p[met].astype(np.int64), q[met].astype(np.int64)
        keys += [x[x >= 0] * (n + 1) + y[x >= 0] + 1 for x, y in ((p, q), (q, p))]
    key, count = np.unique(np.concatenate(keys), return_counts=True)
    return key // (n + 1), key % (n + 1) - 1, count


def _block_kernel(width: int, block: int):
    def run(key, table):
        by, bx = key[0].as_py(), key[1].as_py()
        x, y, v = (table.column(c).to_numpy() for c in ("x", "y", "v"))
        x0, y0 = int(x.min()), int(y.min())
        values = np.zeros((int(y.max()) - y0 + 1, int(x.max()) - x0 + 1), dtype=np.int64)
        there = np.zeros(values.shape, dtype=bool)
        values[y - y0, x - x0], there[y - y0, x - x0] = v, True
        local = label_block(values)
        first, inverse, area = np.unique(local[values != 0], return_inverse=True, return_counts=True)
        place = np.where(there, BACKGROUND, MISSING).astype(np.int32)
        place[values != 0] = inverse
        comp = (first // values.shape[1] + y0) * width + first % values.shape[1] + x0
        label = values.ravel()[first]
        a, b, n = contact_counts(place, len(comp))
        of = lambda table, k: np.append(table, 0)[k]  # noqa: E731  the last stands for background
        rims = []
        for axis, grid, low, across in ((0, place.T, x0, bx), (1, place, y0, by)):
            for k, line, side in ((across * block - low, across * block, False), (across * block + block - 1 - low, (across + 1) * block, True)):
                if 0 <= k < len(grid) and line > 0:
                    at = np.flatnonzero(grid[k] != MISSING)
                    r = grid[k][at]
                    m = len(at)
                    rims.append((np.full(m, axis), np.full(m, line), at + (y0 if axis == 0 else x0), np.full(m, side), np.where(r < 0, -1, of(comp, r)), of(label, r)))
        rim = [np.concatenate(c) for c in zip(*rims, strict=True)] if rims else [[]] * 6
        return pa.table(
            {
                "by": pa.array([by], pa.int64()), "bx": pa.array([bx], pa.int64()), "x0": pa.array([x0], pa.int64()), "y0": pa.array([y0], pa.int64()),
                "width": pa.array([place.shape[1]], pa.int64()), "height": pa.array([place.shape[0]], pa.int64()), "places": pa.array([place.tobytes()]),
                "regions": _structs(_REGION, comp, label, area), "contacts": _structs(_CONTACT, comp[a], np.where(b < 0, -1, of(comp, b)), label[a], of(label, b), n), "rim": _structs(_RIM, *rim),
            }
        )

    return run


def _named(rows: DataFrame, names: DataFrame, *columns: str) -> DataFrame:
    """rows with the regions in `columns` under their names as whole regions; most keep theirs."""
    for c in columns:
        of = names.select(F.col("comp").alias("__comp"), F.col("root").alias("__root"))
        rows = rows.join(of, F.col(c) == F.col("__comp"), "left").withColumn(c, F.coalesce("__root", c)).drop("__comp", "__root")
    return rows


def _summed(regions: DataFrame, contacts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """regions and contacts added up; contacts of a region with itself fall away, those with background are its `open`."""
    touching = contacts.where("a <> b and b >= 0").groupBy("a", "b").agg(F.min("a_label").alias("a_label"), F.min("b_label").alias("b_label"), F.sum("length").alias("length"))
    beside = contacts.where("b < 0").select(F.col("a").alias("comp"), F.col("a_label").alias("label"), F.lit(0).cast("long").alias("area"), F.lit(True).alias("open"))
    both = regions.select("comp", "label", "area", "open").unionByName(beside)
    return both.groupBy("comp").agg(F.min("label").alias("label"), F.sum("area").alias("area"), F.max("open").alias("open")), touching


def region_graph(pixels: DataFrame, width: int = 1 << 31, block: int = BLOCK) -> RegionGraph:
    """The graph of (x, y, label); label 0 (or null) is background, a pixel that is absent is nothing. A region's comp is y * width + x of its first pixel."""
    px = pixels.select(F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), F.coalesce(F.col("label").cast("long"), F.lit(0)).cast("long").alias("v"))
    keyed = px.withColumns({"by": F.floor(F.col("y") / block).cast("long"), "bx": F.floor(F.col("x") / block).cast("long")})
    blocks = materialise(keyed.groupBy("by", "bx").applyInArrow(_block_kernel(width, block), _BLOCK))
    rim = blocks.select(F.explode("rim").alias("r")).select("r.*")
    end = F.struct("comp", "label")
    met = rim.groupBy("axis", "line", "at").agg(F.max(F.when(F.col("first"), end)).alias("p"), F.max(F.when(~F.col("first"), end)).alias("q"))
    met = materialise(met.where("p is not null and q is not null and (p.comp >= 0 or q.comp >= 0)").groupBy("p", "q").agg(F.count("*").alias("n")))
    same = met.where("p.comp >= 0 and q.comp >= 0 and p.label = q.label").select(F.col("p.comp").alias("a"), F.col("q.comp").alias("b"))
    names = bounded_broadcast(materialise(closure(same).where("node <> component").select(F.col("node").alias("comp"), F.col("component").alias("root"))))
    one = lambda p, q: met.where(f"{p}.comp >= 0").select(F.col(f"{p}.comp").alias("a"), F.col(f"{q}.comp").alias("b"), F.col(f"{p}.label").alias("a_label"), F.col(f"{q}.label").alias("b_label"), F.col("n").alias("length"))
    inner = blocks.select(F.explode("contacts").alias("c")).select("c.a", "c.b", "c.a_label", "c.b_label", F.col("c.n").alias("length"))
    contacts = _named(inner.unionByName(one("p", "q")).unionByName(one("q", "p")), names, "a", "b")
    regions = blocks.select(F.explode("regions").alias("r")).select("r.*").withColumn("open", F.lit(False))
    found, touching = _summed(_named(regions, names, "comp"), contacts)
    return RegionGraph(blocks, names, materialise(found), materialise(touching))


def neighbours(graph: RegionGraph) -> DataFrame:
    """(comp, n_neighbours, contact, labels, low_label, largest, open): how many regions touch a region and how long, how large the largest is.

    `labels` is 1 where all of them have the label low_label. Regions without neighbours have none of these.
    """
    area = graph.regions.select(F.col("comp").alias("b"), F.col("area").alias("b_area"))
    beside = graph.contacts.join(area, "b").groupBy(F.col("a").alias("comp"))
    told = beside.agg(F.count("*").alias("n_neighbours"), F.sum("length").alias("contact"), F.min("b_label").alias("low_label"), F.max("b_label").alias("high_label"), F.max("b_area").alias("largest"))
    told = graph.regions.join(told, "comp", "left")
    one = (F.col("low_label") == F.col("high_label")).cast("int")
    return told.select("comp", "label", "area", "open", F.coalesce("n_neighbours", F.lit(0)).alias("n_neighbours"), F.coalesce("contact", F.lit(0)).alias("contact"), one.alias("one_label"), "low_label", "largest")


def enclosed(graph: RegionGraph, max_area: int = 500) -> DataFrame:
    """(comp, target): regions of at most max_area pixels without background beside them, whose neighbours all have one label and of which the largest is larger.

    Asking for a larger one keeps two regions that enclose each other's only contact from swapping labels.
    """
    candidates = graph.regions.where((F.col("area") <= max_area) & ~F.col("open")).select(F.col("comp").alias("a"), F.col("area").alias("a_area"))
    area = graph.regions.select(F.col("comp").alias("b"), F.col("area").alias("b_area"))
    beside = graph.contacts.join(candidates, "a").join(area, "b")
    found = beside.groupBy("a", "a_area").agg(F.min("b_label").alias("target"), F.max("b_label").alias("other"), F.max("b_area").alias("largest"))
    return found.where("target = other and largest > a_area").select(F.col("a").alias("comp"), "target")


def contract(graph: RegionGraph, targets: DataFrame) -> RegionGraph:
    """The graph once the regions in targets (comp, target; written) have their new labels: touching regions of one label are one."""
    new = targets.select(F.col("comp").alias("__comp"), "target")
    relabelled = graph.regions.join(new, F.col("comp") == F.col("__comp"), "left").select("comp", F.coalesce("target", "label").alias("label"), "area", "open")
    contacts = graph.contacts
    for c in ("a", "b"):
        contacts = contacts.join(new, F.col(c) == F.col("__comp"), "left").withColumn(f"{c}_label", F.coalesce("target", f"{c}_label")).drop("__comp", "target")
    contacts = materialise(contacts)
    names = bounded_broadcast(materialise(closure(contacts.where("a_label = b_label and a < b")).where("node <> component").select(F.col("node").alias("comp"), F.col("component").alias("root"))))
    regions, touching = _summed(_named(relabelled, names, "comp"), _named(contacts, names, "a", "b"))
    # what had a name gets the name of that, the others that have changed get one
    before = _named(graph.names, names, "root")
    again = names.join(before.select("comp"), "comp", "left_anti")
    out = replace(graph, names=materialise(before.unionByName(again)), regions=materialise(regions), contacts=materialise(touching))
    discard(contacts)
    return out


def _paint(batches):
    """(x, y, label) of blocks that come with the new labels of their regions, by place."""
    for batch in batches:
        for row in batch.to_pylist():
            place = np.frombuffer(row["places"], dtype=np.int32).reshape(row["height"], row["width"])
            y, x = np.nonzero(place != MISSING)
            labels = np.append(np.asarray(row["labels"], dtype=np.int64), 0)  # BACKGROUND is the last
            yield pa.RecordBatch.from_arrays([pa.array((x + row["x0"]).astype(np.int32)), pa.array((y + row["y0"]).astype(np.int32)), pa.array(labels[place[y, x]])], names=["x", "y", "label"])


def paint(graph: RegionGraph, labels: DataFrame | None = None) -> DataFrame:
    """(x, y, label) of all pixels, by the labels (comp, label) of whole regions, the graph's own if none are given; regions not in labels keep theirs.

    A block's regions travel and come back to it as one row; its pixels meet them there.
    """
    new = (graph.regions if labels is None else labels).select(F.col("comp").alias("__region"), F.col("label").alias("__label"))
    each = graph.blocks.select("by", "bx", F.posexplode("regions").alias("k", "r")).select("by", "bx", "k", F.col("r.comp").alias("comp"), F.col("r.label").alias("label"))
    each = _named(each, graph.names, "comp").join(new, F.col("comp") == F.col("__region"), "left")
    table = each.groupBy("by", "bx").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", F.coalesce("__label", "label").alias("label")))), lambda s: s["label"]).alias("labels"))
    rows = graph.blocks.select("by", "bx", "x0", "y0", "width", "height", "places").join(table, ["by", "bx"], "left")
    rows = rows.select("x0", "y0", "width", "height", "places", F.coalesce("labels", F.array().cast("array<long>")).alias("labels"))
    return rows.mapInArrow(_paint, "x int, y int, label long")
