"""Intermediate tables in the cluster's shared folder, and joins whose broadcast side has a checked size."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows above which a narrow side is joined by shuffle and not by broadcast.
BROADCAST_ROWS = 200_000
#: A key is hot if it has more than HOT_ROWS rows and more than one in HOT_KEYS of all: at most HOT_KEYS keys are.
HOT_ROWS, HOT_KEYS = 1_000, 100_000


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a temporary one only where the session names none."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named is None:
        named = tempfile.mkdtemp(prefix="checkpoints-")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


#: Bytes of a row group of a written table: what a writing task holds back.
ROW_GROUP = 16 << 20


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, most: int | None):
    """Within it, at most `most` rows go to Python at a time (no fewer than the session asks for already)."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if most and not 0 < int(before) <= most:
        spark.conf.set(name, most)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def materialise(df: DataFrame, most_rows: int | None = None) -> DataFrame:
    """df written to the shared checkpoint folder and read back: its lineage ends, lost executors cost nothing.

    Rows that carry long texts take `most_rows`, the rows that go to Python at a time meanwhile.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/table-{uuid.uuid4().hex}"
    with arrow_rows(spark, most_rows):
        df.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._materialised_path = path
    _written.append((spark, path))
    return out


#: Share of the executors' memory that `auto` fills before it turns to the shared folder.
AUTO_SHARE = 0.3


def keep(df: DataFrame, mode: str = "auto", size: int = 0) -> DataFrame:
    """df computed once: in memory (`ram`), as a table in the shared folder (`disk`), or in memory where its `size` in bytes is at most AUTO_SHARE of all executors' (`auto`)."""
    if mode not in ("ram", "disk", "auto"):
        raise ValueError("mode must be ram, disk or auto")
    if mode == "auto":
        status = df.sparkSession._jsc.sc().getExecutorMemoryStatus().values().iterator()
        room = 0
        while status.hasNext():
            room += status.next()._1()
        mode = "ram" if size <= AUTO_SHARE * room else "disk"
    if mode == "disk":
        return materialise(df)
    out = df.persist(StorageLevel.MEMORY_AND_DISK)
    out.count()
    return out


_written: list[tuple[SparkSession, str]] = []


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clean_up() -> None:
    """When the application ends, the tables that it wrote go."""
    for spark, path in _written:
        with contextlib.suppress(Exception):  # the JVM may be gone already
            _delete(spark, path)


def discard(df: DataFrame | None) -> None:
    """Delete what materialise() wrote, once no later job reads it."""
    path = getattr(df, "_materialised_path", None)
    if path:
        _delete(df.sparkSession, path)


def bounded_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most max_rows rows, else df as it is (the join then shuffles).

    Pass a materialised table of narrow rows, so that counting reads metadata only.
    """
    return F.broadcast(df) if df.count() <= max_rows else df


def hot_limit(small: DataFrame, size: str) -> int | None:
    """Rows above which a key of small counts as hot; None if no key does."""
    total, most = small.agg(F.sum(size), F.max(size)).first()
    limit = max(HOT_ROWS, (total or 0) // HOT_KEYS)
    return limit if (most or 0) > limit else None


def join_by_key(big: DataFrame, small: DataFrame, key: str | list[str], size: str, limit: int | None = -1) -> DataFrame:
    """big joined with small, which has one row a key and in `size` the number of big's rows with that key.

    Hot keys, at most HOT_KEYS by their definition, come to their rows by a broadcast, so that no task gets
    all rows of one; the others meet by a shuffle. Pass materialised tables: both are read twice. `limit` is
    hot_limit() of small, if known.
    """
    key = [key] if isinstance(key, str) else key
    limit = hot_limit(small, size) if limit == -1 else limit
    if limit is None:
        return big.join(small, key)
    hot = small.where(F.col(size) > limit)
    rest = big.join(F.broadcast(hot.select(*key)), key, "left_anti").join(small.where(F.col(size) <= limit), key)
    return big.join(F.broadcast(hot), key).unionByName(rest)
