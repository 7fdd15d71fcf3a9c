import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints"))).config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse"))).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def sf_dir():
    return SF


def as_pixels(spark, rows, name="label"):
    """A raster given as rows of numbers, as (x, y, label)."""
    return spark.createDataFrame([(x, y, int(v)) for y, row in enumerate(rows) for x, v in enumerate(row)], f"x int, y int, {name} long")


def as_rows(df, name="label"):
    """The rows of numbers of a long raster."""
    got = {(r["x"], r["y"]): r[name] for r in df.collect()}
    w, h = max(x for x, _ in got) + 1, max(y for _, y in got) + 1
    return [[got[x, y] for x in range(w)] for y in range(h)]
