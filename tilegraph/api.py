"""Entry points: segment an image with a Config, or with options by their flat names."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .config import Config, load
from .operators.multipass import Proposer
from .plans.pipeline import Pipeline, Result


def segment(spark: SparkSession, path: str, out: str, config: Config | str | None = None, checkpoint: str | None = None, proposer: Proposer | None = None) -> Result:
    """Segment the image at `path` into the folder `out`. config is a Config or a YAML file; a Config passed in is never changed."""
    config = load(config) if isinstance(config, str) else config or Config()
    if checkpoint is not None:
        config = config.with_overrides(checkpoint=checkpoint)
    return Pipeline(config, proposer).run(spark, path, out)


def segment_with(spark: SparkSession, path: str, out: str, proposer: Proposer | None = None, **options) -> Result:
    """segment() with options by flat name, such as tile_size=500 or merge_strategy="mutual_best"."""
    return Pipeline(Config().with_overrides(**options), proposer).run(spark, path, out)
