"""Tiled raster label analytics on Spark: every operator is a DataFrame program."""
