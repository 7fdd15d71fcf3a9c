"""Command line: python -m tilegraph.cli image.tif out/ [--config FILE] [options]."""

from __future__ import annotations

import argparse
import logging
import os
import sys
import traceback
import types
import typing
from dataclasses import fields

from . import config as options


def parser() -> argparse.ArgumentParser:
    """A flag for every option, named after it."""
    p = argparse.ArgumentParser(prog="tilegraph", description="Segment a large raster by tiles on Spark.")
    p.add_argument("input")
    p.add_argument("output")
    p.add_argument("--config", help="YAML file of options; flags override it")
    p.add_argument("--preset", choices=sorted(options.PRESETS), help="options to start from, if no file is given")
    p.add_argument("--checkpoint", default=options.UNSET, help="name of a proposer, or module:maker")
    for flat, (group, key) in options.FLAT.items():
        if group is None:
            continue
        cls = options.GROUPS[group]
        kind = typing.get_type_hints(cls)[key]
        default = next(f.default for f in fields(cls) if f.name == key)
        flag = "--" + flat.replace("_", "-")
        if kind is bool:
            p.add_argument(flag, dest=flat, action=argparse.BooleanOptionalAction, default=options.UNSET, help=f"default {default}")
            continue
        optional = isinstance(kind, types.UnionType)
        base = next(t for t in typing.get_args(kind) if t is not type(None)) if optional else kind
        read = (lambda text, base=base: None if text.lower() == "none" else base(text)) if optional else base
        p.add_argument(flag, dest=flat, type=read, default=options.UNSET, help=f"default {default}")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    debug = os.environ.get("TILEGRAPH_DEBUG", "").lower() in ("1", "true", "yes")
    if debug:
        logging.basicConfig(level=logging.DEBUG)
    try:
        from pyspark.sql import SparkSession

        from .api import segment

        base = options.load(args.config) if args.config else options.preset(args.preset) if args.preset else options.Config()
        chosen = base.with_overrides(**{k: v for k, v in vars(args).items() if k in options.FLAT})
        result = segment(SparkSession.builder.getOrCreate(), args.input, args.output, chosen)
    except Exception as e:
        print(f"error: {e}", file=sys.stderr)
        if debug:
            traceback.print_exc()
        return 1
    print(f"{result.n_segments} segments, coverage {result.coverage} %, {result.t_total:.1f} s")
    for path in (result.labels_path, result.shapefile_path, result.geopackage_path, result.stats_path):
        if path:
            print(path)
    return 0


if __name__ == "__main__":
    sys.exit(main())
