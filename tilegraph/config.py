"""Options: frozen groups with defaults, validation, YAML, presets and flat overrides.

Names and defaults of the options are fixed values: configurations written for them must keep their meaning.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, fields, replace

UNSET = object()


@dataclass(frozen=True)
class Tile:
    size: int = 1000
    padding: int = 50
    edge: str = "whole"

    @property
    def padded_size(self) -> int:
        return self.size + 2 * self.padding


@dataclass(frozen=True)
class Threshold:
    iou_start: float = 0.93
    iou_end: float = 0.60
    stability_start: float = 0.93
    stability_end: float = 0.60
    step: float = 0.01

    def for_pass(self, index: int) -> tuple[float, float]:
        """(iou, stability) of a schedule that falls with every pass."""
        return max(self.iou_end, self.iou_start - index * self.step), max(self.stability_end, self.stability_start - index * self.step)


@dataclass(frozen=True)
class Segmentation:
    points_per_side: int = 64
    target_coverage: float = 99.0
    max_passes: int | None = None
    use_black_mask: bool = True
    use_adaptive_threshold: bool = True
    point_strategy: str = "kmeans"
    erosion_iterations: int = 0
    crop_n_layers: int = 0
    box_nms_thresh: float = 0.7
    sort_by_area: bool = False


@dataclass(frozen=True)
class Merge:
    merge_strategy: str = "best_match"
    min_contact_pixels: int = 20
    min_mask_area: int = 100
    merge_enclosed_max_area: int = 500
    connectivity: str = "foreground"


@dataclass(frozen=True)
class Output:
    save_labels: bool = True
    save_shapefile: bool = True
    save_geopackage: bool = False
    save_stats: bool = True
    save_preview: bool = False
    simplify_tolerance: float = 1.0
    streaming_mode: str = "auto"


@dataclass(frozen=True)
class Config:
    tile: Tile = field(default_factory=Tile)
    threshold: Threshold = field(default_factory=Threshold)
    segmentation: Segmentation = field(default_factory=Segmentation)
    merge: Merge = field(default_factory=Merge)
    output: Output = field(default_factory=Output)
    checkpoint: str | None = None

    def validate(self) -> Config:
        """self, or a ValueError that names the first option out of range."""
        t, h, s, m, o = self.tile, self.threshold, self.segmentation, self.merge, self.output
        rules = [
            (t.size > 0, "tile.size must be positive"),
            (t.padding >= 0, "tile.padding must not be negative"),
            (t.edge in ("whole", "cover"), "tile.edge must be whole or cover"),
            (0 < h.iou_end <= h.iou_start <= 1, "threshold.iou_end and iou_start must rise within (0, 1]"),
            (0 < h.stability_end <= h.stability_start <= 1, "threshold.stability_end and stability_start must rise within (0, 1]"),
            (h.step > 0, "threshold.step must be positive"),
            (s.points_per_side > 0, "segmentation.points_per_side must be positive"),
            (0 < s.target_coverage <= 100, "segmentation.target_coverage must lie in (0, 100]"),
            (s.max_passes is None or s.max_passes > 0, "segmentation.max_passes must be positive"),
            (s.point_strategy in ("kmeans", "dense_grid"), "segmentation.point_strategy must be kmeans or dense_grid"),
            (s.erosion_iterations >= 0, "segmentation.erosion_iterations must not be negative"),
            (s.crop_n_layers >= 0, "segmentation.crop_n_layers must not be negative"),
            (0 < s.box_nms_thresh <= 1, "segmentation.box_nms_thresh must lie in (0, 1]"),
            (m.merge_strategy in ("best_match", "mutual_best", "min_contact", "none"), "merge.merge_strategy is unknown"),
            (m.min_contact_pixels > 0, "merge.min_contact_pixels must be positive"),
            (m.min_mask_area >= 0, "merge.min_mask_area must not be negative"),
            (m.merge_enclosed_max_area >= 0, "merge.merge_enclosed_max_area must not be negative"),
            (m.connectivity in ("foreground", "per_label"), "merge.connectivity must be foreground or per_label"),
            (o.simplify_tolerance >= 0, "output.simplify_tolerance must not be negative"),
            (o.streaming_mode in ("auto", "ram", "disk"), "output.streaming_mode must be auto, ram or disk"),
        ]
        for ok, message in rules:
            if not ok:
                raise ValueError(message)
        return self

    def with_overrides(self, **flat) -> Config:
        """A copy with options given by their flat names; UNSET leaves one as it is, None sets it to None."""
        groups = {g: getattr(self, g) for g in GROUPS}
        checkpoint = self.checkpoint
        for name, value in flat.items():
            if name not in FLAT:
                raise ValueError(f"unknown option {name}")
            if value is UNSET:
                continue
            group, key = FLAT[name]
            if group is None:
                checkpoint = value
            else:
                groups[group] = replace(groups[group], **{key: value})
        return replace(self, **groups, checkpoint=checkpoint)


GROUPS = {"tile": Tile, "threshold": Threshold, "segmentation": Segmentation, "merge": Merge, "output": Output}
#: Flat option name to (group, key).
FLAT: dict[str, tuple[str | None, str]] = {
    **{f"tile_{f.name}" if f.name != "padding" else "padding": ("tile", f.name) for f in fields(Tile)},
    **{("threshold_step" if f.name == "step" else f.name): ("threshold", f.name) for f in fields(Threshold)},
    **{f.name: (g, f.name) for g, c in (("segmentation", Segmentation), ("merge", Merge), ("output", Output)) for f in fields(c)},
    "checkpoint": (None, "checkpoint"),
}


#: Options that make a configuration of their own, by name: one pass with a coarse grid, no padding, no merging.
PRESETS: dict[str, dict] = {
    "single_pass": {"points_per_side": 32, "iou_start": 0.88, "iou_end": 0.88, "stability_start": 0.95, "stability_end": 0.95, "padding": 0, "merge_strategy": "none", "max_passes": 1, "use_adaptive_threshold": False},
}


def preset(name: str) -> Config:
    """The defaults with the options of a preset."""
    if name not in PRESETS:
        raise ValueError(f"unknown preset {name}; known are {', '.join(PRESETS)}")
    return Config().with_overrides(**PRESETS[name])


def from_dict(data: dict | None) -> Config:
    """A Config from nested options; absent ones keep their defaults, unknown ones are an error."""
    data = dict(data or {})
    checkpoint = data.pop("checkpoint", None)
    parts = {}
    for group, values in data.items():
        if group not in GROUPS:
            raise ValueError(f"unknown option group {group}")
        unknown = set(values or {}) - {f.name for f in fields(GROUPS[group])}
        if unknown:
            raise ValueError(f"unknown options in {group}: {', '.join(sorted(unknown))}")
        parts[group] = GROUPS[group](**(values or {}))
    return Config(**parts, checkpoint=checkpoint)


def load(path: str) -> Config:
    """A Config from a YAML file; an empty file gives the defaults."""
    import yaml

    with open(path, encoding="utf-8") as f:
        return from_dict(yaml.safe_load(f))


def save(config: Config, path: str) -> None:
    """All options of a Config as YAML that load() reads back."""
    import yaml

    with open(path, "w", encoding="utf-8") as f:
        yaml.safe_dump(asdict(config), f, sort_keys=False)
