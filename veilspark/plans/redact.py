"""Redaction as one plan: scan, detect, order, paint, write."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import specs as s
from ..operators.raster import MODES, SHAPES, mask_frames
from .specs import polygons_of

#: frames(path[, frame_index], image) -> regions(path[, frame_index], ord, polygon, score)
Detector = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Options:
    """What is looked for and how it is painted.  faces and text are detectors; regions are texts that name fixed places."""

    face: Detector | None = None
    text: Detector | None = None
    regions: list[str] = field(default_factory=list)
    mask: str = "mosaic"
    shape: str = "polygon"
    scale: float = 1.3
    mosaic_size: int = 20
    colour: tuple[int, int, int] = (0, 0, 0)

    def __post_init__(self):
        if not (self.face or self.text or self.regions):
            raise ValueError("at least one of face, regions, bands and text must be enabled")
        if self.mask not in MODES or self.shape not in SHAPES:
            raise ValueError(f"unknown mask: {self.mask} {self.shape}")


def fixed(frames: DataFrame, specs: list[str]) -> Column:
    """The fixed regions that lie inside a frame, as an array of literals."""
    rows = [F.struct(F.lit(1).alias("stage"), F.lit(n).alias("ord"), F.lit(1.0).alias("factor"), F.array(*[g.point(F.lit(x), F.lit(y)) for x, y in polygon]).alias("polygon")) for n, polygon in enumerate(polygons_of(frames.sparkSession, specs))]
    return F.filter(F.array(*rows), lambda x: g.fully_inside(x["polygon"], F.col("image.width"), F.col("image.height")))


def detected(frames: DataFrame, detector: Detector, name: str, by: list[str]) -> DataFrame:
    """frames with a column of what a detector finds: its own, or a table of regions joined by key."""
    if hasattr(detector, "attach"):
        return detector.attach(frames, name)
    lists = detector(frames).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("ord", "polygon"))).alias(name))
    return frames.join(lists, by, "left")


def redact(frames: DataFrame, o: Options) -> DataFrame:
    """frames(path[, frame_index], image, ...) with everything found painted over: faces, which alone are scaled, then fixed regions, then text.

    Detectors see frames before anything is painted.  Those of this package add
    columns to the frames, so all is one pass without a join or a shuffle.
    """
    by, out, parts = [c for c in ("path", "frame_index") if c in frames.columns], frames, []
    staged = lambda name, stage, factor: F.transform(F.coalesce(F.col(name), F.array()), lambda x: F.struct(F.lit(stage).alias("stage"), x["ord"].alias("ord"), F.lit(float(factor)).alias("factor"), x["polygon"].alias("polygon")))
    if o.face:
        out = detected(out, o.face, "_face", by)
        parts.append(staged("_face", 0, o.scale))
    if o.regions:
        parts.append(fixed(frames, o.regions))
    if o.text:
        out = detected(out, o.text, "_text", by)
        parts.append(staged("_text", 2, 1.0))
    return mask_frames(out, F.concat(*parts), by, o.mask, o.shape, o.mosaic_size, o.colour).select(*frames.columns)


def with_outputs(frames: DataFrame, root: str, out: str) -> DataFrame:
    return frames.withColumn("out_path", s.output_path(F.col("path"), root, out))
