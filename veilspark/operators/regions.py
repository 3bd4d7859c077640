"""Operators on tables of frames and regions."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import detections as d
from ..functions import geometry as g
from ..functions import specs as s


def in_bands(regions: DataFrame, bands: list[tuple[str, float]], width: Column, height: Column) -> DataFrame:
    """Regions whose centre is in one of the bands at least; without bands, all."""
    keep = F.lit(not bands)
    for name, ratio in bands:
        keep = keep | s.in_band(F.col("polygon"), F.lit(name), F.lit(ratio), width, height)
    return regions.where(keep)


def fixed_regions(frames: DataFrame, specs: list[str]) -> DataFrame:
    """A row for each frame and each of the regions named that lies inside it; a malformed text raises ValueError.

    The regions are a literal array exploded per frame, so frames aren't shuffled.
    """
    from ..plans.specs import polygons_of

    polygons = polygons_of(frames.sparkSession, specs)
    rows = F.array(*[F.struct(F.lit(n).alias("ord"), F.lit(f"region_{n}").alias("label"), F.lit(1.0).alias("score"), F.array(*[g.point(F.lit(x), F.lit(y)) for x, y in p]).alias("polygon")) for n, p in enumerate(polygons)])
    if not specs:
        return frames.select("*", F.lit(0).alias("ord"), F.lit("").alias("label"), F.lit(1.0).alias("score"), F.array(g.point(F.lit(0), F.lit(0))).alias("polygon")).limit(0)
    out = frames.select("*", F.explode(rows).alias("r")).select(*frames.columns, "r.*")
    return out.where(g.fully_inside(F.col("polygon"), F.col("width"), F.col("height")))


def suppress(boxes: DataFrame, top: int | None = d.NMS_TOP) -> DataFrame:
    """Greedy suppression in each frame, by falling score; ties by all other fields."""
    row = F.struct((-F.col("score")).alias("s"), "id", "x", "y", "w", "h")
    kept = boxes.groupBy("frame").agg(d.suppress(F.collect_list(row), top=top).alias("kept"))
    return kept.select("frame", F.explode("kept").alias("k")).select("frame", "k.id", "k.x", "k.y", "k.w", "k.h", (-F.col("k.s")).alias("score"))


def union_stages(stages: dict[int, DataFrame]) -> DataFrame:
    """All regions of all detectors with their stage; nothing is merged."""
    out = None
    for n, df in sorted(stages.items()):
        df = df.withColumn("stage", F.lit(n))
        out = df if out is None else out.unionByName(df)
    return out


def ordered(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """A row for each group with its rows in order, as array of structs."""
    return rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*order))).alias("regions"))


def sequenced(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The rows, each group's in one partition and in order there: what ordered() says, without holding a group."""
    return rows.repartition(*by).sortWithinPartitions(*by, *order)


def placed(rows: DataFrame, results: DataFrame, by: list[str]) -> DataFrame:
    """Rows with the results (one for each place) of those that have any, by their places; '' and 0 for the rest, which stay where they are.

    Unknown parts of a place are as good as known ones, and results are kept as they are, unknown ones too.
    """
    results = results.select(F.struct(*by).alias("_place"), F.struct("text", "rec_score").alias("_result"))
    out = rows.join(results, reduce(and_, [F.col(f"_place.{c}").eqNullSafe(rows[c]) for c in by]), "left")
    read = lambda name, none: F.when(F.col("_result").isNull(), F.lit(none)).otherwise(F.col(f"_result.{name}")).alias(name)
    return out.select(*rows.columns, read("text", ""), read("rec_score", 0.0))


def zipped(left: Column, right: Column, strict: bool = True) -> Column:
    """Elements of two arrays by place, as array<struct<a, b>>: of equal lengths (else an error), or as far as the shorter goes."""
    n = F.least(F.size(left), F.size(right))
    pairs = F.transform(F.slice(left, F.lit(1), n), lambda x, i: F.struct(x.alias("a"), F.get(right, i).alias("b")))
    return F.when(F.size(left) == F.size(right), pairs).otherwise(F.raise_error(F.lit("arrays of different lengths"))) if strict else pairs


def frame_at(frames: DataFrame, index: int | None = None, seconds: float | None = None, fps: float = 25.0) -> DataFrame:
    """The frame of each medium at a time or, if none is given, an index; before the start counts as the start."""
    at = int(max(0.0, seconds) * fps) if seconds is not None else max(0, index or 0)
    return frames.where(F.col("frame_index") == at)


def common_path(folders: list[str]) -> str:
    """The longest path of whole components that some folders share."""
    parts = [f.split("/") for f in folders]
    n = next((i for i, same in enumerate(zip(*parts, strict=False)) if len(set(same)) > 1), min(map(len, parts), default=0))
    if not n:
        raise ValueError(f"no common root: {folders}")
    return "/".join(parts[0][:n]) or "/"


def common_root(paths: DataFrame, by: str, path: str) -> DataFrame:
    """The longest path of whole components that a group's folders share: those of its first and last path in order."""
    parts = lambda p: F.split(p, "/")
    folder = F.regexp_replace(path, "/[^/]*$", "")
    ends = paths.groupBy(by).agg(F.min(parts(folder)).alias("a"), F.max(parts(folder)).alias("b"))
    same = F.zip_with("a", "b", lambda x, y: F.coalesce(x == y, F.lit(False)))
    n = F.when(F.array_position(same, F.lit(False)) > 0, (F.array_position(same, F.lit(False)) - 1).cast("int")).otherwise(F.size("a"))
    return ends.select(by, F.array_join(F.slice("a", F.lit(1), n), "/").alias("root"))
