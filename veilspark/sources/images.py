"""Image files as frames, and frames as image files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import specs as s
from ..operators.raster import IMAGE, pixels, small_batches
from . import codecs, files


def read_images(spark: SparkSession, paths: str | list[str], recursive: bool = True) -> DataFrame:
    """path, image of all image files under folders, or of files; one that can't be decoded raises when it is read."""
    found = spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", recursive).load(paths)
    path = F.regexp_replace("image.origin", "^file:/+", "/")
    found = found.where(s.file_type(path) == "image").select(path.alias("path"), "image")
    broken = F.raise_error(F.concat(F.lit("cannot decode image: "), F.col("path"))).cast(IMAGE)
    return found.withColumn("image", F.when(F.col("image.height") > 0, F.col("image")).otherwise(broken))


def stream_images(spark: SparkSession, path: str) -> DataFrame:
    """The same of a folder that grows, as a stream."""
    found = spark.readStream.format("image").schema(f"image {IMAGE}").load(path)
    return found.select(F.regexp_replace("image.origin", "^file:/+", "/").alias("path"), "image")


def check_encoders(paths: DataFrame) -> None:
    """ValueError if an output's extension has no encoder, before any frame is read."""
    known = F.regexp_extract("out_path", r"[^/](\.[^./]+)$", 1)
    bad = paths.where(~F.lower(known).isin(list(codecs.ENCODERS))).limit(1).collect()
    if bad:
        raise ValueError(f"no encoder for {bad[0]['out_path']}; there are those of {', '.join(codecs.ENCODERS)}")


def encoded(frames: DataFrame) -> DataFrame:
    """out_path and content, in the format of its extension, of frames(out_path, image)."""

    def run(batches):
        for b in batches:
            content = [codecs.ENCODERS[codecs.suffix(p)](pixels(x)) for p, x in zip(b["out_path"], b["image"], strict=True)]
            yield b[["out_path"]].assign(content=content)

    return frames.select("out_path", "image").mapInPandas(run, "out_path string, content binary")


def write_images(frames: DataFrame) -> DataFrame:
    """out_path of each file, written when this is evaluated, of frames(out_path, image)."""
    small_batches(frames.sparkSession)

    def run(batches):
        for b in batches:
            for path, image in zip(b["out_path"], b["image"], strict=True):
                data = codecs.ENCODERS[codecs.suffix(path)](pixels(image))
                files.write_file(path, lambda f: f.write(data))  # noqa: B023
            yield b[["out_path"]]

    return frames.select("out_path", "image").mapInPandas(run, "out_path string")
