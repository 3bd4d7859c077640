"""Video files as frames in order, and frames as video files; containers are pluggable (codecs.DECODERS, codecs.VIDEO_ENCODERS)."""

from __future__ import annotations

import itertools

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import specs as s
from ..operators.raster import IMAGE, image_of, pixels, small_batches
from . import codecs, files

FRAMES = f"path string, frame_index bigint, fps double, image {IMAGE}"
#: Bytes of frames that a decoding task holds.
HELD = 16 << 20


def open_video(path: str, data: bytes) -> codecs.Video:
    decode = codecs.DECODERS.get(codecs.suffix(path))
    if decode is None:
        raise RuntimeError(f"Cannot open video: {path}: no decoder for this container")
    try:
        return decode(data)
    except Exception as e:
        raise RuntimeError(f"Cannot open video: {path}") from e


def read_videos(spark: SparkSession, paths: str | list[str], recursive: bool = True) -> DataFrame:
    """path, frame_index (from 0), fps, image of all frames of all video files; a file is decoded by one task, frame by frame."""
    small_batches(spark)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(paths)
    path = F.regexp_replace("path", "^file:/+", "/").alias("path")

    def run(batches):
        for b in batches:
            for path, data in zip(b["path"], b["content"], strict=True):
                video = open_video(path, data)
                rows, size = [], 0
                for n, frame in enumerate(video.frames):
                    rows.append((path, n, video.fps or codecs.FPS, image_of(frame, path)))
                    size += frame.size
                    if size >= HELD:
                        yield pd.DataFrame(rows, columns=["path", "frame_index", "fps", "image"])
                        rows, size = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=["path", "frame_index", "fps", "image"])

    return found.where(s.file_type(F.col("path")) == "video").select(path, "content").mapInPandas(run, FRAMES)


def frame_totals(spark: SparkSession, paths: str | list[str], recursive: bool = True) -> DataFrame:
    """path, frames: as many as the container says, null if it doesn't or can't be read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(paths)

    def run(batches):
        for b in batches:
            totals = []
            for path, data in zip(b["path"], b["content"], strict=True):
                try:
                    totals.append(open_video(path, data).count)
                except RuntimeError:
                    totals.append(None)
            yield pd.DataFrame({"path": b["path"], "frames": pd.array(totals, "Int64")})

    return found.where(s.file_type(F.col("path")) == "video").select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "content").mapInPandas(run, "path string, frames bigint")


def write_videos(frames: DataFrame, keep_sound: bool = False) -> DataFrame:
    """out_path, frames of each video, written when this is evaluated, of frames(path, out_path, frame_index, fps, image).

    A video's frames meet in one task, sorted by Spark and so spilled if they are many, and pass through it one by one.
    """
    small_batches(frames.sparkSession)
    dealt = frames.select("out_path", "frame_index", "path", "fps", "image").repartition("out_path").sortWithinPartitions("out_path", "frame_index")

    def run(batches):
        rows = (row for b in batches for row in b.itertuples(index=False))
        for out_path, of_video in itertools.groupby(rows, key=lambda r: r.out_path):
            first = next(of_video)
            encode = codecs.VIDEO_ENCODERS.get(codecs.suffix(out_path))
            if encode is None:
                raise ValueError(f"no encoder for {out_path}; there are those of {', '.join(codecs.VIDEO_ENCODERS)}")
            sound = open_video(first.path, files.read_file(first.path)).sound if keep_sound else []
            video = codecs.Video(first.fps, None, (pixels(r.image) for r in itertools.chain([first], of_video)), sound)
            count = []
            files.write_file(out_path, lambda f: count.append(encode(f, video, first.image["width"], first.image["height"])))  # noqa: B023
            yield pd.DataFrame({"out_path": [out_path], "frames": count})

    return dealt.mapInPandas(run, "out_path string, frames bigint")
