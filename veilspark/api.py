"""Images and videos in, redacted ones out: the functions behind the command line."""

from __future__ import annotations

import logging
import os
from collections.abc import Iterable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from . import models
from .functions import specs as s
from .operators import faces, text
from .plans import redact as plan
from .plans.specs import band_of
from .sources import codecs, files, images, videos

LOG = logging.getLogger("veilspark")
#: As many tasks at once as a small machine bears.
WORKERS = max(1, min(4, os.cpu_count() or 1))


def options(
    spark: SparkSession, *, face: bool | plan.Detector = False, face_threshold: float = 0.3, osd_regions: list[str] | None = None, osd_bands: list[str] | None = None, osd_text: list[str] | None = None,
    osd_text_threshold: float = 0.3, osd_text_box_threshold: float = 0.5, osd_text_rec_threshold: float = 0.0, osd_text_model_size: str = "small", mask: str = "mosaic", mask_shape: str = "polygon",
    mask_scale: float = 1.3, mosaic_size: int = 20, solid_color: tuple[int, int, int] = (0, 0, 0), image_format: str = "rgb", device: str | None = "auto", text_models: tuple | None = None,
) -> plan.Options:
    """The plan's options; only models that are asked for are looked for.

    face may be a detector of one's own; text_models (detector, recogniser, characters)
    stand in for model files.  Bands alone need no recogniser.
    """
    models.device_of(device)
    s.check_patterns(osd_text or [])
    bands = [band_of(spark, b) for b in osd_bands or []]
    if not (face or osd_regions or osd_text or bands):
        raise ValueError("at least one of face, regions, bands and text must be enabled")
    detector = face if callable(face) else None
    if face is True:
        path = models.ensure(models.face_asset())
        width, height = models.input_size(models.session(path, "face detection", device), path)
        detector = faces.face_detector(models.runner(path, "face detection", device), width, height, face_threshold, image_format)
    reader = None
    if osd_text or bands:
        if text_models is None:
            paths = [models.ensure(a) for a in models.text_assets(osd_text_model_size, bool(osd_text))]
            runs = [models.first_output(models.runner(p, "text", device)) for p in paths[:2]]
            text_models = (runs[0], runs[1], text.read_characters(open(paths[2], encoding="utf-8").readlines())) if osd_text else (runs[0], None, None)
        reader = text.text_detector(text_models[0], text_models[1], text_models[2], bands, osd_text, osd_text_threshold, osd_text_box_threshold, osd_text_rec_threshold)
    return plan.Options(detector, reader, list(osd_regions or []), mask, mask_shape, mask_scale, mosaic_size, solid_color)


def _bounded(frames: DataFrame, num_worker: int | None) -> DataFrame:
    """At most num_worker tasks at once; none: as many as Spark deals out."""
    return frames if num_worker is None else frames.coalesce(max(1, num_worker))


def _run(written: DataFrame, label: str, disable_progress: bool) -> list[str]:
    """Evaluates the sink; the paths of what was written.  Counts come from the same pass."""
    seen = Observation(f"redacted {label}")
    out = [row["out_path"] for row in written.observe(seen, F.count(F.lit(1)).alias("files")).select("out_path").collect()]
    if not disable_progress:
        LOG.info("Completed %d %s", seen.get["files"], label)
    return sorted(out, key=lambda p: p.split("/"))


def redact_image(spark: SparkSession, input, output=None, *, recursive: bool = True, num_worker: int | None = None, disable_progress: bool = False, **how) -> list[str]:
    """Redacts images (a file, a folder, or several) into the same places under output, in the format of their extension; returns where."""
    o = options(spark, **how)
    found, root, _ = files.collect_files(spark, input, "image", recursive)
    outputs = plan.with_outputs(found, root, files.resolve_output(output))
    images.check_encoders(outputs)
    frames = images.read_images(spark, files.inputs_of(input), recursive)
    return _run(images.write_images(plan.with_outputs(plan.redact(_bounded(frames, num_worker), o), root, files.resolve_output(output))), "images", disable_progress)


def redact_video(spark: SparkSession, input, output=None, *, recursive: bool = True, keep_audio: bool = False, num_worker: int | None = None, disable_progress: bool = False, **how) -> list[str]:
    """The same of videos, frames in order, at their rate; keep_audio copies the sound."""
    o = options(spark, **how)
    found, root, _ = files.collect_files(spark, input, "video", recursive)
    known = F.lower(F.regexp_extract("path", r"[^/](\.[^./]+)$", 1))
    bad = found.where(~known.isin(list(codecs.DECODERS))).limit(1).collect()
    if bad:
        raise RuntimeError(f"Cannot open video: {bad[0]['path']}: no decoder for this container")
    frames = videos.read_videos(spark, files.inputs_of(input), recursive)
    done = plan.with_outputs(plan.redact(_bounded(frames, num_worker), o), root, files.resolve_output(output))
    return _run(videos.write_videos(done, keep_audio), "videos", disable_progress)


def redact_folder(spark: SparkSession, input, output=None, *, keep_audio: bool = False, **how) -> list[str]:
    """Images, then videos, of a folder; it need not hold both."""
    done: list[str] = []
    for work, kind, more in ((redact_image, "images", {}), (redact_video, "videos", {"keep_audio": keep_audio})):
        try:
            done += work(spark, input, output, **more, **how)
        except FileNotFoundError as e:
            if str(e) != f"No {kind} found in the given inputs.":
                raise
    if not done:
        raise FileNotFoundError(f"No images or videos found in: {input}")
    return done


def redact_any(spark: SparkSession, input: str | os.PathLike | Iterable, output=None, *, keep_audio: bool = False, **how) -> list[str]:
    """By what the input is: a folder, an image or a video."""
    paths = files.inputs_of(input)
    if len(paths) == 1 and "://" not in paths[0] and os.path.isfile(paths[0]):
        kind = spark.range(1).select(s.file_type(F.lit(paths[0])).alias("k")).first()["k"]
        if kind == "image":
            return redact_image(spark, paths, output, **how)
        if kind == "video":
            return redact_video(spark, paths, output, keep_audio=keep_audio, **how)
        raise ValueError(f"Unsupported file type: {paths[0]}")
    return redact_folder(spark, input, output, keep_audio=keep_audio, **how)
