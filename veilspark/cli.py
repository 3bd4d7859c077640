"""The command line: python -m veilspark INPUT --osd-region 0,0,640,40 ..."""

from __future__ import annotations

import argparse
import logging
import sys

from . import __version__

LEVELS = ["DEBUG", "INFO", "WARNING", "ERROR"]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="veilspark", description="Redact faces, fixed regions and text in images and videos.")
    add = p.add_argument
    add("input", help="an image, a video or a folder")
    add("-o", "--output", help="folder for results; by default output_redact in the working folder")
    add("-r", "--recursive", action=argparse.BooleanOptionalAction, default=True, help="look into subfolders")
    add("--face", action="store_true", help="redact faces")
    add("--face-threshold", type=float, default=0.3)
    add("--osd-region", action="append", help="x1,y1,x2,y2 or x,y;x,y;x,y...; may be repeated")
    add("--osd-band", action="append", help="top:0.1, bottom:0.1, left:0.1 or right:0.1: redact text there; may be repeated")
    add("--osd-text", action="append", help="regular expression of text to redact; may be repeated")
    add("--osd-text-threshold", type=float, default=0.3)
    add("--osd-text-box-threshold", type=float, default=0.5)
    add("--osd-text-rec-threshold", type=float, default=0.0)
    add("--osd-text-model-size", choices=["tiny", "small", "medium"], default="small")
    add("--mask", choices=["blur", "mosaic", "solid", "none"], default="mosaic")
    add("--mask-shape", choices=["ellipse", "polygon"], default="polygon")
    add("--mask-scale", type=float, default=1.3, help="of faces")
    add("--mosaic-size", type=int, default=20)
    add("--keep-audio", action="store_true")
    add("--device", choices=["auto", "cpu", "cuda"], default="auto")
    add("--num-worker", type=int, help="tasks at once; by default as many as Spark deals out")
    add("--disable-progress", action="store_true")
    add("--log-level", choices=LEVELS, default="INFO", type=str.upper)
    add("--version", action="version", version=__version__)
    return p


def main(argv: list[str] | None = None) -> int:
    args = vars(parser().parse_args(argv))
    log = logging.getLogger("veilspark")
    logging.basicConfig(stream=sys.stderr, format="%(levelname)s %(message)s")
    log.setLevel(args.pop("log_level"))
    named = {"osd_regions": args.pop("osd_region"), "osd_bands": args.pop("osd_band")}
    if not (args["face"] or args["osd_text"] or any(named.values())):
        log.error("give --face, --osd-region, --osd-band or --osd-text")
        return 1
    from pyspark.sql import SparkSession

    from . import api
    from .sources import files

    spark = SparkSession.builder.appName("veilspark").getOrCreate()
    try:
        source = files.resolve_input(args.pop("input"))
        done = api.redact_any(spark, source, files.resolve_output(args.pop("output")), **named, **args)
    except (ValueError, FileNotFoundError, RuntimeError) as e:
        log.error("%s", e)
        return 1
    log.info("Output file: %s" if len(done) == 1 else "Processed %s file(s)", done[0] if len(done) == 1 else len(done))
    return 0
