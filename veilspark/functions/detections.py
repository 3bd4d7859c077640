"""Decoding of model outputs, suppression of overlaps and size arithmetic, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

#: Fixed values of the detectors.
NMS_IOU, NMS_TOP = 0.3, 300
DET_SIDE, DET_STEP = 736, 32
REC_HEIGHT, REC_WIDTH, REC_BATCH = 48, 320, 8


def best_class(scores: Column) -> Column:
    """struct(score, cls): the largest score and its first place."""
    top = F.array_max(scores)
    return F.struct(top.alias("score"), (F.array_position(scores, top) - 1).cast("int").alias("cls"))


def iou(a: Column, b: Column) -> Column:
    """Of structs with x, y, w, h."""
    w = F.greatest(F.lit(0), F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"]))
    h = F.greatest(F.lit(0), F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"]))
    both = (w * h).cast("double")
    return both / (a["w"] * a["h"] + b["w"] * b["h"] - both)


def suppress(boxes: Column, limit: float = NMS_IOU, top: int | None = NMS_TOP) -> Column:
    """Greedy suppression over an array of structs that begins with the sort key (smallest first) and holds x, y, w, h."""
    ranked = F.array_sort(boxes)
    ranked = F.slice(ranked, 1, top) if top else ranked
    return F.aggregate(ranked, F.slice(ranked, 1, 0), lambda kept, b: F.when(F.exists(kept, lambda k: iou(k, b) > limit), kept).otherwise(F.concat(kept, F.array(b))))


def ctc(steps: Column) -> Column:
    """struct(tokens, score) from array<array<float>>: best class of each step, repeats merged, blank (0) dropped; mean score of those kept."""
    best = F.transform(steps, lambda s: best_class(s))
    kept = F.filter(F.transform(best, lambda b, i: F.struct(b["cls"].alias("cls"), b["score"].cast("double").alias("score"), F.when(i > 0, F.get(best, i - 1)["cls"]).alias("before"))), lambda b: (b["cls"] != 0) & (b["before"].isNull() | (b["before"] != b["cls"])))
    total = F.aggregate(kept, F.lit(0.0), lambda a, b: a + b["score"])
    return F.struct(F.transform(kept, lambda b: b["cls"]).alias("tokens"), F.when(F.size(kept) > 0, total / F.size(kept)).otherwise(F.lit(0.0)).alias("score"))


def yolo_box(cx: Column, cy: Column, w: Column, h: Column, fx: Column, fy: Column, pad_x: Column | None = None, pad_y: Column | None = None) -> Column:
    """Centre and size, less the letterbox's padding, to whole left, top, width, height; a left or top below 0 is moved, the size stays."""
    left, top = cx - w / 2 - (F.lit(0.0) if pad_x is None else pad_x), cy - h / 2 - (F.lit(0.0) if pad_y is None else pad_y)
    return F.struct((F.greatest(left, F.lit(0.0)) * fx).cast("int").alias("x"), (F.greatest(top, F.lit(0.0)) * fy).cast("int").alias("y"), (w * fx).cast("int").alias("w"), (h * fy).cast("int").alias("h"))


def level_box(column: Column, row: Column, dx: Column, dy: Column, lw: Column, lh: Column, stride: Column) -> Column:
    """A multi-level head's cell and offsets to centre and size."""
    return F.struct(((column + 0.5) * stride + dx * stride).alias("cx"), ((row + 0.5) * stride + dy * stride).alias("cy"), (F.exp(lw) * stride).alias("w"), (F.exp(lh) * stride).alias("h"))


def letterbox(width: Column, height: Column, to_w: int, to_h: int) -> Column:
    """struct(ratio, w, h): the size that fits, never enlarged, half to even."""
    r = F.least(F.lit(1.0), F.least(to_w / width, to_h / height))
    return F.struct(r.alias("ratio"), F.bround(width * r).cast("int").alias("w"), F.bround(height * r).cast("int").alias("h"))


def det_size(width: Column, height: Column, limit: str = "min") -> Column:
    """The text detector's input in multiples of DET_STEP: 'min' enlarges a short side to DET_SIDE, 'max' reduces a long one to a bound by its length."""
    short, long = F.least(width, height), F.greatest(width, height)
    side = F.when(long < 960, 960).when(long < 1500, 1500).otherwise(2000)
    r = F.when(short < DET_SIDE, DET_SIDE / short) if limit == "min" else F.when(long > side, side / long)
    to = lambda v: F.greatest(F.lit(DET_STEP), (F.bround(v * r.otherwise(F.lit(1.0)) / DET_STEP) * DET_STEP).cast("int"))
    return F.struct(to(width).alias("w"), to(height).alias("h"))


def batch_ratio(by: list[str], order: str, width: Column, height: Column) -> Column:
    """The largest width to height among the REC_BATCH crops of a frame that are recognised together, REC_WIDTH / REC_HEIGHT at least.

    order numbers the crops that exist, from 0.
    """
    chunk = Window.partitionBy(*by, F.floor(F.col(order) / REC_BATCH))
    return F.greatest(F.lit(REC_WIDTH / REC_HEIGHT), F.max(width / height).over(chunk))


def rec_width(width: Column, height: Column, ratio: Column) -> Column:
    """The recogniser's width of a crop, in a batch whose largest ratio is given."""
    return F.least(F.floor(REC_HEIGHT * ratio).cast("int"), F.ceil(REC_HEIGHT * width / height).cast("int"))


def rescaled(p: Column, from_w: int, from_h: int, to_w: int, to_h: int) -> Column:
    """Points of a map of one size in a frame of another, whole, up to and with its far edges."""
    to = lambda v, a, b: F.greatest(F.lit(0), F.least(F.lit(b), F.bround(v / float(a) * b).cast("int")))
    return F.transform(p, lambda v: F.struct(to(v["x"], from_w, to_w).alias("x"), to(v["y"], from_h, to_h).alias("y")))


def padded_box(box: Column, width: Column, height: Column, pad: int = 2) -> Column:
    out = F.struct(F.greatest(F.lit(0), box["x1"] - pad).alias("x1"), F.greatest(F.lit(0), box["y1"] - pad).alias("y1"), F.least(width, box["x2"] + pad).alias("x2"), F.least(height, box["y2"] + pad).alias("y2"))
    return F.when((out["x2"] > out["x1"]) & (out["y2"] > out["y1"]), out)


def warp_size(p: Column) -> Column:
    """Of a quad's straightened crop: the longer of opposite sides, cut to whole pixels."""
    d = lambda i, j: F.sqrt(F.pow(F.get(p, i)["x"] - F.get(p, j)["x"], 2.0) + F.pow(F.get(p, i)["y"] - F.get(p, j)["y"], 2.0))
    return F.struct(F.greatest(d(0, 1), d(3, 2)).cast("int").alias("w"), F.greatest(d(0, 3), d(1, 2)).cast("int").alias("h"))
