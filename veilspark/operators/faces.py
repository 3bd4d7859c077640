"""Face heads: from a model's raw outputs to regions, as column expressions, and the stage that runs a model.

Outputs are rows of anchors: (frame..., anchor, cx, cy, w, h, scores).  A head of
one tensor gives them as they are; one of several levels gives cells and offsets.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import detections as d
from ..functions import geometry as g
from . import kernels as k
from .raster import attached

Model = Callable[[np.ndarray], list[np.ndarray]]

#: Cells of a level in pixels; further levels have the last.
STRIDES = (8, 16, 32)


def level_centre(cell_x: Column, cell_y: Column, level: Column, offsets: Column) -> Column:
    """struct(cx, cy, w, h) of a cell of a level and its four offsets."""
    stride = F.get(F.array(*[F.lit(float(x)) for x in STRIDES]), F.least(level, F.lit(len(STRIDES) - 1)))
    at = lambda i: F.get(offsets, F.lit(i)).cast("double")
    return d.level_box(cell_x, cell_y, at(0), at(1), at(2), at(3), stride)


def faces_of(anchors: Column, threshold: float, ratio: Column, pad_x: float = 0.0, pad_y: float = 0.0, iou: float = d.NMS_IOU, top: int = d.NMS_TOP) -> Column:
    """Regions, as an array, of a frame's anchors, an array<struct<anchor, cx, cy, w, h, scores>>.

    An anchor counts if its best class isn't the first, which is background, and
    scores threshold at least; boxes that remain after suppression (which wants
    more than the threshold) are in order of their scores.
    """
    f = F.when(ratio != 0, 1 / ratio).otherwise(F.lit(1.0))
    double = lambda x, n: x[n].cast("double")
    box = lambda x: d.yolo_box(double(x, "cx"), double(x, "cy"), double(x, "w"), double(x, "h"), f, f, F.lit(float(pad_x)), F.lit(float(pad_y)))
    rows = F.transform(anchors, lambda x: F.struct(d.best_class(x["scores"]).alias("best"), x["anchor"].alias("anchor"), box(x).alias("b")))
    rows = F.filter(rows, lambda x: (x["best"]["score"] >= threshold) & (x["best"]["cls"] != 0) & (x["best"]["score"].cast("double") > threshold))
    rows = F.transform(rows, lambda x: F.struct((-x["best"]["score"].cast("double")).alias("s"), x["anchor"].alias("anchor"), *[x["b"][n].alias(n) for n in "xywh"]))
    polygon = lambda x: g.from_bbox(x["x"], x["y"], x["x"] + x["w"], x["y"] + x["h"])
    return F.transform(d.suppress(rows, iou, top), lambda x, i: F.struct(i.alias("ord"), F.lit("face").alias("label"), (-x["s"]).alias("score"), polygon(x).alias("polygon")))


def faces(anchors: DataFrame, by: list[str], threshold: float, ratio: float, **how) -> DataFrame:
    """by..., ord, label, score, polygon from a table of anchors(by..., anchor, cx, cy, w, h, scores)."""
    lists = anchors.groupBy(*by).agg(F.collect_list(F.struct("anchor", "cx", "cy", "w", "h", "scores")).alias("a"))
    return lists.select(*by, F.explode(faces_of(F.col("a"), threshold, F.lit(float(ratio)), **how)).alias("r")).select(*by, "r.*")


def anchors_of(outputs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Boxes (centre and size) and scores of a model's anchors.  One tensor: 1 x (4 + classes) x n; several: pairs of class scores and offsets, 1 x c x h x w, a pair for each level."""
    if len(outputs) == 1:
        rows = outputs[0].reshape(outputs[0].shape[-2:]).T
        return rows[:, :4].astype(float), rows[:, 4:]
    boxes, scores = [], []
    for level in range(len(outputs) // 2):
        cls, reg = outputs[2 * level][0], outputs[2 * level + 1][0].astype(float)
        stride = STRIDES[min(level, len(STRIDES) - 1)]
        ys, xs = np.mgrid[0 : cls.shape[1], 0 : cls.shape[2]]
        parts = ((xs + 0.5 + reg[0]) * stride, (ys + 0.5 + reg[1]) * stride, np.exp(reg[2]) * stride, np.exp(reg[3]) * stride)
        boxes.append(np.stack([p.ravel() for p in parts], axis=1))
        scores.append(cls.reshape(len(cls), -1).T)
    return np.concatenate(boxes), np.concatenate(scores)


class FaceDetector:
    """Faces of a frame.  model() is called once in each task and gets tensors of 1 x 3 x height x width.

    The kernel gives only anchors that could count; choice, boxes and
    suppression are expressions.  A call gives a table of regions; attach() a
    column of them, for which frames are neither joined nor shuffled.
    """

    def __init__(self, model: Callable[[], Model], width: int, height: int, threshold: float = 0.3, order: str = "rgb", iou: float = d.NMS_IOU):
        self.model, self.size, self.threshold, self.order, self.iou = model, (width, height), threshold, order, iou

    def attach(self, frames: DataFrame, name: str) -> DataFrame:
        model, (width, height), threshold, order = self.model, self.size, self.threshold, self.order

        def kernel():
            call = model()

            def find(frame: np.ndarray) -> dict:
                tensor, ratio = k.face_input(frame, width, height, order)
                box, scores = anchors_of(call(tensor))
                hit = np.flatnonzero(scores.max(1) >= threshold)
                rows = [{"anchor": int(i), "cx": b[0], "cy": b[1], "w": b[2], "h": b[3], "scores": x} for i, b, x in zip(hit, box[hit].tolist(), scores[hit].astype(np.float32).tolist(), strict=True)]
                return {"ratio": ratio, "anchors": rows}

            return find

        kind = "struct<ratio:double,anchors:array<struct<anchor:int,cx:double,cy:double,w:double,h:double,scores:array<float>>>>"
        out = attached(frames, name, kind, kernel)
        return out.withColumn(name, faces_of(F.col(name)["anchors"], threshold, F.col(name)["ratio"], iou=self.iou))

    def __call__(self, frames: DataFrame) -> DataFrame:
        by = [c for c in ("path", "frame_index") if c in frames.columns]
        return self.attach(frames.select(*by, "image"), "_found").select(*by, F.explode("_found").alias("r")).select(*by, "r.*")


face_detector = FaceDetector
