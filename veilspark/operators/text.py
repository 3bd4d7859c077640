"""Text in frames: from a probability map to quads, from crops to strings, and both as stages of a plan.

Models are functions on arrays, so any runtime will do: a detector gets a tensor
(1 x 3 x h x w) and returns a map (1 x 1 x h x w); a recogniser gets a batch
(n x 3 x 48 x w) and returns scores (n x steps x characters).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache, reduce
from operator import or_

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import specs as s
from . import kernels as k
from . import regions as r
from .raster import REGIONS, attached, polygon_stencil

Model = Callable[[np.ndarray], np.ndarray]

#: Thresholds of pixels and boxes, most borders looked at, how far boxes are widened, least side.
PIXEL, BOX, MOST, WIDEN, LEAST = 0.3, 0.5, 1000, 1.6, 3
#: Crops recognised at once, and the least ratio of width to height they are padded to.
AT_ONCE, RATIO = 8, 320 / 48


def box_score(prob: np.ndarray, points: np.ndarray) -> float:
    """Mean probability inside a polygon, within the map."""
    h, w = prob.shape
    x0, y0 = (int(np.clip(np.floor(points[:, i].min()), 0, n - 1)) for i, n in ((0, w), (1, h)))
    x1, y1 = (int(np.clip(np.ceil(points[:, i].max()), 0, n - 1)) for i, n in ((0, w), (1, h)))
    shifted = np.trunc(points - [x0, y0]).astype(int)
    room = (min(0, shifted[:, 0].min()), min(0, shifted[:, 1].min()), max(x1 - x0, shifted[:, 0].max()) + 1, max(y1 - y0, shifted[:, 1].max()) + 1)
    stencil = polygon_stencil([tuple(p) for p in shifted.tolist()], room)
    stencil = stencil[-room[1] : -room[1] + y1 - y0 + 1, -room[0] : -room[0] + x1 - x0 + 1]
    return k.mean_inside(prob[y0 : y1 + 1, x0 : x1 + 1], stencil)


def quad_area_perimeter(quad: np.ndarray) -> tuple[float, float]:
    n = np.roll(quad, -1, axis=0)
    return abs((quad[:, 0] * n[:, 1] - n[:, 0] * quad[:, 1]).sum()) / 2, np.hypot(*(n - quad).T).sum()


def quads(prob: np.ndarray, width: int, height: int, pixel: float = PIXEL, box: float = BOX, most: int = MOST, widen: float = WIDEN, exact: bool = False, dilate: bool = True) -> list[tuple[np.ndarray, float]]:
    """Quads (4 x 2 whole points of a frame of that size) and scores found in a probability map, in the order of its borders.

    exact: scores are taken inside the border instead of its least rectangle.
    """
    mask = prob > pixel
    mask = k.dilated(mask) if dilate else mask
    h, w = prob.shape
    out = []
    for border in k.outlines(mask)[:most]:
        corners, a, b = k.least_rectangle(border)
        if min(a, b) < LEAST:
            continue
        corners = k.in_order(corners)
        score = box_score(prob, k.hull(border) if exact else corners)
        if box > score:
            continue
        area, around = quad_area_perimeter(corners)
        corners, a, b = k.least_rectangle(k.widened(corners, area * widen / max(around, 1e-6)))
        if min(a, b) < LEAST + 2:
            continue
        corners = k.in_order(corners)
        x = np.clip(np.rint(corners[:, 0] / w * width), 0, width)
        y = np.clip(np.rint(corners[:, 1] / h * height), 0, height)
        quad = k.in_order(np.stack([x, y], axis=1))
        quad = np.stack([quad[:, 0].clip(0, width - 1), quad[:, 1].clip(0, height - 1)], axis=1).astype(int)
        if int(np.hypot(*(quad[0] - quad[1]))) > LEAST and int(np.hypot(*(quad[0] - quad[3]))) > LEAST:
            out.append((quad, float(score)))
    return out


@lru_cache(1 << 16)
def rectangle_of(form: bytes) -> np.ndarray:
    """The corners of the least rectangle around some whole points."""
    return k.least_rectangle(np.frombuffer(form, np.int64).reshape(-1, 2))[0]


def polygons(boxes: np.ndarray, dx: int = 0, dy: int = 0) -> list[tuple[np.ndarray, np.ndarray]]:
    """Boxes of as many points each (n x k x 2) as parts (rows, polygons): those that are convex, and the others' least rectangles.

    Rectangles are found once for boxes of a form.  Under three points are no polygon.
    """
    whole = np.trunc(np.asarray(boxes, float) + [dx, dy]).astype(np.int64)
    if whole.shape[1] < 3:
        return []
    convex = k.are_convex(whole)
    some = whole[~convex]
    out = [(np.flatnonzero(convex), whole[convex])]
    if len(some):
        corners = np.stack([rectangle_of(f) for f in map(bytes, (some - some[:, :1]).reshape(len(some), -1))])
        out.append((np.flatnonzero(~convex), np.trunc(corners + some[:, :1]).astype(np.int64)))
    return out


def label_of(n: int, prefix: str = "osd_text") -> str:
    return f"{prefix}_{n}"


def to_regions(found: list[tuple[np.ndarray, float]], dx: int = 0, dy: int = 0, prefix: str = "osd_text") -> list[dict]:
    """Regions of boxes, numbered by place; what isn't convex becomes its least rectangle, what has under three points goes."""
    out = []
    for n, (points, score) in enumerate(found):
        for _, some in polygons(np.asarray(points)[None], dx, dy):
            out += [{"ord": n, "label": label_of(n, prefix), "score": score, "polygon": [{"x": x, "y": y} for x, y in p]} for p in some.tolist()]
    return out


def read_characters(lines: list[str]) -> list[str]:
    """A recogniser's classes: blank, one for each line of its dictionary, and a space."""
    return ["blank", *(x.strip("\n").strip("\r\n") for x in lines), " "]


def decoded(scores: np.ndarray, characters: list[str]) -> list[tuple[str, float]]:
    """Text and mean confidence of each of a batch: the best class of a step, repeats merged, blanks dropped."""
    scores = scores[None] if scores.ndim == 2 else scores
    out = []
    for best, top in zip(scores.argmax(2), scores.max(2), strict=True):
        kept = np.append(True, best[1:] != best[:-1]) & (best != 0)
        out.append(("".join(characters[i] for i in best[kept]), float(top[kept].mean()) if kept.any() else 0.0))
    return out


def recognise(crops: list[np.ndarray | None], model: Model, characters: list[str], at_once: int = AT_ONCE) -> list[tuple[str, float]]:
    """Text and confidence of each crop, in its place; '' and 0 where there is none.  A batch is padded to its widest crop."""
    out = [("", 0.0)] * len(crops)
    there = [i for i, c in enumerate(crops) if c is not None]
    for at in range(0, len(there), at_once):
        some = there[at : at + at_once]
        ratio = max([RATIO, *(crops[i].shape[1] / crops[i].shape[0] for i in some)])
        batch = np.stack([k.recogniser_input(crops[i], ratio) for i in some])
        for i, found in zip(some, decoded(model(batch), characters), strict=True):
            out[i] = found
    return out


# ---- stages ------------------------------------------------------------------------------------------------------


def detect_text(frames: DataFrame, name: str, model: Callable[[], Model], pixel: float = PIXEL, box: float = BOX, widen: float = WIDEN, dilate: bool = True) -> DataFrame:
    """frames(..., image) with all text found, as array<struct<ord, label, score, polygon>>.  model() is called once in each task."""

    def kernel():
        call = model()

        def find(frame: np.ndarray) -> list[dict]:
            prob = call(k.text_input(k.from_bgr(frame, "rgb")))[0, 0]
            return to_regions(quads(prob, frame.shape[1], frame.shape[0], pixel, box, widen=widen, dilate=dilate))

        return find

    return attached(frames, name, REGIONS, kernel)


def read_text(frames: DataFrame, name: str, regions: str, model: Callable[[], Model], characters: list[str]) -> DataFrame:
    """frames(..., image, regions) with text and rec_score of each region, in its place.  A frame's crops are recognised AT_ONCE at a time."""

    def kernel():
        call = model()

        def read(frame: np.ndarray, found: list[dict] | None) -> list[dict]:
            crops = [k.cut_quad(frame, [(p["x"], p["y"]) for p in x["polygon"]]) for x in found or []]
            return [{"text": text, "rec_score": score} for text, score in recognise(crops, call, characters)]

        return read

    return attached(frames, name, "array<struct<text:string,rec_score:double>>", kernel, regions)


class TextDetector:
    """All text of a frame, then what bands let through, then what is read with enough confidence and fits a pattern.

    A call gives a table of regions; attach() a column of them, for which frames
    are neither joined nor shuffled.  Bands alone need no recogniser.
    """

    def __init__(
        self, detect: Callable[[], Model], recognise: Callable[[], Model] | None = None, characters: list[str] | None = None, bands: list[tuple[str, float]] | None = None, patterns: list[str] | None = None,
        pixel: float = PIXEL, box: float = BOX, confidence: float = 0.0, widen: float = WIDEN, dilate: bool = True,
    ):
        if patterns and not (recognise and characters):
            raise ValueError("patterns need a recogniser and its characters")
        s.check_patterns(patterns or [])
        self.detect, self.recognise, self.characters = detect, recognise, characters
        self.bands, self.patterns, self.confidence = bands or [], patterns or [], confidence
        self.how = {"pixel": pixel, "box": box, "widen": widen, "dilate": dilate}

    def attach(self, frames: DataFrame, name: str) -> DataFrame:
        out = detect_text(frames, name, self.detect, **self.how)
        if self.bands:
            size = F.col("image.width"), F.col("image.height")
            out = out.withColumn(name, F.filter(name, lambda x: reduce(or_, [s.in_band(x["polygon"], F.lit(n), F.lit(ratio), *size) for n, ratio in self.bands])))
        if self.patterns:
            out = read_text(out, f"{name}_read", name, self.recognise, self.characters)
            pairs = r.zipped(F.col(name), F.col(f"{name}_read"))
            fits = F.filter(pairs, lambda x: (x["b"]["rec_score"] >= self.confidence) & s.matches_any(x["b"]["text"], self.patterns))
            out = out.withColumn(name, F.transform(fits, lambda x: x["a"].withField("text", x["b"]["text"]).withField("rec_score", x["b"]["rec_score"]))).drop(f"{name}_read")
        return out

    def __call__(self, frames: DataFrame) -> DataFrame:
        by = [c for c in ("path", "frame_index") if c in frames.columns]
        return self.attach(frames.select(*by, "image"), "_found").select(*by, F.explode("_found").alias("r")).select(*by, "r.*")


text_detector = TextDetector


def filter_quads(boxes: DataFrame, width: int, height: int) -> DataFrame:
    """boxes(..., quad) in clockwise order, cut to the frame, without those of LEAST pixels or less in either direction."""
    out = boxes.withColumn("quad", g.clip(g.ordered_quad(F.col("quad")), F.lit(width), F.lit(height)))
    side = lambda i, j: F.sqrt(F.pow(F.get("quad", i)["x"] - F.get("quad", j)["x"], 2.0) + F.pow(F.get("quad", i)["y"] - F.get("quad", j)["y"], 2.0)).cast("int")
    return out.where((side(0, 1) > LEAST) & (side(0, 3) > LEAST))
