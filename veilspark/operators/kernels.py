"""Pixel and point kernels in numpy: what column expressions cannot say, for use inside Arrow batches.

Images are height x width x channels, uint8, BGR.  Sizes are rounded half to
even, coordinates cut towards zero, as the expressions in functions/ do.
"""

from __future__ import annotations

import numpy as np

from .raster import resized

#: Weights of blue, green and red in grey.
GREY = (0.114, 0.587, 0.299)


def to_bgr(image: np.ndarray, order: str = "bgr") -> np.ndarray:
    """Grey (two or three axes), BGR(A) or RGB(A) as BGR."""
    if image.ndim == 2:
        image = image[:, :, None]
    if image.shape[2] == 1:
        return np.repeat(image, 3, axis=2)
    image = image[:, :, :3]
    return image[:, :, ::-1] if order == "rgb" else image


def from_bgr(image: np.ndarray, order: str) -> np.ndarray:
    """BGR as 'bgr', 'rgb' or 'gray' (one channel)."""
    order = order.lower()
    if order == "bgr":
        return image
    if order == "rgb":
        return image[:, :, ::-1]
    if order == "gray":
        return np.rint(image.astype(np.float64) @ np.array(GREY)).astype(np.uint8)[:, :, None]
    raise ValueError(f"unknown image format: {order}")


def letterboxed(image: np.ndarray, width: int, height: int) -> tuple[np.ndarray, float]:
    """The image at the top left of a black frame, reduced to fit but never enlarged, and the ratio."""
    h, w = image.shape[:2]
    ratio = min(height / h, width / w, 1.0)
    out = np.zeros((height, width, 3), np.uint8)
    nw, nh = round(w * ratio), round(h * ratio)
    out[:nh, :nw] = resized(image, nw, nh)
    return out, ratio


def face_input(image: np.ndarray, width: int, height: int, order: str = "rgb") -> tuple[np.ndarray, float]:
    """A face model's tensor (1 x channels x height x width, 0 to 1) and the ratio of its letterbox."""
    if image is None or image.size == 0:
        raise ValueError("the image is empty")
    box, ratio = letterboxed(image, width, height)
    return from_bgr(box, order).transpose(2, 0, 1)[None].astype(np.float32) / np.float32(255), ratio


def centred(image: np.ndarray) -> np.ndarray:
    """Channels x height x width, from -1 to 1."""
    return ((image.astype(np.float32) / np.float32(255) - np.float32(0.5)) / np.float32(0.5)).transpose(2, 0, 1)


def text_input(image: np.ndarray, limit: str = "min", side: int | None = None) -> np.ndarray:
    """A text detector's tensor: RGB image with sides in multiples of 32; 'min' enlarges a short side, 'max' reduces a long one."""
    h, w = image.shape[:2]
    if side is None:
        side = 736 if limit == "min" else 960 if max(h, w) < 960 else 1500 if max(h, w) < 1500 else 2000
    edge = min(h, w) if limit == "min" else max(h, w)
    ratio = side / edge if (edge < side if limit == "min" else edge > side) else 1.0
    to = lambda n: max(32, round(n * ratio / 32) * 32)
    return centred(resized(image, to(w), to(h)))[None]


def recogniser_input(crop: np.ndarray, ratio: float, height: int = 48) -> np.ndarray:
    """A crop at the recogniser's height, padded on the right with zeros to the batch's largest ratio."""
    most = int(height * ratio)
    h, w = crop.shape[:2]
    width = min(most, int(np.ceil(height * (w / h))))
    out = np.zeros((3, height, most), np.float32)
    out[:, :, :width] = centred(resized(crop, width, height))
    return out


def cut_box(image: np.ndarray, polygon: list[tuple[int, int]], pad: int = 2) -> np.ndarray | None:
    """The polygon's bounding box and pad pixels around it; none if nothing of it is in the image."""
    xs, ys = [p[0] for p in polygon], [p[1] for p in polygon]
    x1, y1 = max(0, min(xs) - pad), max(0, min(ys) - pad)
    x2, y2 = min(image.shape[1], max(xs) + 1 + pad), min(image.shape[0], max(ys) + 1 + pad)
    return image[y1:y2, x1:x2] if x2 > x1 and y2 > y1 else None


def homography(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """The projective map of four points to four others."""
    rows, right = [], []
    for (x, y), (u, v) in zip(src, dst, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        right += [u, v]
    return np.append(np.linalg.solve(np.array(rows, float), np.array(right, float)), 1).reshape(3, 3)


def warped(image: np.ndarray, to_image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Bilinear look-up of each pixel of a new image through a map into the old one; black outside."""
    ys, xs = np.mgrid[0:height, 0:width]
    p = to_image @ np.stack([xs.ravel(), ys.ravel(), np.ones(xs.size)])
    x, y = p[0] / p[2], p[1] / p[2]
    padded = np.pad(image.astype(np.float64), ((1, 1), (1, 1), (0, 0)))
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    fx, fy = (x - x0)[:, None], (y - y0)[:, None]
    at = lambda i, j: padded[np.clip(j + 1, 0, padded.shape[0] - 1), np.clip(i + 1, 0, padded.shape[1] - 1)]
    out = (at(x0, y0) * (1 - fx) + at(x0 + 1, y0) * fx) * (1 - fy) + (at(x0, y0 + 1) * (1 - fx) + at(x0 + 1, y0 + 1) * fx) * fy
    return np.rint(out).clip(0, 255).astype(np.uint8).reshape(height, width, -1)


def cut_quad(image: np.ndarray, polygon: list[tuple[int, int]]) -> np.ndarray | None:
    """A quad's straightened crop; the padded box for fewer points or less than two pixels."""
    if len(polygon) < 4:
        return cut_box(image, polygon)
    p = np.array(polygon[:4], float)
    side = lambda a, b: np.linalg.norm(p[a] - p[b])
    w, h = int(max(side(0, 1), side(2, 3))), int(max(side(0, 3), side(1, 2)))
    if w < 2 or h < 2:
        return cut_box(image, polygon)
    try:
        back = homography(np.array([[0, 0], [w, 0], [w, h], [0, h]], float), p)
    except np.linalg.LinAlgError:  # three corners on a line
        return cut_box(image, polygon)
    return warped(image, back, w, h)


# ---- points ------------------------------------------------------------------------------------------------------


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull, counter-clockwise in a frame whose y axis points up, without points on its edges."""
    p = np.unique(np.asarray(points, float), axis=0)
    if len(p) < 3:
        return p

    def half(points):
        out = []
        for q in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(half(p) + half(p[::-1]))


def least_rectangle(points: np.ndarray) -> tuple[np.ndarray, float, float]:
    """Corners and both sides of the rectangle of least area around some points: one of its sides lies on the hull."""
    h = hull(points)
    if len(h) == 1:
        return np.repeat(h, 4, axis=0), 0.0, 0.0
    edges = np.roll(h, -1, axis=0) - h
    length = np.hypot(edges[:, 0], edges[:, 1])
    along = edges[length > 0] / length[length > 0, None]
    across = np.stack([-along[:, 1], along[:, 0]], axis=1)
    u, v = h @ along.T, h @ across.T
    best = int(((u.max(0) - u.min(0)) * (v.max(0) - v.min(0))).round(9).argmin())
    a, b, c, d = u[:, best].min(), u[:, best].max(), v[:, best].min(), v[:, best].max()
    corners = np.array([[a, c], [b, c], [b, d], [a, d]]) @ np.stack([along[best], across[best]])
    return corners, b - a, d - c


def in_order(points: np.ndarray) -> np.ndarray:
    """Four points as top left, top right, bottom right, bottom left: the two leftmost, then by height in each pair."""
    p = points[np.lexsort((points[:, 1], points[:, 0]))]
    left, right = p[:2][np.argsort(p[:2, 1], kind="stable")], p[2:][np.argsort(p[2:, 1], kind="stable")]
    return np.array([left[0], right[0], right[1], left[1]])


def is_convex(polygon: list[tuple[int, int]]) -> bool:
    return bool(are_convex(np.array(polygon, np.int64)[None])[0])


def are_convex(polygons: np.ndarray) -> np.ndarray:
    """Of polygons of as many whole points each (n x k x 2): whether all turns go one way."""
    a = np.roll(polygons, -1, axis=1) - polygons
    b = np.roll(a, -1, axis=1)
    turn = a[:, :, 0] * b[:, :, 1] - a[:, :, 1] * b[:, :, 0]
    return (turn >= 0).all(1) | (turn <= 0).all(1)


def widened(quad: np.ndarray, distance: float, tolerance: float = 0.25) -> np.ndarray:
    """The outline at a distance around a convex polygon of whole points, with round corners; whole points."""
    p = hull(np.trunc(quad))
    if len(p) < 3 or distance <= 0:
        return np.asarray(quad, float)
    # as many steps to a circle as keep its chords within the tolerance
    steps = max(4, int(np.ceil(np.pi / np.arccos(1 - min(tolerance, distance) / distance))))
    edges = np.roll(p, -1, axis=0) - p
    angle = np.arctan2(-edges[:, 0], edges[:, 1])  # of the outward normal
    out = []
    for i, q in enumerate(p):
        turn = (angle[i] - angle[i - 1]) % (2 * np.pi)
        t = angle[i - 1] + np.linspace(0, turn, max(2, int(np.ceil(steps * turn / (2 * np.pi))) + 1))
        out.append(q + distance * np.stack([np.cos(t), np.sin(t)], axis=1))
    return np.rint(np.concatenate(out))


# ---- bitmaps -----------------------------------------------------------------------------------------------------


def dilated(mask: np.ndarray) -> np.ndarray:
    """By a square of two pixels: a pixel is set if it or its upper, left or upper left neighbour is."""
    p = np.pad(mask, ((1, 0), (1, 0)))
    return p[1:, 1:] | p[:-1, 1:] | p[1:, :-1] | p[:-1, :-1]


def labelled(mask: np.ndarray, diagonal: bool) -> tuple[np.ndarray, int]:
    """Numbers of connected parts, from 1 in order of their first pixel by rows; 0 outside."""
    h, w = mask.shape
    p = np.zeros((h, w + 2), np.int8)
    p[:, 1:-1] = mask
    step = np.diff(p, axis=1)
    rows, first = np.nonzero(step == 1)
    stop = np.nonzero(step == -1)[1]
    root = np.arange(len(rows))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    begin = np.searchsorted(rows, np.arange(h + 1))
    reach = 1 if diagonal else 0
    for y in range(1, h):
        i, j = begin[y - 1], begin[y]
        while i < begin[y] and j < begin[y + 1]:
            if first[i] < stop[j] + reach and first[j] < stop[i] + reach:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
            if stop[i] < stop[j]:
                i += 1
            else:
                j += 1
    runs = np.array([find(i) for i in range(len(rows))], np.int64)
    names, number = np.unique(runs, return_inverse=True)
    out = np.zeros((h, w), np.int32)
    for y, a, b, n in zip(rows, first, stop, number, strict=True):
        out[y, a:b] = n + 1
    return out, len(names)


def outlines(mask: np.ndarray) -> list[np.ndarray]:
    """Points (x, y) of the borders of a bitmap's parts and of the holes in them, the last found by rows first.

    A part's border is told by all its pixels' row ends, a hole's by the set
    pixels beside it: each has the hull of the border that goes round it.
    """
    found = []
    parts, n = labelled(mask, diagonal=True)
    ys, xs = np.nonzero(parts)
    order = np.argsort(parts[ys, xs], kind="stable")
    ys, xs = ys[order], xs[order]
    begin = np.searchsorted(parts[ys, xs], np.arange(1, n + 2))
    for i in range(n):
        y, x = ys[begin[i] : begin[i + 1]], xs[begin[i] : begin[i + 1]]
        end = np.flatnonzero(np.diff(y, prepend=-1) | np.diff(y, append=-1))
        found.append(((y[0], x[0]), np.stack([x[end], y[end]], axis=1)))
    gaps, m = labelled(~np.pad(mask, 1), diagonal=False)
    for i in range(2, m + 1):  # the first is what lies around everything
        y, x = np.nonzero(gaps == i)
        beside = np.concatenate([np.stack([x + dx, y + dy], axis=1) for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1))])
        beside = np.unique(beside[gaps[beside[:, 1], beside[:, 0]] == 0], axis=0) - 1
        found.append(((y[0] - 1, x[0] - 2), beside))
    return [points for _, points in sorted(found, key=lambda f: f[0], reverse=True)]


def mean_inside(values: np.ndarray, stencil: np.ndarray) -> float:
    return float(values[stencil].mean()) if stencil.any() else 0.0
