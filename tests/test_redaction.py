"""Rules of regions, masks and detectors on small frames, with figures of their own."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilspark.functions import geometry as g
from veilspark.functions import specs as s
from veilspark.operators import faces, kernels, raster, text
from veilspark.operators import regions as r
from veilspark.plans import catalogue
from veilspark.plans.redact import Options, redact
from veilspark.plans.specs import band_of, polygon_of, value_of


def test_region_texts(spark):
    assert polygon_of(spark, " 5 ,6,, 25,16\t") == [(5, 6), (24, 6), (24, 15), (5, 15)]
    assert polygon_of(spark, "1,1; 9,1 ;;9,9") == [(1, 1), (9, 1), (9, 9)]
    assert polygon_of(spark, "9,9,2,2") == [(9, 9), (1, 9), (1, 1), (9, 1)]
    assert band_of(spark, " BOTTOM : .25") == ("bottom", 0.25)
    for bad in ("", "7", "1,2,3,4,5", "1;2;3", "3,3;4,4", "x,1,2,3", "1.5,2,3,4"):
        with pytest.raises(ValueError):
            polygon_of(spark, bad)
    for bad in ("bottom", "bottom:0", "bottom:1.01", "diagonal:0.2", "left:nan", ":0.3", "left:"):
        with pytest.raises(ValueError):
            band_of(spark, bad)


def test_ratio_text_is_that_of_the_exact_double(spark):
    rows = [(n, d) for d in (640, 1920, 1080, 1000, 32, 16, 20000, 3) for n in range(1, d, max(1, d // 400))]
    got = spark.createDataFrame(rows, "n int, d int").select("n", "d", s.format_ratio(F.col("n"), F.col("d")).alias("t")).collect()
    assert [(x["n"], x["d"], x["t"]) for x in got if x["t"] != (f"{x['n'] / x['d']:.4f}".rstrip("0").rstrip(".") or "0")] == []
    assert value_of(spark, s.format_ratio(F.lit(12), F.lit(640))) == "0.0187"


def test_errors_of_texts_and_bands(spark):
    with pytest.raises(Exception, match="three points"):
        value_of(spark, s.format_polygon(F.array(g.point(1, 2), g.point(3, 4))))
    with pytest.raises(Exception, match="no band along y"):
        value_of(spark, s.band_range(F.lit("left"), "y", F.lit(100), F.lit(0.5)))
    with pytest.raises(ValueError, match="not a pattern"):
        s.check_patterns(["ok", "(open"])
    with pytest.raises(Exception, match="different lengths"):
        value_of(spark, r.zipped(F.array(F.lit(1)), F.array(F.lit(1), F.lit(2))))
    assert len(value_of(spark, r.zipped(F.array(F.lit(1)), F.array(F.lit(1), F.lit(2)), strict=False))) == 1


def rectangle(x, y, w, h):
    return [(x, y), (x + w - 1, y), (x + w - 1, y + h - 1), (x, y + h - 1)]


def noise(h, w, seed=3):
    return np.random.default_rng(seed).integers(0, 256, (h, w, 3), dtype=np.uint8)


def test_masks_stay_inside_their_region():
    frame = noise(50, 70)
    for mode in ("solid", "blur", "mosaic"):
        for shape in ("polygon", "ellipse"):
            out = raster.paint(frame, [(rectangle(8, 9, 30, 20), 1.0)], mode, shape, 7)
            touched = np.argwhere((out != frame).any(2))
            assert len(touched) and touched.min(0)[0] >= 9 and touched.max(0)[0] <= 28 and touched.min(0)[1] >= 8 and touched.max(0)[1] <= 37
    assert (raster.paint(frame, [(rectangle(55, 40, 20, 5), 1.0)], "solid") == frame).all()  # hangs over the edge
    assert (raster.paint(frame, [(rectangle(55, 40, 20, 5), 1.4)], "solid") != frame).any()  # shrinks to fit
    assert (raster.paint(frame, [([(1, 1), (9, 9)], 1.0)], "solid") == frame).all()
    assert (raster.paint(frame, [(rectangle(8, 9, 30, 20), 1.0)], "none") == frame).all()
    with pytest.raises(ValueError):
        raster.paint(frame, [], "smudge")


def test_later_masks_see_earlier_ones():
    frame = noise(40, 40)
    both = raster.paint(frame, [(rectangle(0, 0, 20, 20), 1.0), (rectangle(10, 10, 20, 20), 1.0)], "blur")
    first = raster.paint(frame, [(rectangle(0, 0, 20, 20), 1.0)], "blur")
    assert (both == raster.paint(first, [(rectangle(10, 10, 20, 20), 1.0)], "blur")).all()


def test_blur_by_hand():
    roi = noise(9, 7, 5)
    ky, kx = 4, 3
    wide = np.pad(roi.astype(int), ((8, 8), (6, 6), (0, 0)), mode="reflect")
    want = np.array([[np.rint(wide[8 + y - 2 : 8 + y + 2, 6 + x - 1 : 6 + x + 2].sum((0, 1)) / (ky * kx)) for x in range(7)] for y in range(9)])
    assert (raster.blurred(roi) == want).all()


def test_least_rectangle_and_widening():
    t = np.deg2rad(25)
    turn = np.array([[np.cos(t), np.sin(t)], [-np.sin(t), np.cos(t)]])
    box = np.array([[0, 0], [60, 0], [60, 18], [0, 18]], float) @ turn + 40
    corners, a, b = kernels.least_rectangle(np.concatenate([box, box.mean(0, keepdims=True)]))
    assert sorted([round(a, 6), round(b, 6)]) == [18, 60] and np.allclose(sorted(map(tuple, corners)), sorted(map(tuple, box)))
    wide, c, d = kernels.least_rectangle(kernels.widened(np.array([[10, 10], [50, 10], [50, 22], [10, 22]], float), 4.0))
    assert sorted([c, d]) == [20, 48] and wide.min() == 6
    assert kernels.is_convex([(0, 0), (4, 0), (4, 4), (0, 4)]) and not kernels.is_convex([(0, 0), (4, 0), (1, 1), (0, 4)])


def test_parts_and_holes():
    mask = np.zeros((12, 16), bool)
    mask[1:7, 1:8] = True
    mask[3:5, 3:6] = False
    mask[8:10, 10:14] = True
    mask[7, 9] = True  # touches the second at a corner
    assert kernels.labelled(mask, True)[1] == 2 and kernels.labelled(mask, False)[1] == 3
    found = [(p.min(0).tolist(), p.max(0).tolist()) for p in kernels.outlines(mask)]
    assert found == [([9, 7], [13, 9]), ([2, 2], [6, 5]), ([1, 1], [7, 6])]  # the last found first; the hole's border is the pixels round it
    assert kernels.dilated(mask)[10, 14] and not kernels.dilated(mask)[0, 0]


def test_quads_of_a_probability_map():
    prob = np.zeros((64, 96))
    prob[10:20, 12:52] = 0.9
    prob[40:50, 20:60] = 0.4
    prob[60:62, 80:82] = 0.99
    found = text.quads(prob, 192, 128)
    assert len(found) == 1  # the second scores too little, the third is too small
    quad, score = found[0]
    assert 0.7 < score <= 0.9
    x0, y0 = quad.min(0)
    x1, y1 = quad.max(0)
    assert x0 < 24 and y0 < 20 and x1 > 104 and y1 > 40 and 96 < x1 - x0 < 130 and 34 < y1 - y0 < 60
    assert len(text.quads(prob, 192, 128, box=0.3)) == 2 and text.quads(prob * 0, 10, 10) == []
    assert len(text.quads(prob, 192, 128, box=0.3, most=1)) == 0  # the border found last, the small one, is the only one looked at
    assert len(text.quads(prob, 192, 128, exact=True)) == 1


def test_text_is_read_in_batches():
    seen = []

    def model(batch):
        seen.append(batch.shape)
        out = np.zeros((len(batch), 5, 4), np.float32)
        out[:, [0, 1, 3], 1] = 0.8
        out[:, 2, 0] = 0.9
        out[:, 4, 2] = 0.6
        return out

    letters = text.read_characters(["a\n", "b\r\n"])
    assert letters == ["blank", "a", "b", " "]
    crops = [noise(10, 12)] * 9 + [None] + [noise(8, 100)]
    got = text.recognise(crops, model, letters)
    assert got[9] == ("", 0.0) and got[0][0] == "aab" and abs(got[0][1] - (0.8 + 0.8 + 0.6) / 3) < 1e-6 and len(got) == 11
    assert seen == [(8, 3, 48, 320), (2, 3, 48, 600)]
    assert text.recognise([], model, letters) == []


def test_crops():
    frame = noise(40, 60)
    assert (kernels.cut_quad(frame, rectangle(10, 8, 21, 11)) == frame[8:18, 10:30]).all()
    assert kernels.cut_box(frame, rectangle(70, 8, 5, 5)) is None and kernels.cut_box(frame, rectangle(0, 0, 5, 5)).shape == (7, 7, 3)
    assert kernels.cut_quad(frame, [(5, 5), (5, 5), (5, 6), (5, 6)]).shape == (6, 5, 3)
    box, ratio = kernels.letterboxed(frame, 30, 30)
    assert ratio == 0.5 and box.shape == (30, 30, 3) and not box[20:].any() and box[:20].any()
    assert kernels.face_input(frame, 64, 64, "gray")[0].shape == (1, 1, 64, 64) and kernels.text_input(frame).shape == (1, 3, 736, 1088)
    assert (kernels.to_bgr(frame, "rgb") == frame[:, :, ::-1]).all() and kernels.to_bgr(frame[:, :, 0]).shape == (40, 60, 3)
    for bad in (lambda: kernels.from_bgr(frame, "hsv"), lambda: kernels.face_input(frame[:0], 8, 8)):
        with pytest.raises(ValueError):
            bad()


def frames_of(spark, *images):
    rows = [(f"/in/{n}.png", tuple(raster.image_of(a).values())) for n, a in enumerate(images)]
    return spark.createDataFrame(rows, f"path string, image {raster.IMAGE}")


def images_of(frames):
    return [raster.pixels(x["image"].asDict()) for x in frames.orderBy("path").collect()]


def test_face_stage(spark):
    frame = np.full((100, 200, 3), 90, np.uint8)

    def model():
        def call(tensor):
            assert tensor.shape == (1, 3, 50, 100)
            rows = np.array([[50, 25, 20, 10, 0.1, 0.9], [51, 25, 20, 10, 0.1, 0.8], [20, 10, 8, 8, 0.9, 0.1], [80, 40, 10, 10, 0.0, 0.2]], np.float32)
            return [rows.T[None]]

        return call

    f = frames_of(spark, frame, frame)
    found = faces.face_detector(model, 100, 50)(f).orderBy("path").collect()
    assert [(x["path"], x["ord"], x["label"], [tuple(p) for p in x["polygon"]]) for x in found] == [(f"/in/{n}.png", 0, "face", rectangle(80, 40, 40, 20)) for n in (0, 1)]
    out = images_of(redact(f, Options(face=faces.face_detector(model, 100, 50), regions=["0,0,5,5"], mask="solid", scale=1.0)))
    assert all(not x[40:60, 80:120].any() and not x[:5, :5].any() and (x[70:] == 90).all() for x in out)
    levels = [np.zeros((1, 2, 2, 2), np.float32), np.zeros((1, 4, 2, 2), np.float32)] * 4
    levels[6] = levels[6].copy()
    levels[6][0, 1, 1, 0] = 0.7
    box, scores = faces.anchors_of(levels)
    assert len(box) == len(scores) == 16 and box[14].tolist() == [16.0, 48.0, 32.0, 32.0]


def test_text_stage(spark):
    frame = np.full((736, 736, 3), 200, np.uint8)

    def detect():
        prob = np.zeros((1, 1, 736, 736))
        prob[0, 0, 20:50, 100:300] = 0.9
        prob[0, 0, 600:640, 100:400] = 0.8
        return lambda tensor: prob

    def read():
        out = np.zeros((2, 3, 4), np.float32)
        out[0, 0, 1] = out[1, 0, 2] = 0.7
        out[:, 1:, 0] = 1
        return lambda batch: out[: len(batch)]

    letters = ["blank", "x", "y", " "]
    f = frames_of(spark, frame)
    everything = text.text_detector(detect)(f).collect()
    assert [x["label"] for x in sorted(everything, key=lambda x: x["ord"])] == ["osd_text_0", "osd_text_1"]
    assert min(p["y"] for p in everything[0]["polygon"]) > 500 or min(p["y"] for p in everything[1]["polygon"]) > 500
    low = text.text_detector(detect, bands=[("bottom", 0.25)])(f).collect()
    assert len(low) == 1 and min(p["y"] for p in low[0]["polygon"]) > 500
    fit = text.text_detector(detect, read, letters, patterns=["^x$"])(f).collect()
    assert [(x["ord"], x["text"]) for x in fit] == [(0, "x")]
    assert text.text_detector(detect, read, letters, patterns=["x"], confidence=0.75)(f).count() == 0
    out = images_of(redact(f, Options(text=text.text_detector(detect, read, letters, patterns=["y"]), mask="solid")))[0]
    assert not out[25:45, 110:290].any() and (out[600:640, 100:400] == 200).all()
    with pytest.raises(ValueError):
        text.text_detector(detect, patterns=["x"])
    with pytest.raises(ValueError):
        Options()


def test_regions_are_not_joined(spark):
    f = frames_of(spark, noise(20, 20), noise(10, 10))
    plan = redact(f, Options(regions=["0,0,15,15", "0,0,5,5"], mask="solid"))
    big, small = images_of(plan)
    assert not big[:15, :15].any() and not small[:5, :5].any() and small[5:].any()
    empty = lambda: lambda tensor: [np.zeros((1, 6, 3), np.float32)]
    blank = lambda: lambda tensor: np.zeros((1, 1, *tensor.shape[2:]), np.float32)
    for o in (Options(regions=["0,0,5,5"]), Options(face=faces.face_detector(empty, 64, 64), text=text.text_detector(blank, bands=[("top", 0.5)]), regions=["0,0,5,5"])):
        shown = redact(f, o)._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in shown and "Exchange" not in shown and "MapInArrow" in shown
        assert len(images_of(redact(f, o))) == 2


def test_detector_of_another_kind(spark):
    def find(frames):
        return frames.select("path", F.lit(0).alias("ord"), g.from_bbox(F.lit(2), F.lit(3), F.lit(6), F.lit(9)).alias("polygon"), F.lit(0.5).alias("score"))

    out = images_of(redact(frames_of(spark, noise(12, 12) | 1), Options(face=find, mask="solid", scale=1.0)))[0]
    assert not out[3:9, 2:6].any() and out[9:].all()


def test_results_are_placed_once_though_boxes_agree_in_all_but_their_scores(spark, tmp_path):
    one = "1L as l_orderkey, 2L as l_partkey, 3L as l_suppkey, 1 as l_linenumber, 4.0D as l_quantity"
    spark.sql(f"select {one}, explode(array(0.01D, 0.02D, 0.02D)) as l_discount").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = catalogue.QUERIES["q66_scatter_results"](spark, str(tmp_path)).collect()
    assert sorted((r["id"], r["text"], round(r["rec_score"], 6)) for r in got) == [(11, "t11", 0.1), (11, "t11", 0.2), (11, "t11", 0.2)]


def test_results_of_unknown_places_and_unknown_results_are_kept(spark):
    rows = spark.createDataFrame([(None, 1), (7, 2), (8, 3)], "a int, b int")
    got = r.placed(rows, spark.createDataFrame([(None, 1, "x", 0.5), (7, 2, None, None)], "a int, b int, text string, rec_score double"), ["a", "b"])
    assert sorted(map(tuple, got.collect()), key=lambda x: x[1]) == [(None, 1, "x", 0.5), (7, 2, None, None), (8, 3, "", 0.0)]


def test_boxes_of_many_frames_become_polygons_at_once():
    rng = np.random.default_rng(3)
    boxes = rng.integers(-50, 50, (200_000, 1, 2)) + rng.integers(0, 6, (200_000, 4, 2))
    parts = text.polygons(boxes, 10, -5)
    assert sorted(np.concatenate([rows for rows, _ in parts]).tolist()) == list(range(len(boxes)))
    for rows, polygons in parts:
        for i, p in list(zip(rows, polygons.tolist(), strict=True))[:200]:
            want = boxes[i] + [10, -5]
            if not kernels.is_convex(want):
                want = np.trunc(kernels.least_rectangle(want - want[0])[0] + want[0])
            assert p == want.tolist()
    assert text.polygons(boxes[:, :2]) == []
