"""Files in and out: formats, inputs and their errors, videos, models, the command line."""

import io
import os

import numpy as np
import pytest

from veilspark import api, cli, models
from veilspark.operators import raster
from veilspark.sources import codecs, files, images, streams, videos


def gradient(h=48, w=64):
    ys, xs = np.mgrid[0:h, 0:w]
    return np.stack([(xs * 3) % 200, (ys * 4) % 200, (xs + ys) % 200], axis=2).astype(np.uint8)


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "in"
    for name, encode in {"a.png": codecs.png, "sub/b.jpg": codecs.jpeg, "sub/c.bmp": codecs.bmp, "sub/d.tif": codecs.tiff}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(encode(gradient()))
    (root / "notes.txt").write_text("no image")
    video(root / "clip.avi", 5)
    return root


def video(path, n, fps=12.5, sound=()):
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open("wb") as f:
        codecs.write_avi(f, codecs.Video(fps, None, (gradient() + np.uint8(i) for i in range(n)), list(sound)), 64, 48)


def pictures(spark, path):
    return {os.path.relpath(x["path"], path): raster.pixels(x["image"].asDict()) for x in images.read_images(spark, str(path)).collect()}


def test_formats_are_decoded_as_they_were_encoded(spark, folder):
    got = pictures(spark, folder)
    assert sorted(got) == ["a.png", "sub/b.jpg", "sub/c.bmp", "sub/d.tif"]
    for name, image in got.items():
        off = np.abs(image.astype(int) - gradient())
        assert off.max() == 0 if not name.endswith("jpg") else off.mean() < 2


def test_jpeg_of_odd_and_flat_images(spark, tmp_path):
    cases = {"flat": np.full((9, 17, 3), 77, np.uint8), "one": np.full((1, 1, 3), 200, np.uint8), "noise": np.random.default_rng(1).integers(0, 256, (33, 41, 3), dtype=np.uint8)}
    for name, image in cases.items():
        (tmp_path / f"{name}.jpg").write_bytes(codecs.jpeg(image))
    got = pictures(spark, tmp_path)
    for name, image in cases.items():
        assert got[f"{name}.jpg"].shape == image.shape and np.abs(got[f"{name}.jpg"].astype(int) - image).mean() < 6


def test_images_keep_place_and_format(spark, folder, tmp_path):
    done = api.redact_image(spark, str(folder), tmp_path / "out", osd_regions=["0,0,32,48"], mask="solid")
    assert [os.path.relpath(p, tmp_path / "out") for p in done] == ["a.png", "sub/b.jpg", "sub/c.bmp", "sub/d.tif"]
    for name, image in pictures(spark, tmp_path / "out").items():
        assert image[:, :28].max() < 12 and image[:, 40:].max() > 100, name
    assert not list((tmp_path / "out").rglob("*.part"))
    assert [os.path.basename(p) for p in api.redact_image(spark, folder, tmp_path / "flat", recursive=False, osd_regions=["0,0,9,9"], num_worker=1)] == ["a.png"]
    several = api.redact_image(spark, [folder / "a.png", folder / "sub" / "c.bmp"], tmp_path / "two", osd_regions=["0,0,9,9"])
    assert [os.path.relpath(p, tmp_path / "two") for p in several] == ["a.png", "sub/c.bmp"]


def test_input_errors(spark, folder, tmp_path):
    with pytest.raises(FileNotFoundError, match="Input not found"):
        api.redact_image(spark, folder / "nothing", tmp_path, osd_regions=["0,0,9,9"])
    with pytest.raises(ValueError, match="Expected image input, got text/plain"):
        api.redact_image(spark, [folder / "a.png", folder / "notes.txt"], tmp_path, osd_regions=["0,0,9,9"])
    with pytest.raises(FileNotFoundError, match="No videos found"):
        api.redact_video(spark, folder / "sub", tmp_path, osd_regions=["0,0,9,9"])
    with pytest.raises(ValueError, match="at least one"):
        api.redact_image(spark, folder, tmp_path)
    with pytest.raises(ValueError, match="not a region"):
        api.redact_image(spark, folder, tmp_path, osd_regions=["0,0,9"])
    with pytest.raises(ValueError, match="not a pattern"):
        api.redact_image(spark, folder, tmp_path, osd_text=["("])
    (folder / "odd.webp").write_bytes(b"x")
    with pytest.raises(ValueError, match="no encoder"):
        api.redact_image(spark, folder, tmp_path, osd_regions=["0,0,9,9"])
    (folder / "odd.webp").unlink()
    (folder / "broken.png").write_bytes(b"not an image")
    with pytest.raises(Exception, match="cannot decode image"):
        api.redact_image(spark, folder, tmp_path, osd_regions=["0,0,9,9"])


def test_paths(tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    assert files.resolve_output(None) == str(tmp_path / "output_redact") and files.resolve_output("x/../y") == str(tmp_path / "y")
    (tmp_path / "data").mkdir()
    (tmp_path / "data/here.png").write_bytes(b"")
    assert files.resolve_input("here.png", "data") == str(tmp_path / "data/here.png") and files.resolve_input("data") == str(tmp_path / "data")
    with pytest.raises(FileNotFoundError, match="searched"):
        files.resolve_input("gone.png", "data")
    assert files.inputs_of("~/a") == [os.path.expanduser("~/a")] and files.inputs_of(["a", tmp_path]) == ["a", str(tmp_path)]


def test_video_frames_in_order(spark, tmp_path):
    sound = [(b"auds" + b"\0" * 52, b"\1\0" * 8, [b"abc", b"de"])]
    video(tmp_path / "in/x/one.avi", 37, sound=sound)
    video(tmp_path / "in/two.avi", 3, fps=30)
    totals = {os.path.basename(x["path"]): x["frames"] for x in videos.frame_totals(spark, str(tmp_path / "in")).collect()}
    assert totals == {"one.avi": 37, "two.avi": 3}
    done = api.redact_video(spark, tmp_path / "in", tmp_path / "out", osd_regions=["0,0,64,10"], mask="solid", keep_audio=True)
    assert [os.path.relpath(p, tmp_path / "out") for p in done] == ["two.avi", "x/one.avi"]
    got = codecs.read_avi((tmp_path / "out/x/one.avi").read_bytes())
    for i, frame in enumerate(got.frames):
        assert not frame[:10].any() and (frame[10:] == (gradient() + np.uint8(i))[10:]).all()
    assert got.fps == 12.5 and got.count == 37 and got.sound[0][2] == sound[0][2]
    assert not codecs.read_avi((tmp_path / "out/two.avi").read_bytes()).sound
    (tmp_path / "in/bad.avi").write_bytes(b"RIFF1234AVI nothing")
    with pytest.raises(Exception, match="Cannot open video"):
        videos.read_videos(spark, str(tmp_path / "in")).count()
    (tmp_path / "in/bad.avi").rename(tmp_path / "in/bad.mkv")
    with pytest.raises(RuntimeError, match="no decoder"):
        api.redact_video(spark, tmp_path / "in", tmp_path / "out", osd_regions=["0,0,9,9"])


def test_folder_with_both_kinds(spark, folder, tmp_path):
    done = api.redact_folder(spark, folder, tmp_path / "out", osd_regions=["0,0,9,9"])
    assert [os.path.basename(p) for p in done] == ["a.png", "b.jpg", "c.bmp", "d.tif", "clip.avi"]
    (tmp_path / "none").mkdir()
    (tmp_path / "none/notes.txt").write_text("x")
    with pytest.raises(FileNotFoundError, match="No images or videos"):
        api.redact_folder(spark, tmp_path / "none", tmp_path / "out", osd_regions=["0,0,9,9"])


def test_command_line(spark, folder, tmp_path):
    args = cli.parser().parse_args(["x", "--osd-region", "1,2,3,4", "--osd-region", "5,6,7,8", "--no-recursive"])
    assert args.osd_region == ["1,2,3,4", "5,6,7,8"] and args.recursive is False and args.mask == "mosaic" and args.mask_scale == 1.3 and args.mosaic_size == 20
    assert cli.main([str(folder / "a.png")]) == 1 and cli.main([str(folder / "gone"), "--face"]) == 1 and cli.main([str(folder / "notes.txt"), "--osd-region", "0,0,9,9"]) == 1
    assert cli.main([str(folder / "a.png"), "-o", str(tmp_path / "o"), "--osd-region", "0,0,9,9", "--mask", "solid"]) == 0
    assert (tmp_path / "o/a.png").exists()
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["--version"])


def test_stream_of_a_folder(spark, folder, tmp_path):
    query = images.stream_images(spark, str(folder / "sub")).select("path", "image.width").writeStream.format("memory").queryName("seen").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    query.awaitTermination(60)
    assert {(os.path.basename(x["path"]), x["width"]) for x in spark.table("seen").collect()} == {("b.jpg", 64), ("c.bmp", 64), ("d.tif", 64)}


def test_models(spark, tmp_path, monkeypatch):
    monkeypatch.setenv(models.FOLDER_ENV, str(tmp_path))
    good, page, small = b"m" * 2000, b"  <!DOCTYPE html>" + b"x" * 2000, b"m" * 10
    import hashlib

    for name, data in {"good.onnx": good, "page.onnx": page, "page.txt": page, "small.onnx": small}.items():
        (tmp_path / name).write_bytes(data)
    hash_ = hashlib.sha256(good).hexdigest()
    cases = [("good.onnx", hash_, True), ("good.onnx", None, True), ("page.onnx", None, False), ("page.txt", None, True), ("small.onnx", None, False), ("gone.onnx", None, False), ("good.onnx", "0" * 64, False)]
    for name, sha, want in cases:
        asset = models.Asset(str(tmp_path / name), name, 1000, sha)
        assert models.is_usable(asset) is want
        assert models.check(spark.read.format("binaryFile").load(str(tmp_path)), [asset]).first()["usable"] is want
    assert models.ensure(models.Asset(str(tmp_path / "good.onnx"), "model", 1000, hash_)).endswith("good.onnx")
    with pytest.raises(FileNotFoundError, match="not found"):
        models.ensure(models.Asset(str(tmp_path / "page.onnx"), "model", 1000))
    with pytest.raises(FileNotFoundError):
        api.options(spark, face=True)
    assert [a.label for a in models.text_assets("tiny", True)] == ["text detection model (tiny)", "text recognition model (tiny)", "text dictionary"] and len(models.text_assets()) == 1
    assert models.device_of(" CPU ") == "cpu" and models.device_of(None) == "auto"
    assert models.providers_for("auto", ["CUDAExecutionProvider", "CPUExecutionProvider"])[0] == "CUDAExecutionProvider" and models.providers_for("cpu", ["CUDAExecutionProvider"]) == ["CPUExecutionProvider"]
    with pytest.raises(RuntimeError):
        models.providers_for("cuda", ["CPUExecutionProvider"])
    with pytest.raises(ValueError):
        models.device_of("tpu")

    class Session:
        def __init__(self, shape):
            self.shape = shape

        def get_inputs(self):
            return [self]

    assert models.input_size(Session([1, 3, 480, "640"])) == (640, 480) and models.dimension("height") is None and models.dimension(0) is None
    with pytest.raises(ValueError):
        models.input_size(Session([1, 3, "h", "w"]))


def test_avi_without_known_content():
    for bad in (b"", b"RIFF\0\0\0\0AVI "):
        with pytest.raises(ValueError):
            codecs.read_avi(bad)
    out = io.BytesIO()
    assert codecs.write_avi(out, codecs.Video(None, None, []), 4, 4) == 0 and codecs.read_avi(out.getvalue()).count == 0


def test_counts_come_with_the_work(spark, folder, tmp_path, caplog):
    with caplog.at_level("INFO", "veilspark"):
        api.redact_image(spark, folder, tmp_path / "o", osd_regions=["0,0,9,9"])
    assert "Completed 4 images" in caplog.text


def test_single_frames(spark, tmp_path):
    import subprocess

    video(tmp_path / "v.avi", 30, fps=10)
    want = gradient() + np.uint8(12)
    for how in ({"seconds": 1.25}, {"index": 12}):
        data, width, height = streams.video_frame(spark, str(tmp_path / "v.avi"), **how)
        (tmp_path / "f.jpg").write_bytes(data)
        assert (width, height) == (64, 48) and np.abs(pictures(spark, tmp_path / "f.jpg")["."].astype(int) - want).mean() < 2
    assert streams.video_frame(spark, str(tmp_path / "v.avi"), seconds=-3)[1] == 64
    for source, how, said in ((str(tmp_path / "v.avi"), {"index": 30}, "Cannot read frame"), (str(tmp_path / "gone.avi"), {}, "Cannot open video")):
        with pytest.raises(ValueError, match=said):
            streams.video_frame(spark, source, **how)

    url = "rtsp://me:secret@cam/1"
    assert streams.command(spark, url, "o.jpg", 2.5) == ["ffmpeg", "-y", "-loglevel", "error", "-rtsp_transport", "tcp", "-ss", "2.5", "-i", url, "-frames:v", "1", "-q:v", "2", "o.jpg"]
    assert "-ss" not in streams.command(spark, "https://cam/1", "o.jpg", 0) and "tcp" not in streams.command(spark, "https://cam/1", "o.jpg")

    def works(args, **_):
        with open(args[-1], "wb") as f:
            f.write(codecs.jpeg(gradient()))
        return subprocess.CompletedProcess(args, 0, "", "")

    def late(args, **_):
        raise subprocess.TimeoutExpired(args, 30)

    assert streams.video_frame(spark, url, run=works)[1:] == (64, 48)
    for run, said in ((late, "connect timeout"), (lambda a, **_: subprocess.CompletedProcess(a, 1, "", f"{url}: Connection refused"), "connect failed"), (lambda a, **_: subprocess.CompletedProcess(a, 1, "", "no such codec"), "decode failed")):
        with pytest.raises(ValueError, match=said) as e:
            streams.video_frame(spark, url, run=run)
        assert "secret" not in str(e.value)
