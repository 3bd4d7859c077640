"""Model files: which there are, whether a cached one can be used, and sessions that run them in workers."""

from __future__ import annotations

import hashlib
import os
import sys
import types
from dataclasses import dataclass
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEVICES, DEVICE_ENV, FOLDER_ENV = ("auto", "cpu", "cuda"), "VEILSPARK_DEVICE", "VEILSPARK_MODELS"
SIZES = ("tiny", "small", "medium")
#: Least bytes of a model and of a dictionary, bytes looked at for HTML, and hashes of the text models by size.
MODEL_BYTES, DICTIONARY_BYTES, HEAD = 1 << 20, 1024, 256
DET_SHA256 = {
    "tiny": "f42c0fbd294d95eac1a550e131b277dac97462c8025fa4b6c3cec1b7894bd3d5",
    "small": "090f04abcd9d9a7498bc4ebf677e4cb9bdce1fe4197ddb7e529f1ef44e1ff94f",
    "medium": "92078b7355007ccfffcd4c8cd441a3afd4538904d06881b29a155e1e679907c2",
}
REC_SHA256 = {
    "tiny": "e16e242de5937ad92609223f19bc2aff3727ee40b095f996907c24749bad251b",
    "small": "6f327246b50388f3c176ae304bd95767ea6dc0c9ae92153ef8cbe210b3c14884",
    "medium": "eef444829dbbe18d7fea59a3f6eb75647518d2b3a9568d27c92e42940204894b",
}


@dataclass(frozen=True)
class Asset:
    path: str
    label: str
    least: int = MODEL_BYTES
    sha256: str | None = None
    url: str | None = None


def folder() -> Path:
    """Where model files are kept."""
    return Path(os.environ.get(FOLDER_ENV) or Path.home() / ".veilspark" / "models").expanduser().resolve()


def face_asset() -> Asset:
    return Asset(str(folder() / "face_det.onnx"), "face detection model")


def text_assets(size: str = "small", reading: bool = False) -> list[Asset]:
    """The text detector, and for reading the recogniser and its dictionary."""
    if size not in SIZES:
        raise ValueError(f"model size must be one of {', '.join(SIZES)}; got {size!r}")
    out = [Asset(str(folder() / f"text_det_{size}.onnx"), f"text detection model ({size})", sha256=DET_SHA256[size])]
    if reading:
        out += [Asset(str(folder() / f"text_rec_{size}.onnx"), f"text recognition model ({size})", sha256=REC_SHA256[size]), Asset(str(folder() / "text_dict.txt"), "text dictionary", DICTIONARY_BYTES)]
    return out


def is_html(content: Column) -> Column:
    """The first bytes of a file are a web page's, as of an error that was saved for a model."""
    head = F.lower(F.decode(F.substring(content, 1, HEAD), "ISO-8859-1"))
    return F.regexp_replace(head, r"^[\x20\x09-\x0D]+", "").startswith("<!doctype") | head.contains("<html")


def usable(path: Column, length: Column, content: Column, least: Column, sha256: Column) -> Column:
    """A cached file is large enough, no web page in place of a model, and has the hash that is expected, if any."""
    ok = (length >= least) & (~path.endswith(".onnx") | ~is_html(content)) & (sha256.isNull() | (F.sha2(content, 256) == sha256))
    return F.coalesce(ok, F.lit(False))


def check(files: DataFrame, assets: list[Asset]) -> DataFrame:
    """path, label, usable of each asset, by files(path, length, content) as the binaryFile source gives them; one that isn't there isn't usable."""
    spark = files.sparkSession
    wanted = spark.createDataFrame([(a.path, a.label, a.least, a.sha256) for a in assets], "path string, label string, least bigint, sha256 string")
    found = files.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "length", "content")
    out = F.broadcast(wanted).join(found, "path", "left")
    return out.select("path", "label", usable(F.col("path"), F.col("length"), F.col("content"), F.col("least"), F.col("sha256")).alias("usable"))


def is_usable(asset: Asset) -> bool:
    """The same of a local file, read in pieces."""
    path = Path(asset.path)
    if not path.is_file() or path.stat().st_size < asset.least:
        return False
    with path.open("rb") as f:
        head = f.read(HEAD).lstrip().lower()
    if path.suffix == ".onnx" and (head.startswith(b"<!doctype") or b"<html" in head):
        return False
    if asset.sha256:
        with path.open("rb") as f:
            return hashlib.file_digest(f, "sha256").hexdigest() == asset.sha256
    return True


def fetch(asset: Asset) -> None:
    """Downloads a model file; RuntimeError for what is no model."""
    import urllib.error
    import urllib.request

    try:
        with urllib.request.urlopen(asset.url, timeout=120) as answer:  # a status of 400 and above raises
            data = answer.read()
    except urllib.error.URLError as e:
        raise RuntimeError(f"Failed to download {asset.label} from {asset.url}: {e}") from e
    if len(data) < 64:
        raise RuntimeError(f"Failed to download {asset.label}: empty or truncated")
    if data.lstrip().lower().startswith((b"<!doctype", b"<html")):
        raise RuntimeError(f"Failed to download {asset.label}: a web page instead of a model")
    Path(asset.path).parent.mkdir(parents=True, exist_ok=True)
    Path(asset.path).write_bytes(data)


def ensure(asset: Asset) -> str:
    """The path of a usable file.  In the model folder an unusable one is removed and fetched anew, if a URL is known."""
    if is_usable(asset):
        return asset.path
    path = Path(asset.path)
    path.unlink(missing_ok=True)
    if not path.resolve().is_relative_to(folder()) or not asset.url:
        raise FileNotFoundError(f"{asset.label} not found: {path}")
    fetch(asset)
    if not is_usable(asset):
        path.unlink(missing_ok=True)
        raise RuntimeError(f"Downloaded {asset.label} is corrupt or too small: {path}")
    return asset.path


def device_of(name: str | None) -> str:
    """'auto', 'cpu' or 'cuda'; by default what the environment says, else auto."""
    name = os.environ.get(DEVICE_ENV, "auto") if name is None else name
    if name.strip().lower() not in DEVICES:
        raise ValueError(f"device must be one of {', '.join(DEVICES)}; got {name!r}")
    return name.strip().lower()


def providers_for(device: str, available: list[str]) -> list[str]:
    """Providers in order of preference."""
    gpu, cpu = "CUDAExecutionProvider", "CPUExecutionProvider"
    if device == "cuda" and gpu not in available:
        raise RuntimeError(f"{gpu} is not available")
    return [gpu, cpu] if device != "cpu" and gpu in available else [cpu]


def session(path: str, label: str = "model", device: str | None = None):
    """A runtime session, one for each worker process and file."""
    import onnxruntime

    store = sys.modules.setdefault("_veilspark_worker", types.ModuleType("_veilspark_worker")).__dict__.setdefault("sessions", {})
    if (path, device) not in store:
        providers = providers_for(device_of(device), onnxruntime.get_available_providers())
        try:
            store[path, device] = onnxruntime.InferenceSession(path, providers=providers)
        except Exception as e:
            if "Unsupported model IR version" in str(e):
                raise RuntimeError(f"Failed to load {label} {path}: it needs a newer runtime. {e}") from e
            raise
    return store[path, device]


def dimension(value) -> int | None:
    """A model's dimension: a positive number, or one as text; none for a name."""
    if isinstance(value, int) and value > 0:
        return value
    return int(value) if isinstance(value, str) and value.isdigit() else None


def input_size(opened, path: str = "") -> tuple[int, int]:
    """Width and height of a model's images."""
    shape = opened.get_inputs()[0].shape
    width, height = (dimension(shape[3]), dimension(shape[2])) if len(shape) == 4 else (None, None)
    if not width or not height:
        raise ValueError(f"the model's input size is not fixed: {path}")
    return width, height


def runner(path: str, label: str = "model", device: str | None = None):
    """For the operators that take a model: called in a worker, it opens the session and gives a function of one tensor with all outputs."""

    def open_():
        opened = session(path, label, device)
        name = opened.get_inputs()[0].name
        return lambda x: opened.run(None, {name: np.ascontiguousarray(x)})

    return open_


def first_output(open_):
    """The same with the first output only."""
    return lambda: (lambda call: lambda x: call(x)[0])(open_())
