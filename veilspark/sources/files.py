"""Inputs and outputs as paths: what is there, of which kind, and where results go.

Files are listed by Spark, so any file system that it reads will do.
"""

from __future__ import annotations

import os
import re
import shutil
import tempfile
from collections.abc import Callable, Iterable
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import specs as s
from ..operators.regions import common_path

#: Name of the folder for results if none is given.
OUTPUT = "output_redact"
LABELS = {"image": "images", "video": "videos"}


def plain(path: str) -> str:
    """A local path without its scheme; another stays."""
    return re.sub(r"^file:/+", "/", path)


def inputs_of(inputs: str | os.PathLike | Iterable[str | os.PathLike]) -> list[str]:
    """One path or several, as a list; ~ is the home folder."""
    several = [inputs] if isinstance(inputs, (str, os.PathLike)) else list(inputs)
    return [os.path.expanduser(os.fspath(x)) for x in several]


def absolute(path: str | os.PathLike, base: str | os.PathLike) -> str:
    """path, under base if it is relative."""
    path = os.fspath(path)
    return path if "://" in path or os.path.isabs(path) else os.path.join(os.fspath(base), path)


def resolve_input(path: str | os.PathLike, data: str | os.PathLike | None = None) -> str:
    """An input that exists: as it is, under the working folder, or under a folder of data."""
    path = os.path.expanduser(os.fspath(path))
    if "://" in path:
        return path
    tried = [path] if os.path.isabs(path) else [str(Path.cwd() / path)] + ([str(Path(data) / path)] if data else [])
    for one in tried:
        if os.path.exists(one):
            return os.path.realpath(one)
    raise FileNotFoundError(f"Input not found: {path} (searched: {', '.join(tried)})")


def resolve_output(output: str | os.PathLike | None) -> str:
    """The folder that results go to, always a folder; by default one in the working folder."""
    if output is not None and "://" in os.fspath(output):
        return os.fspath(output)
    return os.path.realpath(absolute(os.path.expanduser(os.fspath(output)) if output is not None else OUTPUT, Path.cwd()))


def files_under(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """path, length of the files that a path names: itself, or those in the folder."""
    try:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"Input not found: {path}") from None
        raise
    return found.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "length")


def collect_files(spark: SparkSession, inputs, kind: str, recursive: bool = True) -> tuple[DataFrame, str, bool]:
    """path of all files of a kind ('image', 'video') that the inputs name, once and in order of their components; their root; whether a folder was among them.

    In folders other files are passed over; one that is named must be of the kind.
    """
    roots, parts, folders = [], [], False
    for path in inputs_of(inputs):
        found = files_under(spark, path, recursive)
        here = plain(path) if "://" in path or path.startswith("file:") else os.path.realpath(path)
        head = found.limit(2).collect()
        if len(head) == 1 and plain(head[0]["path"]) in (here, plain(path)):
            got = found.select(s.file_type(F.col("path")).alias("k")).first()["k"]
            if got != kind:
                raise ValueError(f"Expected {kind} input, got {got or 'unknown'}: {path}")
            roots.append(here.rsplit("/", 1)[0] or "/")
        else:
            folders = True
            found = found.where(s.file_type(F.col("path")) == kind)
            roots.append(here.rstrip("/") or "/")
        parts.append(found.select("path"))
    files = parts[0] if parts else spark.createDataFrame([], "path string")
    for more in parts[1:]:
        files = files.unionByName(more)
    if files.isEmpty():
        raise FileNotFoundError(f"No {LABELS[kind]} found in the given inputs.")
    return files.distinct().orderBy(F.split("path", "/")), common_path(roots), folders


def write_file(path: str, fill: Callable) -> None:
    """Writes what fill(file) writes, as a whole: a task that runs again, or beside another try, leaves whole files.

    The parts lie in the task's own temporary file until they are sent to the
    file system that path names, which all executors share.
    """
    from pyarrow import fs

    system, target = fs.FileSystem.from_uri(path if "://" in path else "file://" + os.path.abspath(path))
    folder = target.rsplit("/", 1)[0]
    system.create_dir(folder, recursive=True)
    with tempfile.TemporaryFile() as held:
        fill(held)
        held.seek(0)
        part = f"{folder}/.{os.getpid()}-{os.urandom(4).hex()}.part"
        with system.open_output_stream(part) as out:
            shutil.copyfileobj(held, out, 1 << 20)
        system.move(part, target)


def read_file(path: str) -> bytes:
    from pyarrow import fs

    system, source = fs.FileSystem.from_uri(path if "://" in path else "file://" + os.path.abspath(plain(path)))
    with system.open_input_stream(source) as f:
        return f.read()
