"""What the operators of this subpackage share: reading, cutting lineage, hashing."""

from __future__ import annotations

import ctypes
import re
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

# Executors need not have the package installed: its functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: A word is a maximal run of characters other than ASCII white space.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
WORD_SQL = r"[^\x20\x09-\x0D]+"
SPACE_SQL = r"[\x20\x09-\x0D]+"
MIX = np.uint64(0x9E3779B97F4A7C15)


def ascii_words(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8, A-Z lower-cased: on bytes, lower() and split() know ASCII alone."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where it names none, a temporary one, which only a local master may use."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="veilspark-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


#: While a table is cut: shuffle files are given back with the write's end, and the driver keeps no long texts of its plans.
CUTTING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.maxPlanStringLength": "4096"}


def cut(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: its lineage ends there and survives lost executors.

    As a file source it also carries its true size, so that Spark's own threshold
    decides between a broadcast and a shuffled join.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k, None) for k in CUTTING}
    for k, v in CUTTING.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_to = path
    return out


def done(*tables: DataFrame) -> None:
    """Removes the files of tables that cut() wrote, once nothing is to be computed from them any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._cut_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


SMALL = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of few rows and bytes, as documents can be long and a batch stands in memory; settings of the user's own stay.

    Results are lazy, so the setting has to last as long as the session.
    """
    for key, small in SMALL.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, small)


def kept() -> None:
    """Lets a worker keep up to 32 MB that it has freed until returned(): arrays made again and again otherwise get new pages each time."""
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 8 << 20)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 32 << 20)  # M_TRIM_THRESHOLD
    except (OSError, AttributeError):  # another C library
        pass


def returned() -> None:
    """Gives the memory that a worker process has freed back to the system; workers are reused by later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run for mapInArrow, with the worker's freed memory returned at a task's end."""

    def whole(batches):
        yield from run(batches)
        returned()

    return whole


def revive(kind: type, state: dict):
    """An object from its broadcast attributes: a broadcast class would have to be installed on the executors."""
    out = object.__new__(kind)
    out.__dict__.update(state)
    return out


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads their bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class HashIndex:
    """Positions of 64-bit keys, found for whole arrays at once.

    Keys are sorted by their mixed value; the top bits point at the start of a
    short run, which is walked in step for all queries that are still open.
    """

    def __init__(self, keys: np.ndarray):
        mixed = mix64(keys.astype(np.uint64))
        order = np.argsort(mixed, kind="stable")
        self.mixed, self.order = mixed[order], order.astype(np.int32)
        bits = max(1, int(2 * len(keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.start = np.searchsorted(self.mixed, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)
        self.start = np.append(self.start, np.int32(len(keys)))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Each key's position in the array given at first, or -1."""
        out = np.full(len(keys), -1, np.int64)
        if not len(self.mixed) or not len(keys):
            return out
        mixed = mix64(keys.astype(np.uint64))
        top = (mixed >> self.shift).astype(np.int64)
        at, end = self.start[top], self.start[top + 1]
        open_ = np.flatnonzero(at < end)
        at, end, mixed = at[open_], end[open_], mixed[open_]
        while len(open_):
            hit = self.mixed[at] == mixed
            out[open_[hit]] = self.order[at[hit]]
            at = at + 1
            go = ~hit & (at < end)
            open_, at, end, mixed = open_[go], at[go], end[go], mixed[go]
        return out
