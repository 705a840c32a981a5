"""Helpers that the corpus operators share: table reading, lineage cuts, tokenisation of raw UTF-8 buffers."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a new temporary folder, if all runs on one machine; an error on a cluster."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tallyframe-")
        sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Materialise `df` in the shared checkpoint folder, so that a lost executor costs a read and not a recomputation."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame, compression: str | None = None) -> DataFrame:
    """As cut(), for large tables: written as Parquet there, which takes a fraction of a checkpoint's space."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables that stored() gave and nothing reads any more; they would fill the shared folder until the end."""
    for df in tables:
        for folder in {name.rpartition("/")[0] for name in df.inputFiles()}:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let go of the files of shuffles that are done with, after a large table has been stored.

    Spark deletes them once the driver's collector finds their plans unreachable, which with a roomy heap may be long after; until then
    they fill the executors' disks beside what comes next.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def words(text: Column) -> Column:
    """The words of a text, unchanged: runs of anything but ASCII white space. Null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def splitmix(x: np.ndarray) -> np.ndarray:
    """Mix 64-bit integers; a bijection."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def text_chunks(batch, text: int, limit: int = 1 << 21):
    """Slices of an Arrow batch, as (first row, last row, UTF-8 bytes, byte offsets), of about `limit` bytes or one text."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(batch.column(text).cast(pa.large_string()), "")
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + limit, "right")) - 1)
        yield lo, hi, data[ends[lo] : ends[hi]], ends[lo : hi + 1] - ends[lo]
        lo = hi


def word_spans(data: np.ndarray, offsets: np.ndarray):
    """Of concatenated texts: each word's first and past-the-last byte, and the number of words before each text."""
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    starts_of_text = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[starts_of_text] = solid[starts_of_text]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    last[starts_of_text[1:] - 1] = solid[starts_of_text[1:] - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


_TABLE = {seed: splitmix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) for seed in (1, 2)}
_BASE = {1: 0x9E3779B97F4A7C15, 2: 0xD6E8FEB86659FD93}


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of each word's bytes; two seeds give independent halves of a 128-bit hash."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    place = np.arange(len(data), dtype=np.int64)
    solid = np.zeros(len(data) + 1, np.int64)
    solid[starts] += 1
    solid[ends] -= 1
    inside = np.cumsum(solid[:-1]) > 0
    place, value = place[inside], _TABLE[seed][data[inside]]
    lengths = ends - starts
    at = np.cumsum(lengths) - lengths
    value = value * powers(_BASE[seed], int(lengths.max()))[place - np.repeat(starts, lengths)]
    return splitmix(np.add.reduceat(value, at) + lengths.astype(np.uint64))


@lru_cache
def _short_powers(base: int) -> np.ndarray:
    return powers(base, 1 << 19)


def _powers(base: int, n: int) -> np.ndarray:
    return _short_powers(base)[:n] if n <= 1 << 19 else powers(base, n)


class Rolling:
    """Hashes of any run of a sequence of 64-bit values in constant time: a polynomial modulo 2**64."""

    def __init__(self, values: np.ndarray, seed: int):
        self.power = _powers(_BASE[seed], len(values) + 1)
        self.prefix = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.power[:-1], out=self.prefix[1:])
        self.inverse = _powers(pow(_BASE[seed], -1, 1 << 64), len(values) + 1)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return splitmix((self.prefix[ends] - self.prefix[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64))
