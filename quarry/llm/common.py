"""Shared pieces: checkpoints in the cluster's folder, vectorised words, hashes and per-document spans."""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: UTF-8 text handled at once by one Python task (a longer text is a chunk of its own).
CHUNK_BYTES = 2_000_000

SPACE = frozenset([0x20, *range(0x09, 0x0E)])
#: Byte classes: what is a word byte (bytes over 0x7F belong to non-ASCII characters, which are word characters).
NONSPACE = np.array([b not in SPACE for b in range(256)])
ALNUM = np.array([chr(b).isalnum() if b < 0x80 else True for b in range(256)])
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint8)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.  Where it is unset, a local session gets a temporary folder; a cluster must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="quarry-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of finished intermediate data."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or it with underscores, so that no column of ``df`` has it (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def partitions(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    bounds = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if len(column) == 0 or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(column.buffers()[2], dtype=np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def chunks(bounds: np.ndarray, size: int = CHUNK_BYTES):
    """Row ranges (a, b) whose texts have about ``size`` bytes together."""
    a, n = 0, len(bounds) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + size, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def word_spans(data: np.ndarray, bounds: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in ``data`` and the first word of every text (with the total at the end)."""
    inside = np.zeros(len(data) + 1, dtype=bool)
    inside[:-1] = kind[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[bounds] = True
    before = np.zeros_like(inside)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (edge | ~before))
    ends = np.flatnonzero(before & (edge | ~inside))
    return starts, ends, np.searchsorted(starts, bounds)


#: Bytes of a span that are hashed at once; longer spans go by pieces.
PIECE = 4096
_FACTORS = np.random.default_rng(20240611).integers(1, 2**63, PIECE, dtype=np.uint64) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads them."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans that do not overlap: a multilinear hash, then ``mix``; pieces of a long span are joined."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    if int(size.max()) > PIECE:
        out, long = np.empty(len(starts), np.uint64), size > PIECE
        out[~long] = hash_spans(data, starts[~long], ends[~long])
        for k in np.flatnonzero(long).tolist():
            cut = np.arange(int(starts[k]), int(ends[k]), PIECE, dtype=np.int64)
            part = hash_spans(data, cut, np.append(cut[1:], ends[k]))
            # sums of pieces with factors by place, so that the pieces are hashed like the bytes of a span
            while len(part) > 1:
                part = np.array([mix((g * _FACTORS[: len(g)]).sum(keepdims=True) + np.uint64(len(g)))[0] for g in np.split(part, range(PIECE, len(part), PIECE))], np.uint64)
            out[k] = join_hash(part, size[k : k + 1].astype(np.uint64))[0]
        return out
    first = np.cumsum(size) - size
    rel = np.arange(int(size.sum()), dtype=np.int64) - np.repeat(first, size)
    at = rel + np.repeat(starts, size)
    sums = np.add.reduceat((data[at].astype(np.uint64) + np.uint64(1)) * _FACTORS[rel], first)
    return mix(sums + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def join_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of an ordered pair of hashes."""
    return mix(a * np.uint64(0xD6E8FEB86659FD93) + (b ^ np.uint64(0xA5A5A5A5A5A5A5A5)))


def crc_mod(doc_id: str, mod: int):
    """crc32 of the id written as text, modulo ``mod``; null ids give null."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % F.lit(mod)
