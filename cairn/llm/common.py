"""Helpers that several operators share: scratch tables, columns, byte classes."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import new_folder as scratch_dir

#: ASCII white space that separates words: \x20 and \x09-\x0D, which is also what bytes.split() cuts at.
SPACES = " \t\n\x0b\x0c\r"
#: A-Z to a-z, every other byte unchanged.
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


_MADE: ContextVar[tuple[list[str], ...]] = ContextVar("_MADE", default=())


def drop_shuffles(spark: SparkSession) -> None:
    """Have Spark's cleaner delete the shuffle files of finished jobs now; by itself it waits until the driver collects garbage."""
    spark._jvm.System.gc()


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written within are deleted as soon as it is, whenever the driver collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Tables written within are deleted at the end, but for those written with keep: what leaves must be one of these."""
    token = _MADE.set((*_MADE.get(), made := []))
    try:
        yield
    finally:
        _MADE.reset(token)
        for path in made:
            there = spark._jvm.org.apache.hadoop.fs.Path(path)
            there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)
        drop_shuffles(spark)


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """df as a written Parquet table: its lineage ends here, lost executors lose nothing of it.

    keep: it outlives the innermost tidy() (but not the one around that).
    """
    path = f"{scratch_dir(df.sparkSession)}-{name}"
    stack = _MADE.get()[: -1 if keep else None]
    if stack:
        stack[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text ('' for null), with other columns asked for; all else is left unread."""
    return docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs as a written table in which each row has a number of its own, and the name of that column (none of docs' names)."""
    name = "row_key"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    return written(docs.select("*", F.monotonically_increasing_id().alias(name)), "keyed"), name


def exact_ids(docs: DataFrame) -> DataFrame:
    """docs with doc_id 0 and missing true where it is null: a batch with nulls would hold its ids as floats in pandas."""
    return docs.withColumn("missing", F.col("doc_id").isNull()).withColumn("doc_id", F.coalesce("doc_id", F.lit(0)))


def mix64(x: np.ndarray) -> np.ndarray:
    """A well-mixed 64-bit hash of each unsigned 64-bit number (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def runs(lengths: np.ndarray) -> np.ndarray:
    """0..n-1 for each length n, one after another."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)


def packed(x: np.ndarray) -> bytes:
    """An integer array as compressed bytes: byte by byte plane, so that small and sorted numbers shrink."""
    import zstandard

    x = np.ascontiguousarray(x)
    planes = x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes() if len(x) else b""
    return zstandard.ZstdCompressor(level=3).compress(planes)


def unpacked(data: bytes, kind) -> np.ndarray:
    import zstandard

    kind = np.dtype(kind)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(kind.itemsize, -1).T).view(kind).ravel()


def slices(pdf, size: int):
    """Consecutive parts of a batch with about size characters of text each, so that work arrays stay small."""
    for _, part in pdf.groupby(pdf["text"].str.len().cumsum().to_numpy() // size, sort=False):
        yield part
