"""Cut content into chunks, store each once, and put it together again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashing import content_hash

CHUNK = 1024


def cut(files: DataFrame, key: str, text: str, size: int = CHUNK) -> DataFrame:
    """key, pos and chunk: consecutive pieces of size characters; an empty text has one empty chunk."""
    n = F.greatest(F.lit(1), F.ceil(F.length(text) / size)).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.col(text), i * size + 1, F.lit(size)))
    return files.where(F.col(text).isNotNull()).select(key, F.posexplode(pieces).alias("pos", "chunk"))


def store(chunks: DataFrame) -> DataFrame:
    """hash and chunk of each distinct chunk."""
    return chunks.withColumn("hash", content_hash(F.col("chunk"))).groupBy("hash").agg(F.first("chunk").alias("chunk"))


def reassemble(parts: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """key, text and n_chunks from parts (key, pos, hash) and stored chunks; text is null while a chunk is missing.

    One file's chunks meet in one row, which is as large as the file itself.
    """
    joined = parts.select(key, "pos", "hash").join(stored.select("hash", "chunk"), "hash", "left")
    put = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "chunk"))), lambda x: x["chunk"]), "")
    whole = F.count("*") == F.count("chunk")
    return joined.groupBy(key).agg(F.when(whole, put).alias("text"), F.count("*").alias("n_chunks"))


def offsets(chunks: DataFrame, key: str) -> DataFrame:
    """The place in its file where each chunk begins, in bytes."""
    before = W.partitionBy(key).orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    size = F.octet_length("chunk").cast("long")
    return chunks.withColumn("size", size).withColumn("offset", F.coalesce(F.sum("size").over(before), F.lit(0)))


def partitions_needed(size: Column, partition_size: Column) -> Column:
    return F.when(partition_size <= 0, 1).otherwise(F.greatest(F.lit(1), F.ceil(size / partition_size))).cast("long")


def corrupt(stored: DataFrame, data: str = "chunk") -> DataFrame:
    """Rows whose bytes do not have the hash they are stored under."""
    return stored.where(~content_hash(F.col(data)).eqNullSafe(F.col("hash")))


def insert_new(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming rows (hash, chunk) to append: valid ones that are not stored yet, each once."""
    valid = incoming.where(content_hash(F.col("chunk")) == F.col("hash")).dropDuplicates(["hash"])
    return valid.join(stored.select("hash"), "hash", "left_anti")


def delete(stored: DataFrame, gone: DataFrame) -> DataFrame:
    """Stored rows without those of deleted hashes."""
    return stored.join(gone.select("hash").distinct(), "hash", "left_anti")


def with_prefix(stored: DataFrame, prefix: str) -> DataFrame:
    """Stored rows whose hash begins with a prefix in hex, as it is typed."""
    return stored.where(F.col("hash").startswith(prefix.lower()))


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """hash, in_a and in_b of all hashes of two sets."""
    side = lambda df, x, y: df.select("hash", F.lit(x).alias("in_a"), F.lit(y).alias("in_b"))
    return side(a, True, False).unionByName(side(b, False, True)).groupBy("hash").agg(F.bool_or("in_a").alias("in_a"), F.bool_or("in_b").alias("in_b"))


def bag(*lists: DataFrame) -> DataFrame:
    """hash and n: how often each hash is in all lists together; nothing is made distinct."""
    every = lists[0].select("hash")
    for more in lists[1:]:
        every = every.unionByName(more.select("hash"))
    return every.groupBy("hash").agg(F.count("*").alias("n"))


def is_disjoint(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: whether no hash is in both."""
    return a.select("hash").join(b.select("hash"), "hash", "left_semi").agg((F.count("*") == 0).alias("disjoint"))


def fetch(keys: DataFrame, stored: DataFrame, *columns: str) -> DataFrame:
    """keys (ordinal, hash) with the stored columns, null where missing: a batched get."""
    return keys.join(stored.select("hash", *columns), "hash", "left")


def held(keys: DataFrame, stored: DataFrame) -> DataFrame:
    """keys (ordinal, hash) with a flag whether each is stored."""
    return keys.join(stored.select("hash", F.lit(True).alias("found")).distinct(), "hash", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def page(rows: DataFrame, order: list, offset: int, length: int) -> DataFrame:
    """A page of rows in a total order."""
    return rows.orderBy(*order).offset(max(0, offset)).limit(max(0, length))
