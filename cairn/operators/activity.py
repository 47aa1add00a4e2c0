"""The activity log: ts (epoch millis), action, user_id, hash. Append-only, ordered by ts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import mask_matches

# Action codes.
SET_DATA, SET_META, DELETE_DATA, DELETE_META, REPLACE_META, ANY = 33, 34, 65, 66, 50, 16
SET, DELETE = 32, 64


def between(log: DataFrame, start: int, end: int, mask: int = ANY) -> DataFrame:
    """Entries of a time range (both ends inclusive; a start of 0 or less means from the first) that match the mask."""
    if start > end:
        raise ValueError("start is after end")
    return log.where(F.col("ts").between(max(start, 0), end) & mask_matches(F.col("action"), mask))


def read(log: DataFrame, start: int, end: int, limit: int, mask: int = ANY) -> DataFrame:
    """The first entries of a range, by time."""
    return between(log, start, end, mask).orderBy("ts", "event_id").limit(limit)


def contains(log: DataFrame, wanted: DataFrame) -> DataFrame:
    """Wanted rows (ts, action, hash) that the log has."""
    return wanted.join(log.select("ts", "action", "hash"), ["ts", "action", "hash"], "left_semi")


def replay_deletes(log: DataFrame, since: int, until: int, held: DataFrame, users: DataFrame) -> DataFrame:
    """hash and ts of deletes since a server was last seen, by users who may, of chunks held here; the latest each."""
    may = users.where("may_delete").select("user_id")
    own = between(log, since, until, DELETE).join(may, "user_id", "left_semi").join(held.select("hash"), "hash", "left_semi")
    return own.groupBy("hash").agg(F.max("ts").alias("ts"))


def with_signers(log: DataFrame, signers: DataFrame, key: str) -> DataFrame:
    """Entries with who signed them, looked up by the key that both have."""
    return log.join(signers, key)


def append(log: DataFrame, new: DataFrame, now: int) -> DataFrame:
    """New entries (host, seq and what they hold) as a host's log takes them: ts rises with each and is not before now or the log's last entry; index goes on
    from the log's last one. A host's new entries are one sorted pass."""
    ends = log.groupBy("host").agg(F.max("ts").alias("_ts"), F.max("index").alias("_index"))
    turn = F.row_number().over(W.partitionBy("host").orderBy("seq"))
    j = new.withColumn("_turn", turn).join(ends, "host", "left")
    ts = F.greatest(F.lit(now).cast("long"), F.coalesce(F.col("_ts") + 1, F.lit(0))) + F.col("_turn") - 1
    return j.withColumns({"ts": ts, "index": F.coalesce("_index", F.lit(-1)) + F.col("_turn")}).drop("_turn", "_ts", "_index")


def replay_adds(log: DataFrame, since: int, until: int, held: DataFrame, first: int, last: int, users: DataFrame | None = None, source: DataFrame | None = None) -> DataFrame:
    """hash and ts of additions since then that lie in the own span and are not held yet; with users, only by those who may set data; with source, only what
    the other server still holds."""
    own = between(log, since, until, SET).where(F.col("place").between(first, last)).join(held.select("hash"), "hash", "left_anti")
    if users is not None:
        own = own.join(users.where("may_set").select("user_id"), "user_id", "left_semi")
    if source is not None:
        own = own.join(source.select("hash"), "hash", "left_semi")
    return own.groupBy("hash").agg(F.max("ts").alias("ts"))
