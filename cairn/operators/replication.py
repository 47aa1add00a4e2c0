"""Replication and repair: how often chunks are held, what to copy, and what servers should do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .routing import known_place, ranked

#: Characters of a hash that are sorted first.
BEGIN = 16


def counts(placement: DataFrame, required: int, by: str = "hash") -> DataFrame:
    """hash, n and enough: on how many servers each chunk is. A shorter key than the hash, named in by, takes less memory."""
    return placement.groupBy(by).agg(F.count_distinct("host").alias("n")).withColumn("enough", F.col("n") >= required)


def plan(placement: DataFrame, candidates: DataFrame, required: int) -> DataFrame:
    """hash and host to copy to: candidates (hash, host, in_span) not holding a chunk, those in span first, until enough."""
    short = counts(placement, required).where("NOT enough").select("hash", (required - F.col("n")).alias("lack"))
    free = candidates.join(placement.select("hash", "host"), ["hash", "host"], "left_anti").join(short, "hash")
    turn = F.row_number().over(W.partitionBy("hash").orderBy(F.desc("in_span"), "host"))
    return free.withColumn("turn", turn).where("turn <= lack").select("hash", "host", "in_span")


def capacity_share(servers: DataFrame, capacity: str = "capacity") -> DataFrame:
    """servers with share: their part of all capacity. Servers are few."""
    return servers.withColumn("share", F.col(capacity) / F.sum(capacity).over(W.partitionBy()))


def plan_copies(placement: DataFrame, keys: DataFrame, servers: DataFrame, required: int) -> DataFrame:
    """hash, host and in_span of copies to make for chunks on fewer than required servers: first to servers with the chunk in their span, then to others, by name.

    A chunk that lacks copies is on fewer than required servers, so the first `required` servers at its place are enough to choose from.
    """
    have = placement.groupBy("hash").agg(F.collect_set("host").alias("have")).withColumn("lack", required - F.size("have")).where("lack > 0")
    hosts = servers.select("host").where("host IS NOT NULL").distinct()
    lists = ranked(hosts, servers.select("host", "first", "last"), F.lit(0), F.lit(1), ["host"], required)
    lists = lists.groupBy("place").agg(F.array_sort(F.collect_list(F.struct("rank", "host", (F.col("tier") == 0).alias("in_span")))).alias("list"))
    j = have.join(keys.select("hash", known_place().alias("place")).distinct(), "hash").join(F.broadcast(lists), "place")
    picked = F.slice(F.filter("list", lambda s: ~F.array_contains("have", s["host"])), F.lit(1), F.col("lack"))
    return j.select("hash", F.explode(picked).alias("s")).select("hash", "s.host", "s.in_span")


def heal_page(
    remote: DataFrame, local: DataFrame, cursors: DataFrame, first: int, last: int, limit: int,
    by: str = "hash", hashed: Column | None = None, begins: Column | None = None, known: bool = False, tasks: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The next chunks to heal from each server (host and hash), and the cursors after them.

    remote: host, hash, place; cursors: host and after (the last hash looked at; null or none: from the start). A page is the next `limit`
    hashes of a host in the own span; what is held already is looked at, not fetched. A host whose page is not full starts over, and so does one without a
    page, which has no cursor. known: only hosts with a cursor are asked. tasks: how many tasks to deal hosts to, where the session's partitions are too few.

    A shorter key, named in by, may stand for the hash in remote and local; hashed makes the hash from it, begins a text that a hash begins with. Then keys are
    sent and sorted by that text alone, and hashes made of what may be on a page.
    """
    whole = F.col("hash") if hashed is None else hashed
    begin = F.substring(whole if begins is None else begins, 1, BEGIN)
    near = remote.where(F.col("place").between(first, last) & F.col("host").isNotNull()).select("host", by)
    near = (near.repartition("host") if tasks is None else near.repartition(tasks, "host")).distinct().withColumn("_begin", begin)
    at = F.substring("after", 1, BEGIN)
    own = near.join(cursors.select("host", "after"), "host", "inner" if known else "left")
    own = own.where(F.col("after").isNull() | (F.col("_begin") > at) | (F.col("_begin") == at) & (whole > F.col("after")))
    # Fewer than limit beginnings come before that of any hash on the page; hashes that begin alike are told apart after that.
    own = own.withColumn("_n", F.rank().over(W.partitionBy("host").orderBy("_begin"))).where(F.col("_n") <= limit).select("host", by, whole.alias("_hash"))
    page = own.withColumn("_n", F.row_number().over(W.partitionBy("host").orderBy("_hash"))).where(F.col("_n") <= limit)
    ends = page.groupBy("host").agg(F.max("_hash").alias("end"), F.count("*").alias("n"))
    moved = ends.select("host", F.when(F.col("n") >= limit, F.col("end")).alias("after"))
    lacking = page.select("host", by).join(local.select(by), by, "left_anti")
    return lacking.select("host", whole.alias("hash")), moved


def delete_everywhere(placement: DataFrame, gone: DataFrame, reachable: DataFrame) -> tuple[DataFrame, DataFrame]:
    """placement after a delete of hashes on all servers, and what is left to retry: copies on servers that were not reachable."""
    hit = placement.join(gone.select("hash").distinct(), "hash", "left_semi")
    retry = hit.join(reachable.select("host"), "host", "left_anti").select("hash", "host")
    kept = placement.join(gone.select("hash").distinct(), "hash", "left_anti").select("hash", "host")
    return kept.unionByName(retry), retry


def heal(remote: DataFrame, local: DataFrame, first: int, last: int) -> DataFrame:
    """Remote hashes in the own target span that are not held here."""
    return remote.where(F.col("place").between(first, last)).select("hash").distinct().join(local.select("hash"), "hash", "left_anti")


def holders(servers: DataFrame, placement: DataFrame, hash_value, without: bool = False) -> DataFrame:
    """Servers that hold a chunk, or do not."""
    own = placement.where(F.col("hash") == hash_value).select("host")
    return servers.join(own, "host", "left_anti" if without else "left_semi")


def drain(placement: DataFrame, target_spans: DataFrame) -> DataFrame:
    """host and hash of chunks outside their server's target spans."""
    spans = target_spans.select("host", "first", "last")
    inside = placement.join(spans, "host").where("place BETWEEN first AND last").select("host", "hash")
    return placement.select("host", "hash").join(inside, ["host", "hash"], "left_anti")


def repair(bad: DataFrame, placement: DataFrame, corrupt_at: DataFrame) -> DataFrame:
    """hash, host of a damaged chunk and the source to copy it from: the first other holder that is not damaged too."""
    good = placement.join(corrupt_at, ["hash", "host"], "left_anti").groupBy("hash").agg(F.min("host").alias("source"))
    return bad.join(good, "hash", "left")


def balance(directories: DataFrame, difference: int = 15, used: int = 60) -> DataFrame:
    """Per server: fullest and emptiest directory, and whether to move data between them."""
    pct = directories.withColumn("pct", F.floor(F.col("used") * 100 / F.col("size_limit")).cast("int"))
    out = pct.groupBy("host").agg(
        F.max("pct").alias("most_pct"), F.min("pct").alias("least_pct"),
        F.min(F.struct((-F.col("pct")).alias("k"), "directory"))["directory"].alias("most"),
        F.min(F.struct(F.col("pct").alias("k"), "directory"))["directory"].alias("least"),
    )
    return out.withColumn("move", (F.col("most_pct") - F.col("least_pct") >= difference) & (F.col("most_pct") >= used))


def disk_state(directories: DataFrame) -> DataFrame:
    """Per server LOW, NORMAL or HIGH: any directory over 90 % or a mean over 80 % is HIGH, a mean under 30 % LOW."""
    pct = directories.withColumn("pct", F.floor(F.col("used") * 100 / F.col("size_limit")).cast("int"))
    agg = pct.groupBy("host").agg(F.max("pct").alias("top"), F.floor(F.sum("pct") / F.count("*")).cast("int").alias("mean_pct"))
    state = F.when((F.col("top") > 90) | (F.col("mean_pct") > 80), "HIGH").when(F.col("mean_pct") < 30, "LOW").otherwise("NORMAL")
    return agg.select("host", "mean_pct", state.alias("state"))
