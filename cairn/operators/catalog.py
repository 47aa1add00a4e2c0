"""Catalogues: server status, uploaders of metadata, projects and their versions."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..scratch import written


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row of each key: the first in order."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def status_upsert(rows: DataFrame, keep_seq: bool = False) -> DataFrame:
    """Per host: the last update's row, the last response time of any row; an offline report wins whenever it came."""
    own = [c for c in rows.columns if c not in ("host", "response_ts", "online")]
    last = F.max_by(F.struct(*own), F.struct("update_ts", "seq")).alias("_last")
    out = rows.groupBy("host").agg(last, F.max("response_ts").alias("response_ts"), F.bool_and("online").alias("online"))
    return out.select("host", *[f"_last.{c}" for c in own if keep_seq or c != "seq"], "response_ts", "online")


def without_defunct(rows: DataFrame, now: int, threshold: int, connected: list[str] = ()) -> DataFrame:
    """Rows without servers that are offline, not core, not connected and last updated more than threshold before now; 0 keeps all."""
    if threshold <= 0:
        return rows
    gone = ~F.col("online") & ~F.col("is_core") & ~F.col("host").isin(list(connected)) & (F.lit(now) - F.col("update_ts") > threshold)
    return rows.where(~F.coalesce(gone, F.lit(False)))


def ring_groups(rows: DataFrame, own: str, size: int) -> DataFrame:
    """rows without the own host, with grp_no: groups of size in the ring of hosts that begins after it."""
    from .metadata import numbered

    others = rows.where(F.col("host") != own).withColumn("_turn", F.when(F.col("host") > own, 0).otherwise(1))
    return numbered(others, [F.col("_turn"), F.col("host")], "_n").withColumn("grp_no", F.floor((F.col("_n") - 1) / size).cast("long")).drop("_n", "_turn")


def status_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """host and change: added, removed, or updated with what it affects; unchanged hosts are left out."""
    a, b = old.alias("a"), new.alias("b")
    j = a.join(b, F.col("a.host") == F.col("b.host"), "full")
    link = ~F.col("a.flags").eqNullSafe(F.col("b.flags"))
    span = ~(F.col("a.first").eqNullSafe(F.col("b.first")) & F.col("a.last").eqNullSafe(F.col("b.last")))
    change = (
        F.when(F.col("a.host").isNull(), "added").when(F.col("b.host").isNull(), "removed")
        .when(link & span, "updated: connectivity, spans").when(link, "updated: connectivity").when(span, "updated: spans")
    )
    return j.select(F.coalesce("a.host", "b.host").alias("host"), change.alias("change")).where("change IS NOT NULL")


def host_portion(rows: DataFrame, start: str, end: str) -> DataFrame:
    """Hosts from start up to but without end, wrapping after the last; start = end gives all, from start on."""
    h = F.col("host")
    inside = ((h >= start) & (h < end)) if start < end else ((h >= start) | (h < end))
    return rows.where(inside).withColumn("turn", F.when(h >= start, 0).otherwise(1))


def merge_uploaders(old: DataFrame, new: DataFrame) -> DataFrame:
    """Existing uploaders stay; new ones with an unseen (hash, user, ts, path) are appended."""
    identity = ["hash", "user", "ts", "path"]
    both = old.withColumn("_from", F.lit(0)).unionByName(new.withColumn("_from", F.lit(1)))
    return latest(both, identity, [F.col("_from")]).drop("_from")


def delete_uploader(rows: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is left, and the hashes of which nothing is left."""
    identity = ["hash", "user", "ts", "path"]
    left = rows.join(gone.select(identity), identity, "left_anti")
    return left, rows.select("hash").distinct().join(left.select("hash"), "hash", "left_anti")


def select_uploader(rows: DataFrame, user: str, ts: int, path: str | None = None) -> DataFrame:
    """hash, n and state: one, none or ambiguous uploaders that match."""
    match = (F.col("user") == user) & (F.col("ts") == ts)
    match = match & (F.col("path") == path) if path is not None else match
    n = rows.groupBy("hash").agg(F.count_if(match).alias("n"))
    return n.withColumn("state", F.when(F.col("n") == 1, "one").when(F.col("n") == 0, "none").otherwise("ambiguous"))


def version_chain(versions: DataFrame) -> DataFrame:
    """root, id and depth: from each first version (nobody's next) along next, of any length."""
    first = versions.join(versions.select(F.col("next").alias("id")).where("id IS NOT NULL"), "id", "left_anti")
    edges = versions.where("next IS NOT NULL").select("id", "next")
    return _walk(first.select(F.col("id").alias("root"), "id"), edges)


def _walk(start: DataFrame, edges: DataFrame) -> DataFrame:
    """All walks from start, by doubling: each round jumps twice as far from all that was reached, so rounds grow with the logarithm."""
    jump, hops = written(edges), 1
    most = jump.count()
    walk = written(start.withColumn("depth", F.lit(0)))
    while True:
        step = written(walk.join(jump, "id").select("root", F.col("next").alias("id"), (F.col("depth") + hops).alias("depth")))
        if step.isEmpty():
            return walk
        if hops > most:
            raise ValueError("versions go round in a circle")
        walk = walk.unionByName(step)
        then = jump.select(F.col("id").alias("next"), F.col("next").alias("then"))
        jump, hops = written(jump.join(then, "next").select("id", F.col("then").alias("next"))), hops * 2


def request_depth(links: DataFrame, source: str) -> DataFrame:
    """node and depth: fewest hops from source over links (src, dst), level by level until none is new. Servers are few."""
    spark = links.sparkSession
    seen = spark.createDataFrame([(source, 0)], "node string, depth int")
    front = seen
    for depth in count(1):
        step = front.join(links, front["node"] == links["src"]).select(F.col("dst").alias("node")).distinct()
        front = step.join(seen, "node", "left_anti").withColumn("depth", F.lit(depth))
        front = written(front)
        if front.isEmpty():
            return seen
        seen = seen.unionByName(front)
        if depth % 16 == 0:  # the union stays short
            seen = written(seen)


def fastest(depths: DataFrame) -> DataFrame:
    """Requests with the least depth and those one hop longer."""
    least = F.min("depth").over(W.partitionBy("target"))
    return depths.withColumn("least", least).where("depth <= least + 1").drop("least")


def list_directory(names: DataFrame, path: str) -> DataFrame:
    """entry, kind and n of what lies right under a path: folders (with how many files below) and files."""
    own = names.where(F.col("name").startswith(path)).withColumn("rest", F.substring("name", F.lit(len(path) + 1), F.length("name")))
    kind = F.when(F.instr("rest", "/") > 0, "folder").otherwise("file")
    return own.groupBy(F.substring_index("rest", "/", 1).alias("entry"), kind.alias("kind")).agg(F.count("*").alias("n"))


def build_project(projects: DataFrame, chosen: DataFrame, license_name: str = "LICENSE") -> DataFrame:
    """Files (project, name, hash) chosen by (project, name) as one new project; licence files go, and a path that
    two files would share is flagged."""
    files = projects.join(chosen, ["project", "name"]).where(F.col("name") != license_name)
    return files.withColumn("collides", F.count("*").over(W.partitionBy("name")) > 1)
