"""Who may do what: users, hosts, nonces, checked writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashing import content_hash
from ..functions.scalars import has_flag

# Bits of a user's rights.
RIGHTS = {"set_data": 1, "set_meta": 2, "delete_data": 4, "delete_meta": 8, "set_configuration": 16}
NONCES = 10000  # that a server keeps; older ones are dropped


def permissions(users: DataFrame, at: Column) -> DataFrame:
    """users (flags, valid_from, valid_to) with valid at a time (ends inclusive) and each right, which an invalid certificate does not give."""
    valid = at.between(F.col("valid_from"), F.col("valid_to"))
    out = users.withColumn("valid", F.coalesce(valid, F.lit(False)))
    return out.withColumns({f"may_{name}": F.col("valid") & has_flag(F.col("flags"), bit) for name, bit in RIGHTS.items()})


def recognised(certificates: DataFrame, users: DataFrame) -> DataFrame:
    """certificates (subject, issuer, digest) with user: the one with the same name and bytes, else the one who issued it; null if neither."""
    own = users.select(F.col("name").alias("subject"), "digest", F.col("name").alias("_own")).distinct()
    issuers = users.select(F.col("name").alias("issuer"), F.col("name").alias("_issuer")).distinct()
    j = certificates.join(own, ["subject", "digest"], "left").join(issuers, "issuer", "left")
    how = F.when(F.col("_own").isNotNull(), "own").when(F.col("_issuer").isNotNull(), "issuer")
    return j.withColumn("user", F.coalesce("_own", "_issuer")).withColumn("how", how).drop("_own", "_issuer")


def allowed_hosts(rows: DataFrame, banned: DataFrame, startup: DataFrame | None = None) -> DataFrame:
    """rows whose host (without case) is not banned, with startup: whether it is one of the servers that are tried first."""
    key = F.lower(F.trim("host"))
    out = rows.withColumn("_key", key).join(banned.select(key.alias("_key")).distinct(), "_key", "left_anti")
    if startup is not None:
        out = out.join(startup.select(key.alias("_key"), F.lit(True).alias("startup")).distinct(), "_key", "left").withColumn("startup", F.coalesce("startup", F.lit(False)))
    return out.drop("_key")


def accepted_nonces(log: DataFrame, limit: int = NONCES) -> DataFrame:
    """Uses of nonces with accepted: a nonce is good once, after its issue, and until `limit` newer ones were issued by the same host.

    log: host, nonce, kind (issue or use), seq (the order of a host's log). A host's log is one sorted pass.
    """
    w = W.partitionBy("host").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    counted = log.withColumn("issued", F.count_if(F.col("kind") == "issue").over(w))
    n = W.partitionBy("host", "nonce").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    last_issue = F.max(F.when(F.col("kind") == "issue", F.struct("seq", "issued"))).over(n)
    last_use = F.max(F.when(F.col("kind") == "use", F.col("seq"))).over(n)
    out = counted.withColumns({"_issue": last_issue, "_use": last_use}).where("kind = 'use'")
    fresh = F.col("_use").isNull() | (F.col("_use") < F.col("_issue.seq"))
    good = F.col("_issue").isNotNull() & fresh & (F.col("issued") - F.col("_issue.issued") < limit)
    return out.select("host", "nonce", "seq", F.coalesce(good, F.lit(False)).alias("accepted"))


def checked_insert(stored: DataFrame, incoming: DataFrame, users: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows to append, each hash once, and errors (hash, user, reason) of those refused.

    What is stored already is ignored without an error. Else the user must be known, valid and allowed to set data, and the bytes must have the hash.
    """
    rights = users.select("user", "valid", "may_set_data", F.lit(True).alias("known"))
    new = incoming.join(stored.select("hash"), "hash", "left_anti").join(rights, "user", "left")
    reason = (
        F.when(F.col("known").isNull(), "unknown user").when(~F.col("valid"), "certificate not valid").when(~F.col("may_set_data"), "no right to set data")
        .when(~content_hash(F.col("chunk")).eqNullSafe(F.col("hash")), "hash does not match")
    )
    judged = new.withColumn("reason", reason)
    good = judged.where("reason IS NULL").groupBy("hash").agg(F.min("chunk").alias("chunk"))
    return good, judged.where("reason IS NOT NULL").select("hash", "user", "reason")


def replaced_configuration(current: DataFrame, proposed: DataFrame, users: DataFrame, user: str) -> DataFrame:
    """The configuration (key, value) after a user's proposal: theirs where they may set it, else the current one."""
    may = users.where((F.col("user") == user) & F.col("may_set_configuration")).select(F.lit(True).alias("may")).limit(1)
    both = current.select("key", "value", F.lit(False).alias("new")).unionByName(proposed.select("key", "value", F.lit(True).alias("new")))
    allowed = not may.isEmpty()
    return both.where(F.col("new") == allowed).drop("new")


def no_nulls(values: Column) -> Column:
    return ~F.exists(values, lambda x: x.isNull())


def no_duplicates(values: Column) -> Column:
    return F.size(F.array_distinct(values)) == F.size(values)


def tag_values(text: Column) -> Column:
    """Lines of "name: value" as a map; values have line ends as tags. Of names that come twice the last counts."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.instr(x, ": ") > 0)
    pairs = F.transform(lines, lambda x: F.struct(F.substring_index(x, ": ", 1).alias("k"), F.replace(F.substring(x, F.instr(x, ": ") + 2, F.length(x)), F.lit("<<NL>>"), F.lit("\n")).alias("v")))
    last = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda y: y["k"] == x["k"]))
    return F.map_from_entries(last)


def tag_text(values: Column) -> Column:
    """A map as lines of "name: value", sorted by name."""
    entries = F.array_sort(F.map_entries(values))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit(": "), F.replace(e["value"], F.lit("\n"), F.lit("<<NL>>")))), "\n")
