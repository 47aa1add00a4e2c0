"""Diagnostics: requests, progress, batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def host_extremes(requests: DataFrame) -> DataFrame:
    """Per host: longest and shortest request with its description; the first to come wins a tie."""
    top = F.min(F.struct((-F.col("millis")).alias("k"), "seq", "description", "millis"))
    low = F.min(F.struct(F.col("millis").alias("k"), "seq", "description", "millis"))
    out = requests.groupBy("host").agg(top.alias("a"), low.alias("b"))
    return out.select("host", F.col("a.millis").alias("longest"), F.col("a.description").alias("longest_what"), F.col("b.millis").alias("shortest"), F.col("b.description").alias("shortest_what"))


def request_stats(requests: DataFrame) -> DataFrame:
    """Per host and description: total, count and mean, cut to whole numbers."""
    out = requests.groupBy("host", "description").agg(F.sum("millis").alias("total"), F.count("*").alias("n"))
    return out.withColumn("mean", F.floor(F.col("total") / F.col("n")).cast("long"))


def mean_of_means(requests: DataFrame) -> DataFrame:
    """Per description the unweighted mean of the hosts' means, cut at each level."""
    return request_stats(requests).groupBy("description").agg(F.floor(F.sum("mean") / F.count("*")).cast("long").alias("mean"))


def conditional_counts(rows: DataFrame, by: list[str], tests: dict[str, Column]) -> DataFrame:
    """Per group, how many rows pass each test."""
    return rows.groupBy(*by).agg(*[F.count_if(t).alias(name) for name, t in tests.items()])


def share(rows: DataFrame, by: str, value: Column) -> DataFrame:
    """Per group: total and tenths of a percent of everything, cut. Groups are few where shares are read."""
    out = rows.groupBy(by).agg(F.sum(value).alias("total"))
    return out.withColumn("permille", F.floor(F.col("total") * 1000 / F.sum("total").over(W.partitionBy())).cast("long"))


def latency(sends: DataFrame, answers: DataFrame) -> DataFrame:
    """Sends with their answers by callback id: millis and a description marked (up) or, for failures, (down)."""
    j = sends.join(answers, "callback")
    mark = F.when(F.col("ok"), " (up)").otherwise(" (down)")
    return j.select("callback", "host", F.concat("description", mark).alias("description"), (F.col("answer_ts") - F.col("send_ts")).alias("millis"))


def eta_overall(elapsed: Column, percent: Column) -> Column:
    """Millis left at the rate so far; null before any progress."""
    return F.when(percent > 0, F.floor(elapsed * (100 - percent) / percent)).cast("long")


def eta_contextual(progress: DataFrame, by: str, total: Column, seconds: int = 60) -> DataFrame:
    """Per group and window: done so far and millis left at the last window's rate; null where it made no progress."""
    own = progress.groupBy(by, F.window("ts", f"{seconds} seconds").alias("w")).agg(F.sum("amount").alias("amount"))
    upto = F.sum("amount").over(W.partitionBy(by).orderBy("w").rowsBetween(W.unboundedPreceding, 0))
    last = F.lag("amount").over(W.partitionBy(by).orderBy("w"))
    out = own.select(by, F.col("w.start").alias("start"), upto.alias("done"), last.alias("last"))
    return out.withColumn("left", F.when(F.col("last") > 0, F.floor(F.greatest(F.lit(0), total - F.col("done")) * seconds * 1000 / F.col("last"))).cast("long"))


def outstanding(sends: DataFrame, answers: DataFrame) -> DataFrame:
    """host and n: requests of each server that have no answer yet, 0 where all have."""
    open_ = sends.join(answers.select("callback"), "callback", "left_anti").groupBy("host").agg(F.count("*").alias("n"))
    return sends.select("host").distinct().join(open_, "host", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def totals(rows: DataFrame, by: str, size: Column, failed: Column, time: str) -> DataFrame:
    """Per group: files, bytes, failed and elapsed (from the first to the last)."""
    return rows.groupBy(by).agg(F.count("*").alias("files"), F.sum(size).alias("bytes"), F.count_if(failed).alias("failed"), (F.max(time) - F.min(time)).alias("elapsed"))


def batches(rows: DataFrame, by: str, order: list[str], size: str, most_bytes: int, most_rows: int, time: str | None = None, most_ms: int = 0) -> DataFrame:
    """Greedy batches in order: a batch is flushed once it holds most_bytes or most_rows, or (with time, in millis) its rows span most_ms.

    A group's rows pass one task in order; only the open batch is held, and one row leaves for each finished one.
    """
    own = rows.select(by, *order, F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("_size"), F.col(size).isNull().alias("_null"), (F.col(time) if time else F.lit(0)).cast("long").alias("_ms"))
    dealt = own.repartition(by).sortWithinPartitions(by, *order).select(by, "_size", "_null", F.coalesce("_ms", F.lit(0)).alias("_ms"))
    kind = own.schema[by].dataType.simpleString()

    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # A missing size makes the open batch's bytes unknown, so that only its rows can end it; known sizes are summed.
        host, batch, n, total, known, unknown, started, begin, last = None, 0, 0, 0, 0, False, False, 0, 0
        columns = [by, "batch", "n", "bytes"]
        for pdf in parts:
            out = []
            hosts = pdf[by].astype(object).where(pdf[by].notna(), None)
            for h, x, null, ms in zip(hosts, pdf["_size"].tolist(), pdf["_null"].tolist(), pdf["_ms"].tolist(), strict=True):
                if not started or h != host:
                    if started:
                        out.append((host, batch, n, total if known else None))
                    host, batch, n, total, known, unknown, started, begin = h, 0, 0, 0, 0, False, True, ms
                elif n >= most_rows or (not unknown and total >= most_bytes) or (time is not None and last - begin >= most_ms):
                    out.append((host, batch, n, total if known else None))
                    batch, n, total, known, unknown, begin = batch + 1, 0, 0, 0, False, ms
                last = ms
                n, total, known, unknown = n + 1, total + x, known + (not null), unknown or null
            yield pd.DataFrame(out, columns=columns).astype({"bytes": "Int64"})
        if started:
            yield pd.DataFrame([(host, batch, n, total if known else None)], columns=columns).astype({"bytes": "Int64"})

    return dealt.mapInPandas(fold, f"`{by}` {kind}, batch int, n long, bytes long")
