"""Mixing sources to target weights by Pfair scheduling.

Each source's documents, in a seeded random order, are cut into blocks of about equal text. Block i (from 0) of
a source with weight w may not start before slot floor(i / w) and must be out by slot ceil((i + 1) / w);
in each slot the released block with the earliest deadline goes next. So at every slot each source is less
than one block away from its share, for as long as all sources last; rows past that point keep the same rule
and are marked.

Weights are exact fractions (as decimals read), and releases and deadlines are whole-number arithmetic, so no
rounding adds up. Scaled to coprime whole numbers with the sum T, the schedule repeats every T slots. Where T is PERIOD
or less, one period is laid out once and all blocks find their slot from it by a broadcast join. Finer weights are
laid out block by block on the driver, streamed into a written table and joined; which of the two depends on
the weights alone. Running totals per source are made in two levels (slices of a source, then offsets of
slices), so a source with a third of all rows is spread over all tasks.

Edge cases: a null source is a source of its own; sources without a weight share the default weight;
null and empty texts take no room and go with the block they fall in; repeated rows are kept; the order hangs on doc_id and
text alone, so rows that share a doc_id, or have none, are spread as well, and where the rows lie changes nothing (rows alike in both
are interchangeable); an empty table gives an empty result; further columns are not read, but with_columns hands them on.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from fractions import Fraction
from itertools import islice
from math import ceil, floor, gcd, lcm

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import scratch_dir

BLOCK_CHARS = 65536
PERIOD = 4096
SLICE_ROWS = 20000
PLAN_ROWS = 1 << 17  # rows of the plan that are on the driver at once
PLAN = "source string, i long, at long"


def exact_weights(weights: dict[str | None, float]) -> dict[str | None, int]:
    """The weights as coprime whole numbers."""
    if min(weights.values()) <= 0:
        raise ValueError("weights must be positive")
    exact = {k: Fraction(str(v)) for k, v in weights.items()}
    scale = lcm(*(v.denominator for v in exact.values()))
    whole = {k: int(v * scale) for k, v in exact.items()}
    return {k: v // gcd(*whole.values()) for k, v in whole.items()}


def schedule(weights: dict[str | None, int], blocks: dict[str | None, int]) -> Iterator[tuple[str | None, int, int]]:
    """(source, block, slot) of so many blocks of each source, slot by slot: earliest deadline first among released blocks.

    A source's blocks follow each other, so one of each is looked at; slots in which none is released stay empty.
    """
    total = sum(weights.values())
    # str(None) may be a source's name as well, so the place among the sources decides last.
    waiting = [(0, str(k), n, k) for n, k in enumerate(weights) if blocks[k]]
    heapq.heapify(waiting)
    ready: list[tuple] = []
    at, slot = dict.fromkeys(weights, 0), 0
    while waiting or ready:
        slot = slot if ready else max(slot, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            _, name, n, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(at[k] + 1) * total // weights[k]), name, n, k))
        deadline, name, n, k = heapq.heappop(ready)
        assert deadline > slot
        yield k, at[k], slot
        at[k] += 1
        slot += 1
        if at[k] < blocks[k]:
            heapq.heappush(waiting, (at[k] * total // weights[k], name, n, k))


def whole_weights(weights: dict[str | None, float], period: int = PERIOD) -> dict[str | None, int]:
    """Slots of each source in a period of fixed length, rounded: largest remainders, one at least. mixing() does not round."""
    total = sum(weights.values())
    if len(weights) > period or min(weights.values()) <= 0:
        raise ValueError("weights must be positive, and no more than the period's slots")
    exact = {k: v / total * period for k, v in weights.items()}
    out = {k: max(1, floor(v)) for k, v in exact.items()}
    order = sorted(exact, key=lambda k: (floor(exact[k]) - exact[k], str(k)))
    while (gap := period - sum(out.values())) > 0:
        for k in order[:gap]:
            out[k] += 1
    while (gap := sum(out.values()) - period) > 0:
        for k in sorted(out, key=lambda k: (-out[k], str(k)))[:gap]:
            out[k] -= out[k] > 1
    return out


def _before(df: DataFrame, slices: Column, value: str, order: list) -> DataFrame:
    """df with `before`: the sum of value over the rows of the same source that come before, in two levels.

    A null source is told apart by a flag, so that the window and the join share one shuffle.
    """
    df = df.withColumns({"slice": slices, "none": F.col("source").isNull(), "name": F.coalesce("source", F.lit(""))})
    group = ["none", "name"]
    sums = df.groupBy(*group, "slice").agg(F.sum(value).alias("s"))
    offsets = sums.select(*group, "slice", (F.sum("s").over(W.partitionBy(*group).orderBy("slice")) - F.col("s")).alias("offset"))
    own = F.sum(value).over(W.partitionBy(*group, "slice").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)) - F.col(value)
    out = df.withColumn("own", own).join(offsets, [*group, "slice"])
    return out.withColumn("before", F.col("own") + F.col("offset")).drop("own", "offset", *group)


def _written(spark: SparkSession, laid: Iterator[tuple[str | None, int, int]], last: dict[str | None, int]) -> tuple[DataFrame, list[int]]:
    """The plan as a written table, and the slot of each source's last block."""
    path, ends = f"{scratch_dir(spark)}-plan", []
    while part := list(islice(laid, PLAN_ROWS)):
        spark.createDataFrame(part, PLAN).write.mode("append").parquet(path)
        ends += [slot for s, i, slot in part if i == last[s]]
    return spark.read.schema(PLAN).parquet(path), ends


def mixing(
    docs: DataFrame,
    weights: dict[str | None, float] | None = None,
    default_weight: float = 1.0,
    block_chars: int = BLOCK_CHARS,
    period: int = PERIOD,
    slice_rows: int = SLICE_ROWS,
    seed: int = 17,
    with_columns: bool = False,
) -> DataFrame:
    """doc_id, source, block (of the source), slot (of the block in the mix) and on_target of each row; with_columns: also all, a struct of the row."""
    spark = docs.sparkSession
    rows = docs.select(
        F.col("doc_id").cast("long"),
        F.col("source").cast("string"),
        F.length(F.coalesce("text", F.lit(""))).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), "doc_id", "text").alias("order"),
        *([F.struct("*").alias("all")] if with_columns else []),
    )
    # One row for each source comes to the driver, which lays out their turns; the mix has as many sources as it has weights.
    counts = rows.groupBy("source").agg(F.count("*").alias("count"), F.sum("size").alias("size")).collect()
    handed = ["a.all"] if with_columns else []
    if not counts:
        none = rows.select("doc_id", "source", *[F.lit(0).cast("long").alias(c) for c in ("block", "slot")], F.lit(True).alias("on_target"), *(["all"] if with_columns else []))
        return none.where("false")
    slices = max(1, -(-max(r["count"] for r in counts) // slice_rows))
    each = exact_weights({r["source"]: (weights or {}).get(r["source"], default_weight) for r in counts})
    total = sum(each.values())
    last = {r["source"]: max(0, r["size"] - 1) // block_chars for r in counts}
    if total <= period:
        laid = list(schedule(each, each))
        plan = F.broadcast(spark.createDataFrame(laid, PLAN))  # one period at most
        at = {(s, i): slot for s, i, slot in laid}
        end = min(b // each[s] * total + at[s, b % each[s]] for s, b in last.items())
        turns = each
    else:
        # Empty texts after a source's last full block begin one more.
        laid = schedule(each, {r["source"]: r["size"] // block_chars + 1 for r in counts})
        plan, ends = _written(spark, laid, last)
        end, total, turns = min(ends), 0, dict.fromkeys(each, 1 << 62)
    each_turn = spark.createDataFrame(list(turns.items()), "source string, each long")

    # Slices are ranges of the random order, so a source's order is slice by slice. 2**63 / slices wide each way.
    slice_of = F.floor((F.col("order") / 2.0**64 + 0.5) * slices).cast("long")
    placed = _before(rows, slice_of, "size", ["order", "doc_id", "size"])
    placed = placed.withColumn("block", F.floor(F.col("before") / block_chars).cast("long"))
    few = F.broadcast(each_turn) if len(each) <= period else each_turn
    left = placed.alias("a").join(few.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source"))).select("a.*", "b.each")
    left = left.withColumn("i", F.pmod("block", "each")).alias("a")
    on = F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.i") == F.col("b.i"))
    out = left.join(plan.alias("b"), on).select(
        "a.doc_id", "a.source", "a.block", *handed, (F.floor(F.col("a.block") / F.col("a.each")) * total + F.col("b.at")).cast("long").alias("slot")
    ).withColumn("on_target", F.col("slot") <= F.lit(end))
    return out.select("doc_id", "source", "block", "slot", "on_target", *(["all"] if with_columns else []))
