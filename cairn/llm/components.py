"""Connected components of a table of links, by rounds of contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(links: DataFrame) -> DataFrame:
    """node and component (its smallest node) for each node of links (columns a and b).

    In each round every node points to its smallest neighbour and links move to where their ends point; at least
    half of the nodes with links go, so rounds grow with the logarithm. Only the number of links left comes to
    the driver; each round's tables are written, so lost executors cost no more than that round.
    """
    left = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    left = written(left, "links")
    ends = F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other"))))
    labels = written(left.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node")), "labels")
    while not left.isEmpty():
        to = left.select(ends.alias("e")).select("e.*").groupBy("node").agg(F.min("other").alias("low")).where("low < node")
        to = _roots(written(to, "to"))
        labels = written(_moved(labels, "component", to), "labels")
        left = _moved(_moved(left, "a", to), "b", to).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        left = written(left.where("a < b").distinct(), "links")
    return labels.select("node", "component")


def _moved(df: DataFrame, column: str, to: DataFrame) -> DataFrame:
    """df with column replaced by where it points."""
    there = to.select(F.col("node").alias(column), "low")
    return df.join(there, column, "left").withColumn(column, F.coalesce("low", column)).drop("low")


def _roots(to: DataFrame) -> DataFrame:
    """Follow the pointers to their ends by doubling (they lead to ever smaller nodes, so they end)."""
    while True:
        next_ = to.select(F.col("node").alias("low"), F.col("low").alias("then"))
        step = to.join(next_, "low", "left")
        if step.where("then IS NOT NULL").isEmpty():
            return to
        to = written(step.select("node", F.coalesce("then", "low").alias("low")), "to")
