"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, out: Scratch) -> DataFrame:
    """``node``, ``root`` for each node of ``edges`` (a, b: non-null longs); the root is the
    smallest node of its component. The result is a table of the run ``out``.

    Alternating large-star and small-star steps (Kiveris et al., 2014): each is a minimum per
    node, combined before the shuffle, and an equi-join, so that a node with a third of all
    edges is split by the skew join. A step's result is written to the shared folder; about
    log(n) rounds end with one star per component. Nothing is collected but two sums.
    """
    spark = edges.sparkSession
    with Scratch(spark) as run:
        found = run.table(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
        state = None
        while True:
            now = tuple(found.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())
            if now == state or not now[0]:
                break
            state = now
            both = found.union(found.select("v", "u"))
            least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
            large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
            least = large.groupBy("u").agg(F.min("v").alias("m"))
            small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
            found = run.table(small.where("u <> v").distinct(), "edges")
        stars = found.select(F.col("u").alias("node"), F.col("v").alias("root"))
        return out.table(stars.union(found.select("v", "v").distinct()), "roots")
