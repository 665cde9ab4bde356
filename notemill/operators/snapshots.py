"""The feedback log's views, kept up to date: a summary that grows by what is new in the log instead of being made from all of it.

A summary has one row a surface, a pair of surface and proposal, and a proposal; all its columns are maxima, minima and sums, so
that summaries of any split of a log, merged in any order, are that of the whole log. Of two events with one ``seq``, which no log
should hold, the greater values count. Nulls are keys like any other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .feedback import _key

SUMMARY = "kind string, k1 string, k2 string, last struct<seq:long,a:string,b:string,accepted:boolean>, dead long, misses long, first_seq long"


def _grouped(rows: DataFrame) -> DataFrame:
    return rows.groupBy("kind", "k1", "k2").agg(F.max("last").alias("last"), F.max("dead").alias("dead"), F.sum("misses").alias("misses"), F.min("first_seq").alias("first_seq"))


def summary(log: DataFrame) -> DataFrame:
    """The summary of a log (or of a part of one): one pass, combined before the shuffle."""
    surface, text, long = _key("surface"), F.lit(None).cast("string"), F.lit(None).cast("long")
    yes, no = F.coalesce("accepted", F.lit(False)), F.coalesce(~F.col("accepted"), F.lit(False))
    told = no & F.col("correct").isNotNull()
    role = F.when(told, F.coalesce("corr_role", "role")).otherwise(F.col("role"))
    last = lambda a, b: F.struct(F.col("seq").cast("long").alias("seq"), a.alias("a"), b.alias("b"), F.col("accepted").alias("accepted"))
    row = lambda kind, k1, k2, last, dead, misses, first: F.struct(F.lit(kind).alias("kind"), k1.alias("k1"), k2.alias("k2"), last.alias("last"), dead.alias("dead"), misses.alias("misses"), first.alias("first_seq"))
    rows = F.array(
        F.when(yes | told, row("surface", surface, text, last(F.when(yes, F.col("proposed")).otherwise(F.col("correct")), role), long, F.lit(0).cast("long"), long)),
        row("pair", surface, F.col("proposed"), last(text, text), F.when(no, F.col("seq").cast("long")), F.lit(0).cast("long"), long),
        F.when(no, row("proposal", F.col("proposed"), text, F.when(told, last(F.col("correct"), role)), long, F.lit(1).cast("long"), F.col("seq").cast("long"))),
    )
    return _grouped(log.select(F.explode(F.filter(rows, lambda x: x.isNotNull())).alias("r")).select("r.*"))


def merge(*summaries: DataFrame) -> DataFrame:
    """The summary of several logs together; sizes are those of their distinct keys."""
    every = summaries[0]
    for other in summaries[1:]:
        every = every.unionByName(other)
    return _grouped(every)


def confirmed(state: DataFrame) -> DataFrame:
    """``feedback.confirmed`` from a summary."""
    good = state.where("kind = 'surface'").select(F.col("k1").alias("surface"), F.col("last.a").alias("canonical"), F.col("last.b").alias("role"), F.col("last.seq").alias("since"))
    dead = state.where("kind = 'pair' and dead is not null").select(F.col("k1").alias("surface"), F.col("k2").alias("canonical"), "dead")
    return good.join(dead, ["surface", "canonical"], "left").where("dead is null or dead <= since").select("surface", "canonical", "role")


def confusions(state: DataFrame) -> DataFrame:
    """``feedback.confusions`` from a summary."""
    return state.where("kind = 'proposal' and last is not null").select(F.col("k1").alias("proposed"), F.col("last.a").alias("correct"), F.col("last.b").alias("role"))


def rejected(state: DataFrame) -> DataFrame:
    """``feedback.rejected`` from a summary."""
    return state.where("kind = 'pair' and not last.accepted").select(F.col("k1").alias("surface"), F.col("k2").alias("proposed"))


def misses(state: DataFrame) -> DataFrame:
    """``feedback.misses`` from a summary."""
    return state.where("kind = 'proposal' and misses > 0").select(F.col("k1").alias("proposed"), "misses", "first_seq")


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the whole snapshots under ``path``, in order; one whose write didn't end has no mark and doesn't count."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    root = folder(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in fs.listStatus(root)] if fs.exists(root) else []
    own = [n for n in names if n.startswith("batch=") and fs.exists(folder(f"{path}/{n}/_SUCCESS"))]
    return sorted(int(n.split("=")[1]) for n in own)


def load(spark: SparkSession, path: str) -> DataFrame:
    """The newest snapshot; an empty summary if there is none."""
    known = versions(spark, path)
    return spark.read.schema(SUMMARY).parquet(f"{path}/batch={known[-1]}") if known else spark.createDataFrame([], SUMMARY)


def advance(delta: DataFrame, path: str, batch: int, keep: int = 2) -> None:
    """A snapshot numbered ``batch`` (0, 1, .. of one writer) of the newest one and a part of the log that is new. A batch that is in already is left
    alone, so that one that is given again is not counted twice. The last ``keep`` snapshots stay, for those who read them."""
    spark = delta.sparkSession
    known = versions(spark, path)
    if known and known[-1] >= batch:
        return
    merge(load(spark, path), summary(delta)).write.mode("overwrite").parquet(f"{path}/batch={batch}")
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for old in [*known, batch][:-keep]:
        gone = folder(f"{path}/batch={old}")
        gone.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(gone, True)


def follow(log: DataFrame, path: str, checkpoint: str):
    """A started query that keeps the snapshots under ``path`` up to date with a stream of log rows."""
    return log.writeStream.foreachBatch(lambda delta, batch: advance(delta, path, batch)).option("checkpointLocation", checkpoint).start()
