"""Human feedback as an append-only log, and how it changes later matches.

A log row: seq, surface, proposed, accepted, role, correct, corr_role. Its views are aggregates, so
that nothing is updated in place: the latest event of a pair decides."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BOOST, MOST, OVERRIDE, CONFUSION, MOST_CONFUSION, PENALTY, LEAST = 0.06, 0.99, 0.95, 0.03, 0.97, 0.40, 0.70

#: The log's columns, and the version of its form: a stored log of another version counts as none.
LOG = "seq long, surface string, proposed string, accepted boolean, role string, correct string, corr_role string"
VERSION = 1
log_ = logging.getLogger(__name__)


def blank(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LOG)


def append(log: DataFrame, path: str) -> None:
    """Add rows to the stored log; the writer's commit makes them appear at once or not at all."""
    columns = [c.split()[0] for c in LOG.split(", ")]
    log.select(*columns).write.mode("append").parquet(f"{path}/version={VERSION}")


def load(spark: SparkSession, path: str) -> DataFrame:
    """The stored log; none yet, or one of another version alone, is a blank one."""
    from ..sources.tables import exists

    own = f"{path}/version={VERSION}"
    if not exists(spark, own):
        if exists(spark, path):
            log_.warning("%s holds no log of version %d", path, VERSION)
        return blank(spark)
    return spark.read.schema(LOG).parquet(own)


def reset(spark: SparkSession, path: str) -> None:
    """Empty the stored log."""
    blank(spark).write.mode("overwrite").parquet(f"{path}/version={VERSION}")


def _key(c: str):
    return F.lower(F.btrim(c))


def confirmed(log: DataFrame) -> DataFrame:
    """surface, canonical, role: what a surface stands for by its latest acceptance or correction,
    unless that pair was rejected later."""
    good = log.where("accepted").select("seq", _key("surface").alias("surface"), F.col("proposed").alias("canonical"), "role")
    told = log.where("not accepted and correct is not null").select("seq", _key("surface").alias("surface"), F.col("correct").alias("canonical"), F.coalesce("corr_role", "role").alias("role"))
    latest = good.unionByName(told).groupBy("surface").agg(F.max_by(F.struct("canonical", "role", "seq"), "seq").alias("b")).select("surface", "b.canonical", "b.role", F.col("b.seq").alias("since"))
    dead = log.where("not accepted").groupBy(_key("surface").alias("surface"), F.col("proposed").alias("canonical")).agg(F.max("seq").alias("dead"))
    return latest.join(dead, ["surface", "canonical"], "left").where("dead is null or dead <= since").select("surface", "canonical", "role")


def confusions(log: DataFrame) -> DataFrame:
    """proposed, correct, role: the latest correction of a proposal."""
    told = log.where("not accepted and correct is not null")
    return told.groupBy("proposed").agg(F.max_by(F.struct("correct", F.coalesce("corr_role", "role").alias("role")), "seq").alias("b")).select("proposed", "b.correct", "b.role")


def rejected(log: DataFrame) -> DataFrame:
    """surface, proposed: pairs rejected after their last acceptance."""
    last = log.groupBy(_key("surface").alias("surface"), "proposed").agg(F.max_by("accepted", "seq").alias("accepted"))
    return last.where("not accepted").select("surface", "proposed")


def misses(log: DataFrame) -> DataFrame:
    return log.where("not accepted").groupBy("proposed").agg(F.count(F.lit(1)).alias("misses"), F.min("seq").alias("first_seq"))


def stats(log: DataFrame, top: int = 5) -> DataFrame:
    """One row: counts of the views, and the proposals missed most (ties by first miss)."""
    one = log.agg(F.count(F.lit(1)).alias("total_feedback"))
    for name, view in (("confirmed", confirmed(log)), ("rejected", rejected(log)), ("confusion_pairs", confusions(log))):
        one = one.join(view.agg(F.count(F.lit(1)).alias(name)))
    worst = misses(log).orderBy(F.col("misses").desc(), "first_seq").limit(top)
    return one.join(worst.agg(F.array_sort(F.collect_list(F.struct((-F.col("misses")).alias("n"), "first_seq", "proposed"))).alias("w")).select(F.transform("w", lambda x: F.struct(x["proposed"].alias("proposed"), (-x["n"]).alias("misses"))).alias("most_missed")))


def apply_feedback(detections: DataFrame, log: DataFrame) -> DataFrame:
    """Detections (surface, canonical, role, confidence, path) after the cascade confirmed, confusion,
    rejected; three equi-joins by surface or proposal, none of them forced to broadcast."""
    d = detections.withColumn("_s", _key("surface"))
    d = d.join(confirmed(log).select(F.col("surface").alias("_s"), F.col("canonical").alias("_c"), F.col("role").alias("_cr")), "_s", "left")
    d = d.join(confusions(log).select(F.col("proposed").alias("canonical"), F.col("correct").alias("_x"), F.col("role").alias("_xr")), "canonical", "left")
    d = d.join(rejected(log).select(F.col("surface").alias("_s"), F.col("proposed").alias("canonical"), F.lit(True).alias("_r")), ["_s", "canonical"], "left")
    agree = F.col("_c") == F.col("canonical")
    sure, mixed, bad = F.col("_c").isNotNull(), F.col("_x").isNotNull(), F.coalesce("_r", F.lit(False))
    low = F.col("confidence") - PENALTY
    pick = lambda same, other, swap, dead, weak, rest: F.when(sure & agree, same).when(sure, other).when(mixed, swap).when(bad & (low < LEAST), dead).when(bad, weak).otherwise(rest)
    null = F.lit(None).cast("string")
    new = {
        "canonical": pick(F.col("canonical"), F.col("_c"), F.col("_x"), null, F.col("canonical"), F.col("canonical")),
        "role": pick(F.col("role"), F.col("_cr"), F.col("_xr"), F.col("role"), F.col("role"), F.col("role")),
        "confidence": pick(F.least(F.col("confidence") + BOOST, F.lit(MOST)), F.lit(OVERRIDE), F.least(F.col("confidence") + CONFUSION, F.lit(MOST_CONFUSION)), F.lit(0.0), low, F.col("confidence")),
        "path": pick(F.concat("path", F.lit("+confirmed")), F.lit("learned_confirmed"), F.lit("learned_confusion"), F.lit("rejected_by_learning"), F.concat("path", F.lit("+penalised")), F.col("path")),
    }
    return d.select(*[new[c].alias(c) if c in new else F.col(c) for c in detections.columns])
