"""Summaries of a feedback log against its views made from the whole log."""

import random

import pytest
from pyspark.sql import functions as F

from notemill.operators import feedback, snapshots

VIEWS = ("confirmed", "confusions", "rejected", "misses")


def made(seed, n):
    r = random.Random(seed)
    some = lambda xs, none=0.1: None if r.random() < none else r.choice(xs)
    return [(i, some(["Ana", " ana", "BO", "cy"]), some(["P1", "P2", "P3"]), some([True, False]), some(["nurse", "patient"]), some(["P1", "P4"], 0.5), some(["nurse"], 0.5)) for i in range(n)]


def views(module, of):
    return {v: sorted(map(repr, map(tuple, getattr(module, v)(of).collect()))) for v in VIEWS}


@pytest.mark.parametrize("seed", range(4))
def test_any_split_and_order(spark, seed):
    rows = made(seed, 60)
    r = random.Random(seed)
    log = lambda own: spark.createDataFrame(own, feedback.LOG)
    want = views(feedback, log(rows))
    r.shuffle(rows)
    at = sorted(r.sample(range(61), 3))
    parts = [rows[i:j] for i, j in zip([0, *at], [*at, 60])]
    state = snapshots.merge(*[snapshots.summary(log(p)) for p in parts])
    assert views(snapshots, state) == want and all(want.values())


def test_snapshots_of_a_stream(spark, tmp_path):
    """Batch by batch, one of them given twice, one left half-written: as from the whole log; old snapshots go."""
    rows, path, src = made(9, 90), f"file://{tmp_path}/state", f"file://{tmp_path}/log"
    assert snapshots.load(spark, path).isEmpty()
    put = lambda own: spark.createDataFrame(own, feedback.LOG).coalesce(1).write.mode("append").parquet(src)
    put(rows[:30])
    stream = spark.readStream.schema(feedback.LOG).parquet(src)
    q = snapshots.follow(stream, path, f"{tmp_path}/cp")
    for own in (rows[30:50], rows[50:]):
        q.processAllAvailable()
        put(own)
    q.processAllAvailable()
    q.stop()
    whole = spark.createDataFrame(rows, feedback.LOG)
    assert views(snapshots, snapshots.load(spark, path)) == views(feedback, whole)
    known = snapshots.versions(spark, path)
    assert len(known) == 2
    snapshots.advance(spark.createDataFrame(rows[50:], feedback.LOG), path, known[-1])  # again: no change
    snapshots.summary(whole.where(F.lit(False))).write.parquet(f"{path}/batch=99")
    (tmp_path / "state" / "batch=99" / "_SUCCESS").unlink()  # a writer that was lost
    assert snapshots.versions(spark, path) == known
    assert views(snapshots, snapshots.load(spark, path)) == views(feedback, whole)
