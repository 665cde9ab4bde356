"""Request accounting in sliding windows of time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one range in order, with running sums of ``n`` and ``c`` from the range's start, and the range's number."""
    part, n, c = TaskContext.get().partitionId(), 0, 0
    for b in batches:
        if not b.num_rows:
            continue
        ns, cs = (np.cumsum(b[x].to_numpy(zero_copy_only=False)) + base for x, base in (("n", n), ("c", c)))
        n, c = int(ns[-1]), int(cs[-1])
        own = [b["k"], b["us"], b["kind"], pa.array(ns), pa.array(cs), pa.array(np.full(b.num_rows, part, "int32"))]
        yield pa.RecordBatch.from_arrays(own, ["k", "us", "kind", "n", "c", "part"])


def window_usage(log: DataFrame, key: str, ts: str = "ts", tokens: str = "tokens", seconds: int = 60, most_tokens: int = 6000, most_requests: int = 28) -> DataFrame:
    """``log`` with ``used_tokens`` and ``used_requests`` of the window that ends at each request (a request
    exactly ``seconds`` ago still counts), and ``admitted``; a request larger than the limit alone is
    never admitted. ``tokens`` are whole numbers, null ones none; requests of a key without a time are a window of their own.

    One client may hold most of the log, so no task takes a client: requests of a key and time are summed first, each such
    time gives a row where its window begins and one where it ends, and these are sorted by ranges. Running sums within the
    ranges, and a carry of one row a range, give sums over all rows before; the window's own are the difference of its two."""
    micros, span = F.unix_micros(F.col(ts).cast("timestamp")), seconds * 1_000_000
    step = log.drop("used_tokens", "used_requests", "admitted").withColumn("_us", micros)
    at = step.groupBy(F.col(key).alias("k"), F.col("_us").alias("us")).agg(F.sum(F.coalesce(F.col(tokens).cast("long"), F.lit(0))).alias("n"), F.count(F.lit(1)).alias("c"))
    none = F.lit(0).cast("long")
    begin = F.struct((F.col("us") - span).alias("p"), F.lit(0).alias("kind"), none.alias("n"), none.alias("c"))  # before the rows of its own time
    end = F.struct(F.col("us").alias("p"), F.lit(1).alias("kind"), "n", "c")
    marks = at.select("k", "us", F.explode(F.array(begin, end)).alias("m")).select("k", "us", "m.*")
    order = ["k", "p", "kind"]
    ranges = marks.repartitionByRange(*order).sortWithinPartitions(*order)
    # the table is written, so that a range's number and its rows stay the same whatever is computed again
    run = cut(ranges.mapInArrow(_running, f"k {dict(at.dtypes)['k']}, us long, kind int, n long, c long, part int"))
    ends = run.groupBy("part").agg(F.max(F.struct("c", "n")).alias("e"))  # a row a range; n changes only where c grows
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select("part", *[F.coalesce(F.sum(f"e.{x}").over(before), none).alias(f"_{x}") for x in "nc"])
    sign = F.col("kind") * 2 - 1
    used = run.join(F.broadcast(carry), "part").groupBy("k", "us").agg(F.sum(sign * (F.col("n") + F.col("_n"))).alias("used_tokens"), F.sum(sign * (F.col("c") + F.col("_c"))).alias("used_requests"))
    used = used.withColumnsRenamed({"k": "_k", "us": "_at"})
    joined = step.join(used, F.col(key).eqNullSafe(F.col("_k")) & F.col("_us").eqNullSafe(F.col("_at")))
    ok = (F.col("used_tokens") <= most_tokens) & (F.col("used_requests") <= most_requests) & (F.coalesce(F.col(tokens), F.lit(0)) <= most_tokens)
    return joined.withColumn("admitted", ok).drop("_us", "_k", "_at")
