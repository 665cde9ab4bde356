"""Streams of notes and requests. The note operators are row-local given their dimensions, so they
apply to a stream as they are; what needs state is stated here."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.restore import restore


def restore_stream(notes: DataFrame) -> DataFrame:
    """Restored notes of a stream with a ``pii_map`` column."""
    return restore(notes)


def usage_stream(log: DataFrame, key: str = "key", ts: str = "ts", tokens: str = "tokens", seconds: int = 60, slide: int = 10, late: str = "5 minutes") -> DataFrame:
    """Tokens and requests by key in sliding windows; rows later than ``late`` are left out."""
    window = F.window(ts, f"{seconds} seconds", f"{slide} seconds")
    return log.withWatermark(ts, late).groupBy(window.alias("w"), key).agg(F.sum(tokens).alias("used_tokens"), F.count(F.lit(1)).alias("used_requests")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "used_tokens", "used_requests")


def _used(every: list[tuple[int, int]], at: list[int], span: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and requests, of (time, tokens) in order, in the window of ``span`` that ends at each time."""
    times, sums = np.array([x for x, _ in every], "int64"), np.cumsum([0, *(y for _, y in every)])
    lo, hi = np.searchsorted(times, np.array(at, "int64") - span, "left"), np.searchsorted(times, at, "right")
    return sums[hi] - sums[lo], hi - lo


def _requests(key: str, value, new: list[tuple[int, int]], used_tokens, used_requests, most_tokens: int, most_requests: int) -> pd.DataFrame:
    own = np.array([y for _, y in new], "int64")
    ok = (used_tokens <= most_tokens) & (used_requests <= most_requests) & (own <= most_tokens)
    return pd.DataFrame({key: [value] * len(new), "ts": pd.to_datetime([t for t, _ in new], unit="us"), "tokens": own, "used_tokens": used_tokens, "used_requests": used_requests, "admitted": ok})


def exact_usage_stream(log: DataFrame, key: str, ts: str = "ts", tokens: str = "tokens", seconds: int = 60, most_tokens: int = 6000, most_requests: int = 28) -> DataFrame:
    """``key``, ``ts``, ``tokens``, ``used_tokens``, ``used_requests`` and ``admitted`` of each request of a stream, by the same frame as
    ``limits.window_usage``: the window that ends at the request, a request exactly ``seconds`` ago included. The state of a key
    holds the requests of its last window. Rows of a batch are taken in the order of their times; rows without a time are in no window."""
    kinds = dict(log.dtypes)
    out = f"`{key}` {kinds[key]}, ts timestamp, tokens long, used_tokens long, used_requests long, admitted boolean"

    def run(keys, frames, state):
        rows = pd.concat(list(frames), ignore_index=True)
        at, n = (list(x) for x in state.get) if state.exists else ([], [])
        new = sorted(zip(rows["us"].tolist(), rows[tokens].fillna(0).astype("int64").tolist()))
        every = sorted([*zip(at, n), *new])
        span = seconds * 1_000_000
        used_tokens, used_requests = _used(every, [t for t, _ in new], span)
        last = every[-1][0]
        held = [(x, y) for x, y in every if x >= last - span]
        state.update(([x for x, _ in held], [y for _, y in held]))
        yield _requests(key, keys[0], new, used_tokens, used_requests, most_tokens, most_requests)

    timed = log.where(F.col(ts).isNotNull()).select(key, F.unix_micros(F.col(ts).cast("timestamp")).alias("us"), tokens)
    return timed.groupBy(key).applyInPandasWithState(run, out, "at array<long>, n array<long>", "append", "NoTimeout")


class _Settled(StatefulProcessor):
    """State of a client: requests that wait for the watermark, and those of the last window. One timer is set: for the first
    request that waits, else for the end of the last window, when the client's state goes."""

    def __init__(self, key: str, span: int, most_tokens: int, most_requests: int) -> None:
        self.key, self.span, self.most = key, span, (most_tokens, most_requests)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting, self.past = (handle.getListState(name, "us long, tokens long") for name in ("waiting", "past"))

    def _wake(self, micros: int) -> None:
        """Sets the timer to a time, unless it is set to an earlier one."""
        at, known = -(-micros // 1000), list(self.handle.listTimers())
        if known and min(known) <= at:
            return
        for other in known:
            self.handle.deleteTimer(other)
        self.handle.registerTimer(at)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            new = list(zip(frame["us"].tolist(), frame["tokens"].tolist()))
            if new:
                self.waiting.appendList(new)
                self._wake(min(new)[0])
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        waiting, past = (sorted((x[0], x[1]) for x in state.get()) for state in (self.waiting, self.past))
        due, later = [x for x in waiting if x[0] <= now], [x for x in waiting if x[0] > now]
        every = sorted(past + due)
        held = [x for x in every if x[0] > now - self.span]  # what a later request's window can reach
        for state, rows in ((self.waiting, later), (self.past, held)):
            state.put(rows) if rows else state.clear()
        for other in list(self.handle.listTimers()):
            self.handle.deleteTimer(other)
        if later:
            self._wake(later[0][0])
        elif held:
            self._wake(held[-1][0] + self.span)
        if due:
            yield _requests(self.key, key[0], due, *_used(every, [t for t, _ in due], self.span), *self.most)

    def close(self) -> None:
        pass


def settled_usage_stream(log: DataFrame, key: str, ts: str = "ts", tokens: str = "tokens", seconds: int = 60, most_tokens: int = 6000, most_requests: int = 28, late: str = "5 minutes") -> DataFrame:
    """The columns of ``exact_usage_stream``, each request given once, when the watermark (the latest time less ``late``) has
    passed it, so that the order in which requests arrive makes no difference: they equal ``limits.window_usage`` over all requests
    that weren't late. A request is late if its time isn't after the watermark of the batch before: it is in no row and in no
    window, and counted by the query's ``numRowsDroppedByWatermark``. Rows without a time are left out; null tokens are none.

    Python's ``transformWithState``: ``spark.sql.streaming.stateStore.providerClass`` has to name the RocksDB store. State of a
    client is its requests of ``late`` and ``seconds``; it is gone when the watermark has passed its last window."""
    spark = log.sparkSession
    if "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass"):
        raise ValueError("set spark.sql.streaming.stateStore.providerClass to the RocksDB provider")
    out = f"`{key}` {dict(log.dtypes)[key]}, ts timestamp, tokens long, used_tokens long, used_requests long, admitted boolean"
    at = F.col(ts).cast("timestamp")
    timed = log.where(at.isNotNull()).select(key, at.alias("_ts"), F.unix_micros(at).alias("us"), F.coalesce(F.col(tokens).cast("long"), F.lit(0)).alias("tokens"))
    each = timed.withWatermark("_ts", late).groupBy(key)
    return each.transformWithStateInPandas(_Settled(key, seconds * 1_000_000, most_tokens, most_requests), out, "append", "eventTime")


def feedback_stream(log: DataFrame, detections: DataFrame) -> DataFrame:
    """Running counts of a feedback stream joined to static detections (stream-static join)."""
    return log.join(detections, log["proposed"] == detections["canonical"], "left_semi").groupBy("proposed").agg(F.count_if(~F.col("accepted")).alias("misses"), F.count(F.lit(1)).alias("events"))
