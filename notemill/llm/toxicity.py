"""Toxicity by maximum-scoring segments.

1. *Counts.* Features are tokens (runs of ASCII letters and digits and of bytes beyond ASCII, A-Z as
   a-z) and their beginnings of a few bytes (words of one stem share them), known by 64-bit hashes. Of
   the labelled rows a distributed table counts, for each feature and each of two folds, the toxic
   and the clean documents that have it, and a 64-bit map of the contexts (neighbouring tokens) in which
   toxic documents have it. A token that owes its toxic counts to copies of one text has few
   contexts; its count is held to their estimated number (linear counting). The background is counted over
   all documents, for the features that can be significant.
2. *Log-odds with a Dirichlet prior* (Monroe, Colaresi and Quinn, 2008): the prior's pseudo-counts
   follow the occurrences in all documents. A feature scores its log-odds if the signed root of its likelihood
   ratio, which holds for counts of zero too, reaches ``LEAST_Z``; a token scores as its best feature
   does, and ``-DRIFT`` where it has none.
3. *Segments.* The all-maximal-segments scan of Ruzzo and Tompa finds every passage of maximal
   score in linear time.
4. *Extreme values* (Karlin and Altschul, 1990): lambda solves sum p(w) exp(lambda s(w)) = 1 over
   the clean distribution and K comes from the mean of clean documents' best segments, so that
   K m exp(-lambda S) is the expected number of segments of score S by chance in m tokens. A
   segment is significant if that is under ``MOST_EXPECTED``; the document's own evidence is
   the sum of its significant segments beyond chance.
5. *Calibration* of the evidence to a probability: monotone regression on ``BINS`` bins, scaled so
   that 0.7 is the cut of best F1. K and the calibration are cross-fitted: a training row is scored
   by the log-odds of the other fold, any other row by those of both.

Labels are used of at most ``most_labels`` rows (those of the smallest id hashes), which bounds
what is broadcast; everything else covers all documents. What reaches the driver and is broadcast are
the significant features, bounded by the labelled rows. Text is never shuffled: three row-local passes, one
of them over labelled rows alone.

Defined results: null counts as the empty text; texts without significant segment score low, as
such training rows do; ids with several labels are toxic if one says so, null labels don't
count; with no toxic or no clean training row in a fold all scores are 0; repeated rows get equal
results; an empty table gives an empty table. Only the id and the columns named below are returned, so
other columns of the input don't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import _BASE_INV, Scratch, Words, mapped, mix, powers, slices

#: Words of one stem share their beginnings.
PREFIXES = (4, 5, 6, 7)
PRIOR = 500.0
CONTINUITY = 0.5
LEAST_Z = 4.0
DRIFT = 0.02
MOST_EXPECTED = 0.05
BINS = 512
CUT = 0.7
_FOLD = np.full(256, 32, np.uint8)
_FOLD[48:58] = np.arange(48, 58)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


class Tokens(Words):
    def __init__(self, texts: pa.Array):
        super().__init__(mapped(texts, _FOLD))

    def features(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Hashes of the tokens, then of their beginnings of PREFIXES bytes, each with the numbers of the
        tokens that have one."""
        sums = self.sums()
        back = powers(_BASE_INV, len(self.data) + 1)[self.start]
        out = [(mix((sums[self.end] - sums[self.start]) * back), np.arange(len(self.start)))]
        for n in PREFIXES:  # a feature of its own, also where it is all of the token
            own = np.flatnonzero(self.end - self.start >= n)
            out.append((mix((sums[self.start[own] + n] - sums[self.start[own]]) * back[own], n), own))
        return out


class Lookup:
    """Places of hashes in a sorted table; most are ruled out by 20 of their bits."""

    def __init__(self, table: np.ndarray):
        self.table, self.bits = table, np.zeros(1 << 20, bool)
        self.bits[table & np.uint64((1 << 20) - 1)] = True

    def __call__(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are known, and their places."""
        own = np.flatnonzero(self.bits[hashes & np.uint64((1 << 20) - 1)])
        at = np.minimum(np.searchsorted(self.table, hashes[own]), max(len(self.table) - 1, 0))
        good = self.table[at] == hashes[own] if len(self.table) else np.zeros(0, bool)
        return own[good], at[good]


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from training: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


_COUNTS = ("feature", "toxic_0", "toxic_1", "clean_0", "clean_1", "contexts_0", "contexts_1")


def _counts(labelled: DataFrame) -> DataFrame:
    """Documents by feature, label and fold, of rows (text, label, fold)."""

    def combined(parts):
        feature, kind, bits = (np.concatenate(x) for x in zip(*parts))
        distinct, which = np.unique(feature, return_inverse=True)
        count = np.bincount(which * 4 + kind, minlength=4 * len(distinct)).reshape(-1, 4)  # clean 0, clean 1, toxic 0, toxic 1
        maps = np.zeros((len(distinct), 2), np.uint64)
        some = np.flatnonzero(bits)
        np.bitwise_or.at(maps, (which[some], kind[some] & 1), bits[some])
        for at in range(0, len(distinct), 50_000):
            own = slice(at, at + 50_000)
            columns = [distinct[own].view(np.int64), count[own, 2], count[own, 3], count[own, 0], count[own, 1], maps[own, 0].view(np.int64), maps[own, 1].view(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in columns], names=list(_COUNTS))

    def run(batches):
        parts, held = [], 0
        for batch in batches:
            for block in slices(batch, 1 << 20, 0):
                words = Tokens(block.column(0))
                row = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
                kind = np.asarray(block.column(1)).astype(np.int64) * 2 + np.asarray(block.column(2))
                h, side = words.hashes(), np.zeros(len(row), np.uint64)
                side[1:] ^= mix(h[:-1], 1)
                side[:-1] ^= mix(h[1:], 2)
                bit = np.uint64(1) << (side & np.uint64(63))
                for feature, token in words.features():
                    at = row[token]
                    order = np.lexsort((feature, at))
                    new = np.ones(len(order), bool)
                    new[1:] = (at[order][1:] != at[order][:-1]) | (feature[order][1:] != feature[order][:-1])
                    first = np.flatnonzero(new)
                    if len(first):
                        own = order[first]
                        maps = np.bitwise_or.reduceat(bit[token[order]], first) * (kind[at[own]] >= 2).astype(np.uint64)
                        parts.append((feature[own], kind[at[own]], maps))
                        held += len(own)
                if held > 4_000_000:
                    yield from combined(parts)
                    parts, held = [], 0
        if parts:
            yield from combined(parts)

    found = labelled.mapInArrow(run, ", ".join(f"{c} long" for c in _COUNTS))
    return found.groupBy("feature").agg(*[F.sum(x).alias(x) for x in _COUNTS[1:5]], *[F.bit_or(x).alias(x) for x in _COUNTS[5:]])


#: The folds that a model learns from: both, or the one that a training row is not in.
MODELS = ((0, 1), (1,), (0,))


def _sides(table) -> list[tuple[np.ndarray, np.ndarray]]:
    """Toxic and clean counts of each model; toxic ones held to their estimated contexts."""
    column = lambda c: table.column(c).to_numpy(zero_copy_only=False)
    out = []
    for folds in MODELS:
        toxic, clean = (sum(column(f"{side}_{f}") for f in folds) for side in ("toxic", "clean"))
        bits = np.bitwise_count(np.bitwise_or.reduce([column(f"contexts_{f}").view(np.uint64) for f in folds])).astype(float)
        estimate = np.where(bits < 60, -64 * np.log1p(-np.minimum(bits, 63) / 64), np.inf)
        out.append((np.minimum(toxic, estimate), clean.astype(float)))
    return out


def _totals(counts: DataFrame) -> list[tuple[float, float]]:
    """Sums of both sides, by model."""

    def run(batches):
        for batch in batches:
            sums = [float(x.sum()) for side in _sides(batch) for x in side]
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in sums], names=[f"s{i}" for i in range(len(sums))])

    names = [f"s{i}" for i in range(2 * len(MODELS))]
    row = counts.mapInArrow(run, ", ".join(f"{n} double" for n in names)).agg(*[F.coalesce(F.sum(F.round(n, 6).cast("decimal(30,6)")), F.lit(0)).cast("double").alias(n) for n in names]).first()
    return [(row[2 * i], row[2 * i + 1]) for i in range(len(MODELS))]


def significance(toxic: np.ndarray, clean: np.ndarray, n1: float, n0: float) -> np.ndarray:
    """Signed root of the likelihood ratio (Dunning, 1993) of two binomials; it holds for counts of zero too."""
    both, n = toxic + clean, n1 + n0
    part = lambda x, of: x * np.log(np.maximum(x, 1e-300) / np.maximum(of, 1e-300))
    g = part(toxic, both * n1 / n) + part(clean, both * n0 / n) + part(n1 - toxic, (n - both) * n1 / n) + part(n0 - clean, (n - both) * n0 / n)
    return np.sqrt(2 * np.maximum(g, 0)) * np.sign(toxic * n0 - clean * n1)


def log_odds(toxic: np.ndarray, clean: np.ndarray, prior: np.ndarray, n1: float, n0: float) -> np.ndarray:
    """Log-odds with the prior and ``CONTINUITY`` as pseudo-counts, finite however rare a feature is."""
    a, b = toxic + prior + CONTINUITY, clean + prior + CONTINUITY
    return np.log(a / (n1 + PRIOR + 2 * CONTINUITY - a)) - np.log(b / (n0 + PRIOR + 2 * CONTINUITY - b))


class Model:
    """Feature scores and lambda of each of MODELS."""

    def __init__(self, counts: DataFrame, docs: DataFrame, text_col: str):
        totals = _totals(counts)
        self.trained = all(n1 > 0 and n0 > 0 for n1, n0 in totals)
        self.features, self.scores, self.scales = np.zeros(0, np.uint64), np.zeros((len(MODELS), 0), np.float32), [0.0] * len(MODELS)
        if not self.trained:
            return

        def sure(batches):
            for batch in batches:
                z = [significance(t, c, n1, n0) for (t, c), (n1, n0) in zip(_sides(batch), totals)]
                yield batch.filter(pa.array(np.max(z, axis=0) >= LEAST_Z))

        table = counts.mapInArrow(sure, counts.schema).toArrow().sort_by("feature").combine_chunks()  # bounded by the labelled rows
        feature = table.column("feature").to_numpy().view(np.uint64)
        order = np.argsort(feature)
        self.features = feature[order]
        every, total = _background(docs, text_col, self.features)
        scores = []
        for (toxic, clean), (n1, n0) in zip(_sides(table), totals):
            toxic, clean, prior = toxic[order], clean[order], PRIOR * every / max(total, 1)
            odds = log_odds(toxic, clean, prior, n1, n0)
            good = (significance(toxic, clean, n1, n0) >= LEAST_Z) & (odds > 0)
            scores.append(np.where(good, odds, -DRIFT))
        self.scores = np.array(scores, np.float32)
        for m, ((_, clean), (_, n0)) in enumerate(zip(_sides(table), totals)):
            b = clean[order] + PRIOR * every / max(total, 1)
            self.scales[m] = karlin_lambda(b, self.scores[m].astype(float), n0 + PRIOR)


def karlin_lambda(mass: np.ndarray, scores: np.ndarray, total: float) -> float:
    """lambda > 0 with sum p exp(lambda s) = 1, where features of score -DRIFT hold what ``mass`` leaves of ``total``."""
    up = scores > 0
    share, s, rest = mass[up] / total, scores[up], 1 - mass[up].sum() / total
    low, high = 1e-6, 50.0
    for _ in range(80):
        mid = (low + high) / 2
        value = (share * np.exp(np.minimum(mid * s, 700))).sum() + rest * np.exp(-mid * DRIFT)
        low, high = (mid, high) if value < 1 else (low, mid)
    return low


def _background(docs: DataFrame, text_col: str, features: np.ndarray) -> tuple[np.ndarray, int]:
    """Occurrences of the features in all documents, and of all features."""
    shared = docs.sparkSession.sparkContext.broadcast(features)

    def run(batches):
        find = Lookup(shared.value)
        seen, total = np.zeros(len(shared.value), np.int64), 0
        for batch in batches:
            for block in slices(batch, 1 << 20, 0):
                for feature, _ in Tokens(block.column(0)).features():
                    total += len(feature)
                    seen += np.bincount(find(feature)[1], minlength=len(seen))
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(seen[some], total))], names=["at", "n"])

    found = docs.select(F.col(f"`{text_col}`")).mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    every, total = np.zeros(len(features)), 0
    for at, n in zip(found.column("at").to_pylist(), found.column("n").to_pylist()):
        if at < 0:
            total = n
        else:
            every[at] = n
    return every, total


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, end, score), left to right, in linear time: each
    positive score opens a candidate, which is joined to the candidates before it as long as
    that gives a segment of larger score."""
    up = np.flatnonzero(scores > 0)
    if not len(up):
        return []
    sums = np.concatenate([[0.0], np.cumsum(scores, dtype=np.float64)])
    found: list[list] = []  # first, end, sum before, sum after, number of the nearest candidate with a smaller sum before
    for first in up.tolist():
        new = [first, first + 1, sums[first], sums[first + 1], -1]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j = found[j][4]
            new[4] = j
            if j < 0 or found[j][3] >= new[3]:
                break
            new[0], new[2] = found[j][0], found[j][2]
            del found[j:]
        found.append(new)
    return [(a, b, float(y - x)) for a, b, x, y, _ in found]


def _segments(docs: DataFrame, model: Model) -> DataFrame:
    """Per row (id, label, held_out, fold, text): id, label, held_out, ``n_tokens`` and ``segments``, whose scores
    are in units of 1 / lambda."""
    shared = docs.sparkSession.sparkContext.broadcast((model.features, model.scores, model.scales))
    span = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
    kind = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())]))
    schema = T.StructType([*docs.schema.fields[:3], T.StructField("n_tokens", T.LongType()), T.StructField("segments", kind)])
    names = schema.names

    def run(batches):
        features, scores, scales = shared.value
        find = Lookup(features)
        for batch in batches:
            for block in slices(batch, 1 << 20, 4):
                words = Tokens(block.column(4))
                fold = block.column(3).fill_null(-1).to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
                own = np.full(len(row), -DRIFT, np.float32)
                for hashes, token in words.features():
                    which, at = find(hashes)
                    which = token[which]
                    own[which] = np.maximum(own[which], scores[fold[row[which]] + 1, at])
                found = []
                for i, j, f in zip(words.first.tolist(), words.first[1:].tolist(), fold.tolist()):
                    found.append([{"first": a, "end": b, "score": s * scales[f + 1]} for a, b, s in maximal_segments(own[i:j])])
                yield pa.RecordBatch.from_arrays([*block.columns[:3], pa.array(np.diff(words.first).astype(np.int64)), pa.array(found, span)], names=names)

    return docs.mapInArrow(run, schema)


def _monotone(good: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Rising rates of bins, by pooling neighbours that fall."""
    stack: list[list[float]] = []
    for g, t in zip(good.tolist(), total.tolist()):
        stack.append([g, t, 1])
        while len(stack) > 1 and stack[-2][0] * stack[-1][1] >= stack[-1][0] * stack[-2][1]:
            g, t, n = stack.pop()
            stack[-1] = [stack[-1][0] + g, stack[-1][1] + t, stack[-1][2] + n]
    return np.concatenate([np.full(n, g / t if t else 0.0) for g, t, n in stack])


def _calibrated(rows: list) -> np.ndarray:
    """Probability at each bin edge, strictly rising, with CUT at the edge of best F1."""
    good, total = np.zeros(BINS + 1), np.zeros(BINS + 1)
    for bin_, label, n in rows:
        total[bin_] += n
        good[bin_] += n * label
    if not good.sum() or good.sum() == total.sum():
        return np.zeros(BINS + 1)
    rate = _monotone(good, total)
    hits, called = np.cumsum(good[::-1])[::-1], np.cumsum(total[::-1])[::-1]
    best = int(np.argmax(2 * hits / (called + good.sum())))
    above = np.arange(BINS + 1) >= best
    top = rate.max()
    low = rate / max(rate[:best].max(initial=0), 1e-9) if best else rate
    out = np.where(above, CUT + (1 - CUT) * 0.98 * np.where(top > rate[best], (rate - rate[best]) / max(top - rate[best], 1e-9), 0.5), np.minimum(low, 1) * rate.mean().clip(0.02, CUT - 0.05))
    return np.clip(out + np.arange(BINS + 1) * 1e-5 - (~above) * 1e-5, 0, 1)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_labels: int = 200_000) -> DataFrame:
    """Per row of ``docs``: id, ``held_out``, ``score``, ``predicted`` and ``passages``, its significant
    segments (first token, end token, score in units of 1 / lambda, expected number by chance)."""
    with Scratch(docs.sparkSession) as run:
        known = labels.select(F.col(f"`{id_col}`").alias("known"), F.col(f"`{label_col}`").cast("int").alias("label")).where("known is not null and label is not null").where(~held_out(F.col("known")))
        known = known.groupBy("known").agg(F.max("label").alias("label"))
        known = run.table(known.orderBy(F.xxhash64("known"), "known").limit(most_labels).withColumn("fold", F.pmod(F.xxhash64(F.lit(3), "known"), F.lit(2)).cast("int")), "labels")
        own = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).join(F.broadcast(known), F.col("id") == F.col("known"), "left")  # bound: most_labels rows
        labelled = own.where("label is not null").select("text", F.when(F.col("label") > 0, 1).otherwise(0).alias("label"), "fold")
        model = Model(run.table(_counts(labelled), "counts"), docs, text_col)
        rows = run.keep(_segments(own.select("id", "label", held_out(F.col("id")).alias("held_out"), "fold", "text"), model), "segments")
    m = F.greatest(F.col("n_tokens"), F.lit(1)).cast("double")
    best = F.coalesce(F.array_max(F.transform("segments", lambda x: x["score"])), F.lit(0.0))
    mean = rows.where("label = 0 and size(segments) > 0").agg(F.avg(best - F.log(m))).first()[0]
    chance = F.lit((mean if mean is not None else 0.0) - 0.5772156649)  # ln K; Euler's constant is the mean of the standard law
    expected = lambda s: F.exp(chance + F.log(m) - s)
    passages = F.filter(F.transform("segments", lambda x: F.struct(x["first"].alias("first"), x["end"].alias("end"), x["score"].alias("score"), expected(x["score"]).alias("expected"))), lambda x: x["expected"] < MOST_EXPECTED)
    beyond = F.aggregate("segments", F.lit(0.0), lambda a, x: a + F.greatest(x["score"] - F.log(F.lit(1 / MOST_EXPECTED)), F.lit(0.0)))
    evidence = F.when(best > 0, F.log1p(beyond) + F.log1p(best)).otherwise(0.0)
    rows = rows.withColumn("bin", F.least(F.floor(evidence * (BINS / 16)), F.lit(BINS)).cast("int"))
    table = rows.where("label is not null and not held_out").groupBy("bin", F.when(F.col("label") > 0, 1).otherwise(0).alias("label")).count().collect()  # at most 2 (BINS + 1) rows
    rate = _calibrated([tuple(r) for r in table]) if model.trained else np.zeros(BINS + 1)
    inner = evidence * (BINS / 16) - F.floor(evidence * (BINS / 16))
    score = F.when(F.lit(bool(rate.any())), F.least(F.get(F.array(*[F.lit(float(x)) for x in rate]), F.col("bin")) + inner * 1e-5 * 0.5, F.lit(1.0))).otherwise(0.0)
    found = rows.select(F.col("id").alias(id_col), "held_out", score.alias("score"), passages.alias("passages"))
    return found.withColumn("predicted", (F.col("score") >= CUT).cast("int"))
