"""Best-fit packing of tokenised documents into sequences of bounded length.

Bulk-synchronous best fit. Pieces (documents, cut where they exceed the capacity) are placed by bands of
length, the longest first; pieces of over half the capacity open a sequence each. For each other band,
supersteps run until its pieces are placed:

1. *Range sort.* The band's pieces and all gaps that could hold one are sorted together by size, descending,
   a gap before a piece of its size, and dealt out by range; a hash breaks ties, so that a length that a third of all
   pieces have is split over tasks.
2. *Successor sweep.* Each range is swept in descending order: a piece takes the smallest gap of the
   range that holds it, and what is left of the gap goes back into the sweep at its own size.
3. *Conflicts by rank.* Pieces that found no gap in their range claim gaps that larger ranges
   have left. Pieces are to gaps as closing brackets are to opening ones: each range's pieces take the slots
   of the nearest larger ranges that have any, smallest gaps first. A range tells two numbers (pieces
   and slots left); from these follow, for runs of ranks of pieces, the runs of ranks of slots that they
   get, so that no slot is claimed twice. Pieces and slots meet by range and rank.
4. *Update.* Gaps shrink by what they took, and the next superstep sorts what is left. When hardly any
   piece finds a gap, the rest of the band open new sequences, best fit decreasing within a range.

Nothing but the two numbers of a range reaches the driver, and every task holds a range of bounded
size (``each`` items, about). Placements are written after each superstep, so that a lost executor costs its tasks.

Longer documents are cut into pieces of ``capacity`` tokens, of which the first is the
shorter one. Defined results: a null text counts as empty, which is the end token alone;
repeated rows are packed as often as they come; null ids stay null; an empty table gives no
pieces; only the id and the columns named below are returned, so other columns don't matter.
"""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .bpe import encoder, rank_encode
from .common import Scratch, slices, small

def cut_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row a piece: ``id``, piece, start, length, ids_crc32 and, if asked for, its ids."""
    fields = [T.StructField("id", docs.schema[id_col].dataType), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.IntegerType()), T.StructField("ids_crc32", T.LongType())]
    fields += [T.StructField("ids", T.BinaryType())] * keep_ids
    end = array("I", [end_id]).tobytes()
    names = [f.name for f in fields]

    def run(batches):
        coder = encoder(tokenizer_path, rank_encode)
        for batch in batches:
            for block in slices(batch, 4 << 20, 1):
                row, piece, start, length, crc, ids = [], [], [], [], [], []
                for k, own in enumerate(coder.encode(block.column(1)).to_pylist()):
                    own += end
                    n = len(own) // 4
                    at, i = 0, 0
                    while at < n:
                        size = min(n, n % capacity or capacity) if not i else capacity
                        part = own[4 * at : 4 * (at + size)]
                        row.append(k)
                        piece.append(i)
                        start.append(at)
                        length.append(size)
                        crc.append(zlib.crc32(part))
                        if keep_ids:
                            ids.append(part)
                        at, i = at + size, i + 1
                columns = [block.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int32()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, *[pa.array(ids, pa.binary())] * keep_ids], names=names)

    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(run, T.StructType(fields))


def bands(capacity: int) -> list[tuple[int, int]]:
    """Ranges (least, most) of lengths, from half the capacity down: halved to 64, then by 8."""
    out, most = [], capacity // 2
    while most:
        least = most // (2 if most > 64 else 8) + 1
        out.append((least, most))
        most = least - 1
    return out


def sweep(lengths: list[int], gaps: list[int], capacity: int, opening: bool = False):
    """Best fit of descending lengths into gaps: per piece the number of its gap (None: none held it) and
    its offset, and what is left of each gap. ``opening``: a piece that no gap holds opens one of its own, numbered on."""
    left, stacks, sizes = list(gaps), {}, []

    def add(gap: int, k: int) -> None:
        if gap:
            if gap not in stacks:
                stacks[gap] = []
                insort(sizes, gap)
            stacks[gap].append(k)

    for k in range(len(gaps) - 1, -1, -1):
        add(gaps[k], k)
    placed = []
    for length in lengths:
        at = bisect_left(sizes, length)
        if at < len(sizes):
            gap = sizes[at]
            k = stacks[gap].pop()
            if not stacks[gap]:
                del stacks[gap], sizes[at]
        elif opening:
            gap, k = capacity, len(left)
            left.append(capacity)
        else:
            placed.append((None, 0))
            continue
        placed.append((k, capacity - gap))
        left[k] = gap - length
        add(gap - length, k)
    return placed, left


#: What a sweep tells: 0 a placed piece, 1 a piece without gap, 2 a gap.
_SWEPT = "part int, kind int, id long, size int, bin long, offset int, rank long, slots long"
_SWEPT_NAMES = [x.split()[0] for x in _SWEPT.split(", ")]


def _ranged(items: DataFrame, n: int, each: int) -> DataFrame:
    """Items (size, kind 0: gap, 1: piece, id) in ranges of about ``each``, sorted."""
    order = [F.col("size").desc(), F.col("kind").asc(), F.xxhash64("id").asc(), F.col("id").asc()]
    return items.select("size", "kind", "id").repartitionByRange(max(1, -(-n // each)), *order).sortWithinPartitions(*order)


def _swept(items: DataFrame, n: int, each: int, capacity: int, opening: bool) -> DataFrame:
    """A sweep of each range. Of gaps that hold any piece of a smaller range, ``rank`` is the first of
    their ``slots``, ascending by size; pieces without gap are ranked in their order."""

    def run(batches):
        from pyspark import TaskContext

        parts = [x for x in batches if len(x)]
        if not parts:
            return
        size, kind, ids = (np.concatenate([p.column(i).to_numpy() for p in parts]) for i in range(3))
        part, low = TaskContext.get().partitionId(), int(size.min())
        piece = kind == 1
        lengths, rows, bins = size[piece].tolist(), ids[piece].tolist(), ids[~piece].tolist()
        placed, left = sweep(lengths, size[~piece].tolist(), capacity, opening)
        out = []
        waiting = 0
        for row, length, (k, offset) in zip(rows, lengths, placed):
            if k is None:
                out.append((1, row, length, None, None, waiting, None))
                waiting += 1
            else:
                if k == len(bins):
                    bins.append(row)  # a sequence is called as its first piece
                out.append((0, row, length, bins[k], offset, None, None))
        at = 0
        for k in sorted(range(len(left)), key=lambda k: (left[k], k)):
            slots = left[k] // low if left[k] >= low else 0
            if left[k]:
                out.append((2, bins[k], left[k], None, None, at if slots else None, slots))
                at += slots
        for i in range(0, len(out), 50_000):
            own = list(zip(*out[i : i + 50_000]))
            kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(own[0]), pa.int32()), *[pa.array(x, t) for x, t in zip(own, kinds)]], names=_SWEPT_NAMES)

    return _ranged(items, n, each).mapInArrow(run, _SWEPT)


def claims(ranges: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int, int, int, int]], dict[int, int], dict[int, int]]:
    """Of ranges (number, pieces without gap, slots) from the largest sizes down: runs (range, first rank, end,
    range of the slots, first slot), and how many pieces and slots of each range are matched."""
    stack, runs, pieces, used = [], [], {}, {}
    for part, waiting, slots in ranges:
        rank = 0
        while rank < waiting and stack:
            other, first, end = stack[-1]
            n = min(waiting - rank, end - first)
            runs.append((part, rank, rank + n, other, first))
            rank, stack[-1][1], used[other] = rank + n, first + n, first + n
            if first + n == end:
                stack.pop()
        pieces[part] = rank
        if slots:
            stack.append([part, 0, slots])
    return runs, pieces, used


def _claimed(swept: DataFrame, runs: list, used: dict[int, int], capacity: int) -> DataFrame:
    """Pieces (id, size) with the bin and offset of the slot that their rank claims."""
    key = np.array([(part << 40) + first for part, first, *_ in runs], np.int64)
    end = np.array([(x[0] << 40) + x[2] for x in runs], np.int64)
    other, slot = np.array([x[3] for x in runs], np.int64), np.array([x[4] for x in runs], np.int64)
    most = np.zeros(max(used) + 1, np.int64)
    for part, n in used.items():
        most[part] = n

    def pieces(batches):
        for batch in batches:
            own = (batch.column(0).to_numpy().astype(np.int64) << 40) + batch.column(3).to_numpy()
            run = np.searchsorted(key, own, "right") - 1
            good = (run >= 0) & (own < end[run])
            part = batch.filter(pa.array(good))
            run, own = run[good], own[good]
            yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), pa.array(other[run]), pa.array(slot[run] + own - key[run])], names=["id", "size", "q", "slot"])

    def gaps(batches):
        for batch in batches:
            q = batch.column(0).to_numpy().astype(np.int64)
            first = batch.column(3).to_numpy()
            n = np.clip(np.where(q < len(most), most[np.minimum(q, len(most) - 1)], 0) - first, 0, batch.column(4).to_numpy())
            row = np.repeat(np.arange(len(n)), n)
            step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            yield pa.RecordBatch.from_arrays([pa.array(q[row]), pa.array(first[row] + step), batch.column(1).take(pa.array(row)), batch.column(2).take(pa.array(row))], names=["q", "slot", "bin", "gap"])

    left = swept.where("kind = 1").select("part", "id", "size", "rank").mapInArrow(pieces, "id long, size int, q long, slot long")
    right = swept.where("kind = 2 and slots > 0").select("part", "id", "size", "rank", "slots").mapInArrow(gaps, "q long, slot long, bin long, gap int")
    before = F.sum("size").over(Window.partitionBy("bin").orderBy("slot")) - F.col("size")  # a bin's slots: at most its capacity
    return left.join(right, ["q", "slot"]).select("id", "size", "bin", (F.lit(capacity) - F.col("gap") + before).cast("int").alias("offset"))


def place(pieces: DataFrame, run: Scratch, capacity: int, each: int = 20_000) -> DataFrame:
    """``id``, ``bin`` and ``offset`` of pieces (id: unique, size: 1 to capacity), by the supersteps above."""
    spark = pieces.sparkSession
    large = pieces.where(F.col("size") > capacity // 2)
    done = [run.table(large.select("id", F.col("id").alias("bin"), F.lit(0).alias("offset")), "placed")]
    gaps = run.table(large.where(F.col("size") < capacity).select(F.col("id").alias("bin"), (F.lit(capacity) - F.col("size")).cast("int").alias("gap")), "gaps")
    for least, most in bands(capacity):
        waiting = run.table(pieces.where(F.col("size").between(least, most)).select("id", "size"), "waiting")
        n = waiting.count()
        opening = False
        while n:
            usable = gaps.where(F.col("gap") >= least)
            n_gaps = 0 if opening else usable.count()
            items = waiting.select("size", F.lit(1).alias("kind"), "id")
            if n_gaps:
                items = items.union(usable.select("gap", F.lit(0), "bin"))
            opening = opening or not n_gaps
            swept = run.table(_swept(items, n + n_gaps, each, capacity, opening), "swept")
            told = swept.groupBy("part").agg(F.count_if(F.col("kind") == 1).alias("w"), F.coalesce(F.sum("slots"), F.lit(0)).alias("s"), F.count_if(F.col("kind") == 0).alias("d")).orderBy("part").collect()  # a row a range
            runs, taken, used = claims([(x.part, x.w, 0 if opening else x.s) for x in told])
            done.append(swept.where("kind = 0").select("id", "bin", "offset"))
            left = swept.where("kind = 2").select(F.col("id").alias("bin"), F.col("size").alias("gap"))
            if runs:
                claimed = run.table(_claimed(swept, runs, used, capacity), "claimed")
                done.append(claimed.select("id", "bin", "offset"))
                spent = claimed.groupBy("bin").agg(F.sum("size").alias("spent"))
                left = left.join(spent, "bin", "left").select("bin", (F.col("gap") - F.coalesce("spent", F.lit(0))).cast("int").alias("gap")).where("gap > 0")
            kept = gaps if opening else gaps.where(F.col("gap") < least)
            gaps = run.table(kept.select("bin", "gap").union(left.select("bin", "gap")), "gaps")
            before, n = n, sum(x.w - taken[x.part] for x in told)
            if n:
                shown = spark.createDataFrame(list(taken.items()), "part int, taken long")
                waiting = run.table(swept.where("kind = 1").join(F.broadcast(shown), "part").where("rank >= taken").select("id", "size"), "waiting")  # bound: a row a range
                opening = (before - n) * 100 < n
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False, each: int = 20_000) -> DataFrame:
    """id, ``piece``, ``start``, ``length``, ``ids_crc32``, with ``keep_ids`` the ``ids`` (binary: little-endian unsigned
    32-bit), ``sequence_id`` and ``offset`` of each piece; ``each`` is about how many pieces and gaps a task sweeps."""
    with Scratch(docs.sparkSession) as run:
        pieces = run.keep(cut_pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col, keep_ids).withColumn("_row", F.monotonically_increasing_id()), "pieces")
        placed = run.keep(place(pieces.select(F.col("_row").alias("id"), F.col("length").alias("size")), run, capacity, each), "places")
    columns = [F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids]
    return pieces.join(small(placed.select(F.col("id").alias("_row"), F.col("bin").alias("sequence_id"), "offset")), "_row").select(*columns, "sequence_id", F.col("offset").cast("long").alias("offset"))


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id``, ``n_tokens`` and ``ids`` (binary) of each sequence, from pieces with ids;
    a sequence holds ``capacity`` tokens at most, and so does a group."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), parts.alias("p")).select("sequence_id", "n_tokens", F.unhex(F.array_join(F.transform("p", lambda x: F.hex(x["ids"])), "")).alias("ids"))
