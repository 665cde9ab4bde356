"""Exact substring deduplication by fixed-block anchors.

A passage is repeated if ``WINDOW`` = 35 words in a row also start somewhere else, in the same
text or another one; every word that such a window covers is removed, from all its places.

1. *Index and probe.* Each text is cut into reference blocks of ``BLOCK`` = 18 words that don't
   overlap. Two places with the same 35 words both contain a whole reference block of the other
   (35 >= 2 * 18 - 1), so that each is found by probing the index with every rolling window of
   18 words. Index and probes meet by hash: they are packed by task into one compressed row for
   each of a number of buckets that grows with the table (4 bytes of hash and about one of place
   a window), and a bucket is a bounded piece of work.
2. *Extend.* A hit is extended to all windows of 35 words around it; their hashes (64 bits, and
   more by the bucket, which hangs on a second hash) meet again, and those that occur twice are
   the repeats. Neighbouring ones join to maximal exact repeats. No pair of places is ever
   formed: a passage that a third of all texts share costs as much as it is long.
3. *Remove.* The repeats of a text are joined to it once more by its id.

Within a task, windows that occur twice are known as repeats at once and go on as one mark a
task, not one row a place; so no bucket receives more than one row a task for any window.

Defined results: a null text has no words; words are joined by single spaces in what is kept;
repeated rows and ids are texts of their own, so that copies of 35 words or more remove each
other; ids are of any type, and null ids stay null; an empty table gives an empty table. Columns that are added get
leading underscores where the input has one of the same name; the input's own stay as they are.
Rows of one id and text share one list of repeats (equal parts of it are one, whatever the number of rows).
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import MOST_BROADCAST, Scratch, Words, buckets, by_bucket, free_names, mix, rolling, row_key, slices, texts_of, tidy

WINDOW = 35
BLOCK = (WINDOW + 1) // 2
#: Windows a task packs at once.
PACKED_AT_ONCE = 1_000_000
_PACKED = "bucket int, size int, meta binary, hashes binary, marks binary"
_NAMES = ["bucket", "size", "meta", "hashes", "marks"]
_HITS = "_id long, _key int, places binary"


def _squeeze(ids, keys, counts, places, flags) -> tuple[int, bytes]:
    """Ids, keys, places a document and flags of windows, compressed."""
    steps = np.diff(places, prepend=np.int32(0)).astype("<i4").view(np.uint8).reshape(-1, 4).T
    head = np.array([len(ids), len(places)], "<i4")
    raw = b"".join([head.tobytes(), ids.astype("<i8").tobytes(), keys.astype("<i4").tobytes(), counts.astype("<i4").tobytes(), steps.tobytes(), np.packbits(flags).tobytes()])
    return len(raw), pa.Codec("zstd", 1).compress(raw, asbytes=True)


def _unsqueeze(size: int, data: bytes):
    raw = np.frombuffer(pa.Codec("zstd").decompress(data, size, asbytes=True), np.uint8)
    n, m = raw[:8].view("<i4").tolist()
    ids, keys, counts = raw[8 : 8 + 8 * n].view("<i8"), raw[8 + 8 * n : 8 + 12 * n].view("<i4"), raw[8 + 12 * n : 8 + 16 * n].view("<i4")
    at = 8 + 16 * n
    steps = np.ascontiguousarray(raw[at : at + 4 * m].reshape(4, m).T).view("<i4").ravel()
    return ids, keys, counts, np.cumsum(steps, dtype=np.int32), np.unpackbits(raw[at + 4 * m :], count=m).astype(bool)


class _Packer:
    """Packs the windows of a task by bucket; ``width`` bytes of each hash are kept."""

    def __init__(self, n_buckets: int, width: int):
        self.n, self.width, self.turn = n_buckets, width, 0
        self._clear()

    def _clear(self) -> None:
        self.parts, self.ids, self.keys, self.rows, self.held = [], [], [], 0, 0

    def add(self, ids, keys, row, place, hashes, route, flag):
        """Windows of a block: ``row`` counts its texts from 0; ``route`` decides the bucket."""
        self.parts.append((row + self.rows, place.astype(np.int32), hashes, (route % np.uint64(self.n)).astype(np.int32), flag))
        self.ids.append(ids)
        self.keys.append(keys)
        self.rows += len(ids)
        self.held += len(hashes)
        if self.held >= PACKED_AT_ONCE:
            yield from self.flush()

    def flush(self):
        if not self.held:
            self._clear()
            return
        row, place, hashes, bucket, flag = (np.concatenate(x) for x in zip(*self.parts))
        ids, keys = np.concatenate(self.ids), np.concatenate(self.keys)
        self._clear()
        order = np.argsort(hashes)
        edge = np.flatnonzero(np.diff(hashes[order], prepend=~hashes[order[:1]]))
        size = np.diff(np.append(edge, len(order)))
        several = size > 1
        known = np.sort(order[np.repeat(several, size)])  # repeated within this task
        marked = np.maximum.reduceat(flag[order].astype(np.uint8), edge)[several] if several.any() else np.zeros(0, np.uint8)
        first = order[edge[several]]
        single = np.sort(order[edge[~several]])
        rows = []
        for at in range(0, len(known), 100_000):
            own = known[at : at + 100_000]
            self.turn += 1
            rows.append((self.turn * 7919 % self.n, *self._places(ids, keys, row[own], place[own], flag[own]), None, None))
        single = single[np.argsort(bucket[single], kind="stable")]
        first_order = np.argsort(bucket[first], kind="stable")
        first, marked = first[first_order], marked[first_order]
        every = np.unique(np.concatenate([bucket[single], bucket[first]]))
        a, b = (np.searchsorted(bucket[x], every) for x in (single, first))
        c, d = (np.searchsorted(bucket[x], every, "right") for x in (single, first))
        keep = np.uint64(2 ** (8 * self.width) - 1)
        kind = f"<u{self.width}"
        for i, k in enumerate(every.tolist()):
            own, mark = single[a[i] : c[i]], slice(b[i], d[i])
            marks = (hashes[first[mark]] & keep).astype(kind).tobytes() + marked[mark].tobytes()
            rows.append((k, *self._places(ids, keys, row[own], place[own], flag[own]), (hashes[own] & keep).astype(kind).tobytes(), marks))
        for at in range(0, len(rows), 64):
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[at : at + 64]), (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=_NAMES)

    @staticmethod
    def _places(ids, keys, row, place, flag):
        cut = np.flatnonzero(np.diff(row, prepend=-1))
        return _squeeze(ids[row[cut]], keys[row[cut]], np.diff(np.append(cut, len(row))), place, flag)


def _meet(width: int):
    """What a bucket answers: per text, the places of windows that occur twice, flagged once at least."""

    def run(table: pa.Table) -> pa.Table:
        ids, keys, counts, places, flags, hashes, marks, mark_flags = ([] for _ in range(8))
        kind = f"<u{width}"
        out: list[tuple] = []

        def answer(i, k, c, p):
            ends = np.cumsum(c)
            out.extend(zip(i.tolist(), k.tolist(), (p[e - n : e].astype("<i4").tobytes() for e, n in zip(ends.tolist(), c.tolist()))))

        for size, meta, own, mark in zip(*(table.column(x).to_pylist() for x in _NAMES[1:])):
            i, k, c, p, f = _unsqueeze(size, meta)
            if own is None:
                answer(i, k, c, p)
                continue
            ids.append(i), keys.append(k), counts.append(c), places.append(p), flags.append(f)
            hashes.append(np.frombuffer(own, kind))
            n = len(mark) // (width + 1)
            marks.append(np.frombuffer(mark[: n * width], kind))
            mark_flags.append(np.frombuffer(mark[n * width :], np.uint8))
        if hashes:
            single, mark = np.concatenate(hashes), np.concatenate(marks)
            every = np.concatenate([single, mark])
            flag = np.concatenate([*flags, *(x > 0 for x in mark_flags)])
            order = np.argsort(every)
            edge = np.flatnonzero(np.diff(every[order].astype(np.uint64), prepend=~every[order[:1]].astype(np.uint64)))
            size = np.diff(np.append(edge, len(order)))
            # a mark stands for two places or more of its own
            good = (size > 1) & (np.maximum.reduceat(flag[order].astype(np.uint8), edge) > 0) if len(edge) else np.zeros(0, bool)
            hit = np.zeros(len(every), bool)
            hit[order[np.repeat(good, size)]] = True
            hit = hit[: len(single)]
            c, p = np.concatenate(counts), np.concatenate(places)
            i, k = np.concatenate(ids), np.concatenate(keys)
            of = np.repeat(np.arange(len(c)), c)[hit]
            n = np.bincount(of, minlength=len(c))
            some = n > 0
            answer(i[some], k[some], n[some], p[hit])
        x, y, z = zip(*out) if out else ((), (), ())
        return pa.table({"_id": pa.array(x, pa.int64()), "_key": pa.array(y, pa.int32()), "places": pa.array(z, pa.binary())})

    return run


def _rows_of(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The text of each word, and its place in it."""
    row = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    return row, np.arange(len(row)) - words.first[row]


def _inside(row: np.ndarray, width: int) -> np.ndarray:
    """Which runs of ``width`` words lie within one text."""
    return row[: len(row) - width + 1] == row[width - 1 :] if len(row) >= width else np.zeros(0, bool)


def _anchor_hits(docs: DataFrame, n_buckets: int, window: int) -> DataFrame:
    block_words = (window + 1) // 2

    def run(batches):
        packer = _Packer(n_buckets, 4)
        for batch in batches:
            for block in slices(batch, 1 << 20, 2):
                words = Words(block.column(2))
                row, place = _rows_of(words)
                own = np.flatnonzero(_inside(row, block_words))
                h = rolling(words.hashes(), block_words)[own]
                yield from packer.add(block.column(0).to_numpy(), block.column(1).to_numpy(), row[own], place[own], h, h >> np.uint64(32), place[own] % block_words == 0)
        yield from packer.flush()
        tidy()

    return by_bucket(docs.mapInArrow(run, _PACKED), n_buckets).groupBy("bucket").applyInArrow(_meet(4), _HITS)


def _places_of(column: pa.Array, first: np.ndarray) -> np.ndarray:
    """Word numbers within the block of all places, from lists of binaries of places."""
    found = [np.frombuffer(b"".join(x), "<i4").astype(np.int64) + at for x, at in zip(column.to_pylist(), first.tolist()) if x]
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def _repeat_hits(docs: DataFrame, n_buckets: int, window: int) -> DataFrame:
    block_words = (window + 1) // 2

    def run(batches):
        packer = _Packer(n_buckets, 8)
        for batch in batches:
            for block in slices(batch, 1 << 20, 2):
                words = Words(block.column(2))
                row, place = _rows_of(words)
                hits = _places_of(block.column(3), words.first[:-1])
                near = np.zeros(len(row) + 1, np.int64)
                np.add.at(near, np.maximum(hits - (window - block_words), words.first[row[hits]]) if len(hits) else hits, 1)
                np.add.at(near, hits + 1, -1)
                inside = _inside(row, window)
                own = np.flatnonzero(inside & (np.cumsum(near)[: len(inside)] > 0))
                h = words.hashes()
                route = rolling(mix(h, 5), window)[own]
                yield from packer.add(block.column(0).to_numpy(), block.column(1).to_numpy(), row[own], place[own], rolling(h, window)[own], route, np.ones(len(own), bool))
        yield from packer.flush()
        tidy()

    return by_bucket(docs.mapInArrow(run, _PACKED), n_buckets).groupBy("bucket").applyInArrow(_meet(8), _HITS)


def _few(table: DataFrame, names: list[str]) -> DataFrame | None:
    """The keys of a table, to be broadcast, if they are counted to be few enough."""
    return F.broadcast(table.select("_id", "_key").toDF(*names)) if table.count() <= MOST_BROADCAST else None


def repeats(docs: DataFrame, run: Scratch, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``_id`` and ``_key`` (``row_key``) and ``places``: the first words of all repeated windows of a text. A table
    that ``run`` keeps."""
    n = buckets(docs, text_col)
    text = F.col(f"`{text_col}`")
    keyed = docs.select(*row_key(F.col(f"`{id_col}`"), text), text.alias("text"))
    gather = lambda hits: hits.groupBy("_id", "_key").agg(F.collect_set("places").alias("places"))
    anchors = run.table(gather(_anchor_hits(keyed, n, window)), "anchors")
    few = _few(anchors, ["_id", "_key"])
    near = keyed if few is None else keyed.join(few, ["_id", "_key"], "left_semi")
    return run.keep(gather(_repeat_hits(near.join(anchors, ["_id", "_key"]).select("_id", "_key", "text", "places"), n, window)), "repeats")


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with ``kept_text``, ``n_words``, ``n_removed`` and ``removed``: the maximal repeats,
    as first word and the word after the last."""
    with Scratch(docs.sparkSession) as scope:
        found = repeats(docs, scope, id_col, text_col, window)
    added = free_names(docs, "kept_text", "n_words", "n_removed", "removed")
    spans = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    schema = T.StructType([*docs.schema.fields, *map(T.StructField, added, (T.StringType(), T.LongType(), T.LongType(), spans))])
    names, width, column = schema.names, len(docs.columns), docs.columns.index(text_col)
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for batch in batches:
            for block in slices(batch, 4 << 20, column):
                texts, total, gone, removed = [], [], [], []
                for text, places in zip(texts_of(block.column(column)), block.column(width).to_pylist()):
                    words = text.split()
                    total.append(len(words))
                    if places:
                        cover = np.zeros(len(words) + 1, np.int64)
                        at = np.unique(np.frombuffer(b"".join(places), "<i4"))
                        cover[at] += 1
                        cover[at + window] -= 1
                        keep = np.cumsum(cover)[:-1] == 0
                        cut = np.flatnonzero(np.diff(np.concatenate([[True], keep, [True]])))
                        words = list(compress(words, keep.tolist()))
                        removed.append([{"start": a, "end": b} for a, b in zip(cut[::2].tolist(), cut[1::2].tolist())])
                    else:
                        removed.append([])
                    gone.append(total[-1] - len(words))
                    texts.append(b" ".join(words).decode())
                yield pa.RecordBatch.from_arrays([*block.columns[:width], pa.array(texts, pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(removed, span)], names=names)

    names_ = free_names(docs, "_id", "_key", "_places")
    own = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.select("*", *row_key(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"), *names_[:2]))
    found_ = found.toDF(*names_)
    few = _few(found, names_[:2])
    if few is None:
        return keyed.join(found_, names_[:2], "left").select(*own, F.col(names_[2])).mapInArrow(run, schema)
    # texts without a repeat stay where they are
    some = keyed.join(few, names_[:2], "left_semi").join(found_, names_[:2]).select(*own, F.col(names_[2]))
    rest = keyed.join(few, names_[:2], "left_anti").select(*own, F.lit(None).cast("array<binary>").alias(names_[2]))
    return some.union(rest).mapInArrow(run, schema)
