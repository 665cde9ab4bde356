"""SimHash near-dedup at a similarity: soft-decoded Golay keys propose, the shingle sets decide.

Texts whose sets of word shingles have a Jaccard similarity of ``least`` or more are linked, and
each component of linked texts keeps one row. The method is that of ``simhash``, for pairs that
differ in many more bits than a hard decision bears (about 15 in 100 at a similarity of 0.8):

* A text's fingerprint is the sum of +-1 of each bit of its distinct shingles' hashes, kept with its
  size: a bit near zero is one that a near copy may have flipped. It has ``SEGMENTS`` = 5 segments of
  23 bits.
* Each segment is decoded softly by the binary Golay code: its ``NEAREST`` = 3 codewords of largest
  correlation are its indices. Segment errors go by the pigeonhole: two of the five segments must
  share an index, so a pair of segments with an index of each is a key (90 keys of 24 bits).
  Measured on random sets, a pair of similarity 0.8 shares a key with probability 0.98, one of 0.85
  with 0.99, one of 0.9 with over 0.999 (``tests/llm``).
* Entries meet by pair and first index, so that the three keys of one first index travel as one entry.
  Those that share a key and differ in ``MOST_BITS`` bits or fewer are candidates, unless their sizes or a second
  word, one bit of the least hash of each of 64 parts of the set, rule the similarity out.
* Candidates are verified on their whole shingle sets (64-bit hashes).

Texts of equal words (A-Z as a-z) are folded to one node before anything is compared. A bucket of keys hands on what its
candidates connect, as stars, not their pairs. The sets of each group so connected meet once, in blocks of ``BLOCK`` bytes:
a block is searched breadth first, each node verified against the candidates that no link has reached yet, so that a cluster
of near copies costs its size and no pair becomes a row. Of groups of several blocks that aren't one component then, blocks
meet by two, the first one with each first. No candidate of another component is left out.

Defined results: null and word-less texts are one node; the smallest id of a component stays (null
last; ids of any type), and of rows that repeat it, that of the smallest row key; rows that are equal in id and
text count once; columns stay as they are, whatever their names; an empty table gives an empty table.
A key's group is held by one task, at 42 bytes a distinct text; entries of a pair and first index are split by ranges of the second
one as texts grow, so that a group's size is that of a key of 24 bits. A task that verifies holds two blocks and one text more. Words are
hashed by polynomials modulo 2**64 over random values of their bytes: two words that are made to collide do, as one word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, Words, by_bucket, free_names, id_order, lowered, mix, powers, rolling, row_key, slices, small, tidy
from .common import _BASE, _BASE_INV
from .graph import components
from .simhash import code_bits

SHINGLE_WORDS, LEAST = 5, 0.8
SEGMENTS, NEAREST, BITS = 5, 3, 115
MOST_BITS = 34
#: Of 64 bits of least hashes: 6 differ at a similarity of 0.8 on average, with a spread of 2.4, and 32 of unlike sets.
MOST_MINS = 18
#: Bytes of sets of a block.
BLOCK = 8_000_000
#: Entries of one pair and first index beyond which they are split by ranges of the second one.
SPLIT = 2_000_000
_PAIRS = [(x, y) for x in range(SEGMENTS) for y in range(x + 1, SEGMENTS)]


class Sets(Words):
    """Distinct shingle hashes of several texts: ``hashes_[first_[i]:first_[i+1]]``, sorted, are text i's."""

    def __init__(self, texts: pa.Array, shingle: int = SHINGLE_WORDS):
        super().__init__(lowered(texts))
        h, n = self.hashes(), np.diff(self.first)
        row = np.repeat(np.arange(len(n)), n)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * powers(_BASE, len(h)), dtype=np.uint64)]) if len(h) else np.zeros(1, np.uint64)
        whole = (sums[self.first[1:]] - sums[self.first[:-1]]) * powers(_BASE_INV, len(h) + 1)[self.first[:-1]]
        #: A hash of all words of a text in order; 0 without words.
        self.node = np.where(n > 0, mix(whole, 3), np.uint64(0))
        parts = []
        for k in range(1, shingle + 1):  # shorter texts are one shingle
            inside = row[: len(row) - k + 1] == row[k - 1 :] if len(row) >= k else np.zeros(0, bool)
            own = np.flatnonzero(inside & ((n[row[: len(inside)]] == k) if k < shingle else True))
            if len(own):
                parts.append((row[own], mix(rolling(h, k)[own], k)))
        at = np.concatenate([x for x, _ in parts]) if parts else np.zeros(0, np.int64)
        values = np.concatenate([x for _, x in parts]) if parts else np.zeros(0, np.uint64)
        order = np.lexsort((values, at))
        at, values = at[order], values[order]
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1]) | (values[1:] != values[:-1])
        self.hashes_, at = values[new], at[new]
        self.first_ = np.searchsorted(at, np.arange(len(n) + 1))

    def margins(self) -> list[bytes | None]:
        """Sums of signs of BITS bits, in units of a 24th of their spread, as signed bytes; None without words."""
        n = np.diff(self.first_)
        some = np.flatnonzero(n)
        out: list[bytes | None] = [None] * len(n)
        if len(some):
            both = np.stack([mix(self.hashes_, 11), mix(self.hashes_, 12)], axis=1).astype("<u8")
            bits = np.unpackbits(both.view(np.uint8), axis=1, bitorder="little", count=BITS)
            total = np.add.reduceat(bits, self.first_[some], axis=0, dtype=np.int32) * 2 - n[some][:, None]
            scaled = np.clip(np.rint(total * (24 / np.sqrt(n[some])[:, None])), -127, 127).astype(np.int8)
            for i, x in zip(some.tolist(), scaled):
                out[i] = x.tobytes()
        return out

    def mins(self) -> np.ndarray:
        """One bit of the least hash of each of 64 parts of each set; 0 for a part that is empty."""
        h, n = mix(self.hashes_, 13), len(self.first_) - 1
        least = np.full(n * 64, np.uint64(2**64 - 1))
        np.minimum.at(least, np.repeat(np.arange(n), np.diff(self.first_)) * 64 + (h >> np.uint64(58)).astype(np.int64), h << np.uint64(6))
        bits = (least >> np.uint64(8) & np.uint64(1)).astype(np.uint8) * (least != np.uint64(2**64 - 1))
        return np.packbits(bits.reshape(n, 64), axis=1, bitorder="little").view("<u8").ravel()


_code: list[np.ndarray] = []


def soft_indices(margins: np.ndarray) -> np.ndarray:
    """The NEAREST codeword indices of each segment of each row: (rows, SEGMENTS, NEAREST)."""
    if not _code:
        _code.append(code_bits().astype(np.float32).T * 2 - 1)
    segments = margins.reshape(-1, 23)
    out = np.empty((len(segments), NEAREST), np.uint16)
    for at in range(0, len(segments), 512):  # 8 MB at a time
        near = segments[at : at + 512].astype(np.float32) @ _code[0]
        each = np.arange(len(near))
        for k in range(NEAREST):
            out[at : at + 512, k] = best = near.argmax(axis=1)
            near[each, best] = -np.inf
    return out.reshape(len(margins), SEGMENTS, NEAREST)


_SIGNS, _SIZE = np.uint64((1 << BITS - 64) - 1), np.uint64(BITS - 64)


def _prints(margins: np.ndarray, sizes: np.ndarray, mins: np.ndarray) -> np.ndarray:
    """Three 64-bit words a row: the signs, and in the bits that they leave the size of the set in steps of a 20th; the
    bits of least hashes."""
    bits = np.zeros((len(margins), 128), np.uint8)
    bits[:, :BITS] = margins > 0
    words = np.packbits(bits, axis=1, bitorder="little").view("<u8")
    words[:, 1] |= (np.log(np.maximum(sizes, 1)) / np.log(1.05)).astype(np.uint64) << _SIZE
    return np.column_stack([words, mins.astype(np.uint64)])


def _differ(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Differing bits; 1000 and more where sizes (a step of slack included) or least hashes rule a similarity of LEAST out."""
    signs = np.bitwise_count(x[..., 0] ^ y[..., 0]).astype(np.int16) + np.bitwise_count((x[..., 1] ^ y[..., 1]) & _SIGNS)
    away = np.abs((x[..., 1] >> _SIZE).astype(np.int16) - (y[..., 1] >> _SIZE).astype(np.int16))
    return signs + 1000 * ((away > 6) | (np.bitwise_count(x[..., 2] ^ y[..., 2]) > MOST_MINS)).astype(np.int16)


def _forest(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Candidates that connect what is connected among the entries of a key, by numbers."""
    a, b, rest = [], [], np.arange(len(prints))
    while len(rest) > 1:
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            x = todo.pop()
            near = _differ(prints[rest], prints[x]) <= MOST_BITS
            if near.any():
                found, rest = rest[near], rest[~near]
                a.append(np.full(len(found), x))
                b.append(found)
                todo.extend(found.tolist())
    return (np.concatenate(a), np.concatenate(b)) if a else (rest[:0], rest[:0])


def candidates(keys: np.ndarray, entry: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs of entries (by number) that connect those that are connected within any key."""
    order = np.lexsort((entry, keys))
    keys, entry = keys[order], entry[order]
    edge = np.flatnonzero(np.diff(keys.astype(np.int64), prepend=-1))
    size = np.diff(np.append(edge, len(keys)))
    two = edge[size == 2]  # most groups
    near = two[_differ(prints[entry[two]], prints[entry[two + 1]]) <= MOST_BITS]
    a, b = [entry[near]], [entry[near + 1]]
    for i in np.flatnonzero(size > 2).tolist():
        own = entry[edge[i] : edge[i] + size[i]]
        x, y = _forest(prints[own])
        a.append(own[x])
        b.append(own[y])
    return np.concatenate(a).astype(np.int64), np.concatenate(b).astype(np.int64)


def _rows(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """isnull, id, _id, _key, node, the number n of its shingles and margins of each row."""
    own = docs.select(F.col(f"`{id_col}`").isNull().alias("isnull"), F.col(f"`{id_col}`").alias("id"), *row_key(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")), F.col(f"`{text_col}`").alias("text"))
    schema = T.StructType([*own.schema.fields[:4], T.StructField("node", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("margins", T.BinaryType()), T.StructField("mins", T.LongType())])
    names = schema.names

    def run(batches):
        for batch in batches:
            for block in slices(batch, 1 << 20, 4):
                sets = Sets(block.column(4), shingle)
                yield pa.RecordBatch.from_arrays([*block.columns[:4], pa.array(sets.node.view(np.int64)), pa.array(np.diff(sets.first_).astype(np.int32)), pa.array(sets.margins(), pa.binary()), pa.array(sets.mins().view(np.int64))], names=names)
        tidy()

    return own.mapInArrow(run, schema)


def _parts(n: int) -> int:
    """Into how many ranges (a power of two) second indices are split for ``n`` nodes, each with ``NEAREST`` of the 4096 first indices."""
    return 1 << max(0, min(12, (max(0, n * NEAREST // 4096 - 1) // SPLIT).bit_length()))


def _entries(nodes: DataFrame, n_buckets: int, parts: int = 1) -> DataFrame:
    """Keys of nodes, packed by bucket of pair, first index and range of second indices."""

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), 2048):
                part = batch.slice(at, 2048)
                margins = np.frombuffer(b"".join(part.column(1).to_pylist()), np.int8).reshape(-1, BITS)
                node = part.column(0).to_numpy()
                index, prints = soft_indices(margins), _prints(margins, part.column(2).to_numpy(), part.column(3).to_numpy().view(np.uint64))
                group, row, second = [], [], []
                for p, (x, y) in enumerate(_PAIRS):
                    range_ = index[:, y].astype(np.int64) * parts >> 12
                    for j in range(NEAREST):
                        new = np.flatnonzero(~(range_[:, :j] == range_[:, j : j + 1]).any(axis=1))  # once in each range of its second indices
                        for k in range(NEAREST):
                            group.append((p << 24) | (index[new, x, k].astype(np.int64) << 12) | range_[new, j])
                            row.append(new)
                            second.append(index[new, y])
                group, row, second = np.concatenate(group), np.concatenate(row), np.concatenate(second)
                bucket = (mix(group.astype(np.uint64), 5) % np.uint64(n_buckets)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                group, row, second, bucket = group[order], row[order], second[order], bucket[order]
                cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
                packed = [(group[a:b].astype("<u4").tobytes(), second[a:b].tobytes(), node[row[a:b]].tobytes(), prints[row[a:b]].tobytes()) for a, b in zip(cuts, [*cuts[1:], len(bucket)])]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts]), *[pa.array(x, pa.binary()) for x in zip(*packed)]], names=["bucket", "groups", "seconds", "nodes", "prints"])

    return nodes.select("node", "margins", "n", "mins").mapInArrow(run, "bucket int, groups binary, seconds binary, nodes binary, prints binary")


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least number that each of ``n`` is connected to."""
    root = np.arange(n)
    while (root[a] != root[b]).any():
        x, y = root[a], root[b]
        np.minimum.at(root, x, y)
        np.minimum.at(root, y, x)
        while (root != (up := root[root])).any():
            root = up
    return root


def _meet(parts: int = 1):
    """What the candidates of a bucket connect, as stars of the least nodes; of an entry's second indices, those of its range count."""

    def run(table: pa.Table) -> pa.Table:
        joined = lambda c, kind: np.frombuffer(b"".join(table.column(c).to_pylist()), kind)
        group, second, node, prints = joined("groups", "<u4").astype(np.int64), joined("seconds", np.uint16).reshape(-1, NEAREST), joined("nodes", np.int64), joined("prints", "<u8").reshape(-1, 3)
        distinct, at, entry = np.unique(node, return_index=True, return_inverse=True)
        own = (second.astype(np.int64) * parts >> 12) == (group & 0xFFF)[:, None]
        keys = ((group << 12)[:, None] | second)[own]
        root = _roots(len(distinct), *candidates(keys, np.repeat(entry, NEAREST)[own.ravel()], prints[at]))
        found = np.flatnonzero(root != np.arange(len(root)))
        return pa.table({"a": distinct[root[found]], "b": distinct[found]})

    return run


def _search(prints: np.ndarray, first: np.ndarray, codes: np.ndarray, root: np.ndarray, block: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Verified links that connect what verified candidates connect, breadth first. ``codes[first[i]:first[i+1]]`` is set i, as
    numbers from 0; nodes of one root are connected, and those of one block too or not at all (-1: not searched yet)."""
    size, marked = np.diff(first), np.zeros(int(codes.max()) + 1, bool)
    a, b, rest, todo = [], [], np.arange(len(prints)), []
    while len(rest):
        if not todo:
            same = root[rest] == root[rest[0]]
            todo, rest = rest[same].tolist(), rest[~same]
            continue
        x = todo.pop()
        near = rest[_differ(prints[rest], prints[x]) <= MOST_BITS]
        near = near[(block[near] != block[x]) | (block[near] < 0)]
        if not len(near):
            continue
        n, own = size[near], codes[first[x] : first[x + 1]]
        ends = np.cumsum(n)
        marked[own] = True
        shared = np.add.reduceat(marked[codes[np.repeat(first[near] - ends + n, n) + np.arange(ends[-1])]], ends - n, dtype=np.int64)
        marked[own] = False
        near = near[shared >= (n + size[x] - shared) * least - 1e-9]
        if len(near):
            a.append(np.full(len(near), x))
            b.append(near)
            reached = np.isin(root[rest], root[near])
            todo += rest[reached].tolist()
            rest = rest[~reached]
    return (np.concatenate(a), np.concatenate(b)) if a else (rest[:0], rest[:0])


def _link(least: float):
    """Verified links of the groups of a unit: of each block that isn't searched, or between two blocks."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("group", "ascending"), ("node", "ascending")]).combine_chunks()
        group, node, root, block = (table.column(x).to_numpy() for x in ("group", "node", "root", "block"))
        prints = np.frombuffer(b"".join(table.column("print").to_pylist()), "<u8").reshape(-1, 3)
        sets = table.column("set").combine_chunks()
        first, values = np.append(0, np.cumsum(pc.list_value_length(sets).to_numpy())).astype(np.int64), sets.flatten().to_numpy()
        edge = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        a, b = [node[:0]], [node[:0]]
        for i, j in zip(edge.tolist(), [*edge[1:].tolist(), len(group)]):
            if j - i > 1:
                codes = np.unique(values[first[i] : first[j]], return_inverse=True)[1]
                x, y = _search(prints[i:j], first[i : j + 1] - first[i], codes, root[i:j], block[i:j], least)
                a.append(node[i + x])
                b.append(node[i + y])
        tidy()
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    return run


def _sets(docs: DataFrame, id_col: str, text_col: str, wanted: DataFrame, n_wanted: int, shingle: int) -> DataFrame:
    """node, set and print of the rows ``wanted`` (_id, _key)."""
    own = docs.select(*row_key(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")), F.col(f"`{text_col}`").alias("text")).join(small(wanted, n_wanted), ["_id", "_key"], "left_semi")

    def run(batches):
        for batch in batches:
            for block in slices(batch, 1 << 20, 0):
                sets = Sets(block.column(0), shingle)
                prints = _prints(np.frombuffer(b"".join(sets.margins()), np.int8).reshape(-1, BITS), np.diff(sets.first_), sets.mins())  # all have words
                yield pa.RecordBatch.from_arrays([pa.array(sets.node.view(np.int64)), pa.ListArray.from_arrays(pa.array(sets.first_.astype(np.int32)), pa.array(sets.hashes_.view(np.int64))), pa.array([x.tobytes() for x in prints], pa.binary())], names=["node", "set", "print"])
        tidy()

    return own.select("text").mapInArrow(run, "node long, set array<long>, print binary").dropDuplicates(["node"])


def similar_links(docs: DataFrame, nodes: DataFrame, run: Scratch, id_col: str, text_col: str, shingle: int = SHINGLE_WORDS, least: float = LEAST) -> DataFrame:
    """``node`` and ``root`` of the nodes (node, _id, _key, n, margins, mins) that are linked to another."""
    worded = nodes.where("margins is not null")
    n = worded.count()
    n_buckets = max(64, n * 30 // 400_000)
    parts = _parts(n)
    pairs = run.table(by_bucket(_entries(worded, n_buckets, parts), n_buckets).groupBy("bucket").applyInArrow(_meet(parts), "a long, b long").distinct(), "pairs")
    near = components(pairs, run).withColumnRenamed("root", "group")
    wanted = run.table(worded.join(near, "node", "left_semi").select("_id", "_key"), "wanted")
    sets = run.table(_sets(docs, id_col, text_col, wanted, wanted.count(), shingle), "sets").withColumn("bytes", F.size("set").cast("long") * 8 + 64)
    member = sets.join(near, "node")
    total = sets.agg(F.sum("bytes")).first()[0] or 0
    units = int(max(64, 2 * total // BLOCK))
    large = run.table(member.groupBy("group").agg(F.ceil(F.sum("bytes") / BLOCK).cast("int").alias("blocks")).where("blocks > 1"), "large")
    several = large.count()
    member = member.join(small(large, several), "group", "left").withColumn("of", F.pmod(F.xxhash64("node"), F.coalesce("blocks", F.lit(1))).cast("int"))
    # groups of one block share units; other blocks are units of their own
    alone = member.withColumn("unit", F.when(F.col("blocks").isNull(), F.pmod(F.xxhash64("group"), F.lit(units))).otherwise(F.xxhash64("group", "of")))
    links = run.table(_apply(alone.withColumn("root", F.col("node")).withColumn("block", F.lit(-1)), units, least), "links")
    roots = components(links, run)
    for first in (True, False):
        if not several:
            break
        own = member.where("blocks is not null").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        mixed = own.groupBy("group").agg(F.max("blocks").alias("n"), (F.max("root") > F.min("root")).alias("more")).where("more").select("group", "n")
        mixed = run.table(mixed if first else mixed.where("n > 2"), "mixed")
        several = mixed.count()
        if not several:
            break
        cells = mixed.agg(F.sum(F.col("n") - 1 if first else (F.col("n") - 1) * (F.col("n") - 2) / 2)).first()[0]
        others = F.sequence(F.lit(1), F.col("blocks") - 1)
        cell = F.when(F.col("of") == 0, others).otherwise(F.array("of")) if first else F.transform(F.filter(others, lambda j: j != F.col("of")), lambda j: F.least("of", j) * F.lit(1 << 31).cast("long") + F.greatest("of", j))
        own = own.where("true" if first else "of > 0").join(small(mixed.select("group"), several), "group", "left_semi").withColumn("cell", F.explode(cell))
        more = run.table(_apply(own.withColumn("unit", F.xxhash64("group", "cell")).withColumn("block", F.col("of")), int(cells), least), "links")
        links = links.union(more)
        roots = components(links, run)
    return roots


def _apply(members: DataFrame, units: int, least: float) -> DataFrame:
    """Verified links (a, b) within each unit."""
    part = members.select("unit", "group", "node", "root", "block", "print", "set")
    return part.repartition(max(1, min(units, 100_000)), "unit").groupBy("unit").applyInArrow(_link(least), "a long, b long")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE_WORDS, least: float = LEAST) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates of a similarity of ``least`` (0.8 or more, which the number
    of bits allows for)."""
    if least < LEAST:
        raise ValueError(f"least must be {LEAST} or more")
    spark = docs.sparkSession
    with Scratch(spark) as run:
        rows = run.table(_rows(docs, id_col, text_col, shingle), "rows")
        order = F.struct("isnull", "id", "_id", "_key")
        nodes = run.table(rows.groupBy("node").agg(F.min(order).alias("k"), F.first("n").alias("n"), F.first("margins").alias("margins"), F.first("mins").alias("mins")).select("node", "k", "k._id", "k._key", "n", "margins", "mins"), "nodes")
        roots = similar_links(docs, nodes, run, id_col, text_col, shingle, least)
        rooted = nodes.join(roots, "node", "left").select("k", F.coalesce("root", "node").alias("root"))
        kept = rooted.groupBy("root").agg(F.min("k").alias("k")).select("k._id", "k._key")
        counts = rows.groupBy("_id", "_key").agg(F.count(F.lit(1)).alias("n"))
        # rows that go, and those that stay once of several
        marked = counts.join(kept.withColumn("stays", F.lit(True)), ["_id", "_key"], "left").where("stays is null or n > 1")
        mark = run.keep(marked.select("_id", "_key", F.col("stays").isNotNull().alias("stays")), "marked")
        again = mark.where("stays").count()
        n_marks = mark.count()
    names = free_names(docs, "_id", "_key", "_stays")
    keyed = docs.select("*", *row_key(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"), *names[:2]))
    own = [F.col(f"`{c}`") for c in docs.columns]
    marks = small(mark.toDF(*names), n_marks)
    out = keyed.join(marks, names[:2], "left_anti").select(*own)
    if again:
        out = out.unionByName(keyed.join(small(mark.where("stays").toDF(*names).select(*names[:2]), again), names[:2], "left_semi").dropDuplicates(names[:2]).select(*own))
    return out
