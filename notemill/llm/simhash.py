"""SimHash near-duplicates, found by Golay-code fuzzy hashing.

A text's 64-bit fingerprint has bit i set if over half the XXH64 values (seed 42) of its
word shingles have it. Fingerprints link at ``MOST_BITS`` = 4 or fewer differing bits:

* A fingerprint is cut into segments of 22, 21 and 21 bits. Of 4 differing bits, two of the
  three segments together have at most 2 (pigeonhole on the largest of three).
* A segment, padded to 23 bits, is decoded by the perfect binary Golay code: each word lies
  within 3 bits of exactly one codeword. Its keys are the 12-bit indices of the codewords of
  all words within 1 bit of it: one if its own codeword is within 2 bits, else six. Two
  segments within 2 bits have a word within 1 bit of both, and so share a key.
* Hence two fingerprints that link share one of the keys (pair of segments, index, index).
  Rows meet by key, each pair that shares a key is verified on all 64 bits, and of a large
  cluster only a spanning forest is passed on: a pair of linked fingerprints that is left
  out is still connected by pairs that are not, so that no component loses a member.

In a group of over ``LARGE`` fingerprints of one key only those are compared that agree on one of five
blocks of their 64 bits, as any two within 4 bits do; so a key's work grows with its links, not its
square. Copies share a fingerprint and are folded before anything is compared; the components of
distinct fingerprints are found in the shared folder (``graph.components``).

``classes`` is the operator with links by bits; ``near.near_dedup`` is the one for a similarity.

Defined results: null and word-less texts have fingerprint zero and link like any other; ids are of
any type that can be ordered; null ids don't count for ``component_id``, which is null where all ids
are; repeated rows get equal rows; what is returned has the id's name and ``fp``, ``component_id``, ``root``
(with leading underscores where the id is called so), other columns don't matter; an empty table
gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, by_bucket, mix, slices, texts_of
from .graph import components

SHINGLE_WORDS = 4
MOST_BITS = 4
#: Groups beyond this are split by blocks of bits.
LARGE = 512
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))  # lowest bit, bits
SEED = 42
SEGMENTS = ((42, 22), (21, 21), (0, 21))  # lowest bit, bits
PAIRS = ((0, 1), (0, 2), (1, 2))
#: Fixed value: generator polynomial of the binary Golay code, x^11+x^10+x^6+x^5+x^4+x^2+1.
GENERATOR = 0xC75


def _remainder(word: int) -> int:
    for bit in range(22, 10, -1):
        if word >> bit & 1:
            word ^= GENERATOR << bit - 11
    return word


def golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The syndrome part of each upper 12 bits; for each syndrome the error patterns that lead
    to its keys (padded with the first), and how many there are."""
    upper = np.array([_remainder(i << 11) for i in range(4096)], np.uint32)
    one = [_remainder(1 << i) for i in range(23)]
    near: dict[int, int] = {0: 0}
    for i in range(23):
        near[one[i]] = 1 << i
        for j in range(i):
            near[one[i] ^ one[j]] = 1 << i | 1 << j
            for k in range(j):
                near[one[i] ^ one[j] ^ one[k]] = 1 << i | 1 << j | 1 << k
    patterns, number = np.zeros((2048, 6), np.uint32), np.zeros(2048, np.int64)
    for syndrome in range(2048):
        found = [near[syndrome]]
        for i in range(23):
            pattern = near[syndrome ^ one[i]] ^ 1 << i
            if pattern not in found:
                found.append(pattern)
        number[syndrome] = len(found)
        patterns[syndrome] = found + found[:1] * (6 - len(found))
    return upper, patterns, number


def code_bits() -> np.ndarray:
    """The 4096 codewords as rows of 23 bits."""
    word = np.array([i << 11 | _remainder(i << 11) for i in range(4096)], np.uint32)
    return (word[:, None] >> np.arange(23, dtype=np.uint32) & 1).astype(np.uint8)


_tables: list = []


def segment_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Key indices (n, 6) of 23-bit words, and how many of the six count."""
    if not _tables:
        _tables.extend(golay_tables())
    upper, patterns, number = _tables
    syndrome = (words & 2047) ^ upper[words >> 11]
    return (words[:, None] ^ patterns[syndrome]) >> 11, number[syndrome]


def fuzzy_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All keys of fingerprints, and the row that each key belongs to."""
    parts = [segment_keys(((prints >> np.uint64(low)) & np.uint64((1 << bits) - 1)).astype(np.uint32)) for low, bits in SEGMENTS]
    keys, rows = [], []
    for p, (x, y) in enumerate(PAIRS):
        (a, n), (b, m) = parts[x], parts[y]
        for i in range(6):
            for j in range(6):
                row = np.flatnonzero((n > i) & (m > j))
                keys.append((np.uint32(p) << np.uint32(24)) | (a[row, i] << np.uint32(12)) | b[row, j])
                rows.append(row)
    return np.concatenate(keys), np.concatenate(rows)


def fingerprint(text: bytes, shingle: int = SHINGLE_WORDS) -> int:
    """The fingerprint of one text, given as UTF-8; A-Z count as a-z."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # of bytes: A-Z alone, and exactly the six ASCII white-space bytes
    n = len(words)
    if not n:
        return 0
    line = b" ".join(words)
    at = 0
    begins = [at := at + len(w) + 1 for w in words]  # where the next word begins
    starts, ends = [0, *begins[:-1]], [b - 1 for b in begins]
    k = min(shingle, n)
    h = np.fromiter((xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts, ends[k - 1 :])), np.uint64, n - k + 1)
    total = np.zeros(64, np.int64)
    for part in np.array_split(h, max(1, len(h) >> 14)):
        total += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE_WORDS) -> DataFrame:
    """The id (as ``id``) and ``fp`` (long: the 64 bits) of each row."""
    own = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    schema = T.StructType([own.schema["id"], T.StructField("fp", T.LongType())])

    def run(batches):
        for batch in batches:
            for block in slices(batch, 4 << 20, 1):
                fps = np.array([fingerprint(t, shingle) for t in texts_of(block.column(1))], np.uint64)
                yield pa.RecordBatch.from_arrays([block.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    return own.mapInArrow(run, schema)


def _forest(prints: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect whatever is connected among ``prints``: each print found from a
    neighbour is compared to those that are not found yet."""
    out, rest = [], prints
    while len(rest) > 1:
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            x = todo.pop()
            near = np.bitwise_count(rest ^ x) <= MOST_BITS
            if near.any():
                found = rest[near]
                out.append((np.full(len(found), x), found))
                todo.extend(found)
                rest = rest[~near]
    return out


def links(keys: np.ndarray, prints: np.ndarray, small: int = 24) -> tuple[np.ndarray, np.ndarray]:
    """Verified links between distinct prints that share a key. Groups over ``small`` give spanning forests:
    not every link, but links that connect whatever is connected."""
    order = np.argsort(keys, kind="stable")
    keys, prints = keys[order], prints[order]
    edge = np.flatnonzero(np.diff(keys.astype(np.int64), prepend=-1))
    size = np.diff(np.append(edge, len(keys)))
    found = []
    for i in np.flatnonzero(size > small):
        own = np.unique(prints[edge[i] : edge[i] + size[i]])
        if len(own) <= LARGE:
            found += _forest(own)
            continue
        for low, bits in BLOCKS:
            part = (own >> np.uint64(low)) & np.uint64((1 << bits) - 1)
            by = np.argsort(part, kind="stable")
            for group in np.split(own[by], np.flatnonzero(np.diff(part[by])) + 1):
                found += _forest(group)
    inside = np.repeat(size <= small, size)
    keys, prints = keys[inside], prints[inside]
    at = np.arange(len(keys))
    for step in range(1, small):
        at = at[at + step < len(keys)]
        at = at[keys[at] == keys[at + step]]
        if not len(at):
            break
        near = at[np.bitwise_count(prints[at] ^ prints[at + step]) <= MOST_BITS]
        found.append((prints[near], prints[near + step]))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    a, b = np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])
    both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
    return both[0], both[1]


def fuzzy_links(distinct: DataFrame, keys_at_once: int = 1_000_000) -> DataFrame:
    """Links (a, b) between the distinct fingerprints ``fp`` of a table: all of small groups, spanning forests
    of large ones, so that components are whole but pairs need not be."""
    n = distinct.count()
    buckets = int(max(64, n * 84 // keys_at_once))

    def spread(batches):
        for batch in batches:
            for at in range(0, len(batch), 20_000):
                prints = batch.column(0).to_numpy(zero_copy_only=False)[at : at + 20_000].view(np.uint64)
                keys, rows = fuzzy_keys(prints)
                bucket = (mix(keys.astype(np.uint64)) % np.uint64(buckets)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                keys, rows, bucket = keys[order], rows[order], bucket[order]
                cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
                parts = [(keys[a:b].tobytes(), prints[rows[a:b]].tobytes()) for a, b in zip(cuts, [*cuts[1:], len(bucket)])]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts]), pa.array([x for x, _ in parts], pa.binary()), pa.array([y for _, y in parts], pa.binary())], names=["bucket", "keys", "prints"])

    def meet(table: pa.Table) -> pa.Table:
        keys = np.frombuffer(b"".join(table.column("keys").to_pylist()), np.uint32)
        prints = np.frombuffer(b"".join(table.column("prints").to_pylist()), np.uint64)
        a, b = links(keys, prints)
        return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    packed = distinct.select("fp").mapInArrow(spread, "bucket int, keys binary, prints binary")
    return by_bucket(packed, buckets).groupBy("bucket").applyInArrow(meet, "a long, b long")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE_WORDS) -> DataFrame:
    """id, ``fp``, ``component_id``, the smallest id that is reachable by links, and ``root``, the smallest
    fingerprint (as a long) of the component."""
    spark = docs.sparkSession
    with Scratch(spark) as run:
        prints = run.keep(fingerprints(docs, id_col, text_col, shingle), "prints")
        distinct = run.table(prints.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
        roots = components(run.table(fuzzy_links(distinct), "links"), run)
        rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
        # a table of its own: joined as read, a root with many fingerprints can be split
        least = run.table(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "least")
        member = run.keep(rooted.join(least, "root").select("fp", "component_id", "root"), "members")
    added = [x if x != id_col else "_" + x for x in ("fp", "component_id", "root")]
    return prints.join(member, "fp").select(F.col("id").alias(id_col), *[F.col(x).alias(y) for x, y in zip(("fp", "component_id", "root"), added)])
