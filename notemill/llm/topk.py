"""Exact top-k search by tiled matrix products.

Queries are the rows whose id is divisible by ``every``; candidates are all rows. Queries are taken in
blocks of a bounded size (``block_bytes``), each of which is broadcast; candidates stay where they are: a task reads its
shard of them in tiles, takes the matrix product of each tile and the block, keeps the best k of the tile for
every query (partial selection), and merges them into its running lists. The lists are then merged as a tree: first
within groups of shards, then per query. More queries are more blocks; nothing that is broadcast or held grows with the table.

Components x become floor(256 x), x as double; products of integers are exact (double precision
while all sums stay under 2**53, Python integers beyond; scores are held to 64 bits).

Defined results: ids are integers; vectors that are null or hold a null or non-finite component, and null ids,
take no part; a shorter vector counts as padded with zeros; ties go to the smaller id; a
query's own id is no candidate; rows that repeat id and vector count once; rows that share an
id but not the vector are searched together as that id, and one score of theirs counts once; only the columns named
below are returned, so other columns don't matter; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch

#: Groups of shards whose lists are merged first.
GROUP = 16


def quantised(column: pa.Array) -> np.ndarray:
    """floor(256 x) of the vectors as a matrix of doubles, padded with zeros."""
    column = column.cast(pa.large_list(pa.float64()))
    at = np.asarray(column.offsets, np.int64)
    size = np.diff(at)
    flat = np.floor(256.0 * np.asarray(column.values)[at[0] : at[-1]] if len(column) else np.zeros(0))
    out = np.zeros((len(column), int(size.max(initial=0))))
    out[np.arange(out.shape[1]) < size[:, None]] = flat
    return out


def _once(ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted by id, without rows that repeat another one's id and vector."""
    order = np.argsort(ids, kind="stable")
    ids, rows = ids[order], rows[order]
    if len(ids) > 1 and (ids[1:] == ids[:-1]).any():
        seen, keep = set(), []
        for i, x in enumerate(ids.tolist()):
            key = x, rows[i].tobytes()
            if key not in seen:
                seen.add(key)
                keep.append(i)
        ids, rows = ids[keep], rows[keep]
    return ids, rows


def best_of_tile(query_ids, queries, ids, rows, k: int, tile: int = 256):
    """The k best (query, candidate, score) of each query; ``ids`` ascend."""
    width = max(queries.shape[1], rows.shape[1])
    queries, rows = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (queries, rows))
    exact = np.abs(queries).max(initial=0) * np.abs(rows).max(initial=0) * max(width, 1) < 2**53
    out: tuple[list, list, list] = ([], [], [])
    if not exact:
        rows = np.array([[int(x) for x in r] for r in rows.tolist()], object).reshape(len(rows), width)
    for at in range(0, len(queries), tile):
        part = queries[at : at + tile]
        if exact:
            scores = part @ rows.T
        else:
            whole = np.array([[int(x) for x in r] for r in part.tolist()], object).reshape(len(part), width)
            scores = np.clip(whole @ rows.T, -(2**63), 2**63 - 1)
        for query, line in zip(query_ids[at : at + tile].tolist(), scores):
            other = np.flatnonzero(ids != query)
            own = line[other]
            if len(own) > k:
                if exact:
                    bar = np.partition(own, len(own) - k)[len(own) - k]
                    over = np.flatnonzero(own > bar)
                    pick = np.concatenate([over, np.flatnonzero(own == bar)[: k - len(over)]])
                else:
                    pick = np.array(sorted(range(len(own)), key=lambda i: (-own[i], i))[:k])
                other, own = other[pick], own[pick]
            out[0].extend([query] * len(own))
            out[1].extend(ids[other].tolist())
            out[2].extend(int(x) for x in own)
    return out


def _pruned(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int):
    """The k best distinct (candidate, score) of each query."""
    order = np.lexsort((ids, np.invert(scores), query))
    query, ids, scores = query[order], ids[order], scores[order]
    new = np.ones(len(query), bool)
    new[1:] = (query[1:] != query[:-1]) | (ids[1:] != ids[:-1]) | (scores[1:] != scores[:-1])
    query, ids, scores = query[new], ids[new], scores[new]
    first = np.flatnonzero(np.diff(query, prepend=query[:1] - 1))
    rank = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
    return query[rank < k], ids[rank < k], scores[rank < k]


def _search(own: DataFrame, block: tuple[np.ndarray, np.ndarray], k: int, tile: int) -> DataFrame:
    """query_id, id, score and shard: the k best of each shard of candidates for a block of queries."""
    shared = own.sparkSession.sparkContext.broadcast(block)

    def run(batches):
        from pyspark import TaskContext

        asked, queries = shared.value
        best = tuple(np.zeros(0, np.int64) for _ in range(3))
        for batch in batches:
            for at in range(0, len(batch), tile):
                part = batch.slice(at, tile)
                ids, rows = _once(part.column(0).to_numpy(), quantised(part.column(1)))
                found = best_of_tile(asked, queries, ids, rows, k)
                best = _pruned(*(np.concatenate([x, np.array(y, np.int64)]) for x, y in zip(best, found)), k)
        shard = TaskContext.get().partitionId()
        for at in range(0, len(best[0]), 50_000):
            query, ids, scores = (x[at : at + 50_000] for x in best)
            yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(ids), pa.array(scores), pa.array(np.full(len(query), shard, np.int32))], names=["query_id", "id", "score", "shard"])

    return own.mapInArrow(run, "query_id long, id long, score long, shard int")


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", block_bytes: int = 32 << 20, tile: int = 4096) -> DataFrame:
    """``query_id``, ``rank``, id and ``score`` of the k best candidates of each query."""
    own = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    own = own.where(F.forall("v", lambda x: fine(x.cast("double"))))
    with Scratch(vectors.sparkSession) as run:
        queries = run.table(own.where(F.col("id") % every == 0), "queries")
        n, width = queries.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
        n_blocks = max(1, -(-n * (8 * width + 16) // block_bytes))
        partial = None
        for b in range(n_blocks):
            table = queries.where(F.pmod(F.xxhash64("id"), F.lit(n_blocks)) == b).toArrow().combine_chunks()  # about block_bytes
            vectors_ = table.column("v").combine_chunks() if table.num_rows else pa.array([], pa.list_(pa.float64()))
            vectors_ = pa.concat_arrays(vectors_.chunks) if isinstance(vectors_, pa.ChunkedArray) else vectors_
            block = _once(table.column("id").to_numpy(), quantised(vectors_))
            found = run.keep(_search(own, block, k, tile), "lists")
            partial = found if partial is None else partial.union(found)
    best = [F.col("score").desc(), F.col("id")]
    inner = partial.dropDuplicates(["query_id", "id", "score"]).withColumn("g", F.col("shard") % GROUP)
    inner = inner.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "g").orderBy(*best))).where(F.col("n") <= k)
    ranked = inner.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*best))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), "score")
