"""Near-duplicates of embeddings by a pigeonhole join of subspaces.

Vectors of one label link at a cosine of ``least`` or more, that is, as unit vectors, at a squared distance of at most D = 2 (1 - ``least``).
They are rotated (random signs, then a Walsh-Hadamard transform, which deals the distance out evenly) and split into blocks of
``BLOCK`` dimensions. Two vectors that link have a block in which their squared distance is at most that block's share of D, in
proportion to its dimensions: else all shares together would exceed D. So for each block the vectors are joined within that range, and what any
block proposes is verified on the whole vectors, by their cosine in double precision.

* A block's range join is by slices of its first coordinate, twice as wide as the range: a vector is at home in one slice, and a guest in the
  next one if the range reaches there. Slices of over ``UNIT_BYTES`` of vectors are dealt out to units by two parts of the slice, so
  that a task holds two parts, however many vectors lie in a slice, and units of one slice spread over tasks.
* In a unit, vectors lie in kd-ordered tiles; tiles whose boxes are out of range are skipped, others compared by matrix products.
* Block coordinates are whole numbers (units of 2**-20), so that every task judges the range of a block alike. The range is wider by what rounding to
  these can cost. A pair counts in the first block that proposes it, which each task can tell from the two vectors, so that links are
  counted once without a shuffle of pairs: a unit hands on one row for a vector that has links, with their number and the least vector it is connected to.

Equal vectors of a label are folded before anything is compared, and their number counts in ``n_links``.

Defined results: vectors that are null, empty, zero or hold a null or non-finite component, and those without a label, link with nothing; neither do vectors
of two lengths; ids are of any type that can be ordered, null ids don't count for ``component_id``, which is null where all are;
rows that repeat are linked rows; other columns don't matter; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, small, tidy
from .graph import components
from .kmeans import tree_of

LEAST, BLOCK, TILE = 0.93, 8, 256
UNIT_BYTES = 4_000_000
_UNIT = float(1 << 20)
#: Pairs of two tiles beyond which whole matrix products are cheaper than one product a pair.
DENSE = 4096


def unit_vectors(v: np.ndarray) -> np.ndarray:
    """Rows of length one; rows are not zero."""
    v = np.ascontiguousarray(v / np.abs(v).max(axis=1, keepdims=True))
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def rotated(units: np.ndarray) -> np.ndarray:
    """The rotated rows as whole numbers, times the square root of their (padded) width."""
    width = 1 << max(0, units.shape[1] - 1).bit_length()
    out = np.zeros((len(units), width))
    signs = np.random.Generator(np.random.PCG64(13)).integers(0, 2, width) * 2.0 - 1
    out[:, : units.shape[1]] = np.rint(units * _UNIT) * signs[: units.shape[1]]
    half = 1
    while half < width:
        pairs = out.reshape(len(out), -1, 2, half)
        out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(out), width)
        half *= 2
    return out


def budget(width: int, least: float) -> float:
    """The squared range of a block of a (padded) width, in the numbers of ``rotated``."""
    far = np.sqrt(max(0.0, 2 - 2 * least) + 1e-9) + np.sqrt(width) / _UNIT
    return float(np.ceil(far * far * min(BLOCK, width) * _UNIT * _UNIT))


def _tiles(x: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
    """The rows in tiles of neighbours."""
    if not len(rows):
        return []
    order, nodes = tree_of(x[rows], TILE)
    return [rows[order[i : min(i + TILE, end)]] for begin, end, right in nodes.tolist() if not right for i in range(begin, end, TILE)]


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of whole numbers, exact."""
    return (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1) - 2 * (x @ y.T)


class Links:
    """Links of the vectors of a unit: for each the number of rows that it links with, and the least number it is connected to."""

    def __init__(self, copies: np.ndarray):
        self.copies, self.n, self.root = copies, np.zeros(len(copies), np.int64), np.arange(len(copies))

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        np.add.at(self.n, a, self.copies[b])
        np.add.at(self.n, b, self.copies[a])
        while True:
            x, y = self.root[a], self.root[b]
            away = x != y
            if not away.any():
                return
            a, b, x, y = a[away], b[away], x[away], y[away]
            np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))
            while (self.root != (up := self.root[self.root])).any():
                self.root = up


def unit_links(v: np.ndarray, copies: np.ndarray, side: np.ndarray, inner: bool, block: int, least: float) -> Links:
    """The links that ``block`` is the first to propose: between the sides 0 and 1 and, if ``inner``, within side 0."""
    units = unit_vectors(v)
    turned = rotated(units)
    most, width = budget(turned.shape[1], least), min(BLOCK, turned.shape[1])
    part = [np.ascontiguousarray(turned[:, i : i + width]) for i in range(0, width * (block + 1), width)]
    x, found = part[block], Links(copies)
    homes, guests = _tiles(x, np.flatnonzero(side == 0)), _tiles(x, np.flatnonzero(side == 1))
    tiles = homes + guests
    low, high = (np.array([f(x[t], axis=0) for t in tiles]).reshape(-1, width) for f in (np.min, np.max))
    for i, a in enumerate(homes):
        others = np.arange(i if inner else len(homes), len(tiles))
        gap = np.maximum(0, np.maximum(low[others] - high[i], low[i] - high[others]))
        for j in others[(gap * gap).sum(axis=1) <= most]:
            b = tiles[j]
            near = _apart(x[a], x[b]) <= most
            if i == j:
                near &= np.tri(len(a), k=-1, dtype=bool).T
            p, q = np.nonzero(near)
            if len(p) > DENSE:
                for y in part[:block]:
                    near &= _apart(y[a], y[b]) > most
                near &= units[a] @ units[b].T >= least
                p, q = np.nonzero(near)
                p, q = a[p], b[q]
            else:
                p, q = a[p], b[q]
                for y in part[:block]:
                    away = ((y[p] - y[q]) ** 2).sum(axis=1) > most
                    p, q = p[away], q[away]
                linked = (units[p] * units[q]).sum(axis=1) >= least
                p, q = p[linked], q[linked]
            if len(p):
                found.add(p, q)
    return found


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _sliced(nodes: DataFrame, least: float) -> DataFrame:
    """``nodes`` with, for each block, the slice and whether the range reaches the next one."""

    def run(batches):
        for batch in batches:
            sizes = batch.column("d").to_numpy()
            for d in np.unique(sizes):
                part = batch.filter(pa.array(sizes == d))
                for at in range(0, len(part), 2048):
                    own = part.slice(at, 2048)
                    turned = rotated(unit_vectors(_matrix(own.column("v"))))
                    reach = np.ceil(np.sqrt(budget(turned.shape[1], least))) + 1
                    x = turned[:, ::BLOCK]
                    slice_ = np.floor(x / (2 * reach))
                    up = x + reach >= (slice_ + 1) * (2 * reach)
                    offsets = pa.array(np.arange(len(own) + 1) * x.shape[1], pa.int32())
                    yield pa.RecordBatch.from_arrays([*own.columns, pa.ListArray.from_arrays(offsets, pa.array(slice_.astype(np.int32).ravel())), pa.ListArray.from_arrays(offsets, pa.array(up.ravel()))], names=[*own.schema.names, "slices", "up"])
        tidy()

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in nodes.schema.fields)
    return nodes.mapInArrow(run, fields + ", slices array<int>, up array<boolean>")


_CELL = ["label", "d", "block", "slice"]


def _units(sliced: DataFrame, run: Scratch, unit_bytes: int) -> DataFrame:
    """A row for each vector and unit: the cell, the two parts x and y of it that meet, and on which side the vector is."""
    homes = sliced.select("*", F.posexplode("slices").alias("block", "home"))
    guest = F.element_at("up", F.col("block") + 1)
    at = F.when(guest, F.array(F.struct(F.col("home").alias("slice"), F.lit(0).alias("side")), F.struct((F.col("home") + 1).alias("slice"), F.lit(1).alias("side")))).otherwise(F.array(F.struct(F.col("home").alias("slice"), F.lit(0).alias("side"))))
    each = homes.select("label", "d", "node", "copies", "v", "block", F.explode(at).alias("at")).select("label", "d", "node", "copies", "v", "block", "at.slice", "at.side")
    most = F.greatest(F.lit(32), F.floor(F.lit(unit_bytes) / (8 * F.col("d"))))
    parts = lambda n: F.ceil(n / most).cast("int")
    cells = each.drop("v").groupBy(*_CELL).agg(F.sum(1 - F.col("side")).alias("h"), F.sum("side").alias("g"))
    large = run.table(cells.where((F.col("h") > most) | (F.col("g") > most)).select(*_CELL, F.greatest(parts(F.col("h")), F.lit(1)).alias("hs"), parts(F.col("g")).alias("gs")), "cells")
    each = each.join(small(large), _CELL, "left")
    own = F.pmod(F.xxhash64("node"), F.when(F.col("side") == 0, F.col("hs")).otherwise(F.col("gs"))).cast("int")
    unit = lambda x, y, side: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"), side.cast("int").alias("side"))
    until = lambda n: F.filter(F.sequence(F.lit(0), n), lambda i: i < n)
    met = F.concat(F.transform(until(F.col("hs")), lambda i: unit(F.least(own, i), F.greatest(own, i), F.when(own <= i, 0).otherwise(1))), F.transform(until(F.col("gs")), lambda i: unit(own, F.col("hs") + i, F.lit(0))))
    visits = F.transform(until(F.col("hs")), lambda i: unit(i, F.col("hs") + own, F.lit(1)))
    where = F.when(F.col("hs").isNull(), F.array(unit(F.lit(0), F.lit(0), F.col("side")))).when(F.col("side") == 0, met).otherwise(visits)
    return each.select(*_CELL, "node", "copies", "v", F.explode(where).alias("unit")).select(*_CELL, "unit.x", "unit.y", "unit.side", "node", "copies", "v")


def _linked(units: DataFrame, least: float, partitions: int) -> DataFrame:
    """node, n and root: for each unit its vectors that have links there."""

    def run(table: pa.Table) -> pa.Table:
        node = table.column("node").to_numpy()
        order = np.argsort(node)  # the least number is the least node
        inner = table.column("x")[0].as_py() == table.column("y")[0].as_py()
        found = unit_links(_matrix(table.column("v"))[order], table.column("copies").to_numpy()[order], table.column("side").to_numpy()[order], inner, table.column("block")[0].as_py(), least)
        some, node = np.flatnonzero(found.n), node[order]
        tidy()
        return pa.table({"node": node[some], "n": found.n[some], "root": node[found.root[some]]})

    keys = [*_CELL, "x", "y"]
    return units.repartition(partitions, *keys).groupBy(*keys).applyInArrow(run, "node long, n long, root long")


def embedding_near(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = LEAST, unit_bytes: int = UNIT_BYTES) -> DataFrame:
    """id, ``n_links``, ``component_id`` (the least id that is reachable) and ``kept`` (whether that is the row's own) of each row."""
    spark = vectors.sparkSession
    v = F.col("v")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"), F.col(f"`{vector_col}`").alias("v")).withColumn("fine", F.coalesce(fine & F.col("label").isNotNull(), F.lit(False)))
    keyed = rows.where("fine").select("id", "label", "v", F.xxhash64(F.lit(1), "label", "v").alias("k"), F.xxhash64(F.lit(2), "label", "v").alias("l"))
    with Scratch(spark) as run:
        folded = keyed.groupBy("k", "l").agg(F.first("label").alias("label"), F.first("v").alias("v"), F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"))
        nodes = run.table(folded.select("k", "l", "least", "label", F.size("v").alias("d"), F.monotonically_increasing_id().alias("node"), "copies", "v"), "nodes")
        sliced = run.table(_sliced(nodes.select("node", "label", "d", "copies", "v"), least), "sliced")
        rows_met = sliced.agg(F.coalesce(F.sum(F.size("slices")), F.lit(0))).first()[0] * 3 // 2
        linked = run.table(_linked(_units(sliced, run, unit_bytes), least, int(min(100_000, max(64, rows_met // 50_000)))), "linked")
        roots = components(linked.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")), run)
        number = linked.groupBy("node").agg(F.sum("n").alias("n"))
        rooted = nodes.select("k", "l", "least", "node", "copies").join(number, "node", "left").join(roots, "node", "left")
        rooted = run.table(rooted.select("k", "l", "least", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("root")), "rooted")
        # a table of its own: joined as read, a root with many vectors can be split
        least_id = run.table(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "least")
        member = run.keep(rooted.join(least_id, "root").select("k", "l", "n_links", "component_id"), "members")
    named = lambda df, n, c: df.select(F.col("id").alias(id_col), n.alias("n_links"), c.alias("component_id"), F.col("id").eqNullSafe(c).alias("kept"))
    found = named(keyed.select("id", "k", "l").join(member, ["k", "l"]), F.col("n_links"), F.col("component_id"))
    return found.unionByName(named(rows.where(~F.col("fine")), F.lit(0).cast("long"), F.col("id")))
