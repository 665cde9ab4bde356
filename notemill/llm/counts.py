"""Edit-aware token counts.

Each document keeps a segment tree over its pre-token pieces: a leaf segment holds the code
points and tokens of up to ``SEGMENT`` pieces, an inner node their sums. An edit (``at``, ``cut``,
``put``: at a code point, so many removed, a text put there) descends to the pieces that it
touches, re-encodes these with one piece of context on either side, splices the new pieces in,
and updates the sums on the paths to the root. The context is enough: whether a border lies
between two pieces hangs on the two characters beside it alone (``bpe.Pieces``).

``build`` makes the state, ``edit`` takes a state with a column of edits to the next state, so
that logs of any length go through in rounds. Both are row-local.

Defined results: null counts as the empty text; places outside the text are moved to its ends,
negative lengths count as 0; null edits, and null parts of an edit, change nothing; edits of a
row apply in their order, each to the text that the edits before it left; repeated rows get
equal results; an empty table gives an empty table. The state's columns get leading underscores where
the input of ``build`` has columns of that name; ``edit`` takes, of the columns called so, the one with the most.
Other columns stay as they are.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bpe import encoder
from .common import free_names, slices

SEGMENT = 64
STATE = ("piece_chars", "piece_tokens", "n_tokens", "reencoded_chars")


class Tree:
    """Sums of code points and tokens over segments of pieces; a segment that no edit touches stays a
    view of the arrays it came from."""

    def __init__(self, chars: np.ndarray, tokens: np.ndarray):
        cuts = range(0, len(chars), SEGMENT)
        self.parts = [[chars[i : i + SEGMENT], tokens[i : i + SEGMENT]] for i in cuts] or [[chars, tokens]]
        self.size = 1 << (len(self.parts) - 1).bit_length()
        self.sums = [[0] * (2 * self.size), [0] * (2 * self.size)]
        for values, own in zip((chars, tokens), self.sums):
            if len(values):
                own[self.size : self.size + len(self.parts)] = np.add.reduceat(values, cuts, dtype=np.int64).tolist()
            for i in range(self.size - 1, 0, -1):
                own[i] = own[2 * i] + own[2 * i + 1]

    def find(self, at: int) -> tuple[int, int, int]:
        """Segment, piece within it, and first code point of the piece that holds place ``at``
        (the last piece for the end of the text)."""
        node, before, chars = 1, 0, self.sums[0]
        at = max(0, min(at, chars[1] - 1))
        while node < self.size:
            node *= 2
            if before + chars[node] <= at:
                before += chars[node]
                node += 1
        segment = min(node - self.size, len(self.parts) - 1)
        ends = np.cumsum(self.parts[segment][0]).tolist()
        piece = min(bisect_right(ends, at - before), max(len(ends) - 1, 0))
        return segment, piece, before + (ends[piece - 1] if piece else 0)

    def around(self, at: int, cut: int) -> tuple[tuple[int, int], tuple[int, int], int, int]:
        """The pieces that an edit touches with one more on either side: first and last as
        (segment, piece), and the code points that they span."""
        a, i, start = self._step(*self.find(at - 1), -1)
        b, j, last = self._step(*self.find(at + cut), 1)
        return (a, i), (b, j), start, last + (int(self.parts[b][0][j]) if len(self.parts[b][0]) else 0)

    def _step(self, segment: int, piece: int, start: int, by: int) -> tuple[int, int, int]:
        """The next piece that way, or the same at the end of the text."""
        s, p = segment, piece + by
        while s >= 0 and s < len(self.parts) and not 0 <= p < len(self.parts[s][0]):
            s += by
            p = 0 if by > 0 else len(self.parts[s][0]) - 1 if s >= 0 else -1
        if not 0 <= s < len(self.parts):
            return segment, piece, start
        return s, p, start + int(self.parts[segment][0][piece]) if by > 0 else start - int(self.parts[s][0][p])

    def splice(self, first: tuple[int, int], last: tuple[int, int], chars: np.ndarray, tokens: np.ndarray) -> None:
        (a, i), (b, j) = first, last
        for k, new in enumerate((chars, tokens)):
            tail = self.parts[b][k][j + 1 :]
            if a == b:
                self.parts[a][k] = np.concatenate([self.parts[a][k][:i], new, tail])
            else:
                self.parts[a][k] = np.concatenate([self.parts[a][k][:i], new])
                for s in range(a + 1, b):
                    self.parts[s][k] = new[:0]
                self.parts[b][k] = tail
        if len(self.parts[a][0]) > 4 * SEGMENT:  # too much in one leaf: deal the pieces anew
            self.__init__(*self.pieces())
            return
        for s in range(a, b + 1):
            for own, part in zip(self.sums, self.parts[s]):
                node = self.size + s
                own[node] = int(part.sum())
                while node > 1:
                    node //= 2
                    own[node] = own[2 * node] + own[2 * node + 1]

    def pieces(self) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([p[0] for p in self.parts]), np.concatenate([p[1] for p in self.parts])

    @property
    def n_tokens(self) -> int:
        return self.sums[1][1]


def _views(column: pa.Array) -> list[np.ndarray]:
    """The lists of a column as arrays, without copying; null as empty."""
    at, values = column.offsets.to_numpy().tolist(), column.values.to_numpy(zero_copy_only=False)
    return [values[a:b] if ok else values[:0] for a, b, ok in zip(at, at[1:], column.is_valid().to_pylist())]


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
    values = np.concatenate(arrays) if arrays else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.astype(np.int32)))


_INTS = T.ArrayType(T.IntegerType())


def state_names(state: DataFrame) -> list[str]:
    """What the state's columns are called in a table."""
    return [max((c for c in state.columns if c.lstrip("_") == x), key=len) for x in STATE]


def build(docs: DataFrame, tokenizer_path: str, text_col: str = "text") -> DataFrame:
    """``docs`` with its state: ``piece_chars``, ``piece_tokens`` (arrays), ``n_tokens``, and ``reencoded_chars``, the code
    points that edits made to be encoded again: none yet."""
    added = free_names(docs, *STATE)
    schema = T.StructType([*docs.schema.fields, *[T.StructField(x, kind) for x, kind in zip(added, (_INTS, _INTS, T.LongType(), T.LongType()))]])
    names, column = schema.names, docs.columns.index(text_col)

    def run(batches):
        coder = encoder(tokenizer_path)
        for batch in batches:
            for block in slices(batch, 4 << 20, column):
                sizes = coder.piece_sizes(block.column(column))
                lists = [_lists([x[k] for x in sizes]) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*block.columns, *lists, pa.array([int(x[1].sum()) for x in sizes], pa.int64()), pa.array([0] * len(sizes), pa.int64())], names=names)

    return docs.mapInArrow(run, schema)


def edit(state: DataFrame, tokenizer_path: str, edits_col: str, text_col: str = "text") -> DataFrame:
    """The state after the edits of ``edits_col`` (array of struct at, cut: integers, put: string); ``reencoded_chars``
    grows by what was encoded again, and ``edits_col`` is dropped."""
    kept = [c for c in state.columns if c != edits_col]
    own_names = state_names(state)
    schema = T.StructType([state.schema[c] for c in kept])
    names, place = schema.names, {c: i for i, c in enumerate(state.columns)}
    column = place[text_col]

    def run(batches):
        coder = encoder(tokenizer_path)
        for batch in batches:
            for block in slices(batch, 2 << 20, column):
                texts = pc.fill_null(block.column(column), "").to_pylist()
                trees = [Tree(c, t) for c, t in zip(_views(block.column(place[own_names[0]])), _views(block.column(place[own_names[1]])))]
                todo = [[x for x in e or [] if x] for e in block.column(place[edits_col]).to_pylist()]
                cost = block.column(place[own_names[3]]).to_pylist()
                for turn in range(max(map(len, todo), default=0)):  # one edit of each text at a time, encoded together
                    rows, spots, regions = [], [], []
                    for i, (text, tree, own) in enumerate(zip(texts, trees, todo)):
                        if turn < len(own):
                            at = max(0, min(own[turn]["at"] or 0, len(text)))
                            cut = max(0, min(own[turn]["cut"] or 0, len(text) - at))
                            put = own[turn]["put"] or ""
                            first, last, start, end = tree.around(at, cut)
                            texts[i] = text[:at] + put + text[at + cut :]
                            regions.append(texts[i][start : end + len(put) - cut])
                            rows.append(i)
                            spots.append((first, last))
                            cost[i] += len(regions[-1])
                    for i, (first, last), (chars, tokens) in zip(rows, spots, coder.piece_sizes(pa.array(regions, pa.string()))):
                        trees[i].splice(first, last, chars.astype(np.int32), tokens.astype(np.int32))
                pieces = [t.pieces() for t in trees]
                new = {text_col: pa.array(texts, pa.string()), own_names[2]: pa.array([t.n_tokens for t in trees], pa.int64()), own_names[3]: pa.array(cost, pa.int64())}
                new |= {own_names[k]: _lists([p[k] for p in pieces]) for k in (0, 1)}
                yield pa.RecordBatch.from_arrays([new.get(c, block.column(place[c])) for c in kept], names=names)

    return state.mapInArrow(run, schema)
