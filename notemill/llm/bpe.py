"""BPE encoding and decoding by a prefix-sharing trie traversal.

``encode`` turns every whole text into token ids exactly as the ``tokenizers`` library does
with a byte-level BPE file; ``decode`` turns ids back into text. Method:

* A text is cut at places where the pre-tokenizer always cuts (before white space that
  follows other text, and between a letter and following ASCII punctuation), so that the
  pieces can be encoded one by one, and each distinct piece of a block once.
* The distinct words of the pieces that are not known yet form a trie, walked depth-first
  (sorted words and their common prefixes are that walk; no node objects are made). The
  state of a node is the last token of the encoding of its prefix. It follows from the
  states of its ancestors: it is the one token that ends there and is *compatible* with the
  last token before it, i.e. BPE leaves that pair as it is. Shared prefixes are thus
  encoded once, and a word's ids are read off backwards.

Everything is row-local: no shuffle, and memory is bounded by one block of texts, the
longest text and a cache of a fixed number of pieces.

Defined results: a null text encodes as the empty text; empty text has no ids; repeated
rows and ids give equal rows; an empty table gives an empty table with the same schema.
Added columns get leading underscores where the input has a column of that name.
"""

from __future__ import annotations

import json
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import SPACE_BYTES, Words, free_name, slices, text_bytes

#: Pieces a worker remembers, about 50 bytes each; a bound on memory, not on results.
CACHE_PIECES = 300_000
_LATIN = rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])"
_ONE_WORD = re.compile(rb" ?" + _LATIN + rb"+").fullmatch



def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies, by its published rule."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merges and special tokens of a byte-level BPE file, and BPE itself for pairs."""

    def __init__(self, path: str, merges: bool = True):
        """``merges``: whether what the trie walk needs is built as well."""
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.alphabet = alphabet = byte_alphabet()
        # the file's own pre-tokenizer, without its model
        self.pre = Tokenizer.from_str(json.dumps(spec | {"model": {"type": "BPE", "vocab": {}, "merges": []}, "added_tokens": []})).pre_tokenizer
        self.special = {x["content"].encode(): x["id"] for x in spec["added_tokens"]}
        self.whole = np.zeros(256, bool)
        self.whole[[*b"".join(self.special)]] = True
        if self.whole[list(SPACE_BYTES)].any():
            raise ValueError("special tokens with white space aren't supported")
        self.id = {bytes(map(alphabet.__getitem__, k)): v for k, v in spec["model"]["vocab"].items() if k.encode() not in self.special}
        self.bytes = {v: k for k, v in self.id.items()} | {v: k for k, v in self.special.items()}
        self._pairs: dict[int, bool] = {}
        if not merges:
            return
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            a, b = bytes(map(alphabet.__getitem__, a)), bytes(map(alphabet.__getitem__, b))
            self.merge[self.id[a], self.id[b]] = rank, self.id[a + b]
        self.byte_id = [self.id[bytes([b])] for b in range(256)]
        ends: dict[bytes, set[int]] = {}
        for token in self.id:
            ends.setdefault(token[-3:], set()).add(len(token))
        #: Lengths of the tokens that end in these three bytes, or are these one or two bytes; longest first.
        self.lengths = {tail: tuple(sorted(n.union(*(ends.get(tail[k:], {}) and {len(tail) - k} for k in range(1, len(tail)))), reverse=True)) for tail, n in ends.items()}

    def bpe(self, word: bytes) -> list[int]:
        """Plain BPE: merge the pair of lowest rank, leftmost first, while there is one."""
        ids = [self.byte_id[b] for b in word]
        while len(ids) > 1:
            rank, at = min((self.merge.get(pair, (1 << 60, 0))[0], i) for i, pair in enumerate(zip(ids, ids[1:])))
            if rank == 1 << 60:
                break
            ids[at : at + 2] = [self.merge[ids[at], ids[at + 1]][1]]
        return ids

    def compatible(self, a: int, b: int) -> bool:
        known = self._pairs.get(a << 32 | b)
        if known is None:
            if len(self._pairs) > 500_000:
                self._pairs.clear()
            known = self._pairs[a << 32 | b] = self.bpe(self.bytes[a] + self.bytes[b]) == [a, b]
        return known

    def words(self, piece: bytes) -> list[bytes | int]:
        """Pre-tokens of a piece; ids for special tokens in it."""
        if _ONE_WORD(piece):
            return [piece]
        out: list[bytes | int] = []
        for part in re.split(b"(" + b"|".join(map(re.escape, self.special)) + b")", piece) if self.special else [piece]:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                out += [bytes(map(self.alphabet.__getitem__, w)) for w, _ in self.pre.pre_tokenize_str(part.decode())]
        return out


def trie_encode(vocabulary: Vocabulary, words: set[bytes]) -> dict[bytes, list[int]]:
    """Ids of each word, by the depth-first walk described above."""
    out: dict[bytes, list[int]] = {}
    ids, lengths, compatible = vocabulary.id.get, vocabulary.lengths, vocabulary.compatible
    pairs = vocabulary._pairs.get
    last, before = [-1], b""
    for word in sorted(words):
        n, depth = len(word), 0
        for x, y in zip(before, word):
            if x != y:
                break
            depth += 1
        del last[depth + 1 :]
        for end in range(depth + 1, n + 1):
            tail = word[max(0, end - 3) : end]
            for size in lengths.get(tail) or lengths.get(tail[1:]) or (1,):
                if size > end:
                    continue
                token = ids(word[end - size : end])
                if token is None:
                    continue
                if size == end:
                    last.append(token)
                    break
                left = last[end - size]
                fits = pairs(left << 32 | token)
                if compatible(left, token) if fits is None else fits:
                    last.append(token)
                    break
        end, back = n, []
        while end:
            back.append(last[end])
            end -= len(vocabulary.bytes[last[end]])
        back.reverse()
        out[word] = back
        before = word
    return out


_KIND = np.zeros(256, np.uint8)  # 1 white space, 2 ASCII letter or ', 4 beyond ASCII
_KIND[list(SPACE_BYTES)] = 1
_KIND[[*range(65, 91), *range(97, 123), 39]] = 2
_KIND[128:] = 4


def _wide_space(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether white space beyond ASCII (a fixed set of characters) ends before each place."""
    z, y, x = data[at - 1], data[np.maximum(at - 2, 0)], data[np.maximum(at - 3, 0)]
    two = (y == 0xC2) & ((z == 0x85) | (z == 0xA0))
    general = (x == 0xE2) & (y == 0x80) & ((z <= 0x8A) | (z == 0xA8) | (z == 0xA9) | (z == 0xAF))
    return two | general | (x == 0xE1) & (y == 0x9A) & (z == 0x80) | (x == 0xE2) & (y == 0x81) & (z == 0x9F) | (x == 0xE3) & (y == 0x80) & (z == 0x80)


class Pieces(Words):
    """Pieces of texts: the pre-tokenizer cuts at each border between two pieces, whatever
    else the text holds. Borders lie before white space that follows other text, and between
    a letter and ASCII that is neither letter nor apostrophe; each hangs on the two characters
    beside it alone."""

    def __init__(self, texts: pa.Array, whole: np.ndarray | None = None):
        """``whole``: flags of the bytes of special tokens, before which no letter is cut off."""
        self.data, self.at = text_bytes(texts)
        data, n = self.data, len(self.data)
        kind = _KIND[data]
        cut = np.zeros(n + 1, bool)
        if n > 1:
            left, right = kind[:-1], kind[1:]
            latin = np.zeros(n, bool)
            latin[1:] = (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
            letter = ((left == 2) & (data[:-1] != 39)) | latin[:-1]
            ends = right == 0 if whole is None else (right == 0) & ~whole[data[1:]]
            cut[1:n] = ((right == 1) & (left != 1)) | (letter & ends)
            other = np.flatnonzero((right == 1) & (left == 4)) + 1
            cut[other[_wide_space(data, other)]] = False
        cut[self.at] = True
        cut[n] = False
        self.start = np.flatnonzero(cut)
        self.end = np.append(self.start[1:], n) if n else self.start
        self.first = np.searchsorted(self.start, self.at)


class Encoder:
    """Encodes arrays of texts. Each distinct piece is known by a 64-bit hash of its bytes;
    ``of_words`` says how the ids of unknown words are found, all of an array at once."""

    def __init__(self, vocabulary: Vocabulary, of_words=trie_encode):
        self.vocabulary, self.of_words = vocabulary, of_words
        self._forget()
        size = max(vocabulary.bytes) + 1
        self.token_bytes = pa.array([vocabulary.bytes.get(i, b"") for i in range(size)], pa.large_binary())

    def _forget(self) -> None:
        self.hashes, self.rows, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), pa.array([], pa.large_binary())

    def _find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of hashes among the known ones, and which are known."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), max(len(self.hashes) - 1, 0))
        return at, self.hashes[at] == hashes if len(self.hashes) else np.zeros(len(hashes), bool)

    def _learn(self, pieces: dict[int, bytes]) -> None:
        parts = {h: self.vocabulary.words(p) for h, p in pieces.items()}
        ids = self.of_words(self.vocabulary, {w for ws in parts.values() for w in ws if isinstance(w, bytes)})
        new = pa.array([array("I", [i for w in ws for i in (ids[w] if isinstance(w, bytes) else [w])]).tobytes() for ws in parts.values()], pa.large_binary())
        hashes = np.concatenate([self.hashes, np.fromiter(parts, np.uint64, len(parts))])
        rows = np.concatenate([self.rows, np.arange(len(self.ids), len(self.ids) + len(new))])
        order = np.argsort(hashes)
        self.hashes, self.rows, self.ids = hashes[order], rows[order], pa.concat_arrays([self.ids, new])

    def encode(self, texts: pa.Array) -> pa.Array:
        """Ids of each text as little-endian unsigned 32-bit integers (large_binary)."""
        out = [joined(taken, pieces.first, pa.large_binary()) for pieces, taken in self._pieces(texts)]
        pa.default_memory_pool().release_unused()
        return pa.concat_arrays(out) if out else pa.array([], pa.large_binary())

    def piece_sizes(self, texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        """Code points and tokens of each piece of each text."""
        out = []
        for pieces, taken in self._pieces(texts):
            points = np.concatenate([[0], np.cumsum((pieces.data & 0xC0) != 0x80)])
            chars = points[pieces.end] - points[pieces.start]
            tokens = np.asarray(pc.binary_length(taken), np.int64) // 4
            out += [(chars[a:b], tokens[a:b]) for a, b in zip(pieces.first, pieces.first[1:])]
        return out

    def _pieces(self, texts: pa.Array):
        """Pieces of slices of the texts, and their ids."""
        held, unknown = [], {}
        if len(self.hashes) > CACHE_PIECES or self.ids.nbytes > 128 << 20:
            self._forget()
        for part in slices(texts, 1 << 20):
            pieces = Pieces(part, self.vocabulary.whole)
            h = pieces.hashes()
            distinct, where, which = np.unique(h, return_index=True, return_inverse=True)
            new = ~self._find(distinct)[1]
            for x, i in zip(distinct[new].tolist(), where[new].tolist()):
                if x not in unknown:
                    unknown[x] = pieces.data[pieces.start[i] : pieces.end[i]].tobytes()
            held.append((distinct, which, pieces))
        if unknown:
            self._learn(unknown)
        for distinct, which, pieces in held:
            yield pieces, self.ids.take(pa.array(self.rows[self._find(distinct)[0]][which])) if len(distinct) else pa.array([], pa.large_binary())

    def decode(self, ids: pa.Array) -> pa.Array:
        """The text of each row of ids, special tokens included; null as no ids; bytes that
        are no UTF-8 become U+FFFD."""
        ids = pc.fill_null(ids.cast(pa.large_binary()), b"")
        at = np.frombuffer(ids.buffers()[1], np.int64)[ids.offset : ids.offset + len(ids) + 1]
        flat = np.frombuffer(ids.buffers()[2] or b"", np.uint8)[at[0] : at[-1]].view(np.uint32) if at[-1] > at[0] else np.zeros(0, np.uint32)
        raw = joined(self.token_bytes.take(pa.array(flat)), (at - at[0]) // 4, pa.large_binary())
        try:
            return raw.cast(pa.large_string()).cast(pa.string())
        except pa.ArrowInvalid:
            return pa.array([x.decode("utf-8", "replace") for x in raw.to_pylist()], pa.string())


def joined(values: pa.Array, first: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Rows ``first[i]:first[i+1]`` of a binary array, each run joined; no bytes are copied."""
    if not len(values):
        return pa.array([b""] * (len(first) - 1), kind)
    at = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    return pa.Array.from_buffers(kind, len(first) - 1, [None, pa.py_buffer(np.ascontiguousarray(at[first])), values.buffers()[2]])


_encoders: dict[tuple, Encoder] = {}


def rank_encode(vocabulary: Vocabulary, words: set[bytes]) -> dict[bytes, list[int]]:
    """Ids of each word by the ``tiktoken`` library over the same vocabulary: for operators that
    only need ids."""
    import tiktoken

    if not hasattr(vocabulary, "ranks"):
        vocabulary.ranks = tiktoken.Encoding("ranks", pat_str=r"[\s\S]+", mergeable_ranks=vocabulary.id, special_tokens={})
    whole = vocabulary.ranks.encode_ordinary
    return {w: whole(w.decode()) for w in words}


def encoder(path: str, of_words=trie_encode) -> Encoder:
    """One encoder a worker and vocabulary; it outlives a task."""
    key = path, of_words
    if key not in _encoders:
        _encoders[key] = Encoder(Vocabulary(path, of_words is trie_encode), of_words)
    return _encoders[key]


def encode(docs: DataFrame, tokenizer_path: str, text_col: str = "text", ids_col: str = "ids", count_col: str = "n_tokens", decoded_col: str | None = None) -> DataFrame:
    """``docs`` with ``ids`` (binary: little-endian unsigned 32-bit) and ``n_tokens`` (long), and,
    where ``decoded_col`` is given, the text decoded again from those ids, in the same pass."""
    ids_col, count_col = free_name(docs, ids_col), free_name(docs, count_col)
    more = [T.StructField(ids_col, T.BinaryType()), T.StructField(count_col, T.LongType())]
    if decoded_col:
        decoded_col = free_name(docs, decoded_col)
        more.append(T.StructField(decoded_col, T.StringType()))
    column = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, *more])
    names = schema.names

    def run(batches):
        coder = encoder(tokenizer_path)
        for batch in batches:
            for block in slices(batch, 6 << 20, column):
                ids = coder.encode(block.column(column))
                for at in range(0, len(ids), 1024):  # smaller batches on the way back
                    own = ids.slice(at, 1024)
                    added = [own.cast(pa.binary()), pc.divide(pc.binary_length(own), 4).cast(pa.int64())]
                    if decoded_col:
                        added.append(coder.decode(own))
                    yield pa.RecordBatch.from_arrays([*block.slice(at, 1024).columns, *added], names=names)

    return docs.mapInArrow(run, schema)


def decode(encoded: DataFrame, tokenizer_path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ids; null ids decode as the empty text."""
    text_col = free_name(encoded, text_col)
    column = encoded.columns.index(ids_col)
    schema = T.StructType([*encoded.schema.fields, T.StructField(text_col, T.StringType())])
    names = schema.names

    def run(batches):
        coder = encoder(tokenizer_path)
        for batch in batches:
            for block in slices(batch, 6 << 20, column):
                yield pa.RecordBatch.from_arrays([*block.columns, coder.decode(block.column(column))], names=names)

    return encoded.mapInArrow(run, schema)
