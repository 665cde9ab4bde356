"""Secret scans through nested encodings.

Every whole text is scanned for three kinds of secrets. Then a worklist of layers runs to its
fixpoint: URL and Unicode escapes of a layer are resolved in place, base64 segments are decoded from each of
the four alignments (they may follow other letters), compressed data is unpacked, and each layer that this gives, an
unpacked one that is compressed again included, is scanned and unwrapped in its turn. Bad bytes are replaced, and
a layer with NUL bytes (UTF-16) is read without them as well. A layer that was seen before in its segment of the
document is not opened again, so that encodings which lead to themselves end; a segment that comes at several
places is opened once and reported at each. Spans found in a layer are mapped back to the
document: through escapes character by character (by runs), to the whole segment through base64 and
compression.

Row-local: no shuffle. The worklist goes depth first, so that of each depth one layer is held, as a stream: in parts of some ``HOLD``
bytes, each of which ends at a place that no secret, no segment and no escape reaches over. So what is found doesn't hang on
``HOLD``; a run without such a place (one secret, one base64 segment, wrapped or not) is held whole, however long it is. Packed data are known
again by a digest of all of them. Nothing is refused.

Defined results: null counts as the empty text and has no spans; repeated rows get equal
results; an empty table gives an empty table. Added columns get leading underscores where the
input has a column of that name.
"""

from __future__ import annotations

import base64
import bz2
import lzma
import re
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator
from hashlib import blake2b

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_names, slices

#: Kinds in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ASSIGN_HINT = re.compile(r"passw|secret|token|api_?key", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  # runs are maximal: a shorter run has no longer match in it
_HEX = re.compile(r"[0-9a-f]{16,}")
_ESCAPES = re.compile(r"(?:%[0-9A-Fa-f]{2})+|(?:\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\u\{[0-9A-Fa-f]{1,6}\}|\\x[0-9A-Fa-f]{2})+")
_ONE_ESCAPE = re.compile(r"\\u\{([0-9A-Fa-f]+)\}|\\[uUx]([0-9A-Fa-f]+)")
_LINE = re.compile(r"[A-Za-z0-9+/]{16,}={0,2}")
_URLSAFE = re.compile(r"[A-Za-z0-9_-]{16,}={0,2}")
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/])(?:[A-Za-z0-9+/]{16,}+\r?\n)+[A-Za-z0-9+/]+={0,2}")
#: How gzip, zlib, bzip2, xz and zstd data begin.
_MAGIC = re.compile(rb"\x1f\x8b|\x78[\x01\x5e\x9c\xda]|BZh|\xfd7zXZ\x00|\x28\xb5\x2f\xfd")
_CONTROL = re.compile(r"[\x00-\x08\x0e-\x1f\x7f-\x9f\ufffd]")
HOLD, READ = 64 << 20, 1 << 20


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the secrets that stand in a text as such, sorted."""
    found = []
    if _ASSIGN_HINT.search(text):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def _worker(data: bytes):
    """What unpacks data that begin as a known format; None if they don't."""
    if data[:2] == b"\x1f\x8b" or data[:1] == b"\x78" and len(data) > 2 and int.from_bytes(data[:2], "big") % 31 == 0:
        return zlib.decompressobj(47)
    if data[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if data[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor()
    if data[:4] == b"\x28\xb5\x2f\xfd":
        import zstandard

        return zstandard.ZstdDecompressor()
    return None


def _unpacked(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Unpacked data in pieces of at most READ bytes, from packed ones; what a broken format gives before it breaks."""
    first = next(pieces, b"")
    worker = _worker(first)
    if worker is None:
        return
    try:
        if hasattr(worker, "stream_reader"):
            reader = worker.stream_reader(_Pieces(first, pieces))
            while out := reader.read(READ):
                yield out
            return
        data = first
        while data or data is first:
            if isinstance(worker, type(zlib.decompressobj())):
                while data and not worker.eof:
                    if out := worker.decompress(data, READ):
                        yield out
                    data = worker.unconsumed_tail
            else:
                while not worker.eof:
                    if out := worker.decompress(data, READ):
                        yield out
                    data = b""
                    if worker.needs_input:
                        break
            if worker.eof:
                return
            data = next(pieces, b"")
            if not data:
                return
    except (zlib.error, OSError, EOFError, lzma.LZMAError):
        return
    except Exception as error:
        if "zstd" not in type(error).__name__.lower():
            raise


class _Pieces:
    """A file of pieces of bytes."""

    def __init__(self, first: bytes, rest: Iterator[bytes]):
        self.held, self.rest = first, rest

    def read(self, n: int = -1) -> bytes:
        if not self.held:
            self.held = next(self.rest, b"")
        out, self.held = (self.held, b"") if n < 0 else (self.held[:n], self.held[n:])
        return out


def _whole(data: bytes) -> bool:
    """Whether packed data unpack to their end."""
    worker = _worker(data)
    if worker is None or hasattr(worker, "stream_reader"):
        return worker is not None and any(True for _ in _unpacked(iter([data])))
    try:
        while not worker.eof:
            out = worker.decompress(data, READ)
            data = worker.unconsumed_tail if hasattr(worker, "unconsumed_tail") else b""
            if not out and not data:
                return worker.eof
        return True
    except (zlib.error, OSError, EOFError, lzma.LZMAError):
        return False


#: ASCII characters that no pattern of this module has within a match, so that nothing reaches over them.
_FREE = re.compile(rb"""[^A-Za-z0-9+/_.=:"'\x20\r\n%\\{}\x80-\xff-]|\x20""")
_OPEN = re.compile(rb"""[%\\]|[:="']\Z|(?:password|passwd|secret|token|api_?key)\Z""", re.I)
_NEAR, _WINDOW = 256, 8192


def _free(data, at: int) -> bool:
    """Whether nothing reaches over the free character at a place. Over a space only an assignment does, between its keyword or separator
    and what follows, and these may be written as escapes."""
    if data[at] != 32:
        return True
    before = bytes(data[max(0, at - _NEAR) : at]).rstrip(b" ")
    word = before[max(before.rfind(x) for x in b" \n\t\r") + 1 :]
    return 0 < len(word) < len(before) and not _OPEN.search(word)


def _last_free(data, first: int) -> int:
    """The end of the last free character from ``first`` on; 0 if there is none."""
    end = len(data)
    while end > first:
        begin = max(first, end - _WINDOW)
        for m in reversed(list(_FREE.finditer(data, begin, end))):
            if _free(data, m.start()):
                return m.end()
        end = begin
    return 0


def _texts(pieces: Iterator[bytes]) -> Iterator[str]:
    """Data as text, bad bytes replaced, in parts of some HOLD bytes. A part ends where nothing reaches over, however much has to be held
    until there; of runs of spaces there, which may be endless and mean the same, one is held."""
    held, looked = bytearray(), 0
    for piece in pieces:
        held += piece
        if len(held) - looked <= HOLD:
            continue
        if cut := _last_free(held, looked):
            yield held[:cut].decode(errors="replace")
            del held[:cut]
            looked = 0
        else:
            held = bytearray(re.sub(rb" {2,}", b" ", held))
            looked = max(0, len(held) - _NEAR)
    if held:
        yield held.decode(errors="replace")


def _layers(source: Callable[[], Iterator[bytes]], above: frozenset[bytes] = frozenset()) -> Iterator[str]:
    """The texts of data and of all that they unpack to, one after the other. ``source()`` gives the data from the beginning. ``above``:
    digests of the data that these came from, so that data which unpack to themselves end."""
    if _worker(next(source(), b"")) is not None:
        digest = blake2b(digest_size=16)
        for piece in source():
            digest.update(piece)
        if digest.digest() in above:
            return
        yield from _layers(lambda: _unpacked(source()), above | {digest.digest()})
    wide = False

    def seen() -> Iterator[bytes]:
        nonlocal wide
        for piece in source():
            wide = wide or 0 in piece
            yield piece

    yield from _texts(seen())
    if wide:  # once more without NUL bytes
        yield from _texts(piece.replace(b"\0", b"") for piece in source())


def _bytes(segment: str) -> bytes:
    """The bytes in a base64 segment; a lone last character, which holds none, goes."""
    body = re.sub(r"[\r\n=]", "", segment)
    body = body[: len(body) - (len(body) % 4 == 1)]
    return base64.b64decode(body.translate({45: 43, 95: 47}) + "=" * (-len(body) % 4))


def _clean(segment: str) -> bool:
    """Whether a segment decodes to text without a bad byte, or to whole packed data, so that it is whole as it stands."""
    if sum(c not in "\r\n=" for c in segment) % 4 == 1:
        return False
    data = _bytes(segment)
    return _whole(data) or not _CONTROL.search(data.decode(errors="replace"))


def _unescape(run: str) -> tuple[str, list[int]] | None:
    """The characters that a run of escapes stands for, and how long the escapes of each are."""
    if run[0] == "%":
        try:
            text = bytes.fromhex(run.replace("%", "")).decode()
        except UnicodeDecodeError:
            return None
        return text, [3 * len(c.encode()) for c in text]
    out, sizes = [], []
    for m in _ONE_ESCAPE.finditer(run):
        unit = int(m[1] or m[2], 16)
        if unit > 0x10FFFF:
            return None
        if 0xDC00 <= unit < 0xE000 and out and 0xD800 <= out[-1] < 0xDC00:
            out[-1] = 0x10000 + ((out[-1] - 0xD800) << 10) + unit - 0xDC00
            sizes[-1] += len(m[0])
        else:
            out.append(unit)
            sizes.append(len(m[0]))
    return "".join("\ufffd" if 0xD800 <= u < 0xE000 else chr(u) for u in out), sizes


class Places:
    """Where the characters of an unescaped text lie in the text before: runs of characters that take the same room."""

    def __init__(self, runs: list[tuple[int, int, int]]):
        self.at, self.start, self.room = zip(*runs)  # first character of a run; its place; places of each character

    def back(self, first: int, end: int) -> tuple[int, int]:
        """A span of the text as a span of the text before."""
        i, j = bisect_right(self.at, first) - 1, bisect_right(self.at, end - 1) - 1
        return self.start[i] + (first - self.at[i]) * self.room[i], self.start[j] + (end - self.at[j]) * self.room[j]


def _unescaped(text: str) -> tuple[str, Places] | None:
    """The text with its escapes resolved, and where it lies; None without escapes. The text gets shorter each time."""
    out, runs, at, size = [], [], 0, 0
    for m in _ESCAPES.finditer(text):
        found = _unescape(m[0])
        if found is None:
            continue
        new, rooms = found
        if m.start() > at:
            runs.append((size, at, 1))
            size += m.start() - at
        place = m.start()
        for k, room in enumerate(rooms):
            if not k or room != rooms[k - 1]:
                runs.append((size, place, room))
            size, place = size + 1, place + room
        out += [text[at : m.start()], new]
        at = m.end()
    if not at:
        return None
    if at < len(text):
        runs.append((size, at, 1))
    return "".join([*out, text[at:]]), Places(runs)


def _segments(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of what could be base64. Where lines could be one wrapped segment, also their parts:
    where the whole has bad bytes the last line may be a word of the text that follows, or several
    segments may follow each other."""
    for m in _WRAPPED.finditer(text):
        yield from _parts(text, *m.span())
    for m in _LINE.finditer(text):
        yield m.span()
    for m in _URLSAFE.finditer(text):
        yield m.span()


def _parts(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """Ranges of the lines of a block that could hold a segment: the whole, the whole without its last
    line, runs of lines of one length, and, as the others may be cut in the middle, for each
    of the four phases the lines that a secret covers and what is compressed from a line on."""
    lines = [(start + m.start(), start + m.end()) for m in re.finditer(r"[^\r\n]+", text[start:end])]
    whole, before = _clean(text[start:end]), (start, lines[-2][1])
    if not whole and _clean(text[slice(*before)]):
        yield before
        if text[end : end + 1] in (" ", "\t") and text[end - 1] != "=":  # a word of a sentence
            lines.pop()
    else:
        yield start, end
    first = 0
    for i in range(1, len(lines) + 1):
        size = lambda k: lines[k][1] - lines[k][0]
        if i == len(lines) or size(i) != size(first):
            if i - first > 1:
                yield lines[first][0], lines[i - 1][1]
            if i < len(lines) and size(i) < size(first):
                yield lines[first][0], lines[i][1]
            first = i
    at, sums = 0, []  # characters before each line
    for a, b in lines:
        sums.append(at)
        at += b - a
    stream = "".join(text[a:b] for a, b in lines)
    for phase in sorted({x % 4 for x in sums}):
        data = _bytes(stream[phase:])
        for a, b in _exact(data):
            i, j = bisect_right(sums, phase + a * 4 // 3) - 1, bisect_right(sums, phase + (b - 1) * 4 // 3 + 1) - 1
            yield lines[i][0], lines[min(j, len(lines) - 1)][1]
        for i, x in enumerate(sums):
            if x % 4 == phase and i and _MAGIC.match(data, (x - phase) // 4 * 3):
                yield lines[i][0], lines[-1][1]


def _exact(data: bytes):
    """Secrets and nested segments in decoded bytes: (start, end)."""
    text = data.decode("latin-1")
    for a, _, b in base_spans(text):
        yield a, b
    for pattern in (_LINE, _ESCAPES):
        for m in pattern.finditer(text):
            yield m.span()


def _below(layer: str) -> Iterator[str]:
    """The layers that a layer leads to."""
    if below := _unescaped(layer):
        yield below[0]
    for a, b in dict.fromkeys(_segments(layer)):
        yield from _decoded(layer[a:b])


def _decoded(segment: str) -> Iterator[str]:
    """The layers in a base64 segment, whichever of its first characters it begins at."""
    body = re.sub(r"[\r\n]", "", segment)
    for first in range(4):
        data = _bytes(body[first:])
        yield from _layers(lambda data=data: iter([data]))


def _inside(segment: str) -> frozenset[int]:
    """Kinds of the secrets in all layers of a segment. All of them map to the whole segment, so a layer that comes
    again in it has nothing new, and nothing is new when all kinds are found."""
    kinds, seen, stack = set(), set(), [_decoded(segment)]
    while stack and len(kinds) < len(KINDS):
        layer = next(stack[-1], None)
        if layer is None:
            stack.pop()
            continue
        key = blake2b(layer.encode("utf-8", "surrogatepass"), digest_size=16).digest()
        if key not in seen:
            seen.add(key)
            kinds.update(kind for _, kind, _ in base_spans(layer))
            stack.append(_below(layer))
    return frozenset(kinds)


def _outer(spans: set[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans that no other span of their kind contains."""
    out, reach = [], {}
    for start, kind, end in sorted(spans, key=lambda x: (x[0], -x[2])):
        if end > reach.get(kind, -1):
            reach[kind] = end
            out.append((start, kind, end))
    return out


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and all spans of one text."""
    base = base_spans(text)
    found, known = set(base), {}
    layer, way = text, []
    while True:

        def back(a: int, b: int) -> tuple[int, int]:
            for places in reversed(way):
                a, b = places.back(a, b)
            return a, b

        if way:
            for start, kind, end in base_spans(layer):
                a, b = back(start, end)
                found.add((a, kind, b))
        own = set()
        for start, end in dict.fromkeys(_segments(layer)):
            segment = layer[start:end]
            if segment not in known:
                known[segment] = _inside(segment)
            if known[segment]:
                a, b = back(start, end)
                # a part of a segment, or a run within it, adds nothing to what is reported of the whole
                own.update((a, kind, b) for kind in known[segment])
        found.update(_outer(own))
        below = _unescaped(layer)
        if below is None:
            return base, sorted(found)
        layer = below[0]
        way.append(below[1])


_SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def secret_scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``base_secrets`` and ``secrets`` (arrays of kind, start, end: code points of
    the text, end exclusive, sorted by start and kind)."""
    added = free_names(docs, "base_secrets", "secrets")
    schema = T.StructType([*docs.schema.fields, *[T.StructField(x, _SPANS) for x in added]])
    names, column = schema.names, docs.columns.index(text_col)
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            for block in slices(batch, 4 << 20, column):
                done = [scan(t) for t in pc.fill_null(block.column(column), "").to_pylist()]
                spans = [pa.array([[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in row[i]] for row in done], span) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*block.columns, *spans], names=names)

    return docs.mapInArrow(run, schema)


def spans_string(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(scanned: DataFrame, text_col: str = "text", spans_col: str = "secrets", mark: str = "[SECRET]") -> DataFrame:
    """``scanned`` with each span of its text, overlapping ones as one, replaced by ``mark``;
    null stays null."""
    spans, text = F.col(f"`{spans_col}`"), F.col(f"`{text_col}`")
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(done: Column, x: Column) -> Column:
        new = x["start"] >= done["at"]
        grown = F.when(new, F.concat(done["out"], F.substring(text, (done["at"] + 1).cast("int"), (x["start"] - done["at"]).cast("int")), F.lit(mark))).otherwise(done["out"])
        return F.struct(grown.alias("out"), F.greatest(done["at"], x["end"]).alias("at"))

    cleaned = F.aggregate(spans, start, step, lambda done: F.concat(done["out"], F.substring(text, (done["at"] + 1).cast("int"), F.length(text))))
    return scanned.withColumn(text_col, F.when(F.size(spans) > 0, cleaned).otherwise(text))
