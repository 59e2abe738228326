"""Secret scan with a recursive decoding worklist.

Base secrets are found in the text itself. Then what looks encoded is decoded into layers: the whole text with its
percent escapes, or its Unicode, byte and backslash escapes, replaced; base64 runs, also wrapped over lines or behind
characters of the same alphabet; UTF-16 below them; and compressed bytes that begin anywhere in them. A run of escapes
of an escape sign is one layer. A layer is let go before the last ones of its own are searched, so a chain of layers needs
the memory of two, however long it is; its time is at most its length times the text's.
Each layer is scanned and searched again, until no layer gives a new one. Layers seen before are skipped, which ends
cycles. Every character of a layer knows which characters of the original it came from, so a find deep inside maps to
a span of the text. A secret that a layer only repeats from the one above it is not reported again.

Defined cases: a null text counts as empty; empty texts have no finds. Finds of a layer whose spans and kinds are equal
are reported once. Compressed content is read to its end, member by member, in blocks, so memory is bounded but a bomb
takes the time of its whole content. One bound is left: in unpacked content, a single run without any character that
ends runs is held LAYER_CHARS at a time in overlapping windows. Other columns are not read.
"""

from __future__ import annotations

import base64
import bz2
import codecs
import hashlib
import re
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import partial
from itertools import islice

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.llm.common import table

#: Characters of a base64 run at least.
BASE64_LEAST = 16
#: Unpacked content is read in blocks of so many bytes, and scanned in blocks of so many characters.
BLOCK_BYTES, BLOCK_CHARS = 1 << 20, 1_000_000
#: Characters of one unbroken run in unpacked content that are held at once; and by which its windows overlap.
LAYER_CHARS, OVERLAP_CHARS = 4_000_000, 1_000_000

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex")

#: An escape sign that is itself escaped, any number of times, is undone in one step: %252541 is A, as %41 is.
PERCENT = re.compile(r"%(?:25)*([0-9A-Fa-f]{2})")
ESCAPED = re.compile(r"""\\(?:(?:u005[Cc]|x5[Cc])(?=u005[Cc]|x5[Cc]|[ux{"'/bfnrt\\]))*(?:u\{([0-9A-Fa-f]{1,6})\}|u([Dd][89ABab][0-9A-Fa-f]{2}\\u[Dd][C-Fc-f][0-9A-Fa-f]{2}|[0-9A-Fa-f]{4})|x([0-9A-Fa-f]{2})|(["'/\\bfnrt]))""")
PLAIN_ESCAPES = dict(zip("bfnrt", "\b\f\n\r\t"))
#: A run, which may be wrapped: then every line but the last is long, too.
BASE64 = re.compile(r"(?:[A-Za-z0-9+/_-]{%d,}+\r?\n[\x20\t]*)+[A-Za-z0-9+/_-]++={0,2}|[A-Za-z0-9+/_-]{%d,}+={0,2}" % (BASE64_LEAST, BASE64_LEAST))
#: A character that no secret or encoded run contains.
BREAK = re.compile(r"""[^A-Za-z0-9+/_.=:~%\\{}"'\x20-]""")
#: Where compressed bytes may begin in a layer whose escapes were replaced.
PACKED = re.compile(rb"\x1f\x8b\x08|x[\x01\x5e\x9c\xda]|BZh[1-9]1AY&SY|\x28\xb5\x2f\xfd")

_FOUND = "struct<base:array<struct<kind:string,start:int,stop:int>>,hidden:array<struct<kind:string,start:int,stop:int>>>"


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, stop) of the secrets that stand in a text as they are, by start, then by kind as listed."""
    found = []
    low = text.lower()
    if any(k in low for k in ("password", "passwd", "secret", "token", "api_key", "apikey")):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _characters(raw: bytes, starts: np.ndarray, stops: np.ndarray):
    """Text of bytes in UTF-8, an undecodable byte as one character, with each character's source."""
    text = raw.decode(errors="surrogateescape")
    if len(text) == len(raw):
        return text, starts, stops
    size = _widths(text)
    ends = np.cumsum(size)
    return text, starts[ends - size], stops[ends - 1]


def _widths(text: str) -> np.ndarray:
    """Bytes of each character; an undecodable byte is one."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    size = 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
    return np.where((code >= 0xDC80) & (code <= 0xDCFF), 1, size)


class _Source:
    """Bytes from an iterator of blocks, with a look ahead."""

    def __init__(self, blocks: Iterator[bytes]):
        self.blocks, self.ready, self.at = iter(blocks), b"", 0

    def peek(self, n: int = 4) -> bytes:
        while len(self.ready) - self.at < n and (part := next(self.blocks, None)) is not None:
            self.ready, self.at = self.ready[self.at :] + part, 0
        return self.ready[self.at : self.at + n]

    def read(self, n: int = BLOCK_BYTES) -> bytes:
        self.peek(1)
        self.at += len(out := self.ready[self.at : self.at + n])
        return out

    def give_back(self, data: bytes) -> None:
        self.ready, self.at = data + self.ready[self.at :], 0


def _packing(head: bytes) -> str | None:
    """The name of the compression that bytes begin with."""
    if head[:2] == b"\x1f\x8b":
        return "gzip"
    if head[:1] == b"\x78" and len(head) > 2 and (head[0] * 256 + head[1]) % 31 == 0:
        return "zlib"
    if head[:3] == b"BZh":
        return "bzip2"
    return "zstd" if head[:4] == b"\x28\xb5\x2f\xfd" else None


def _unpacked(blocks: Iterator[bytes]) -> Iterator[bytes]:
    """The content of all members of compressed bytes, in blocks; where they are damaged it ends."""
    source = _Source(blocks)
    try:
        while name := _packing(source.peek()):
            if name == "zstd":
                reader = zstandard.ZstdDecompressor().stream_reader(source, read_across_frames=True)
                while part := reader.read(BLOCK_BYTES):
                    yield part
                return
            unit = bz2.BZ2Decompressor() if name == "bzip2" else zlib.decompressobj(31 if name == "gzip" else 15)
            while not unit.eof:
                wants = unit.needs_input if name == "bzip2" else not unit.unconsumed_tail
                data = source.read() if wants else b"" if name == "bzip2" else unit.unconsumed_tail
                part = unit.decompress(data, BLOCK_BYTES)
                if part:
                    yield part
                elif wants and not data:
                    return  # cut off
            source.give_back(unit.unused_data)
            while name == "gzip" and source.peek(1) == b"\0":  # padding
                source.read(1)
    except (zlib.error, OSError, EOFError, ValueError, zstandard.ZstdError):
        return


def _texts(blocks: Iterator[bytes]) -> Iterator[str]:
    """Bytes as text in blocks of some BLOCK_CHARS, cut where nothing that is searched for can reach across."""
    decoder = codecs.getincrementaldecoder("utf-8")("surrogateescape")
    held = ""
    for part in blocks:
        held += decoder.decode(part)
        if len(held) < BLOCK_CHARS:
            continue
        if m := BREAK.search(held[::-1]):
            yield held[: len(held) - m.start()]
            held = held[len(held) - m.start() :]
        elif len(held) >= LAYER_CHARS:  # one run; base64 goes on at a multiple of four
            yield held
            held = held[(len(held) - OVERLAP_CHARS) // 4 * 4 :]
    if held := held + decoder.decode(b"", True):
        yield held


def _percent_byte(e: re.Match) -> bytes:
    return bytes([int(e[1], 16)])


def _escaped_bytes(e: re.Match) -> bytes:
    if e[4]:
        return PLAIN_ESCAPES.get(e[4], e[4]).encode()
    if e[2] and len(e[2]) > 4:  # a surrogate pair
        return bytes.fromhex(e[2][:4] + e[2][6:]).decode("utf-16-be").encode()
    code = int(e[1] or e[2] or e[3], 16)
    return bytes([code]) if e[3] and code > 127 else chr(code).encode(errors="replace") if code < 0x110000 else b"?"


def _replaced(text: str, escape: re.Pattern, value):
    """Bytes of a whole text with its escapes replaced, and each byte's source."""
    raw, starts, stops, at = bytearray(), array("q"), array("q"), 0

    def plain(begin: int, end: int) -> None:
        piece = text[begin:end].encode(errors="surrogateescape")
        place = np.arange(begin, end)
        if len(piece) != end - begin:
            place = np.repeat(place, _widths(text[begin:end]))
        raw.extend(piece)
        starts.frombytes(place.tobytes())
        stops.frombytes((place + 1).tobytes())

    for e in escape.finditer(text):
        if at < e.start():
            plain(at, e.start())
        part = value(e)
        raw.extend(part)
        starts.extend([e.start()] * len(part))
        stops.extend([e.end()] * len(part))
        at = e.end()
    plain(at, len(text))
    return bytes(raw), np.frombuffer(starts, np.int64), np.frombuffer(stops, np.int64)


def _base64(m: re.Match) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
    """The bytes of a run, with their sources, read from each of its first four characters.

    What stands before the encoded part may be of the same alphabet, as in id/aGVs..., so where a group of four
    characters begins isn't known; whatever comes before it, one of the four readings is in step.
    """
    run = m[0].rstrip("=")
    places = np.arange(m.start(), m.start() + len(run))
    if "\n" in run:
        kept = np.array([c not in "\r\n \t" for c in run])
        run, places = re.sub(r"[\r\n \t]", "", run), places[kept]
    run = run.replace("-", "+").replace("_", "/")
    for skip in range(4):
        body = run[skip : len(run) - ((len(run) - skip) % 4 == 1)]
        raw = base64.b64decode(body + "=" * (-len(body) % 4))
        k = np.arange(len(raw))
        yield raw, places[skip + 8 * k // 6], places[skip - (-8 * (k + 1) // 6) - 1] + 1


def _without_zeros(raw: bytes, starts: np.ndarray, stops: np.ndarray):
    """The bytes but zeros, with their sources: what UTF-16 or UTF-32 makes of plain characters."""
    kept = np.frombuffer(raw, np.uint8) != 0
    return raw.replace(b"\0", b""), starts[kept], stops[kept]


def _from(raw: bytes, at: int) -> Iterator[bytes]:
    """The bytes from a place on, in blocks that begin small: where nothing is packed, little is copied."""
    size = 64
    while at < len(raw):
        yield raw[at : at + size]
        at, size = at + size, min(2 * size, BLOCK_BYTES)


def _packed_layers(name: str, blocks: Callable[[], Iterator[bytes]], seen: set) -> Iterator[tuple[str, str]]:
    """(name, text) of compressed bytes, block by block, and of those compressed in them; `blocks` begins them anew."""
    while packing := _packing(_Source(blocks()).peek()):
        name, blocks = f"{name}.{packing}", partial(_unpacked_of, blocks)
        for text in _texts(blocks()):
            yield name, text
        if _packing(_Source(blocks()).peek()):
            digest = hashlib.sha256()
            for part in blocks():
                digest.update(part)
            if digest.digest() in seen:
                return
            seen.add(digest.digest())


def _unpacked_of(blocks: Callable[[], Iterator[bytes]]) -> Iterator[bytes]:
    return _unpacked(blocks())


def _same(start: int, stop: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.broadcast_to(np.int64(start), n), np.broadcast_to(np.int64(stop), n)


class _Search:
    """The hidden secrets of one text."""

    def __init__(self, text: str):
        self.seen, self.told = {_digest(text)}, {}
        stack = [self.layers("", text, None, False)]
        while stack:  # a layer is searched before the next one of its parent is opened
            try:
                child = next(stack[-1])
            except StopIteration as done:  # what is as long as its parent comes when that is gone
                stack.pop()
                rest = done.value
                del done
                while rest:
                    stack.append(self.layers(*rest.pop()))
            else:
                stack.append(self.layers(*child))
                del child

    @property
    def found(self) -> list[tuple[str, int, int]]:
        return [(kind, begin, end) for (_, _, begin, end), (kind, _) in self.told.items()]

    def layers(self, path: str, layer: str, sources, shifted: bool):
        """(path, text, sources, shifted) of the new layers that one decoding step opens, once their secrets are noted. The layers
        whose escapes were replaced are returned at the end.

        Escapes are replaced in the layer as a whole, so what is only partly escaped is read with its surroundings. Its
        runs as they stand come first: those that replacing leaves as they are then count as seen.
        """
        whole, later = [], []
        if "%" in layer and PERCENT.search(layer):
            whole.append(("url", *_replaced(layer, PERCENT, _percent_byte)))
        if "\\" in layer and ESCAPED.search(layer):
            whole.append(("unicode", *_replaced(layer, ESCAPED, _escaped_bytes)))
        known = base_spans(layer) if whole else []
        for name, raw, starts, stops in whole:
            later += self.opened(path, sources, name, *_characters(raw, starts, stops), known, shifted=shifted)
        yield from self.base64_layers(path, layer, sources, slice(0, 1), shifted)
        for name, raw, starts, stops in whole:
            if not PACKED.search(raw):
                continue
            wide, lines = stops - starts > 1, np.flatnonzero(np.frombuffer(raw, np.uint8) == 10) if name == "url" else np.empty(0, np.int64)
            for m in PACKED.finditer(raw):
                if m[0][:1] == b"B" or wide[m.start() : m.end()].any():
                    line = np.searchsorted(lines, m.start())
                    ends = int(starts[m.start()]), int(stops[lines[line] if line < len(lines) else -1])
                    for inner, text in _packed_layers(name, partial(_from, raw, m.start()), self.seen):
                        yield from self.opened(path, sources, inner, text, *_same(*ends, len(text)), shifted=shifted)
        yield from self.base64_layers(path, layer, sources, slice(1, 4), True)
        return later[::-1]

    def base64_layers(self, path: str, layer: str, sources, readings: slice, shifted: bool):
        for m in BASE64.finditer(layer):
            for run in islice(_base64(m), readings.start, readings.stop):
                yield from self.opened(path, sources, "base64", *_characters(*run), shifted=shifted)
                if b"\0" in run[0]:
                    yield from self.opened(path, sources, "base64.utf16", *_characters(*_without_zeros(*run)), shifted=shifted)
                for at in PACKED.finditer(run[0]):
                    for name, text in _packed_layers("base64", partial(_from, run[0], at.start()), self.seen):
                        yield from self.opened(path, sources, name, text, *_same(m.start(), m.end(), len(text)), shifted=shifted)
                        if "\0" in text:
                            plain = text.replace("\0", "")
                            yield from self.opened(path, sources, f"{name}.utf16", plain, *_same(m.start(), m.end(), len(plain)), shifted=shifted)

    def opened(self, path: str, sources, name: str, text: str, starts: np.ndarray, stops: np.ndarray, known=(), shifted: bool = False) -> list:
        """The layer to search, if it is new; notes its secrets but those inside `known` spans of its parent.

        A secret that several orders of steps open is noted once, by the first of them in which no base64 run was
        `shifted`, read from a later character than its first.
        """
        if not text:
            return []
        ends = (int(starts[0]), int(stops[-1]))
        if sources is not None:
            ends = (int(sources[0][ends[0]]), int(sources[1][ends[1] - 1]))
        key = _digest(text, *ends)
        if key in self.seen:
            return []
        self.seen.add(key)
        inside = {kind: [(a, b) for k, a, b in known if k == kind] for kind in KINDS} if known else {}
        for kind, a, b in base_spans(text):
            begin, end = int(starts[a]), int(stops[b - 1])
            spans = inside.get(kind, ())
            at = bisect_right(spans, (begin, float("inf"))) - 1
            if at >= 0 and end <= spans[at][1]:
                continue  # it stands in the parent as it is
            if sources is not None:
                begin, end = int(sources[0][begin]), int(sources[1][end - 1])
            same = (kind, _digest(text[a:b]), begin, end)
            if same not in self.told or self.told[same][1] and not shifted:
                self.told[same] = (f"{kind}{path}.{name}", shifted)
        if "%" not in text and "\\" not in text and not BASE64.search(text):
            return []
        if sources is not None:
            starts, stops = sources[0][starts], sources[1][stops - 1]
        return [(f"{path}.{name}", text, (starts, stops), shifted)]


def _digest(text: str, *ends: int) -> bytes:
    return hashlib.sha256(text.encode(errors="surrogatepass") + repr(ends).encode()).digest()


def hidden_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, stop) of the secrets in decoded layers; the kind names the decodings, e.g. assign.base64.gzip."""
    return sorted(set(_Search(text).found), key=lambda s: (s[1], s[0], s[2]))


def find_secrets(text: Column) -> Column:
    """struct(base, hidden) of a text column; spans are code points, stop exclusive."""
    spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))
    kind = pa.struct([("base", spans), ("hidden", spans)])

    def scan(texts: pa.Array) -> pa.Array:
        as_rows = lambda found: [{"kind": k, "start": a, "stop": b} for k, a, b in found]
        return pa.array([{"base": as_rows(base_spans(t)), "hidden": as_rows(hidden_spans(t))} for t in (x or "" for x in texts.to_pylist())], kind)

    return F.arrow_udf(scan, _FOUND)(text)


def joined(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", find_secrets(F.col("text")).alias("f"))
    count = lambda kind: F.size(F.filter("f.base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    by_start = F.array_sort(
        F.concat("f.base", "f.hidden"),
        lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).when(_rank(a) != _rank(b), _rank(a) - _rank(b)).when(a["kind"] < b["kind"], -1).when(a["kind"] > b["kind"], 1).otherwise(a["stop"] - b["stop"]),
    )
    return found.select("doc_id", *(count(k) for k in KINDS), F.sha2(joined(F.col("f.base")), 256).alias("base_sha256"), joined(by_start).alias("spans"))


def _rank(span: Column) -> Column:
    """Base kinds as listed, then the others."""
    return F.when(span["kind"] == "assign", 0).when(span["kind"] == "access", 1).when(span["kind"] == "hex", 2).otherwise(3)


QUERIES = {"op7_secrets": op7_secrets}
ORACLE_SQL: dict[str, str] = {}
