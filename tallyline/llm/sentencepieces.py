"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces with log scores.

The pieces come from a public model file, whose path is a parameter; nothing is trained. That file ranks its pieces and
has no probabilities, so a piece's log score is that of its rank under Zipf's law, or with scores="file" the number
that the file has. Spaces become the marker U+2581 and one is put before the text. Characters that no piece covers
become the byte pieces of their UTF-8, and so does a marker that stands in the text itself; hence decoding gives back
any text exactly.

Defined cases: null and empty texts have no pieces, and no pieces decode to the empty text (a null list to null). Of
equally scored segmentations the one with the shorter last piece stays, as in forward Viterbi with a strict comparison.
Other columns are not read.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.llm.common import table

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: What an uncovered character scores below the lowest piece, and the chunks that a task remembers (or those of 256 texts).
UNKNOWN_PENALTY, REMEMBERED = 10.0, 300_000

_RESULT = "struct<ids:array<int>,exact:boolean>"


class Vocabulary(NamedTuple):
    """What tasks receive: the trie (base, check, value), scores and bytes by id, ids of the byte pieces."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray
    scores: np.ndarray
    pieces: list
    byte_ids: list
    lowest: float
    chunk: str


def double_array(keys: list[tuple[bytes, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base, check and value of a trie: from node s byte c leads to t = base[s] + c + 1 if check[t] == s."""
    root: dict = {}
    for key, value in keys:
        node = root
        for c in key:
            node = node.setdefault(c, {})
        node[-1] = value
    base, check, value = [0], [-2], [-1]
    low, wide, last, todo = 1, 1, 0, [(0, root)]

    def grow(n: int) -> None:
        if len(base) <= n:
            more = n + 1 - len(base)
            base.extend([0] * more)
            check.extend([-1] * more)
            value.extend([-1] * more)

    for s, node in todo:  # todo grows: nodes in breadth-first order
        value[s] = node.get(-1, -1)
        codes = sorted(c for c in node if c >= 0)
        if not codes:
            continue
        grow(low + 256)
        while check[low] != -1:
            low += 1
            grow(low + 256)
        # an only child takes the first free place; siblings search a little, then go behind all others
        at = max(0, (low if len(codes) == 1 else max(low, wide)) - codes[0] - 1)
        tries = 0
        while True:
            grow(at + codes[-1] + 1)
            if all(check[at + c + 1] == -1 for c in codes):
                break
            at += 1
            tries += 1
            if tries == 64:
                wide = last + 1
                at = max(at, wide - codes[0] - 1)
        base[s] = at
        last = max(last, at + codes[-1] + 1)
        for c in codes:
            check[at + c + 1] = s
            todo.append((at + c + 1, node[c]))
    return tuple(np.array(x, np.int32) for x in (base, check, value))


def load(path: str = MODEL_PATH, scores: str = "zipf") -> Vocabulary:
    """Reads a model file on the driver; the result is as large as the vocabulary."""
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.vocab_size()
    plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    score = np.zeros(n)
    if scores == "zipf":
        total = math.log(sum(1 / k for k in range(1, len(plain) + 1)))
        score[plain] = [-math.log(k) - total for k in range(1, len(plain) + 1)]
    else:
        score[plain] = [sp.get_score(i) for i in plain]
    byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    raw = [b""] * n
    for i in plain:
        raw[i] = sp.id_to_piece(i).replace(MARK, " ").encode()
    for b, i in enumerate(byte_ids):
        raw[i] = bytes([b])
    texts = [sp.id_to_piece(i) for i in plain]
    trie = double_array([(t.encode(), i) for t, i in zip(texts, plain)])
    return Vocabulary(*trie, score, raw, byte_ids, float(score[plain].min()), chunk_pattern(texts))


def chunk_pattern(pieces: list[str]) -> str:
    """A pattern of chunks at whose ends every segmentation has a boundary, so that they can be segmented alone.

    No piece holds a marker after another character, a line break or tab at all, or certain signs after a letter; each
    is checked on the pieces. Where the first doesn't hold, a text is one chunk.
    """
    if any(MARK in p.lstrip(MARK) for p in pieces):
        return r"(?s).+"
    inside = set("".join(pieces))
    alone = "".join(c for c in "\n\t" if c not in inside)
    after_letters = {p[i] for p in pieces for i in range(1, len(p)) if p[i - 1].isalpha()}
    signs = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c not in after_letters)
    stop = regex.escape(MARK + alone)
    words = f"{MARK}*\\p{{L}}++(?![^{stop}{regex.escape(signs, special_only=False)}])"
    return "|".join([words, *([f"[{regex.escape(alone)}]+"] if alone else []), f"{MARK}*[^{stop}]+", f"{MARK}+"])


def viterbi(chunk: bytes, trie, scores: list[float], unknown: float, byte_ids: list[int]) -> list[int]:
    """The ids of the best segmentation of UTF-8 bytes; an uncovered character gives the ids of its bytes."""
    base, check, value = trie
    n, size = len(chunk), len(base)
    best, back = [-math.inf] * (n + 1), [(0, -1)] * (n + 1)
    best[0] = 0.0
    i = 0
    while i < n:
        first = chunk[i]
        step = 1 if first < 128 else 2 if first < 224 else 3 if first < 240 else 4
        here, node, covered, j = best[i], 0, False, i
        while j < n:
            t = base[node] + chunk[j] + 1
            if t >= size or check[t] != node:
                break
            node, j = t, j + 1
            v = value[node]
            if v >= 0:
                covered |= j == i + step
                s = here + scores[v]
                if s > best[j]:
                    best[j], back[j] = s, (i, v)
        if not covered and here + unknown > best[i + step]:
            best[i + step], back[i + step] = here + unknown, (i, -1)
        i += step
    out, end = [], n
    while end:
        start, v = back[end]
        if v >= 0:
            out.append(v)
        else:
            out += [byte_ids[x] for x in reversed(chunk[start:end])]
        end = start
    return out[::-1]


def viterbi_together(chunks: list[bytes], trie, scores: np.ndarray, unknown: float) -> tuple[np.ndarray, np.ndarray]:
    """viterbi() for many short chunks at once: each step moves all of them one byte along the trie.

    Returns all ids behind each other, -1 for an uncovered character, and how many each chunk has.
    """
    base, check, value = trie
    lens = np.array([len(c) for c in chunks])
    width, n = int(lens.max()), len(chunks)
    row = width + 1  # a chunk's cells stand together in flat arrays
    data = np.frombuffer(b"".join(c.ljust(row, b"\0") for c in chunks), np.uint8).astype(np.int32)
    best = np.full(n * row, -np.inf)
    begin = np.arange(n) * row
    end = begin + lens
    best[begin] = 0
    origin, piece = np.zeros(n * row, np.int64), np.full(n * row, -1, np.int32)
    for i in range(width):
        cell = begin + i
        cell = cell[(cell < end) & (best[cell] > -np.inf)]
        if not len(cell):
            continue
        first = data[cell]
        stop = cell + 1 + (first >= 192) + (first >= 224) + (first >= 240)
        covered = np.zeros(len(cell), bool)
        which, node, at = np.arange(len(cell)), np.zeros(len(cell), np.int32), cell
        while len(which):
            t = base[node] + data[at] + 1
            on = check[t] == node  # behind a chunk's end stand zeros, which no piece has
            which, node, at = which[on], t[on], at[on] + 1
            v = value[node]
            ends = np.flatnonzero(v >= 0)
            w, to, v = which[ends], at[ends], v[ends]
            covered[w[stop[w] == to]] = True
            score = best[cell[w]] + scores[v]
            better = np.flatnonzero(score > best[to])
            to = to[better]
            best[to], origin[to], piece[to] = score[better], cell[w[better]], v[better]
        bare = np.flatnonzero(~covered)
        to, score = stop[bare], best[cell[bare]] + unknown
        better = np.flatnonzero(score > best[to])
        to = to[better]
        best[to], origin[to], piece[to] = score[better], cell[bare[better]], -1
    found, counts, at, open_ = [], np.zeros(n, np.int64), end.copy(), np.flatnonzero(lens > 0)
    while len(open_):
        column = np.full(n, -2, np.int32)
        column[open_] = piece[at[open_]]
        found.append(column)
        counts[open_] += 1
        at[open_] = origin[at[open_]]
        open_ = open_[at[open_] > begin[open_]]
    if not found:
        return np.zeros(0, np.int32), counts
    back = np.stack(found[::-1], axis=1)
    return back[back > -2], counts


class Encoder:
    """Encodes and decodes texts; remembers the ids of chunks that it has segmented, up to a bound."""

    def __init__(self, vocabulary: Vocabulary):
        v = Vocabulary(*vocabulary)
        room = [np.concatenate((x, np.full(300, fill, np.int32))) for x, fill in ((v.base, 0), (v.check, -1), (v.value, -1))]
        self.trie, self.lists = room, [x.tolist() for x in room]
        self.scores, self.score_list, self.pieces, self.byte_ids = v.scores, v.scores.tolist(), v.pieces, v.byte_ids
        self.unknown = v.lowest - UNKNOWN_PENALTY
        self.known: dict[str, bytes] = {}  # the ids as int32 in bytes, which join fast
        self.chunks = regex.compile(v.chunk).findall

    def learn(self, chunks: set[str]) -> None:
        """Segments the chunks that aren't known yet: short ones together, long or uncovered ones one by one."""
        new = chunks - self.known.keys()
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = chunks
        by_width: dict[int, list[str]] = {}
        for c in new:
            by_width.setdefault(len(c) // 4, []).append(c)
        for width, group in by_width.items():
            for k in range(0, len(group), 20_000):
                part = group[k : k + 20_000]
                raws = [c.encode() for c in part]
                if width > 10:
                    for c, raw in zip(part, raws):
                        self.known[c] = self._alone(raw)
                    continue
                ids, counts = viterbi_together(raws, self.trie, self.scores, self.unknown)
                flat, ends = ids.tobytes(), (4 * np.cumsum(counts)).tolist()
                self.known.update(zip(part, [flat[a:b] for a, b in zip([0, *ends], ends)]))
                bare = np.unique(np.repeat(np.arange(len(part)), counts)[ids < 0])
                for i in bare.tolist():
                    self.known[part[i]] = self._alone(raws[i])

    def _alone(self, raw: bytes) -> bytes:
        return np.array(viterbi(raw, self.lists, self.score_list, self.unknown, self.byte_ids), np.int32).tobytes()

    def _parts(self, text: str) -> list[tuple[bool, list[str]]]:
        """(marker that stands in the text itself?, chunks) in order."""
        if MARK not in text:
            return [(False, self.chunks(MARK + text.replace(" ", MARK)))]
        out = []
        for k, part in enumerate(regex.split(f"([{MARK}]+)", text)):
            if k % 2 or part or not k:
                out.append((True, [part]) if k % 2 else (False, self.chunks((MARK if not k else "") + part.replace(" ", MARK))))
        return out

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        out = []
        for k in range(0, len(texts), 256):
            parts = [self._parts(t) if t else [] for t in texts[k : k + 256]]
            self.learn({c for p in parts for literal, chunks in p if not literal for c in chunks})
            for p in parts:
                found = (np.array([self.byte_ids[x] for x in chunks[0].encode()], np.int32).tobytes() if literal else b"".join(map(self.known.__getitem__, chunks)) for literal, chunks in p)
                out.append(np.frombuffer(b"".join(found), np.int32))
        return out

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_all([text])[0]

    def decode(self, ids) -> str:
        raw = b"".join(map(self.pieces.__getitem__, ids))
        return raw[1:].decode(errors="replace") if raw[:1] == b" " else raw.decode(errors="replace")


def encoded(text: Column, vocabulary) -> Column:
    """struct(ids, exact) of a text column: its pieces, and whether decoding them gives the text back."""
    made = []

    def scan(texts: pa.Array) -> pa.Array:
        if not made:
            made.append(Encoder(vocabulary.value))
        enc = made[0]
        plain = texts.to_pylist()
        ids = enc.encode_all(plain)
        exact = [enc.decode(x.tolist()) == (t or "") for x, t in zip(ids, plain)]
        ends = np.cumsum([0, *map(len, ids)])
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32())), pa.array(exact, pa.bool_())], ["ids", "exact"])

    return F.arrow_udf(scan, _RESULT)(text)


def decoded(ids: Column, vocabulary) -> Column:
    """The text of a column of ids."""
    made = []

    def scan(lists: pa.Array) -> pa.Array:
        if not made:
            made.append(Encoder(vocabulary.value))
        return pa.array([None if x is None else made[0].decode(x) for x in lists.to_pylist()], pa.string())

    return F.arrow_udf(scan, "string")(ids)


def shared(spark: SparkSession, path: str = MODEL_PATH, scores: str = "zipf"):
    """The vocabulary as a broadcast; its size is the model file's."""
    return spark.sparkContext.broadcast(tuple(load(path, scores)))


def encode_documents(docs: DataFrame, path: str = MODEL_PATH) -> DataFrame:
    """doc_id, ids, n_pieces and exact for each document."""
    found = docs.select("doc_id", encoded(F.col("text"), shared(docs.sparkSession, path)).alias("e"))
    return found.select("doc_id", "e.ids", F.size("e.ids").cast("long").alias("n_pieces"), "e.exact")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op9_sentencepiece": op9_sentencepiece}
ORACLE_SQL: dict[str, str] = {}
