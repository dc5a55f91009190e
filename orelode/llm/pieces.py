"""Piece models: byte-pair token counts, and encoding and decoding by Viterbi.

Both operators read a model file of the ``sentencepiece`` format (a protobuf
message). The driver reads the file and ships its bytes; each Python worker
parses them once. No piece of such a model crosses the start of a word (the
escape character only leads a piece), so a text falls apart into chunks that
can be handled one by one, and the result of a chunk can be remembered. The
memory of a worker is bounded: a cache that grows over ``CACHE`` entries is
dropped, and chunks over ``LONG`` characters are never remembered.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, id_text, left_behind, strings

SPACE = "▁"  # stands for a blank within pieces
CACHE = 300_000
LONG = 64
#: What an unknown symbol costs below the worst piece.
UNKNOWN = 10.0


def _varint(raw: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = raw[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    at = 0
    while at < len(raw):
        key, at = _varint(raw, at)
        if key & 7 == 0:
            value, at = _varint(raw, at)
        else:
            size, at = _varint(raw, at) if key & 7 == 2 else ({1: 8, 5: 4}[key & 7], at)
            value = raw[at : at + size]
            at += size
        yield key >> 3, value


class Model:
    """The pieces of a model file: ``scores`` of the normal ones, ``ids``, ``byte_ids``.

    Only what the operators cover is accepted: identity normalisation, a dummy
    blank in front, blanks kept as they are, byte fallback, no user-defined
    pieces. Anything else raises ``ValueError`` rather than count wrongly.
    """

    def __init__(self, raw: bytes):
        self.scores: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.byte_ids: dict[int, int] = {}
        self.output: list[bytes] = []  # what each id decodes to
        for field, value in _fields(raw):
            if field == 1:
                piece = dict(_fields(value))
                name, kind, number = piece[1].decode(), piece.get(3, 1), len(self.output)
                self.output.append(b"")
                if kind == 1:
                    self.scores[name] = struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0]
                    self.ids[name] = number
                    self.output[-1] = name.replace(SPACE, " ").encode()
                elif kind == 6:
                    self.byte_ids[int(name[3:5], 16)] = number
                    self.output[-1] = bytes([int(name[3:5], 16)])
                elif kind not in (2, 3, 5):
                    raise ValueError(f"a piece of kind {kind}")
            elif field == 3:
                rules = dict(_fields(value))
                if rules.get(1, b"identity") != b"identity" or rules.get(3, 1) != 1 or rules.get(4, 1) != 0 or rules.get(5, 1) != 1:
                    raise ValueError("a normalisation other than identity with a dummy blank")
        if len(self.byte_ids) != 256:
            raise ValueError("no byte fallback")
        if any(SPACE in x.lstrip(SPACE) for x in self.scores):
            raise ValueError("pieces cross words")
        self.singles = {x for x in self.scores if len(x) == 1}
        self.chunks = re.compile(f"{SPACE}*[^{SPACE}\\n]+|{SPACE}+|\\n" if not any("\n" in x for x in self.scores) else f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall


def count_chunk(chunk: str, scores: dict[str, float]) -> int:
    """Tokens that byte-pair merging leaves of a chunk.

    Symbols start as characters in a doubly linked list; a heap holds adjacent
    pairs by rank (the negated score), leftmost first among equals. The lowest
    pair is popped, merged if both its ends still stand, and the new pairs on
    either side are pushed. Each merge takes one symbol away; a character that
    is no piece takes part in no merge and counts as its bytes.
    """
    n = len(chunk)
    parts: list[str | None] = list(chunk)
    count = n
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(-s, i, a, b) for i, (a, b) in enumerate(zip(chunk, chunk[1:], strict=False)) if (s := scores.get(a + b)) is not None]
    heapq.heapify(heap)
    pop, push, get = heapq.heappop, heapq.heappush, scores.get
    while heap:
        _, i, a, b = pop(heap)
        j = after[i]
        if parts[i] != a or j >= n or parts[j] != b:
            continue
        parts[i] = both = a + b
        parts[j] = None
        count -= 1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (s := get(both + parts[k])) is not None:
                push(heap, (-s, i, both, parts[k]))
        if (h := before[i]) >= 0 and (s := get(parts[h] + both)) is not None:
            push(heap, (-s, h, parts[h], both))
    return count + sum(len(x.encode()) - 1 for x in parts if x is not None and len(x) == 1 and x not in scores)


class _Counts(dict):
    def __init__(self, model: Model):
        super().__init__()
        self.scores = model.scores

    def __missing__(self, chunk: str) -> int:
        n = count_chunk(chunk, self.scores)
        if len(chunk) <= LONG:
            self[chunk] = n
        return n


def _segments(chunk: str, automaton, singles: set[str], unknown: float) -> list[tuple[int, int]]:
    """Best path over a chunk as (end, id) pairs; id -1 is an unknown character.

    One pass of the automaton: at each end position it yields the pieces that
    end there (the output links), each of which relaxes the best score of that
    position. Among equal scores the piece met first, the longest, stays.
    """
    n = len(chunk)
    best, back, piece = [0.0] + [None] * n, [0] * (n + 1), [-1] * (n + 1)
    strange = [i for i, c in enumerate(chunk) if c not in singles]
    at = 0
    for last, (size, score, number) in automaton.iter(chunk):
        while at < len(strange) and strange[at] < last:
            i = strange[at]
            if best[i + 1] is None or best[i] + unknown > best[i + 1]:
                best[i + 1], back[i + 1], piece[i + 1] = best[i] + unknown, i, -1
            at += 1
        start, end = last + 1 - size, last + 1
        value = best[start] + score
        if best[end] is None or value > best[end]:
            best[end], back[end], piece[end] = value, start, number
    for i in strange[at:]:
        if best[i + 1] is None or best[i] + unknown > best[i + 1]:
            best[i + 1], back[i + 1], piece[i + 1] = best[i] + unknown, i, -1
    path, end = [], n
    while end:
        path.append((end, piece[end]))
        end = back[end]
    return path[::-1]


class _Encoded(dict):
    def __init__(self, model: Model):
        super().__init__()
        self.model = model
        self.unknown = min(model.scores.values()) - UNKNOWN
        self.automaton = ahocorasick.Automaton()
        for name, score in model.scores.items():
            self.automaton.add_word(name, (len(name), score, model.ids[name]))
        self.automaton.make_automaton()

    def __missing__(self, chunk: str) -> bytes:
        ids: list[int] = []
        for end, number in _segments(chunk, self.automaton, self.model.singles, self.unknown):
            ids += [number] if number >= 0 else [self.model.byte_ids[x] for x in chunk[end - 1].encode()]
        packed = array("i", ids).tobytes()
        if len(chunk) <= LONG:
            self[chunk] = packed
        return packed


_ready: dict[tuple[int, str], tuple[Model, dict]] = left_behind({}, "pieces")


def _worker(raw: bytes, kind: type) -> tuple[Model, dict]:
    """The parsed model and the cache of this Python worker."""
    key = (hash(raw), kind.__name__)
    if key not in _ready:
        model = Model(raw)
        _ready[key] = (model, kind(model))
    return _ready[key]


def read_model(path: str) -> bytes:
    """The model file's bytes, read on the driver, where ``path`` lies."""
    with open(path, "rb") as f:
        return f.read()


def token_counts(docs: DataFrame, model: bytes, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token counts of whole texts by heap-and-linked-list byte-pair merging.

    Returns ``doc_id, n_bytes, n_tokens, over_limit`` (``n_tokens > limit``),
    a row for each input row, repeated rows too. Null and empty texts have 0
    bytes and 0 tokens; a null ``doc_id`` stays null; other columns are
    ignored; an empty table gives an empty result. Begin and end tokens aren't
    counted and the text of a special token is ordinary text. Nothing is
    truncated. There is no shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules, cache = _worker(shared.value, _Counts)
        look = cache.__getitem__
        for batch in batches:
            found = []
            for text in strings(batch.column(2)):
                found.append(sum(map(look, rules.chunks(SPACE + text.replace(" ", SPACE)))) if text else 0)
                if len(cache) > CACHE:
                    cache.clear()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    rows = id_text(docs, id_col, text_col).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    return rows.mapInArrow(frugal(count, "pieces"), "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def encode_text(text: str, cache: dict, chunks) -> np.ndarray:
    """Piece ids (int32) of a text; the escape character itself, met in a text, goes through byte fallback so that decoding is exact."""
    if not text:
        return np.empty(0, np.int32)
    look, packed = cache.__getitem__, []
    for k, part in enumerate(text.split(SPACE)):
        if k:
            packed.append(array("i", [cache.model.byte_ids[x] for x in SPACE.encode()]).tobytes())
        part = part.replace(" ", SPACE)
        packed.append(b"".join(map(look, chunks(part if k else SPACE + part))))
    return np.frombuffer(b"".join(packed), np.int32)


def encode(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Piece ids of whole texts: the path of the highest summed piece score.

    An Aho-Corasick automaton over the normal pieces drives one Viterbi pass
    over each chunk; characters that are no piece fall back to byte pieces.
    Returns ``doc_id, ids array<int>``, a row for each input row. Null and
    empty texts have no ids; other columns are ignored. There is no shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules, cache = _worker(shared.value, _Encoded)
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                sizes, flat = [0], []
                for text in strings(part.column(1)):
                    flat.append(encode_text(text, cache, rules.chunks))
                    sizes.append(sizes[-1] + len(flat[-1]))
                    if len(cache) > CACHE:
                        cache.clear()
                ids = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate(flat)))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=["doc_id", "ids"])

    return id_text(docs, id_col, text_col).mapInArrow(frugal(run, "pieces"), "doc_id long, ids array<int>")


class Decoder:
    """The bytes of all pieces in one buffer, to be gathered by id."""

    def __init__(self, model: Model):
        self.flat = np.frombuffer(b"".join(model.output), np.uint8)
        self.size = np.array([len(x) for x in model.output], np.int64)
        self.start = np.cumsum(self.size) - self.size

    def text(self, ids: np.ndarray) -> str:
        """The pieces' bytes in a row, without the dummy blank in front."""
        size = self.size[ids]
        ends = np.cumsum(size)
        if not len(ids) or not ends[-1]:
            return ""
        at = np.repeat(self.start[ids] - (ends - size), size) + np.arange(ends[-1])
        return self.flat[at].tobytes()[1:].decode("utf-8", "replace")


def decode(encoded: DataFrame, model: bytes) -> DataFrame:
    """Texts of ``encode``'s rows: ``doc_id, ids, text``; null or no ids give an empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(Model(shared.value))
        for batch in batches:
            texts = [decoder.text(np.asarray(x.values.to_numpy(zero_copy_only=False), np.int64)) if x.is_valid and len(x) else "" for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, text string")


def round_trip(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes whole texts in one pass and keeps digests only.

    Returns ``doc_id, n_pieces, ids_sha256`` (of the ids as little-endian
    32-bit numbers)``, n_bytes, decoded_sha256, exact`` (the decoded text is
    the text). Null and empty texts have no pieces and decode to nothing.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules, cache = _worker(shared.value, _Encoded)
        decoder = Decoder(rules)
        for batch in batches:
            rows = []
            for text in strings(batch.column(1)):
                ids = encode_text(text, cache, rules.chunks)
                if len(cache) > CACHE:
                    cache.clear()
                back = decoder.text(ids)
                raw = back.encode()
                rows.append((len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), len(raw), hashlib.sha256(raw).hexdigest(), back == text))
            n, digest, size, decoded, exact = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.string()), pa.array(size, pa.int64()), pa.array(decoded, pa.string()), pa.array(exact, pa.bool_())], names=["doc_id", "n_pieces", "ids_sha256", "n_bytes", "decoded_sha256", "exact"])

    return id_text(docs, id_col, text_col).mapInArrow(frugal(run, "pieces"), "doc_id long, n_pieces long, ids_sha256 string, n_bytes long, decoded_sha256 string, exact boolean")
