"""Merge-type SentencePiece encoding by backtracking, and decoding.

The library merges, over the whole text, the best-scored adjacent pair until no pair makes a piece. Its result is the
one sequence of pieces in which every two neighbours, merged anew from their characters, come out as themselves. The
encoder searches for that sequence left to right: at each place the longest Aho-Corasick match first, then shorter ones,
a piece being taken only when it is compatible with the piece before it; places from which no continuation works are
marked in a field of flags and never entered again, so the search is linear in the text.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow
from .wordcache import WordCache

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protobuf message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (raw[at] & 127) << shift
            at, shift, more = at + 1, shift + 7, raw[at] & 128
            if not more:
                return value, at

    at = 0
    while at < len(raw):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        else:
            size, at = varint(at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = raw[at : at + size], at + size
        yield key >> 3, value


#: Words in a generation of a worker's memo, about 300 bytes each; two generations are held at most.
CACHED_WORDS = 500_000


class PieceModel:
    """Pieces, scores and normalizer flags of a serialized SentencePiece model of merge type."""

    def __init__(self, raw: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        trainer: dict = {}
        normalizer: dict = {}
        for field, value in _fields(raw):
            if field == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece[1].decode())
                self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.kinds.append(piece.get(3, NORMAL))
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                normalizer = dict(_fields(value))
        if trainer.get(3, 1) != 2 or not trainer.get(35, 0):
            raise ValueError("only merge-type (BPE) models with byte fallback are supported")
        if normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(3, 1) or not normalizer.get(5, 1) or USER_DEFINED in self.kinds:
            raise ValueError("only identity normalization with a dummy prefix and escaped spaces is supported")
        self.bos, self.eos = trainer.get(41, 1), trainer.get(42, 2)


class PieceCodec:
    """Exact ``encode`` and ``decode`` of one model."""

    BLOCK = 4096

    def __init__(self, raw: bytes, cached_words: int = CACHED_WORDS):
        m = self.model = PieceModel(raw)
        usable = [i for i, k in enumerate(m.kinds) if k in (NORMAL, UNUSED)]
        self.score = {m.pieces[i]: m.scores[i] for i in usable}
        self.ids = {m.pieces[i]: i for i in usable}
        self.byte_ids = [0] * 256
        self.raw_bytes: list[bytes] = []
        for i, (piece, kind) in enumerate(zip(m.pieces, m.kinds, strict=True)):
            if kind == BYTE:
                self.byte_ids[int(piece[3:5], 16)] = i
                self.raw_bytes.append(bytes([int(piece[3:5], 16)]))
            else:
                self.raw_bytes.append(b"" if kind == CONTROL else b" \xe2\x81\x87 " if kind == UNKNOWN else piece.replace(SPACE, " ").encode())
        self.controls = frozenset(i for i, k in enumerate(m.kinds) if k == CONTROL)
        self.longest = max(map(len, self.score), default=1)
        self.automaton = ahocorasick.Automaton()
        for piece in self.score:
            if len(piece) > 1:
                self.automaton.add_word(piece, (len(piece) - 1, piece))
        self.automaton.make_automaton()
        #: Where no piece has a space after another character, text falls apart before each run of spaces.
        self.splits = not any(SPACE in p.lstrip(SPACE) for p in self.score)
        self.chunks = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+", re.S)
        self.joins: dict[tuple[str, str], bool] = {}
        #: Characters that stand side by side in some piece: no merge ever reaches across other neighbours.
        self.neighbours = {p[i : i + 2] for p in self.score for i in range(len(p) - 1)}
        self.packed = WordCache(self._pack_word, cached_words)
        self.inner = WordCache(self._pack, cached_words // 10)

    def merge(self, text: str) -> list[str]:
        """The library's procedure, step by step, on a short text: best score first, leftmost on ties."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best = max(((score[p], -i) for i in range(len(parts) - 1) if (p := parts[i] + parts[i + 1]) in score), default=None)
            if best is None:
                break
            at = -best[1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: str, right: str) -> bool:
        """Whether the two, merged anew side by side, come out as themselves; with no left one, whether right does."""
        known = self.joins.get((left, right))
        if known is None:
            known = self.merge(left + right) == ([left, right] if left else [right])
            if len(self.joins) >= 500_000:
                self.joins.clear()
            self.joins[left, right] = known
        return known

    def _matches(self, text: str, block: int) -> list[list[str]]:
        """For each place of a block, the pieces there, shortest first; a lone character is always one."""
        low = block * self.BLOCK
        high = min(len(text), low + self.BLOCK)
        found: list[list[str]] = [[c] for c in text[low:high]]
        for end, (size, piece) in self.automaton.iter(text, low, min(len(text), high + self.longest)):
            start = end - size
            if start < high:
                found[start - low].append(piece)
        return found

    def pieces(self, text: str) -> list[str]:
        """The pieces of a normalized text; characters without a piece stand for themselves."""
        n, size = len(text), self.BLOCK
        if n <= self.longest and text in self.score and self.compatible("", text):
            return [text]
        blocks: dict[int, list[list[str]]] = {}

        def at(i: int) -> list[str]:
            if (k := i // size) not in blocks:
                if len(blocks) > 3:
                    blocks.pop(next(iter(blocks)))
                blocks[k] = self._matches(text, k)
            return blocks[k][i % size]

        if n <= size:
            at = self._matches(text, 0).__getitem__
        failed = bytearray(n + 1)
        out: list[str] = []
        tries: list[int] = []  # how many of the pieces at its place each chosen piece left untried
        pos, options = 0, at(0) if n else []
        left = len(options)
        compatible, joins = self.compatible, self.joins
        while pos < n:
            last = out[-1] if out else ""
            while left:
                left -= 1
                piece = options[left]
                join = joins.get((last, piece))
                if join is None:
                    join = compatible(last, piece)
                if join and not failed[pos + len(piece)]:
                    out.append(piece)
                    tries.append(left)
                    pos += len(piece)
                    if pos < n:
                        options = at(pos)
                        left = len(options)
                    break
            else:
                failed[pos] = 1
                pos -= len(out.pop())
                options, left = at(pos), tries.pop()
        return out

    def _pack_word(self, word: str) -> bytes:
        """Packed ids of a chunk, given without its space where it has just one; in parts that no merge connects."""
        chunk = word if word[:1] == SPACE else SPACE + word
        known = self.neighbours
        cuts = [i for i in range(1, len(chunk)) if chunk[i - 1 : i + 1] not in known]
        if not cuts:
            return self._pack(chunk)
        head = chunk[: cuts[0]]
        first = self.packed[head[1:]] if head[1:2] != SPACE else self.inner[head]
        return first + b"".join(self.inner[chunk[i:j]] for i, j in zip(cuts, [*cuts[1:], len(chunk)], strict=True))

    def _pack(self, chunk: str) -> bytes:
        out = []
        for piece in self.pieces(chunk):
            if (i := self.ids.get(piece)) is not None:
                out.append(i)
            else:
                out.extend(self.byte_ids[b] for b in piece.encode())
        return struct.pack(f"<{len(out)}I", *out)

    def encode_packed(self, text: str) -> bytes:
        """Ids with begin and end, as little-endian unsigned 32-bit integers."""
        body = b""
        if text:
            if not self.splits:
                body = self._pack(SPACE + text.replace(" ", SPACE))
            elif SPACE not in text and "" not in (words := text.split(" ")):
                body = b"".join(map(self.packed.__getitem__, words))
            else:
                chunks = self.chunks.findall(SPACE + text.replace(" ", SPACE))
                body = b"".join(self.packed[c[1:] if c[1:2] not in (SPACE, "") else c] for c in chunks)
        return struct.pack("<I", self.model.bos) + body + struct.pack("<I", self.model.eos)

    def encode(self, text: str) -> list[int]:
        packed = self.encode_packed(text)
        return list(struct.unpack(f"<{len(packed) // 4}I", packed))

    def decode(self, ids: list[int]) -> str:
        """The text of ids: control ids vanish, byte pieces join to characters, one leading space goes."""
        runs: list[list[int]] = [ids]
        if not self.controls.isdisjoint(ids):
            runs = [[]]
            for i in ids:
                if i in self.controls:
                    runs.append([])
                else:
                    runs[-1].append(i)
        out, first = [], True
        for run in filter(None, runs):
            raw = b"".join(map(self.raw_bytes.__getitem__, run))
            if first and self.model.pieces[run[0]].startswith(SPACE):
                raw = raw[1:]
            first = False
            try:
                out.append(raw.decode())
            except UnicodeDecodeError:  # each stray byte of a byte piece is one replacement character
                out.append(re.sub("[\udc80-\udcff]", "\ufffd", raw.decode(errors="surrogateescape")))
        return "".join(out)


_CODECS: dict[int, PieceCodec] = {}


def codec_of(raw: bytes) -> PieceCodec:
    """One codec for each model and worker process, so that its memo lasts across tasks."""
    key = hash(raw)
    if key not in _CODECS:
        _CODECS[key] = PieceCodec(raw)
    return _CODECS[key]


def encode_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(<id_col>, packed, decoded)`` of every row: packed ids with begin and end, and their decoding.

    Whole texts; a null text counts as empty (begin and end ids, decoded ''). Repeated rows and ids, null ids and
    the order of rows do not matter: each row is encoded alone. No rows give no rows. The model file (half a megabyte)
    is read by the driver and broadcast. Other columns are neither read nor returned.
    """
    with open(model_path, "rb") as f:
        raw = f.read()
    shared = docs.sparkSession.sparkContext.broadcast(raw)

    def run(batch: pa.RecordBatch) -> dict:
        codec = codec_of(shared.value)
        packed = [codec.encode_packed(t.as_py() or "") for t in batch.column(1)]
        return {"id": batch.column(0), "packed": packed, "decoded": [codec.decode(memoryview(p).cast("I").tolist()) for p in packed]}

    out = map_arrow(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), run, "id long, packed binary, decoded string")
    return out.withColumnRenamed("id", id_col)


def encoding_digest(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``encode_decode`` as counts and digests, taken where the ids are made so that they never leave the worker."""
    with open(model_path, "rb") as f:
        raw = f.read()
    shared = docs.sparkSession.sparkContext.broadcast(raw)

    def run(batch: pa.RecordBatch) -> dict:
        codec = codec_of(shared.value)
        counts, ids_digests, text_digests = [], [], []
        for t in batch.column(1):
            packed = codec.encode_packed(t.as_py() or "")
            counts.append(len(packed) // 4)
            ids_digests.append(hashlib.sha256(packed).hexdigest())
            text_digests.append(hashlib.sha256(codec.decode(memoryview(packed).cast("I").tolist()).encode()).hexdigest())
        return {"id": batch.column(0), "n_tokens": counts, "ids_sha256": ids_digests, "decoded_sha256": text_digests}

    out = map_arrow(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", id_col)
