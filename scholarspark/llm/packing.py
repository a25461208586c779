"""Best-two-fit packing of tokenized documents into sequences.

Only the number of documents of each length matters to the packing, and there are at most ``capacity`` lengths. So the
rows are counted by length, the heuristic runs on the counts (a bin that it builds repeats as often as the counts allow,
which gives the same bins as one at a time), and the rows are then dealt to the places of the bins by their rank within
their length. The driver sees ``capacity`` counts and a few thousand kinds of bins at any corpus size.
"""

from __future__ import annotations

import bisect
import json
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, materialize
from .wordcache import WordCache

CAPACITY = 2048
#: Id that ends every document.
END = 0
#: Words in a generation of a worker's memo.
CACHED_WORDS = 400_000


class Ids:
    """Ids of whole texts as packed unsigned 32-bit integers.

    The tokenizer drops white space and nothing it does reaches across it, so each run of other characters is encoded
    once and remembered; texts are parted at ASCII white space. It lower-cases all but its special tokens, so texts
    without a ``<|`` are looked up in lower case. A run of Latin letters is one word to the tokenizer, whose merges
    then apply to its byte symbols directly, and ASCII marks after its last letter are a word of their own. A tokenizer
    that does not work so is refused; ``cached_words`` bounds a generation of the memo (about 200 bytes a word).
    """

    #: ASCII marks that are neither letter, digit nor apostrophe.
    MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and c != 39)
    #: The steps before the merges on which the shortcuts above rest.
    NORMALIZERS = ["NFC", "Replace", "Lowercase"]
    SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, raw: str, cached_words: int = CACHED_WORDS):
        from tokenizers import Tokenizer

        steps = json.loads(raw)
        cuts = (steps.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        normal = [n.get("type") for n in (steps.get("normalizer") or {}).get("normalizers") or []]
        if normal != self.NORMALIZERS or cuts[0].get("pattern") != {"Regex": self.SPLIT} or cuts[-1].get("type") != "ByteLevel" or cuts[-1].get("add_prefix_space"):
            raise ValueError("the tokenizer must lower-case, drop white space and part words from marks")
        self.tokenizer = Tokenizer.from_str(raw)
        self.merges = self.tokenizer.model.tokenize
        self.words = WordCache(self.encode_word, cached_words)
        self.tails = WordCache(self.encode_whole, 10_000)
        # the byte-level alphabet: printable Latin-1 stands for itself, the other bytes for characters from 256 on
        plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
        others = iter(range(256, 512))
        self.alphabet = {b: b if b in plain else next(others) for b in range(256)}

    def encode_whole(self, word: bytes) -> bytes:
        return array("I", self.tokenizer.encode(word.decode(), add_special_tokens=False).ids).tobytes()

    def encode_word(self, word: bytes) -> bytes:
        stem = word.rstrip(self.MARKS)
        if len(stem) < len(word):
            letters = stem.decode()
            if letters.isalpha() and max(letters) < "\u0250" and letters.lower().isalpha():
                return self.words[stem] + self.tails[word[len(stem) :]]
            return self.encode_whole(word)
        text = word.decode()
        if not text.isalpha() or max(text) >= "\u0250":
            return self.encode_whole(word)
        lower = text.lower()
        if not lower.isalpha():  # a capital whose small form has a combining mark
            return self.encode_whole(word)
        symbols = lower if lower.isascii() else lower.encode().decode("latin-1").translate(self.alphabet)
        return array("I", [t.id for t in self.merges(symbols)]).tobytes()

    def packed(self, text: str) -> bytes:
        raw = text.encode()
        if b"<|" not in raw:
            raw = raw.lower()
        return b"".join(map(self.words.__getitem__, raw.split()))


_IDS: dict[tuple[int, int], Ids] = {}


def ids_of(raw: str, cached_words: int = CACHED_WORDS) -> Ids:
    key = hash(raw), cached_words
    if key not in _IDS:
        _IDS[key] = Ids(raw, cached_words)
    return _IDS[key]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", cached_words: int = CACHED_WORDS) -> DataFrame:
    """``(id, piece, start, length, ids)``: each document's ids and the end id, cut only where longer than a sequence."""
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batch: pa.RecordBatch) -> dict:
        words = ids_of(shared.value, cached_words)
        out: dict[str, list] = {k: [] for k in ("id", "piece", "start", "length", "ids")}
        end = np.array([END], "<u4").tobytes()
        size = 4 * capacity
        ids, piece, start, length, parts = out.values()
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            packed = words.packed(t.as_py() or "") + end
            for at in range(0, len(packed), size):
                part = packed[at : at + size]
                ids.append(i), piece.append(at // size), start.append(at // 4), length.append(len(part) // 4), parts.append(part)
        return out

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), run, "id long, piece int, start long, length long, ids binary")


def best_two_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """Bins for ``counts[length]`` items of each length: ``(how often, lengths in the bin)``.

    A bin takes the longest item that fits until none does. If a gap remains, its shortest item gives way to the two
    unpacked items that together fit into the gap and its place, and fill more of them than it did, most tightly.
    """
    counts = {k: v for k, v in counts.items() if v > 0}
    if counts and (min(counts) < 1 or max(counts) > capacity):
        raise ValueError("lengths must be from 1 to the capacity")
    lengths = sorted(counts)
    bins: list[tuple[int, list[int]]] = []
    while lengths:
        taken: dict[int, int] = {}
        room, items = capacity, []
        at = len(lengths)
        while (at := min(at, bisect.bisect_right(lengths, room))) > 0:
            x = lengths[at - 1]
            n = min(counts[x], room // x)
            taken[x] = n
            items += [x] * n
            room -= n * x
            at -= 1
        times = min(counts[x] // n for x, n in taken.items())
        if room and items:
            least = items[-1]
            free = room + least
            left = lambda x: counts[x] - taken.get(x, 0)
            i, j, best = 0, bisect.bisect_right(lengths, free - 1) - 1, (least, 0, 0)
            while i <= j:
                x, y = lengths[i], lengths[j]
                if not left(x):
                    i += 1
                elif not left(y) or x + y > free or (i == j and left(x) < 2):
                    j -= 1
                else:
                    best = max(best, (x + y, y, x))
                    i += 1
            if best[1]:
                # the same bin comes again while what it takes, and the item that gave way, is there in full
                used = dict(taken)
                used[least] -= 1
                for x in best[1:]:
                    used[x] = used.get(x, 0) + 1
                items = [*items[:-1], *best[1:]]
                need = {x: max(n, taken.get(x, 0)) for x, n in used.items()}
                times = min((counts[x] - need[x]) // used[x] + 1 for x in used if used[x])
                taken = {x: n for x, n in used.items() if n}
        bins.append((times, items))
        for x, n in taken.items():
            counts[x] -= n * times
            if not counts[x]:
                del counts[x]
                lengths.pop(bisect.bisect_left(lengths, x))
    return bins


def places(bins: list[tuple[int, list[int]]]) -> dict[int, np.ndarray]:
    """For each length, rows ``(first rank, first sequence, offset)``: rank r of that length goes, from the last row with
    first rank at most r, to sequence ``first sequence + r - first rank`` at ``offset``."""
    rows: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    base = 0
    for times, items in bins:
        offset = 0
        for x in items:
            rows.setdefault(x, []).append((used.get(x, 0), base, offset))
            used[x] = used.get(x, 0) + times
            offset += x
        base += times
    return {x: np.array(r, np.int64) for x, r in rows.items()}


def pack(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, cached_words: int = CACHED_WORDS) -> DataFrame:
    """One row per piece: ``(id, piece, start, length, ids_crc32, sequence_id, offset)``, and ``ids`` on request.

    A null or blank text is the end id alone. Texts longer than a sequence are cut into full pieces and a rest, others
    are never cut. Repeated rows and ids are packed as often as they come; a null id is kept. No rows give no rows. Other
    columns are neither read nor returned. Within a length, ranks follow a hash of the piece's contents: they are
    computed over many slices of each length, so that one frequent length, or group of copies, is spread too.
    ``cached_words`` bounds the memory of a worker's memo and changes no result.
    """
    spark = docs.sparkSession
    cut = pieces(docs, tokenizer_path or default_tokenizer(), capacity, id_col, text_col, cached_words)
    crc = F.crc32("ids").alias("ids_crc32")
    thin = materialize(cut.select("id", "piece", "start", "length", crc, *(["ids"] if with_ids else [])), "pack-pieces")
    counts = {r["length"]: r["n"] for r in thin.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    slices = max(256, 1 << (sum(counts.values()) // 100_000).bit_length())
    key = F.xxhash64("id", "piece", "start", "length", "ids_crc32")
    sliced = thin.withColumn("slice", F.pmod(key, F.lit(slices)))
    sizes = sliced.groupBy("length", "slice").agg(F.count("*").alias("n"))
    firsts = sizes.select("length", "slice", (F.sum("n").over(Window.partitionBy("length").orderBy("slice")) - F.col("n")).alias("first"))
    within = F.row_number().over(Window.partitionBy("length", "slice").orderBy("id", "piece", "start", "ids_crc32")) - 1
    ranked = sliced.withColumn("within", within).join(firsts, ["length", "slice"]).withColumn("rank", F.col("first") + F.col("within")).drop("slice", "within", "first")
    table = spark.sparkContext.broadcast(places(best_two_fit(counts, capacity)))
    out_schema = "id long, piece int, start long, length long, ids_crc32 long, " + "ids binary, " * with_ids + "sequence_id long, offset long"
    columns = [c.split()[0] for c in out_schema.split(", ")]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ranks = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            seq, off = np.empty_like(ranks), np.empty_like(ranks)
            order = np.argsort(lengths, kind="stable")
            cuts = np.flatnonzero(np.diff(lengths[order])) + 1
            for rows in np.split(order, cuts) if len(order) else []:
                spots = table.value[int(lengths[rows[0]])]
                at = np.searchsorted(spots[:, 0], ranks[rows], side="right") - 1
                seq[rows] = spots[at, 1] + ranks[rows] - spots[at, 0]
                off[rows] = spots[at, 2]
            arrays = [pa.array(seq) if c == "sequence_id" else pa.array(off) if c == "offset" else batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays(arrays, names=columns)

    out = ranked.mapInArrow(deal, out_schema)
    return out.withColumnRenamed("id", id_col)


def packing_digest(packed: DataFrame) -> DataFrame:
    """The rows of ``pack`` without their ids, whatever they are: nulls, repeated rows and no rows stay as they come."""
    return packed.drop("ids")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def check_bins(counts: dict[int, int], bins: list[tuple[int, list[int]]], capacity: int = CAPACITY) -> None:
    """Raise unless the bins hold exactly the counted items and none is too full."""
    held: dict[int, int] = {}
    for times, items in bins:
        if times < 1 or sum(items) > capacity:
            raise ValueError((times, items))
        for x in items:
            held[x] = held.get(x, 0) + times
    if held != {k: v for k, v in counts.items() if v > 0}:
        raise ValueError("items lost or invented")


def crc32_of(ids: list[int]) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())
