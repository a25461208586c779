r"""Fill-in-the-middle examples: a text's tokens are counted in overlapping chunks, and only two chunks are read again.

A token starts wherever a character that is no space is followed by one that is, so whether there is a boundary is told by
two adjacent characters. A text is laid out in chunks of ``CHUNK`` characters and the first one of the next, and each
chunk counts its own boundaries without looking at another. The running sum of the counts says which chunk holds
the boundary of a given rank; only the owning chunks of the two cuts are read again, for the places in them.

All of it is column expressions within a row: no text moves, a lost task costs only itself, and a row needs memory for a
few copies of its own text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name

#: Characters of a chunk, besides the one that it shares with the next.
CHUNK = 4096
# The marks of an output's parts, and the spaces that part tokens.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SPACES = r"\x20\x09-\x0D"


def overlapping_chunks(text: Column, size: int = CHUNK) -> Column:
    """A text's chunks, each but the last with the first character of the next; none of an empty text."""
    return F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{1,{size + 1}}})).{{1,{size}}}"), F.lit(1))


def boundaries(chunk: Column) -> Column:
    """How many tokens start at a character of the chunk that is not its first."""
    return F.regexp_count(chunk, F.lit(rf"[^{SPACES}][{SPACES}]"))


def owning_chunk(counts: Column, rank: Column) -> Column:
    """``(chunk, rank)``: the chunk, from 0, that holds the boundary of a rank (from 1) of all, and its rank in there."""
    start = F.struct(F.lit(0).alias("at"), F.lit(0).cast("long").alias("before"), F.lit(-1).alias("chunk"), F.lit(0).cast("long").alias("rank"))

    def step(s: Column, count: Column) -> Column:
        here = (s["chunk"] < 0) & (rank <= s["before"] + count)
        return F.struct((s["at"] + 1).alias("at"), (s["before"] + count).alias("before"), F.when(here, s["at"]).otherwise(s["chunk"]).alias("chunk"), F.when(here, rank - s["before"]).otherwise(s["rank"]).alias("rank"))

    return F.aggregate(counts, start, step, lambda s: F.struct(s["chunk"], s["rank"]))


def place_in_chunk(chunk: Column, rank: Column) -> Column:
    """How many characters of a chunk stand before its boundary of a rank."""
    pieces = F.split(chunk, rf"(?<=[^{SPACES}])(?=[{SPACES}])", -1)
    return F.aggregate(F.slice(pieces, F.lit(1), rank.cast("int")), F.lit(0).cast("long"), lambda sum_, piece: sum_ + F.length(piece))


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: int = 50, spm_rate: int = 80, seed: int = 42, chunk: int = CHUNK) -> DataFrame:
    """``docs`` with ``(n, form, prefix_chars, middle_chars, output)``, every row in place.

    ``n`` counts tokens: a run of other characters with the spaces before it, or spaces at the end. Four numbers come
    from the hash of the seed and the id: two cut the tokens in three parts, one decides whether (``rate`` per cent), one
    how (``spm_rate`` per cent of those) the parts change places. Form is ``psm`` (prefix, suffix, middle), ``spm``
    (suffix, prefix, middle) or ``plain``: the text as it is, as for empty texts and texts that hold a mark. Null
    texts are empty, a null id is hashed as no digits; repeated rows come out alike, no rows give no rows, and columns of
    the names above are replaced.
    """
    size = F.lit(chunk)
    text, chunks, counts, n, h, plain, cuts = (free_name(docs, f"__{x}") for x in ("text", "chunks", "counts", "n", "h", "plain", "cuts"))
    word = lambda k: F.conv(F.substring(h, 8 * k + 1, 8), 16, 10).cast("long")
    rows = docs.withColumn(text, F.coalesce(F.col(text_col), F.lit(""))).withColumn(chunks, overlapping_chunks(F.col(text), chunk))
    rows = rows.withColumn(counts, F.transform(chunks, boundaries))
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda s, c: s + c)
    rows = rows.withColumns({n: F.when(F.col(text) == "", F.lit(0).cast("long")).otherwise(total + 1), h: F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)})
    marked = F.col(text).contains(PREFIX) | F.col(text).contains(SUFFIX) | F.col(text).contains(MIDDLE)
    rows = rows.withColumn(plain, (F.col(text) == "") | marked | (word(2) % 100 >= rate))
    first, second = word(0) % (F.col(n) + 1), word(1) % (F.col(n) + 1)

    def place(rank: Column) -> Column:
        """Characters before the boundary of a rank: none before the first token, all after the last."""
        own = owning_chunk(F.col(counts), rank)
        return F.when(rank == 0, F.lit(0).cast("long")).when(rank == F.col(n), F.length(text).cast("long")).otherwise(own["chunk"] * size + place_in_chunk(F.get(F.col(chunks), own["chunk"]), own["rank"]))

    rows = rows.withColumn(cuts, F.when(~F.col(plain), F.struct(place(F.least(first, second)).alias("a"), place(F.greatest(first, second)).alias("b"))))
    a, b = F.col(cuts)["a"].cast("int"), F.col(cuts)["b"].cast("int")
    prefix, middle, suffix = F.substring(text, F.lit(1), a), F.substring(text, a + 1, b - a), F.substring(text, b + 1, F.length(text))
    spm = word(3) % 100 < spm_rate
    shown = F.when(F.col(plain), F.col(text)).when(spm, F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)).otherwise(F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
    out = rows.withColumns({"n": F.col(n), "form": F.when(F.col(plain), "plain").when(spm, "spm").otherwise("psm"), "prefix_chars": F.col(cuts)["a"], "middle_chars": F.col(cuts)["b"] - F.col(cuts)["a"], "output": shown})
    return out.drop(text, chunks, counts, n, h, plain, cuts)


def restore(output: Column, form: Column) -> Column:
    """The text behind an output, from the output and its form alone."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    return F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output)
