"""Terms counted in tasks, a text at a time: totals of a corpus, and the TF-IDF of each text with a query.

A text comes as its words, a list or with a space between them. Its terms are counted where it is; only sums of a task's texts, or two numbers of each
text, leave. ``Words`` are words and their pairs, ``Runs`` the character runs inside words, ``Given`` any list as it is.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Terms, and words with their terms, that a task holds at a time.
HELD, CACHED = 200_000, 50_000


def split(words: str | list[str] | None) -> list[str]:
    return [w for w in words.split(" ") if w] if isinstance(words, str) else words or []


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The rows of batches a few at a time, as words in Python take several times the room of their text."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


class Given:
    """Terms as they come."""

    def terms(self, words: list[str]) -> list[str]:
        return words

    def once(self, words: list[str]) -> set[str]:
        return set(self.terms(words))

    def counted(self, words: list[str]) -> list[str]:
        """What is summed up over texts before ``spread`` makes terms of it."""
        return self.terms(words)

    def spread(self, sums: Counter) -> Counter:
        return sums

    def places(self, words: list[str], known: dict[str, int]) -> tuple[np.ndarray, np.ndarray | None]:
        """The numbers of the known terms in a text, and how often each counts (None: once)."""
        return np.array([k for t in self.terms(words) if (k := known.get(t)) is not None], np.int64), None


class Words(Given):
    def terms(self, words: list[str]) -> list[str]:
        return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


class Runs(Given):
    def __init__(self, low: int = 2, high: int = 4):
        self.low, self.high = low, high
        self.sets: dict[str, frozenset] = {}
        self.numbers: dict[str, np.ndarray] = {}

    def runs(self, word: str) -> list[str]:
        w = f" {word} "
        return [w[i : i + n] for n in range(self.low, self.high + 1) for i in range(len(w) - n + 1)]

    def once(self, words: list[str]) -> set[str]:
        if len(self.sets) > CACHED:
            self.sets.clear()
        found = []
        for w in set(words):
            if (s := self.sets.get(w)) is None:
                s = self.sets[w] = frozenset(self.runs(w))
            found.append(s)
        return set().union(*found)

    def counted(self, words: list[str]) -> list[str]:
        return words

    def spread(self, sums: Counter) -> Counter:
        out: Counter = Counter()
        for w, n in sums.items():
            for g in self.runs(w):
                out[g] += n
        return out

    def places(self, words: list[str], known: dict[str, int]) -> tuple[np.ndarray, np.ndarray | None]:
        if len(self.numbers) > CACHED:
            self.numbers.clear()
        found, times = [], []
        for w, n in Counter(words).items():
            if (s := self.numbers.get(w)) is None:
                s = self.numbers[w] = np.array([k for g in self.runs(w) if (k := known.get(g)) is not None], np.int64)
            found.append(s), times.append(n)
        if not found:
            return np.zeros(0, np.int64), None
        return np.concatenate(found), np.repeat(np.array(times, float), [len(s) for s in found])


def totals(batches: Iterator[pa.RecordBatch], kind: Given) -> Iterator[pa.RecordBatch]:
    """``(term, total, df)`` of texts ``(words)``, a term once for each time that a task hands on what it holds."""
    sums, df = Counter(), Counter()

    def held() -> Iterator[pa.RecordBatch]:
        total = kind.spread(sums)
        names = list(total)
        for at in range(0, len(names), 50_000):
            part = names[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([float(total[t]) for t in part]), pa.array([df[t] for t in part], pa.int64())], names=["term", "total", "df"])
        sums.clear(), df.clear()

    for batch in slices(batches):
        for words in map(split, batch.column(0).to_pylist()):
            if words:
                sums.update(kind.counted(words))
                df.update(kind.once(words))
                if len(df) > HELD or len(sums) > HELD:
                    yield from held()
    yield from held()


def scores(batches: Iterator[pa.RecordBatch], kind: Given, known: dict[str, int], idf: np.ndarray, asked: np.ndarray) -> Iterator[pa.RecordBatch]:
    """``(id, score)`` of texts ``(id, words)`` that share a known term with the query, whose vector ``asked`` is."""
    qn = float(np.sqrt(asked @ asked))
    for batch in slices(batches):
        at, found = [], []
        for row, words in enumerate(map(split, batch.column(1).to_pylist())):
            places, times = kind.places(words, known)
            w = np.bincount(places, times, minlength=len(idf)) * idf
            if (dot := float(w @ asked)) > 0:
                at.append(row), found.append(dot / (float(np.sqrt(w @ w)) * qn))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(found, pa.float64())], names=["id", "score"])
