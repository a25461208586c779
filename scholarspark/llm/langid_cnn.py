"""Language identification by a byte convolutional network trained here in numpy.

Bytes are embedded, filters of several widths slide over fixed-length windows, each filter's largest response in a window
is kept, and a softmax layer names the language. A text is cut into windows that overlap by the widest filter less one
byte, so every position of the whole text is seen; its score for a language is the mean over its windows, weighted by the
bytes each holds.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, ship_package, slices

UNKNOWN = "und"
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBEDDING = 8
WINDOW = 256
#: Bound of the training sample: most texts of one language, and most bytes of one of them (a stretch from its middle).
MAX_TEXTS_PER_LANG = 400
MAX_BYTES_PER_TEXT = 4096
#: Most languages that are learned, the commonest.
MAX_LANGS = 500
LETTER = regex.compile(r"\p{L}")


class ByteNetwork:
    """Embedding, convolution, max pooling and softmax; ``langs`` are the learned values in order."""

    def __init__(self, langs: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        wide = max(WIDTHS)
        self.langs = langs
        self.embedding = rng.normal(0, 0.5, (256, EMBEDDING)).astype("f4")
        #: Filters of all widths in one matrix; the shorter ones are zero beyond their width.
        self.mask = np.concatenate([np.repeat((np.arange(wide) < w).astype("f4"), EMBEDDING)[:, None].repeat(FILTERS, 1) for w in WIDTHS], axis=1)
        self.filters = (rng.normal(0, 1 / math.sqrt(EMBEDDING * wide), self.mask.shape) * self.mask).astype("f4")
        self.filter_bias = np.zeros(len(WIDTHS) * FILTERS, "f4")
        self.out = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(langs))).astype("f4")
        self.out_bias = np.zeros(len(langs), "f4")
        self.step = WINDOW - wide + 1

    def patches(self, windows: np.ndarray) -> np.ndarray:
        """For each position of each window the embedded bytes under the widest filter."""
        e = self.embedding[windows].reshape(len(windows), -1)
        wide, n = max(WIDTHS), windows.shape[1]
        view = np.lib.stride_tricks.as_strided(e, (len(windows), n - wide + 1, wide * EMBEDDING), (e.strides[0], e.strides[1] * EMBEDDING, e.strides[1]))
        return view

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = self.patches(windows)
        h = (p.reshape(-1, p.shape[2]) @ self.filters).reshape(len(windows), p.shape[1], -1)
        return h, p

    def predict(self, windows: np.ndarray) -> np.ndarray:
        """Probabilities of the languages for each window."""
        h, _ = self.pooled(windows)
        z = np.maximum(h.max(axis=1) + self.filter_bias, 0) @ self.out + self.out_bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def gradients(self, x: np.ndarray, target: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross entropy of windows with one-hot targets, and its gradient by each parameter."""
        wide, rows = max(WIDTHS), np.arange(len(x))
        h, p = self.pooled(x)
        peak = h.argmax(axis=1)
        top = np.take_along_axis(h, peak[:, None, :], 1)[:, 0] + self.filter_bias
        a = np.maximum(top, 0)
        z = a @ self.out + self.out_bias
        z = z - z.max(axis=1, keepdims=True)
        loss = float((np.log(np.exp(z).sum(axis=1)) - (z * target).sum(axis=1)).mean())
        z = np.exp(z)
        dz = (z / z.sum(axis=1, keepdims=True) - target) / len(x)
        da = (dz @ self.out.T) * (top > 0)
        under = p[rows[:, None], peak]  # (rows, filters, bytes under the filter)
        d_filters = np.einsum("rfk,rf->kf", under, da) * self.mask
        d_under = (da[:, :, None] * self.filters.T).reshape(len(x), -1, wide, EMBEDDING)
        at_bytes = x[rows[:, None, None], peak[:, :, None] + np.arange(wide)]
        d_embedding = np.zeros_like(self.embedding)
        np.add.at(d_embedding, at_bytes.ravel(), d_under.reshape(-1, EMBEDDING))
        return loss, [d_embedding, d_filters, da.sum(0), a.T @ dz, dz.sum(0)]

    def fit(self, windows: np.ndarray, y: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 4e-3, seed: int = 11) -> ByteNetwork:
        rng = np.random.default_rng(seed)
        params = [self.embedding, self.filters, self.filter_bias, self.out, self.out_bias]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        step, steps = 0, epochs * math.ceil(len(y) / batch)
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for at in range(0, len(y), batch):
                rows = order[at : at + batch]
                step += 1
                now = rate * (1 - step / (steps + 1))
                for k, g in enumerate(self.gradients(windows[rows], np.eye(len(self.langs), dtype="f4")[y[rows]])[1]):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    params[k] -= (now / (1 - 0.9**step) * m[k] / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype("f4")
        return self

    def windows(self, raw: bytes) -> np.ndarray:
        """All windows of a text, the last one filled up with zero bytes."""
        n = max(1, math.ceil((len(raw) - (WINDOW - self.step)) / self.step))
        padded = np.zeros((n - 1) * self.step + WINDOW, np.uint8)
        padded[: len(raw)] = np.frombuffer(raw, np.uint8)
        return np.lib.stride_tricks.as_strided(padded, (n, WINDOW), (self.step, 1))

    def classify(self, texts: list[str | None], batch: int = 256) -> tuple[list[str], list[float]]:
        """Language and score of whole texts, windows of several texts in one batch; bounded memory for any length."""
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        known = [k for k, t in enumerate(texts) if t and self.langs and LETTER.search(t)]
        totals = np.zeros((len(texts), len(self.langs)))
        held: list[np.ndarray] = []
        owner: list[np.ndarray] = []
        weight: list[np.ndarray] = []

        def flush() -> None:
            if held:
                p = self.predict(np.concatenate(held)) * np.concatenate(weight)[:, None]
                np.add.at(totals, np.concatenate(owner), p)
                held.clear(), owner.clear(), weight.clear()

        waiting = 0
        for k in known:
            raw = texts[k].encode()
            w = self.windows(raw)
            sizes = np.minimum(WINDOW, len(raw) - np.arange(len(w)) * self.step).astype("f4")
            for at in range(0, len(w), batch):
                part = w[at : at + batch]
                held.append(part), owner.append(np.full(len(part), k)), weight.append(sizes[at : at + batch])
                waiting += len(part)
                if waiting >= batch:
                    flush()
                    waiting = 0
        flush()
        for k in known:
            best = int(totals[k].argmax())
            names[k], scores[k] = self.langs[best], min(1.0, float(totals[k][best] / totals[k].sum()))
        return names, scores


def is_held_out(id_col: str = "doc_id", folds: int = 5) -> Column:
    """Rows never learned from: CRC-32 of the id as text is divisible by ``folds``; a null id counts as held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(True))


def train_network(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = MAX_TEXTS_PER_LANG, most_bytes: int = MAX_BYTES_PER_TEXT, most_langs: int = MAX_LANGS) -> ByteNetwork:
    """A network fitted on about ``per_lang`` texts of each language outside the held-out rows.

    The texts are those whose ids hash lowest, so they spread over all sources; of a long one a stretch of
    ``most_bytes`` characters from the middle is learned. Rows without a language or a letter teach nothing. Of more than
    ``most_langs`` languages the commonest are learned: it bounds the counts and texts that the driver gathers.
    Rows that repeat an id have one rank; at most twice the expected texts are taken, in order of rank and text.
    """
    labelled = docs.where(~is_held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    size = F.length(text_col)
    stretch = F.substring(F.col(text_col), F.greatest(F.lit(1), F.floor((size - most_bytes) / 2).cast("int") + 1), F.lit(most_bytes))
    rank = F.xxhash64(F.col(id_col), F.lit("language"))
    cut = _rank_bounds(labelled, lang_col, per_lang, most_langs)
    rows = labelled.select(F.col(lang_col).alias("lang"), rank.alias("rank"), stretch.alias("text"))
    limit = F.lit(None).cast("long")
    for lang, top in cut.items():
        limit = F.when(F.col("lang") == lang, F.lit(top)).otherwise(limit)
    taken = rows.where(F.col("rank") <= limit).orderBy("rank", "lang", "text").limit(2 * per_lang * max(1, len(cut)))
    sample = sorted((r["lang"], r["rank"], r["text"]) for r in taken.collect())
    langs = sorted(cut)
    net = ByteNetwork(langs)
    x, y = [], []
    rng = np.random.default_rng(3)
    for lang, _, text in sample:
        raw = text.encode()
        w = net.windows(raw)
        for row in w[rng.permutation(len(w))[:6]]:
            x.append(row), y.append(langs.index(lang))
        short = rng.integers(8, 64)  # short texts are learned too: a few words, the rest filled up
        at = rng.integers(0, max(1, len(raw) - short))
        x.append(net.windows(raw[at : at + short])[0]), y.append(langs.index(lang))
    return net.fit(np.stack(x), np.array(y)) if len(langs) > 1 else net


def _rank_bounds(labelled: DataFrame, lang_col: str, n: int, most_langs: int) -> dict[str, int]:
    """For each of the commonest languages the rank below which about ``n`` of its rows lie; ranks are uniform hashes."""
    counts = labelled.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_langs).collect()
    return {r["lang"]: (1 << 63) - 1 if r["n"] <= n else -(1 << 63) + (n << 64) // r["n"] for r in counts}


def predict_languages(docs: DataFrame, net: ByteNetwork, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(<id_col>, held_out, lang_pred, score)`` of every row; whole texts, nothing but the text is used.

    A null text, or one without a letter, is ``und`` with score 0, as is every text for a network that learned no
    language; ties go to the first language in order. Repeated rows and null ids stay; no rows give no rows.
    """

    def run(batch: pa.RecordBatch) -> dict:
        names, scores = net.classify([t.as_py() for t in batch.column(2)])
        return {"id": batch.column(0), "held_out": batch.column(1), "lang_pred": names, "score": scores}

    rows = docs.select(F.col(id_col).cast("long").alias("id"), is_held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return map_arrow(rows, run, "id long, held_out boolean, lang_pred string, score double").withColumnRenamed("id", id_col)


def filter_language(docs: DataFrame, training_docs: DataFrame, min_score: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose language is recognised with ``min_score`` or more.

    Null, empty and letterless texts go; texts are judged whole; repeated rows share their text's verdict; null ids and
    nulls in other columns stay as they are; no rows give no rows. Training is ``train_network``'s.
    """
    net = train_network(training_docs, text_col=text_col)
    at = docs.columns.index(text_col)
    ship_package(docs.sparkSession)

    def run(batches):
        for batch in slices(batches):
            names, scores = net.classify([t.as_py() for t in batch.column(at)])
            yield batch.filter(pa.array([n != UNKNOWN and s >= min_score for n, s in zip(names, scores, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
