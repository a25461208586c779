"""Quality rules: base counts, and a linear-chain conditional random field over the lines of a text.

Each line is labelled content or boilerplate by Viterbi decoding; a text is kept when enough of its characters stand in
content lines. The field is trained here from document labels. In a document of good quality every line is content unless
it is a notice; which lines of a bad one are boilerplate is not known, and most bad ones hold content as well. So lines
are first told apart one by one, by features and their document's label; then the field is fitted on chains of these line
labels, and relabels the lines of the bad documents, in a few rounds. Labels thus change within texts, in training
and in use.
"""

from __future__ import annotations

import re
from collections import Counter
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, ship_package, slices

SYMBOLS = "#*$%&|<>"
#: Words that mark notices and page furniture.
NOTICE = re.compile(r"licen[sc]e|copyright|rights reserved|cookie|privacy|subscribe|terms of|sign in|log in|javascript|click here", re.I)
#: Most labelled documents that the field is trained on, and most lines of one of them: four stretches spread over the
#: whole text, as the longest texts are rare and would outweigh the rest. Both bound training only; every document is
#: labelled in full.
MAX_TRAINING_DOCS = 3000
MAX_TRAINING_LINES = 200
STRETCHES = 4
#: Least share of a text's characters in content lines.
LEAST_CONTENT = 0.5
WINDOW = 8


def base_counts(text: str | None) -> dict[str, int]:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` of a whole text (null: none).

    Words are runs of characters other than ASCII white space. A line counts as duplicate when it has a word and equals
    an earlier line. Repeated words are those inside any window of eight words that occurs twice or more.
    """
    if not text:
        return dict.fromkeys(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"), 0)
    raw = text.encode()
    words = raw.split()
    spaces = sum(map(raw.count, (b" ", b"\t", b"\n", b"\v", b"\f", b"\r")))
    seen: set[bytes] = set()
    dup = 0
    for line in raw.split(b"\n"):
        if line in seen:
            dup += bool(line.split())
        seen.add(line)
    return {
        "n_words": len(words),
        "word_chars": len(text) - spaces,
        "n_symbols": sum(map(text.count, SYMBOLS)),
        "n_dup_lines": dup,
        "n_repeat_words": repeated_words(words),
    }


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """How many words stand in a window of ``window`` (a power of two) words that occurs again; exact, by doubling."""
    n = len(words)
    if n <= window:
        return 0
    names: dict[bytes, int] = {}
    ids = np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, n)
    size = 1
    while size < window:
        ids = np.unique(ids[:-size] * (ids.max() + 1) + ids[size:], return_inverse=True)[1]
        size *= 2
    again = np.bincount(ids)[ids] > 1
    if not again.any():
        return 0
    cover = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + window, -1)
    return int((np.cumsum(cover)[:n] > 0).sum())


FEATURES = ("bias", "symbols", "upper", "digits", "top_word", "stutter", "repeat", "short", "notice", "bang")
NOTICED = FEATURES.index("notice")
_SYMBOL_BYTES = bytes(sorted(SYMBOLS.encode()))
_UPPER, _LOWER, _DIGIT = (bytes(range(*r)) for r in ((65, 91), (97, 123), (48, 58)))


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """One row of ``FEATURES`` and the number of characters, for each line of a text that has a word."""
    rows, sizes = [], []
    seen: set[str] = set()
    for line in text.split("\n"):
        raw = line.encode()
        words = raw.split()
        if not words:
            continue
        n = len(raw)
        k = len(words)
        symbols = n - len(raw.translate(None, _SYMBOL_BYTES))
        upper = n - len(raw.translate(None, _UPPER))
        lower = n - len(raw.translate(None, _LOWER))
        digits = n - len(raw.translate(None, _DIGIT))
        top = max(Counter(words).values()) / k if k > 4 else 0.0
        rows.append((1.0, min(1.0, 10 * symbols / n), max(0.0, upper / max(1, upper + lower) - 0.2), digits / n, max(0.0, top - 0.3), sum(map(eq, words, words[1:])) / k, float(line in seen), float(k < 4), float(bool(NOTICE.search(line))), min(1.0, raw.count(b"!!") / k)))
        sizes.append(n)
        seen.add(line)
    return np.array(rows, np.float64).reshape(-1, len(FEATURES)), np.array(sizes, np.int64)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


class _Batch:
    """Labelled chains, the longest first, laid out line by line so that all chains advance together."""

    def __init__(self, chains: list[np.ndarray], labels: list[np.ndarray]):
        lengths = np.array([len(c) for c in chains])
        self.most = int(lengths.max())
        self.alive = [int((lengths > t).sum()) for t in range(self.most)]  # chains that have line t
        self.x = [np.stack([chains[i][t] for i in range(self.alive[t])]) for t in range(self.most)]
        self.y = [np.array([labels[i][t] for i in range(self.alive[t])]) for t in range(self.most)]
        self.share = 1 / len(chains)

    def gradient(self, params: np.ndarray) -> tuple[float, np.ndarray]:
        """Mean log likelihood of the labels, and its gradient by forward and backward sums."""
        x, y, alive, most = self.x, self.y, self.alive, self.most
        w, s = params[:-4].reshape(-1, 2), params[-4:].reshape(2, 2)
        e = [xt @ w for xt in x]
        forward = [e[0]]
        for t in range(1, most):
            forward.append(e[t] + _log_sum(forward[-1][: alive[t], :, None] + s, 1))
        back = [np.zeros((a, 2)) for a in alive]
        for t in range(most - 2, -1, -1):
            back[t][: alive[t + 1]] = _log_sum(s + (e[t + 1] + back[t + 1])[:, None, :], 2)
        total = _log_sum(forward[0] + back[0], 1)
        value, gw, gs = -total.sum(), np.zeros_like(w), np.zeros_like(s)
        for t in range(most):
            a = alive[t]
            p = np.exp(forward[t] + back[t] - total[:a, None])
            gw += x[t].T @ (np.eye(2)[y[t]] - p)
            value += e[t][np.arange(a), y[t]].sum()
            if t:
                q = np.exp(forward[t - 1][:a, :, None] + s + (e[t] + back[t])[:, None, :] - total[:a, None, None])
                seen = np.bincount(2 * y[t - 1][:a] + y[t], minlength=4).reshape(2, 2)
                gs += seen - q.sum(0)
                value += (seen * s).sum()
        return value * self.share, np.concatenate([gw.ravel(), gs.ravel()]) * self.share


class LineField:
    """A linear-chain conditional random field with two labels, 0 boilerplate and 1 content."""

    def __init__(self, weights: np.ndarray | None = None, steps: np.ndarray | None = None):
        self.weights = np.zeros((len(FEATURES), 2)) if weights is None else weights
        self.steps = np.zeros((2, 2)) if steps is None else steps
        self.trained = weights is not None

    def fit(self, chains: list[np.ndarray], labels: list[np.ndarray], rounds: int = 150, rate: float = 0.15, decay: float = 1e-3) -> LineField:
        """Gradient ascent (Adam) on the likelihood of the chains' line labels; chains without lines say nothing."""
        kept = sorted((i for i in range(len(chains)) if len(chains[i])), key=lambda i: -len(chains[i]))
        seen = {int(v) for i in kept for v in labels[i]}
        if len(seen) < 2:
            return self
        batch = _Batch([chains[i] for i in kept], [np.asarray(labels[i], np.int64) for i in kept])
        params, m, v = np.concatenate([self.weights.ravel(), self.steps.ravel()]), 0.0, 0.0
        for step in range(1, rounds + 1):
            g = batch.gradient(params)[1] - decay * params
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            params = params + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-12)
        self.weights, self.steps, self.trained = params[:-4].reshape(-1, 2), params[-4:].reshape(2, 2), True
        return self

    def fit_documents(self, chains: list[np.ndarray], good: list[int], rounds: int = 3) -> LineField:
        """Fit on chains of lines of which only the document's label is known (1 good, 0 bad).

        Lines of good documents are content and lines with a notice boilerplate throughout. The other lines of bad ones
        start with what a field without steps makes of them, and are then decoded anew before each fit; a chain of
        a bad document always has a boilerplate line, the likeliest one if need be.
        """
        if len(set(good)) < 2:
            return self
        lines = [np.where(x[:, NOTICED] > 0, 0, int(g)) for x, g in zip(chains, good, strict=True)]
        alone = LineField().fit([row[None] for x in chains for row in x], [y[None] for ys in lines for y in ys])
        alone.steps = np.zeros((2, 2))
        guess = alone
        for k in range(rounds):
            for i, g in enumerate(good):
                if g or not len(chains[i]):
                    continue
                path = np.where(chains[i][:, NOTICED] > 0, 0, guess.decode(chains[i]))
                if path.all():
                    score = chains[i] @ guess.weights
                    path[int((score[:, 1] - score[:, 0]).argmin())] = 0
                lines[i] = path
            self.fit(chains, lines, rounds=150 if not k else 60)
            guess = self
        return self

    def decode(self, x: np.ndarray) -> np.ndarray:
        """Labels of the likeliest path (Viterbi); of equal paths the one with more content at the end."""
        if not len(x):
            return np.zeros(0, np.int64)
        scores = (x @ self.weights).tolist()
        (s00, s01), (s10, s11) = self.steps.tolist()
        a, b = scores[0]
        origin = []
        for e0, e1 in scores[1:]:
            to0, to1 = b + s10 >= a + s00, b + s11 >= a + s01
            origin.append((to0, to1))
            a, b = (b + s10 if to0 else a + s00) + e0, (b + s11 if to1 else a + s01) + e1
        label = int(b >= a)
        path = [label]
        for back in reversed(origin):
            label = int(back[label])
            path.append(label)
        return np.array(path[::-1])

    def content_share(self, text: str | None) -> float:
        """Share of a text's characters that stand in content lines; 0 without words, 1 from an untrained field."""
        x, sizes = line_features(text or "")
        if not len(x):
            return 0.0
        return float(sizes[self.decode(x) == 1].sum() / sizes.sum()) if self.trained else 1.0


def stretches(rows: np.ndarray, most: int) -> list[np.ndarray]:
    """All rows, or ``STRETCHES`` runs of consecutive rows, ``most`` rows in all, spread evenly from first to last."""
    if len(rows) <= most:
        return [rows]
    size = max(1, most // STRETCHES)
    return [rows[at : at + size] for at in np.linspace(0, len(rows) - size, STRETCHES).astype(int)]


def train_field(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_docs: int = MAX_TRAINING_DOCS, max_lines: int = MAX_TRAINING_LINES) -> LineField:
    """A field fitted on at most ``max_docs`` documents with a quality label, chosen by a hash of their id, and at most
    ``max_lines`` lines of each, in stretches over its whole text.

    Rows with a null id, text or label are no examples; documents with contradicting labels count by the lower one, and
    of texts that share an id the one with the smallest hash. Without examples of both labels the field stays untrained
    and finds everything content.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min("quality").cast("int").alias("quality"))
    chosen = known.orderBy(F.xxhash64(id_col), id_col).limit(max_docs).collect()  # at most max_docs ids and labels
    quality = {r[0]: r["quality"] for r in chosen}
    picked = docs.where(F.col(id_col).isin(list(quality))) if quality else docs.limit(0)
    rows = picked.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))

    def run(batch: pa.RecordBatch) -> dict:
        parts = [stretches(line_features(t.as_py())[0], max_lines) for t in batch.column(2)]
        return {"id": batch.column(0), "h": batch.column(1), "sizes": [[len(p) for p in ps] for ps in parts], "x": [np.concatenate(ps).astype("<f4").tobytes() for ps in parts]}

    one = F.min_by(F.struct("sizes", "x"), F.struct("h", "x")).alias("r")  # equal hashes: the smaller features
    found = sorted(map_arrow(rows, run, "id long, h long, sizes array<int>, x binary").groupBy("id").agg(one).select("id", "r.*").collect(), key=lambda r: r["id"])
    chains, good = [], []
    for r in found:
        x = np.frombuffer(r["x"], "<f4").reshape(-1, len(FEATURES)).astype(np.float64)
        for part in np.split(x, np.cumsum(r["sizes"])[:-1]):
            chains.append(part)
            good.append(quality[r["id"]])
    return LineField().fit_documents(chains, good)


def quality_rules(docs: DataFrame, field: LineField, min_content: float = LEAST_CONTENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, base counts, ``base_failed``, ``content_share``, ``kept``.

    Base rules fail a text of fewer than 20 words, or one with over 30 % of its words in repeated windows. Other texts
    are kept when at least ``min_content`` of their characters stand in content lines. Null and blank texts have no words
    and fail; repeated rows and null ids stay; no rows give no rows; texts are whole. Other columns are not read.
    """
    schema = "id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, kept boolean"

    def run(batch: pa.RecordBatch) -> dict:
        texts = [t.as_py() for t in batch.column(1)]
        counts = [base_counts(t) for t in texts]
        failed = [c["n_words"] < 20 or 100 * c["n_repeat_words"] > 30 * c["n_words"] for c in counts]
        share = [field.content_share(t) for t in texts]
        out: dict = {k: [c[k] for c in counts] for k in counts[0]}
        return out | {"id": batch.column(0), "base_failed": failed, "content_share": share, "kept": [not f and s >= min_content for f, s in zip(failed, share, strict=True)]}

    out = map_arrow(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), run, schema)
    return out.withColumnRenamed("id", id_col)


def filter_quality(docs: DataFrame, training_docs: DataFrame, labels: DataFrame, min_content: float = LEAST_CONTENT, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``quality_rules`` keeps; judged in place, without a shuffle.

    Null, empty and blank texts fail, texts are judged whole, repeated rows and ids share their text's verdict, null ids
    and nulls in other columns stay as they are, and no rows give no rows. Training is ``train_field``'s.
    """
    field = train_field(training_docs, labels, text_col=text_col)
    ship_package(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in slices(batches):
            keep = []
            for t in batch.column(at):
                text = t.as_py()
                c = base_counts(text)
                keep.append(c["n_words"] >= 20 and 100 * c["n_repeat_words"] <= 30 * c["n_words"] and field.content_share(text) >= min_content)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
