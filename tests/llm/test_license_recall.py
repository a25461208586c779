"""License scans: how many licenses are found as their words are edited, whole license texts, and the row-at-once alignment."""

import random
from pathlib import Path

import numpy as np
import pytest

from scholarspark.llm import license_scan

FOLDER = "/usr/share/common-licenses"
FILLER = "the of a software text code work user license file see notes about things other some which module build".split()


def edited(words, share, rng):
    """Words of which a share is replaced, left out or followed by another, in equal parts."""
    out = []
    for w in words:
        r = rng.random()
        if r < share / 3:
            out.append(rng.choice(FILLER))
        elif r < 2 * share / 3:
            continue
        else:
            out.append(w)
            if r < share:
                out.append(rng.choice(FILLER))
    return out


def recall(index, share, rounds, rng):
    found = asked = 0
    for name, ids in zip(index.names, index.tokens, strict=True):
        if len(ids) < 20:  # of a short notice a single edit is over the share
            continue
        for _ in range(rounds):
            text = [w.decode() for w in edited(ids, 0, rng)]
            text = rng.choices(FILLER, k=rng.randint(0, 200)) + edited(text, share, rng) + rng.choices(FILLER, k=rng.randint(0, 200))
            asked += 1
            found += any(m.template.split("/")[0] == name.split("/")[0] for m in index.scan([w.encode() for w in text]))
    return found / asked


def test_recall_on_edited_licenses():
    rng = random.Random(17)
    index = license_scan.TemplateIndex(license_scan.TEMPLATES)
    got = {share: recall(index, share, 12, rng) for share in (0.0, 0.05, 0.10, 0.15)}
    print("recall by share of edited words:", got)
    assert got[0.0] == 1 and got[0.05] >= 0.97 and got[0.10] >= 0.9


@pytest.mark.skipif(not Path(FOLDER).is_dir(), reason="no folder of license texts")
def test_whole_license_texts(spark):
    texts = license_scan.license_texts(FOLDER)
    assert {"Apache-2.0/text", "GPL-3/text", "LGPL-3/text", "MPL-2.0/text"} <= set(texts)
    index = license_scan.TemplateIndex(texts)
    rng = random.Random(3)
    found = {}
    for name in ("Apache-2.0/text", "GPL-3/text", "LGPL-3/text", "MPL-2.0/text"):
        words = [w.decode() for w in license_scan.words_of(texts[name].encode())]
        for share in (0.05, 0.10):
            text = rng.choices(FILLER, k=300) + edited(words, share, rng) + rng.choices(FILLER, k=300)
            best = max(index.scan([w.encode() for w in text]), key=lambda m: m.matched, default=None)
            found[name, share] = best is not None and best.template == name and best.coverage >= 0.85 and best.first >= 250
    assert all(found.values()), found
    # a whole license among a document's words, by the operator
    df = spark.createDataFrame([(1, "About this file.\n" + texts["Apache-2.0/text"] + "\nThe end."), (2, "no license here"), (3, None)], "doc_id long, text string")
    rows = license_scan.scan_licenses(df, texts).collect()
    (one,) = [r for r in rows if r.template == "Apache-2.0/text"]
    assert {r.doc_id for r in rows} == {1} and one.coverage == 1 and one.end_char - one.start_char > 10_000


def plain(template, text, low, high):
    """The best local alignment within the band, cell by cell: (score, matched, first, last)."""
    above, best = {}, (0, 0, -1, -1)
    for i, want in enumerate(template):
        row = {}
        for k in range(high - low + 1):
            j = low + i + k
            cells = [(0, 0, -1, -1)]
            if 0 <= j < len(text):
                s, m, a, b = above.get(k, (0, 0, -1, -1))
                cells.append((s + 2, m + 1, j if a < 0 else a, j) if text[j] == want else (s - 1, m, a, b))
                s, m, a, b = row.get(k - 1, (0, 0, -1, -1))
                cells.append((s - 1, m, a, b))
            s, m, a, b = above.get(k + 1, (0, 0, -1, -1))
            cells.append((s - 1, m, a, b))
            cell = max(cells)
            row[k] = cell if cell[0] > 0 else (0, 0, -1, -1)
            best = max(best, row[k])
        above = row
    return best


def test_rows_at_once_equal_cell_by_cell():
    rng = random.Random(9)
    for _ in range(150):
        words = [f"w{rng.randrange(6)}" for _ in range(rng.randint(4, 14))]
        index = license_scan.TemplateIndex({"L/x": " ".join(words)}, 0.0)
        text = [rng.choice([*words, "other"]) for _ in range(rng.randint(0, 30))]
        at = rng.randint(0, len(text))
        text = text[:at] + edited(words, 0.2, rng) + text[at:]
        ids = np.array([index.vocabulary.get(w.encode(), -1) for w in text], np.int64)
        low = rng.randint(-6, len(text))
        high = low + rng.randint(1, 12)
        got, want = index.align(0, ids, low, high), plain(index.ids[0].tolist(), ids.tolist(), low, high)
        assert got.matched == want[1]
        if want[1]:
            assert (got.first, got.last) == want[2:]
