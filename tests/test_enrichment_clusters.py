"""Rounding, model answers and clusters against plain versions."""

import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from scholarspark.functions import scalar as S
from scholarspark.operators import clusters, enrichment, retrieval
from scholarspark.sources import connectors


def test_rounding_equals_pythons(spark):
    rng = random.Random(8)
    numbers = [0.0, 0.5, 1.5, 2.5, -0.5, 0.125, 0.375, 2.675, 1.005, 0.12345, 0.00005, 1e-17, 1e15 + 0.5, 1e300, -2.5, 0.1 + 0.2]
    numbers += [rng.randrange(10**6) / 2000 for _ in range(300)] + [rng.randrange(999) / rng.randrange(1, 999) for _ in range(300)] + [rng.uniform(-9, 9) for _ in range(100)]
    rows = spark.createDataFrame([(x,) for x in numbers], "x double")
    for digits in (0, 2, 3, 4, 6):
        for r in rows.select("x", S.round_half_even("x", digits).alias("y")).collect():
            assert r.y == round(r.x, digits), (r.x, digits)
    odd = spark.createDataFrame([(None,), (math.inf,), (-math.inf,), (math.nan,)], "x double").select(S.round_half_even("x", 3).alias("y")).collect()
    assert odd[0].y is None and odd[1].y == math.inf and odd[2].y == -math.inf and math.isnan(odd[3].y)


def test_a_batch_that_fails_is_taken_apart(spark):
    def model(prompts):
        if "bad" in prompts or len(prompts) == 3:
            raise RuntimeError
        return [p.upper() for p in prompts] if "short" not in prompts else []

    df = spark.createDataFrame([(k, p) for k, p in enumerate(["a", "bad", None, "short", "é"])], "id long, prompt string").coalesce(1)
    assert [r.answer for r in connectors.completions(df, model).orderBy("id").collect()] == ["A", None, None, None, "É"]


def test_tries_until_valid(spark):
    def model(prompts):
        strict = ["nothing else" in p for p in prompts]
        text = [p.split("TEXT:\n", 1)[1] for p in prompts]
        script = {"good": '{"title": "t", "year": "1999"}', "late": '{"year": 2001}', "wordy": 'Well: {"title": "w", "sub_field": "nlp", "open_sub_field": "NLP"} ok', "wrong": '{"title": "kept", "year": "MM"}', "empty": "{}", "prose": "no"}
        return ["..." if t == "late" and not s else script[t] for t, s in zip(text, strict, strict=True)]

    rows = spark.createDataFrame([(k, x) for k, x in enumerate(["good", "late", "wordy", "wrong", "empty", "prose", None, ""])], "id long, text string")
    got = {r.id: (r.title, r.year, r.sub_field, r.open_sub_field, r.tries, r.valid) for r in enrichment.enrich_metadata(rows, model, ["NLP"], retries=1).collect()}
    assert got == {0: ("t", 1999, None, None, 1, True), 1: (None, 2001, None, None, 2, True), 2: ("w", None, "NLP", None, 1, True), 3: ("kept", None, None, None, 2, False), 4: (None,) * 4 + (2, False), 5: (None,) * 4 + (2, False), 6: (None,) * 4 + (0, False), 7: (None,) * 4 + (0, False)}
    none = enrichment.enrich_metadata(rows, None, ["NLP"]).collect()
    assert len(none) == 8 and all(r.title is None and not r.valid for r in none)
    prompt = rows.limit(1).select(enrichment.metadata_prompt(F.col("text"), ["A", "B"], True, [("an example", "A"), (" ", "B")]).alias("p")).first().p
    assert "one of: A, B" in prompt and "TEXT: an example\nSUB_FIELD: A" in prompt and prompt.count("SUB_FIELD") == 1


def test_summaries(spark):
    rows = spark.createDataFrame([(1, "t", "a"), (2, None, ""), (3, "", "null please"), (4, "quoted", None)], "id long, title string, abstract string")
    model = lambda ps: ["None" if "null please" in p else '"' + "s" * 400 + '"' if "quoted" in p else " fine " for p in ps]
    assert {r.id: r.summary for r in enrichment.summaries(rows, model).collect()} == {1: "fine", 2: None, 3: None, 4: "s" * 300}


# clusters ---------------------------------------------------------------------------------------------------------


def plain_clusters(texts):
    """{id: cell} by the same rules, with dense vectors."""
    words = {i: [w for w in re.findall(r"\w{2,}", t.lower()) if w not in retrieval.STOP_WORDS] for i, t in texts.items()}
    total, df = Counter(w for ws in words.values() for w in ws), Counter(w for ws in words.values() for w in set(ws))
    vocabulary = sorted(total, key=lambda w: (-total[w], w))[: clusters.FEATURES]
    n, at = len(texts), {w: k for k, w in enumerate(vocabulary)}
    x = {}
    for i, ws in words.items():
        v = np.zeros(len(vocabulary))
        for w in ws:
            if w in at:
                v[at[w]] += math.log((1 + n) / (1 + df[w])) + 1
        x[i] = v / np.linalg.norm(v) if v.any() else v
    ids = sorted(x)
    centres = [x[ids[0]]]
    far = lambda i: round(min(float((x[i] - c) @ (x[i] - c)) for c in centres), 8)
    while len(centres) < max(2, min(6, math.isqrt(n))):
        centres.append(x[max(ids, key=lambda i: (far(i), -i))])
    cells = {}
    for _ in range(20):
        nearest = {i: min(range(len(centres)), key=lambda c: (round(float((x[i] - centres[c]) @ (x[i] - centres[c])), 8), c)) for i in ids}
        if nearest == cells:
            break
        cells = nearest
        centres = [np.mean([x[i] for i in ids if cells[i] == c], axis=0) if c in cells.values() else centres[c] for c in range(len(centres))]
    return cells


PAPER = "id long, title string, abstract string, keywords string, dynamic_tags string, sub_field string"


def test_clusters_against_plain_kmeans(spark):
    rng = random.Random(21)
    topics = [[f"{t}{k}" for k in range(12)] for t in ("graph", "event", "vector", "stream", "note")]
    rows = [(i, None, " ".join(rng.choices(topics[i % 5], k=14) + rng.choices(topics[rng.randrange(5)], k=2) + ["the"]), "", None, "f") for i in range(60)] + [(99, None, "the of", None, None, None), (100, None, None, None, None, "x")]
    got = {r.id: r.cluster for r in clusters.paper_clusters(spark.createDataFrame(rows, PAPER).repartition(3)).collect()}
    want = plain_clusters({r[0]: r[2] for r in rows if r[2]})
    assert got == {i: f"Cluster {c + 1}" for i, c in want.items()} and len(set(got.values())) == 6


def test_cluster_texts_and_few_papers(spark):
    rows = [(1, "title", "abstract", "key", '["a", null, "", "b"]', "x"), (2, "title", "abstract", "key", "[]", "x"), (3, "title", "abstract", "", "[broken", "x"), (4, "title", "", None, "tag, two", "")]
    df = spark.createDataFrame(rows, PAPER)
    assert [r.t for r in df.select("id", clusters.cluster_text(df.columns).alias("t")).orderBy("id").collect()] == ["a, b", "key", "[broken", "tag, two"]
    few = df.where("id <> 3").unionByName(spark.createDataFrame([(9, None, None, None, None, None)], PAPER))
    assert {r.id: r.cluster for r in clusters.paper_clusters(few).collect()} == {1: "x", 2: "x", 4: "Cluster 1", 9: "Cluster 1"}
    assert clusters.paper_clusters(df.limit(0)).count() == 0
