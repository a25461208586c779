"""Queries over whole texts and tables, against plain versions."""

import hashlib
import re
from collections import Counter
from itertools import pairwise

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scholarspark.operators import chunking, retrieval, terms
from scholarspark.operators import relational as R
from scholarspark.plans.adapter import Tables
from scholarspark.plans.catalog import QUERIES

from .conftest import DATA


def documents(spark, folder, texts):
    rows = [(i, text, "en", "web", len(text)) for i, text in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_citation_contexts_behind_the_first_characters(spark, tmp_path):
    sf = documents(spark, tmp_path, ["Zeroth kind", "Another study\n" + "filler words " * 300 + "end. Here zeroth ideas follow."])
    got = {(r.source_paper_id, r.target_paper_id): r.context for r in QUERIES["x12_citation_contexts"](spark, sf).collect()}
    assert got[1, 0] == "Here zeroth ideas follow."


def test_components_and_ranks_of_all_citations(spark):
    sf = f"{DATA}/sf0.001"
    t = Tables(spark, sf)
    ids = sorted(r.id for r in t.papers.select("id").collect())
    edges = {(r.source_paper_id, r.target_paper_id) for r in t.citations.collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    assert {tuple(r) for r in QUERIES["g_components"](spark, sf).collect()} == {(x, find(x)) for x in list(parent)}
    known, out = set(ids), {}
    for a, b in edges:
        if b in known:
            out.setdefault(a, []).append(b)
    rank = dict.fromkeys(ids, 1 / len(ids))
    for step in range(12):
        lost = sum(r for i, r in rank.items() if i not in out)
        new = dict.fromkeys(ids, 0.15 / len(ids) + 0.85 * lost / len(ids))
        for a, targets in out.items():
            for b in targets:
                new[b] += 0.85 * rank[a] / len(targets)
        rank = new
        if step == 2:
            sizes = {i: 20 + min(50.0, 800 * r) for i, r in rank.items()}
    got = {r.id: r["rank"] for r in QUERIES["g2_pagerank"](spark, sf).collect()}
    assert got.keys() == rank.keys() and all(abs(got[i] - rank[i]) < 1e-8 for i in ids)
    got = {r.id: r["size"] for r in QUERIES["p2_rank_size"](spark, sf).collect()}
    assert got.keys() == sizes.keys() and all(abs(got[i] - sizes[i]) < 2e-5 for i in ids)


def test_ranks_stop_at_the_tolerance(spark):
    """The default stops once a round changes the ranks by less than a millionth a node, as a plain rewrite does."""
    sf = f"{DATA}/sf0.001"
    t = Tables(spark, sf)
    ids = sorted(r.id for r in t.papers.select("id").collect())
    known, out = set(ids), {}
    for a, b in {(r.source_paper_id, r.target_paper_id) for r in t.citations.collect()}:
        if b in known:
            out.setdefault(a, []).append(b)
    rank = dict.fromkeys(ids, 1 / len(ids))
    for step in range(1, 101):
        lost = sum(r for i, r in rank.items() if i not in out)
        new = dict.fromkeys(ids, 0.15 / len(ids) + 0.85 * lost / len(ids))
        for a, targets in out.items():
            for b in targets:
                new[b] += 0.85 * rank[a] / len(targets)
        change, rank = sum(abs(new[i] - rank[i]) for i in ids), new
        if step % 5 == 0 and change < len(ids) * 1e-6:
            break
    got = {r.id: r["rank"] for r in QUERIES["g2_pagerank_converged"](spark, sf).collect()}
    assert step < 100 and got.keys() == rank.keys() and all(abs(got[i] - rank[i]) < 2e-6 for i in ids)


def grams(text):
    words = re.findall(r"\w\w+", text.lower())
    return Counter(int(hashlib.md5(x.encode()).hexdigest()[:8], 16) % 512 for x in words + [" ".join(p) for p in pairwise(words)])


def test_search_reads_whole_texts(spark, tmp_path):
    sf = documents(spark, tmp_path, ["First line\n" + "filler words " * 200 + "tion the", "Nothing here\nbut filler", "Again\n" + "filler " * 300 + "onthere"])
    assert {r.doc_id for r in QUERIES["r7_hybrid_search"](spark, sf).collect()} >= {0, 2}
    assert {r.doc_id for r in QUERIES["r6_tfidf_chars"](spark, sf).collect()} >= {0, 2}
    assert {r.doc_id for r in QUERIES["r14_search"](spark, sf).collect()} >= {0, 2}
    t = Tables(spark, sf)
    want = {}
    for r in R.search_documents(t.papers, t.paper_notes).collect():
        counts = grams(r.text)
        norm = sum(c * c for c in counts.values()) ** 0.5
        want |= {(r.doc_id, b): c / norm for b, c in counts.items()}
    got = {(r.doc_id, r.bucket): r.weight for r in QUERIES["r9_hash_vectors"](spark, sf).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_contexts_and_search_against_plain_versions(spark):
    """Chunk scores, contexts and the search, from the chunks and the document ranking (which has an oracle of its own)."""
    t = Tables(spark, f"{DATA}/sf0.001")
    docs, chunks, asked = R.search_documents(t.papers, t.paper_notes), chunking.chunk_documents(t.documents), "the tion on them"
    q = grams(asked)
    cosine = lambda c: sum(q[b] * c[b] for b in q) / (sum(v * v for v in q.values()) * sum(v * v for v in c.values())) ** 0.5
    scored = {(r.doc_id, r.chunk_index): (cosine(grams(r.chunk_text)) if grams(r.chunk_text) else 0.0, r.chunk_text) for r in chunks.collect()}
    got = {(r.doc_id, r.chunk_index): r.score for r in retrieval.chunk_scores(chunks, asked).collect()}
    assert got and got.keys() == {k for k, (s, _) in scored.items() if s > 0} and all(abs(got[k] - scored[k][0]) < 1e-9 for k in got)
    papers = {r.id: r for r in t.papers.collect()}
    toks = {"the", "tion", "on", "them"}
    ranked_docs = [(r.doc_id, r.score) for r in retrieval.hybrid_search(docs, asked, 40).collect()]

    def contexts(k):
        top = max(8, 2 * k)
        near = sorted(((-s, *key) for key, (s, _) in scored.items() if s > 0))[:top]
        rows = {(d, n): (-s, 0.0, scored[d, n][1]) for s, d, n in near}
        for d, score in ranked_docs[:top]:
            rows[d, None] = (0.0, score, (papers[d].abstract or papers[d].title or "")[:1200])
        ranked = [(round(0.5 * v + 0.35 * w + 0.15 * sum(x in text.lower() for x in toks) / len(toks), 6), key, text) for key, (v, w, text) in rows.items()]
        return sorted(ranked, key=lambda r: (-r[0], r[1][0], -1 if r[1][1] is None else r[1][1]))[: max(2, min(k, 20))]

    got = [(r.paper_id, r.chunk_index, r.score) for r in retrieval.retrieve_contexts(docs, chunks, asked, 8).collect()]
    assert got == [(*key, s) for s, key, _ in contexts(8)]
    best = {}
    for s, (d, n), text in contexts(20):
        if s > best.get(d, (0.0,))[0]:
            best[d] = (s, n, text)
    want = {d: max(s, 0.72 * s + 0.48 * best[d][0]) if d in best else s for d, s in ranked_docs[:10]}
    want |= {d: 0.48 * s for d, (s, *_) in best.items() if d not in want}
    want = sorted(((-round(s, 6), d) for d, s in want.items()))[:10]
    got = {r.doc_id: r for r in retrieval.search(t.papers, t.paper_notes, docs, chunks, asked, 10).collect()}
    assert sorted((-r.score, d) for d, r in got.items()) == want
    assert all(r.snippet == (best[d][2] if d in best else papers[d].abstract)[:220] for d, r in got.items())
    none = retrieval.search(t.papers, t.paper_notes, docs, chunks, "☃☃", 5).collect()
    assert len(none) == 5 and all(r.score == 0 for r in none)


def test_texts_are_looked_at_once(spark):
    """Scores of chunks hash each word once, and BM25 filters rows that are counted already, whatever the query's length."""
    chunks = spark.createDataFrame([(1, 0, "the graph of events"), (2, 0, "nothing")], "doc_id long, chunk_index int, chunk_text string")
    plan = retrieval.chunk_scores(chunks, "graph of events and other things")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("md5(") == 1
    docs = chunks.selectExpr("doc_id", "chunk_text AS text")
    assert "regexp" not in retrieval.bm25(docs, "graph events")._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("grams", [retrieval.word_grams, retrieval.char_grams])
def test_terms_counted_in_tasks_are_those_of_the_columns(spark, grams, monkeypatch):
    """Also where a task hands on its sums before its texts end."""
    texts = ["The Graph  graph of\u00a0events", "eine Straße, straße x", None, "", "事件抽取 graph 𝒳", "a b c the", "graph graph graph"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(1)
    rows = docs.select("doc_id", F.explode(grams(F.col("text"))).alias("term"))
    want = {(r.term, float(r.total), r.df) for r in rows.groupBy("term").agg(F.count("*").alias("total"), F.countDistinct("doc_id").alias("df")).collect()}
    assert want and {tuple(r) for r in retrieval.corpus_totals(docs, grams).collect()} == want
    monkeypatch.setattr(terms, "HELD", 3)
    kind = retrieval.MADE_OF[grams]
    words = [r[0] for r in docs.select(kind[0](F.col("text"))).collect()]
    sums = {}
    for batch in terms.totals(iter([pa.RecordBatch.from_arrays([pa.array(words, pa.string())], names=["words"])]), kind[1]()):
        for r in batch.to_pylist():
            total, df = sums.get(r["term"], (0.0, 0))
            sums[r["term"]] = total + r["total"], df + r["df"]
    assert {(t, *v) for t, v in sums.items()} == want
