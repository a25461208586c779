"""Queries of text retrieval and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import chunking, retrieval
from ..operators import relational as R
from ..operators.clusters import paper_clusters
from .registry import query

ASKED = "the onthere tion the"
TOK = r"regexp_extract_all(lower(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))), '[A-Za-z0-9一-鿿]+')"


def _bm25_sql(text_query: str) -> str:
    terms = dict.fromkeys(retrieval.query_tokens(text_query))
    mult = {t: retrieval.query_tokens(text_query).count(t) for t in terms}
    tf = ", ".join(f"CAST(len(list_filter(t, lambda x: x = '{t}')) AS DOUBLE) AS tf{i}" for i, t in enumerate(terms))
    df = ", ".join(f"CAST(count(*) FILTER (tf{i} > 0) AS DOUBLE) AS df{i}" for i in range(len(terms)))
    score = " + ".join(
        f"{m} * ln(1 + (n - df{i} + 0.5e0) / (df{i} + 0.5e0)) * tf{i} * 2.6e0 / (tf{i} + 1.6e0 * (0.25e0 + 0.75e0 * greatest(dl, 1) / avgdl))" for i, m in enumerate(mult.values())
    )
    return f"""tk AS (SELECT doc_id, {TOK} AS t FROM documents), ct AS (SELECT doc_id, len(t) AS dl, {tf} FROM tk),
  st AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(dl) AS avgdl, {df} FROM ct), bm AS (SELECT doc_id, {score} AS score FROM ct, st WHERE {" OR ".join(f"tf{i} > 0" for i in range(len(terms)))})"""


STOP = ", ".join(f"'{w}'" for w in retrieval.STOP_WORDS)


def _tfidf_sql(name: str, grams: str, features: int) -> str:
    """CTEs that end in ``name (doc_id, score)``; ``grams`` is a query of (d, term) over ``src (d, text)``."""
    return f"""{name}_g AS ({grams}), {name}_tf AS (SELECT d, term, CAST(count(*) AS DOUBLE) AS tf FROM {name}_g GROUP BY 1, 2),
  {name}_v AS (SELECT term, sum(tf) AS total, count(*) AS df FROM {name}_tf GROUP BY 1 ORDER BY total DESC, term LIMIT {features}),
  {name}_i AS (SELECT term, ln((1 + (SELECT count(*) FROM src)) / CAST(1 + df AS DOUBLE)) + 1 AS idf FROM {name}_v),
  {name}_w AS (SELECT d, term, tf * idf AS w FROM {name}_tf JOIN {name}_i USING (term)),
  {name}_q AS (SELECT term, w AS qw FROM {name}_w WHERE d = -1), {name}_n AS (SELECT sqrt(sum(qw * qw)) AS qn FROM {name}_q),
  {name} AS (SELECT d AS doc_id, sum(w * coalesce(qw, 0)) / (sqrt(sum(w * w)) * max(qn)) AS score FROM {name}_w LEFT JOIN {name}_q USING (term), {name}_n WHERE d <> -1 GROUP BY d HAVING sum(w * coalesce(qw, 0)) > 0)"""


WORD_GRAMS = rf"""SELECT d, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: concat(ws[i], ' ', ws[i + 1])))) AS term FROM
  (SELECT d, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}_]{{2,}}'), lambda w: w NOT IN ({STOP})) AS ws FROM src)"""
CHAR_GRAMS = r"""SELECT d, substr(w, CAST(i AS INT), CAST(k AS INT)) AS term FROM (SELECT d, w, k, unnest(range(1, length(w) - k + 2)) AS i FROM
  (SELECT d, concat(' ', unnest(list_filter(string_split(lower(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))), ' '), lambda w: w <> '')), ' ') AS w FROM src), (SELECT unnest([2, 3, 4]) AS k) WHERE length(w) >= k)"""


#: The documents that a search looks through: each paper's title, abstract and notes as one text.
SEARCHED = """SELECT p.id AS doc_id, trim(concat_ws(' ', coalesce(title, ''), coalesce(abstract, ''), trim(concat_ws(' ', coalesce(notes, ''), coalesce(method, ''), coalesce(datasets, ''), coalesce(conclusions, ''))))) AS text
  FROM papers p LEFT JOIN paper_notes n ON n.paper_id = p.id"""


def _searched(t) -> DataFrame:
    return R.search_documents(t.papers, t.paper_notes)


def _src(body: str, asked: str) -> str:
    return f"src AS ({body} UNION ALL SELECT -1, '{asked}')"


query("r1_normalize", None, r"SELECT doc_id, md5(lower(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')))) AS h FROM documents")(lambda t: t.documents.select("doc_id", F.md5(S.normalize_text("text")).alias("h")))
query("r2_tokenize", None, f"SELECT doc_id, len({TOK}) AS n, {TOK}[1] AS first FROM documents")(lambda t: t.documents.select("doc_id", F.size(S.tokens("text")).alias("n"), F.get(S.tokens("text"), F.lit(0)).alias("first")))
_ASK = "CASE doc_id % 4 WHEN 0 THEN concat('小样本 事件抽取  ', lang) WHEN 1 THEN concat(lang, ' 事件抽取') WHEN 2 THEN lang WHEN 3 THEN ' ' END"
query(
    "r3_expand_query",
    None,
    """SELECT DISTINCT doc_id, unnest(list_concat(CASE doc_id % 4 WHEN 0 THEN [trim(concat('小样本 事件抽取 ', lang)), trim(concat('小样本 few-shot 事件抽取 event extraction ', lang)), 'event extraction', 'few-shot']
  WHEN 1 THEN [trim(concat(lang, ' 事件抽取')), trim(concat(lang, ' 事件抽取 event extraction')), 'event extraction'] WHEN 2 THEN CASE WHEN coalesce(lang, '') <> '' THEN [lang] ELSE [] END ELSE [] END, CAST([] AS VARCHAR[]))) AS q FROM documents""",
)(lambda t: t.documents.select("doc_id", F.expr(_ASK).alias("asked")).select("doc_id", F.explode(S.expanded_queries("asked")).alias("q")))
query("r4_bm25", None, f"WITH {_bm25_sql(ASKED)} SELECT doc_id, round(score, 6) AS score FROM bm ORDER BY round(score, 6) DESC, doc_id LIMIT 20")(
    lambda t: retrieval.bm25(t.documents, ASKED).select("doc_id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(20)
)
query(
    "r5_tfidf_words",
    None,
    f"WITH {_src('SELECT doc_id AS d, text FROM documents', ASKED)}, {_tfidf_sql('s', WORD_GRAMS, 6000)} SELECT doc_id, round(score, 6) AS score FROM s ORDER BY round(score, 6) DESC, doc_id LIMIT 50",
)(lambda t: retrieval.tfidf_scores(t.documents, ASKED).select("doc_id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(50))
query(
    "r6_tfidf_chars",
    "papers paper_notes",
    f"WITH searched AS ({SEARCHED}), {_src('SELECT doc_id AS d, text FROM searched', ASKED)}, {_tfidf_sql('s', CHAR_GRAMS, 5000)} SELECT doc_id, round(score, 6) AS score FROM s ORDER BY round(score, 6) DESC, doc_id LIMIT 50",
)(lambda t: retrieval.tfidf_scores(_searched(t), ASKED, retrieval.char_grams, 5000).select("doc_id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(50))
_toks = retrieval.query_tokens(ASKED)
_norm = r"lower(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')))"
_over = f"CASE WHEN contains({_norm}, '{ASKED}') THEN 1.0e0 ELSE ({' + '.join(f'CAST(contains({_norm}, {chr(39)}{w}{chr(39)}) AS INT)' for w in _toks)}) / {len(_toks)}.0e0 END"
def _hybrid_sql(limit: int) -> str:
    return f"""WITH documents AS ({SEARCHED}), {_bm25_sql(ASKED)}, {_src('SELECT doc_id AS d, text FROM documents', ASKED)}, {_tfidf_sql('sw', WORD_GRAMS, 6000)}, {_tfidf_sql('sc', CHAR_GRAMS, 5000)},
  sm AS (SELECT doc_id, sum(score) AS score FROM (SELECT doc_id, 0.65e0 * score AS score FROM sw UNION ALL SELECT doc_id, 0.35e0 * score FROM sc) GROUP BY 1),
  ov AS (SELECT doc_id, {_over} AS ov FROM documents),
  al AS (SELECT o.doc_id, coalesce(bm.score / (SELECT max(score) FROM bm), 0) AS b, coalesce(sm.score / (SELECT max(score) FROM sm), 0) AS s, ov FROM ov o LEFT JOIN bm USING (doc_id) LEFT JOIN sm USING (doc_id))
  SELECT doc_id, round(0.58e0 * greatest(b, 0.65e0 * ov) + 0.42e0 * greatest(s, 0.55e0 * ov), 6) AS score FROM al ORDER BY score DESC, doc_id LIMIT {limit}"""


query(
    "r7_hybrid_search",
    "papers paper_notes",
    _hybrid_sql(20),
)(lambda t: retrieval.hybrid_search(_searched(t), ASKED, 20).select("doc_id", "score"))

#: Chunks of the documents, cut one after the other; an end that fits is the last sentence end of the chunk's window.
CHUNKS = r"""flat AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS t FROM documents),
  cut AS (SELECT doc_id, t, CAST(0 AS BIGINT) AS pos, CASE WHEN length(t) <= 900 THEN length(t) WHEN length(regexp_extract(substr(t, 1, 900), '(?s)^(.*)[。.!?]', 1)) > 120 THEN length(regexp_extract(substr(t, 1, 900), '(?s)^(.*)[。.!?]', 1)) + 1 ELSE 900 END AS until FROM flat WHERE t <> ''
    UNION ALL SELECT doc_id, t, b, CASE WHEN length(t) - b <= 900 THEN length(t) WHEN length(regexp_extract(substr(t, b + 1, 900), '(?s)^(.*)[。.!?]', 1)) > 120 THEN b + length(regexp_extract(substr(t, b + 1, 900), '(?s)^(.*)[。.!?]', 1)) + 1 ELSE b + 900 END
    FROM (SELECT doc_id, t, greatest(until - 160, pos + 1) AS b FROM cut WHERE until < length(t))),
  chunk AS (SELECT doc_id, pos, trim(substr(t, pos + 1, until - pos)) AS c FROM cut WHERE trim(substr(t, pos + 1, until - pos)) <> '')"""
query("r8_chunks", None, f"WITH RECURSIVE {CHUNKS} SELECT doc_id, count(*) AS n_chunks, max(length(c)) AS longest, sum(length(c)) AS n_chars, md5(string_agg(c, chr(10) ORDER BY pos)) AS h FROM chunk GROUP BY 1")(lambda t: _chunk_counts(t))


def _chunk_counts(t) -> DataFrame:
    """Chunks of all documents: how many, how long, and a checksum of them in order."""
    c = chunking.chunk_documents(t.documents)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_text"))), lambda x: x["chunk_text"]), "\n")  # one document's chunks
    return c.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.max(F.length("chunk_text")).alias("longest"), F.sum(F.length("chunk_text")).alias("n_chars"), F.md5(joined).alias("h"))


query(
    "r12_index_chunks",
    None,
    rf"""WITH RECURSIVE {CHUNKS}, w AS (SELECT doc_id, pos, regexp_extract_all(lower(c), '[\p{{L}}\p{{N}}_]{{2,}}') AS ws FROM chunk),
  b AS (SELECT doc_id, pos, len(list_distinct(list_transform(list_concat(ws, list_transform(range(1, len(ws)), lambda i: concat(ws[i], ' ', ws[i + 1]))), lambda x: CAST(concat('0x', substr(md5(x), 1, 8)) AS BIGINT) % 512))) AS k FROM w)
  SELECT doc_id, count(*) AS chunks, CAST(sum(k) AS BIGINT) AS buckets FROM b GROUP BY 1""",
)(lambda t: _index_counts(t))


def _index_counts(t) -> DataFrame:
    """What an index of the corpus holds: chunks, and the buckets of their hashed vectors, which need no shuffle."""
    chunks = chunking.chunk_documents(t.documents).select("doc_id", F.size(F.array_distinct(retrieval.hash_embedding(F.col("chunk_text")))).alias("k"))
    return chunks.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum("k").alias("buckets"))


query(
    "r9_hash_vectors",
    "papers paper_notes",
    rf"""WITH searched AS ({SEARCHED}) SELECT doc_id, bucket, round(c / sqrt(sum(c * c) OVER (PARTITION BY doc_id)), 6) AS weight FROM (SELECT doc_id, CAST(CAST(concat('0x', substr(md5(term), 1, 8)) AS BIGINT) % 512 AS INT) AS bucket, CAST(count(*) AS DOUBLE) AS c FROM
  (SELECT doc_id, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: concat(ws[i], ' ', ws[i + 1])))) AS term FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}_]{{2,}}') AS ws FROM searched)) GROUP BY 1, 2)""",
)(lambda t: retrieval.hash_vectors(_searched(t)).select("doc_id", "bucket", F.round("weight", 6).alias("weight")))
query("r10_embedding_codec", None, "SELECT vec_id, round(list_sum(CAST(embedding AS DOUBLE[])), 4) AS s, len(embedding) AS n FROM embeddings")(
    lambda t: t.embeddings.select("vec_id", F.from_json(F.to_json(F.col("embedding").cast("array<double>")), "array<double>").alias("v")).select("vec_id", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 4).alias("s"), F.size("v").alias("n"))
)
query("r11_cosine", None, "SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score FROM embeddings a, embeddings b WHERE b.vec_id = 0")(
    lambda t: t.embeddings.join(F.broadcast(t.embeddings.where("vec_id = 0").select(F.col("embedding").alias("q")))).select("vec_id", F.round(S.cosine(F.col("embedding").cast("array<double>"), F.col("q").cast("array<double>")), 6).alias("score"))
)
VEC3 = "SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score FROM embeddings a, embeddings b WHERE b.vec_id = 5 AND score > 0 ORDER BY score DESC, a.vec_id LIMIT 25"


def _query_vector(t, vec_id: int) -> list[float]:
    return t.embeddings.where(F.col("vec_id") == vec_id).select("embedding").first()[0]


query("vec3_rank_chunks", None, VEC3)(lambda t: retrieval.rank_vectors(t.embeddings, _query_vector(t, 5), 25).select("vec_id", F.round("score", 6).alias("score")))
query("src16_vector_collection", None, VEC3.replace("vec_id = 5", "vec_id = 9"))(lambda t: retrieval.rank_vectors(t.embeddings, _query_vector(t, 9), 25).select("vec_id", F.round("score", 6).alias("score")))


def _chunks(t) -> DataFrame:
    return chunking.chunk_documents(t.documents)


_BUCKETS = "SELECT {keys}CAST(concat('0x', substr(md5(x), 1, 8)) AS BIGINT) % 512 AS b, count(*) AS n FROM (SELECT {keys}unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: concat(ws[i], ' ', ws[i + 1])))) AS x FROM {rows}) GROUP BY ALL"
_WORDS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]{{2,}}')"
_ASKED_TOKENS = [w for w in dict.fromkeys(_toks) if len(w) >= 2]


@query(
    "r13_rag_contexts",
    "papers paper_notes",
    f"""WITH RECURSIVE {CHUNKS}, ck AS MATERIALIZED (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INT) AS chunk_index, c FROM chunk),
  w AS (SELECT doc_id, chunk_index, {_WORDS.format("c")} AS ws FROM ck), tb AS ({_BUCKETS.format(keys="doc_id, chunk_index, ", rows="w")}),
  qw AS (SELECT {_WORDS.format("'" + ASKED + "'")} AS ws), qb AS ({_BUCKETS.format(keys="", rows="qw")}),
  near AS (SELECT doc_id, chunk_index, sum(tb.n * coalesce(qb.n, 0)) / (sqrt(CAST(sum(tb.n * tb.n) AS DOUBLE)) * (SELECT sqrt(CAST(sum(n * n) AS DOUBLE)) FROM qb)) AS v FROM tb LEFT JOIN qb USING (b) GROUP BY 1, 2 HAVING v > 0 ORDER BY v DESC, doc_id, chunk_index LIMIT 16),
  best AS ({_hybrid_sql(16)}), hits AS (SELECT best.doc_id AS paper_id, CAST(NULL AS INT) AS chunk_index, substr(coalesce(nullif(abstract, ''), nullif(title, ''), ''), 1, 1200) AS text, 0.0e0 AS v, best.score AS kw FROM best JOIN papers ON papers.id = best.doc_id),
  rows AS (SELECT doc_id AS paper_id, chunk_index, c AS text, v, 0.0e0 AS kw FROM near JOIN ck USING (doc_id, chunk_index) UNION ALL SELECT * FROM hits)
  SELECT paper_id, chunk_index, round(0.5e0 * v + 0.35e0 * kw + 0.15e0 * ({" + ".join(f"CAST(contains(lower(text), '{w}') AS INT)" for w in _ASKED_TOKENS)}) / {len(_ASKED_TOKENS)}.0e0, 6) AS score FROM rows ORDER BY score DESC, paper_id, chunk_index NULLS FIRST LIMIT 8""",
)
def rag_contexts(t):
    """Contexts from all chunks and documents."""
    return retrieval.retrieve_contexts(_searched(t), _chunks(t), ASKED).select("paper_id", "chunk_index", "score")


@query("r14_search")
def search(t):
    """The search over papers, their notes and all chunks; tested against a plain version."""
    return retrieval.search(t.papers, t.paper_notes, _searched(t), _chunks(t), ASKED, 30).select("doc_id", "score", "chunk_index", "snippet")


@query("r15_title_similarity")
def title_similarity(t):
    """Pairs of alike titles; the ratio is the standard library's, tested against it."""
    from ..operators.entity import title_pairs

    return title_pairs(t.papers, 0.9).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query("r16_clusters")
def clusters(t):
    """Papers by k-means over TF-IDF of their tags, keywords or texts; tested against a plain version."""
    return paper_clusters(t.papers)


query(
    "r17_chat_prompt",
    "papers",
    r"SELECT string_agg(concat('[', rank, '] (paper_id=', id, ') ', substr(abstract, 1, 1200)), chr(10) || chr(10) ORDER BY rank) AS prompt FROM (SELECT id, abstract, row_number() OVER (ORDER BY citation_count DESC, id) AS rank FROM papers) WHERE rank <= 8",
)(lambda t: retrieval.chat_prompt(_ranked_papers(t)))
query(
    "r18_fallback_answer",
    "papers",
    "SELECT id AS paper_id, rank, substr(abstract, 1, 160) AS line FROM (SELECT id, abstract, row_number() OVER (ORDER BY citation_count DESC, id) AS rank FROM papers) WHERE rank <= 5",
)(lambda t: _ranked_papers(t).where("rank <= 5").select("paper_id", "rank", F.substring("text", 1, 160).alias("line")))


def _ranked_papers(t) -> DataFrame:
    from pyspark.sql import Window

    top = t.papers.orderBy(F.desc("citation_count"), "id").limit(8)
    return top.select(F.col("id").alias("paper_id"), F.col("abstract").alias("text"), F.row_number().over(Window.orderBy(F.desc("citation_count"), "id")).alias("rank"))
