"""The registered queries of the subpackage: each operator with production parameters over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_crf import quality_rules, train_field

    docs = table(spark, sf_dir, "documents")
    return quality_rules(docs, train_field(docs, table(spark, sf_dir, "labels")))


def op2_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack, packing_digest

    return packing_digest(pack(table(spark, sf_dir, "documents")))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document after line dedup, as counts and a checksum of its text."""
    from .line_dedup import dedup_lines

    out = dedup_lines(table(spark, sf_dir, "documents"))
    text = F.coalesce("text", F.lit(""))
    n_lines = F.when(text == "", 0).otherwise(F.size(F.split(text, "\n", -1))).cast("long")
    return out.select("doc_id", n_lines.alias("n_lines"), F.octet_length(text).cast("long").alias("n_bytes"), F.crc32(text.cast("binary")).alias("text_crc32"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid_cnn import predict_languages, train_network

    docs = table(spark, sf_dir, "documents")
    return predict_languages(docs, train_network(docs))


def op5_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vector_dedup import vector_components

    return vector_components(table(spark, sf_dir, "embeddings"))


def op6_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_by_bytes

    rows = shard_by_bytes(table(spark, sf_dir, "documents"), shards=40)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .piece_bpe import encoding_digest

    return encoding_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


def op9_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc_chunks import archive_pages, record_summary

    return record_summary(archive_pages(table(spark, sf_dir, "pages")))


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash_dedup import simhash_components

    rows = simhash_components(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's proof in the manifest, and what it says of rows of which a seventh have another ``n_chars``."""
    from .merkle import fold, leaf_hash, prove, siblings

    docs = table(spark, sf_dir, "documents")
    row = lambda n_chars: leaf_hash(F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text"))
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    found = F.when(tampered, row(F.col("n_chars") + 1)).otherwise(row(F.col("n_chars")))
    key = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("-"))  # null before all others
    leaves = docs.select(key.alias("key"), "doc_id", row(F.col("n_chars")).alias("hash"), F.struct("doc_id", found.alias("found")).alias("row"))
    rows = prove(leaves, ["doc_id"]).withColumn("folded_root", fold(F.col("row.found"), F.col("path")))
    return rows.select("row.doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fill_middle import fill_in_middle, restore

    rows = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_groups

    return exact_groups(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def _counted(column: str) -> str:
    """A value as its length in bytes and itself, null as a dash, in DuckDB SQL."""
    text = f"CAST({column} AS VARCHAR)"
    return f"coalesce(strlen({text}) || ':' || {text}, '-')"


#: CRC-32 of a decimal id in DuckDB SQL, bit by bit.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
  lambda s, c: list_reduce(list_prepend(xor(s, c), CAST(range(8) AS BIGINT[])), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)))"""


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules, op2_best_two_fit, op3_line_dedup, op4_language_id, op5_vector_dedup, op6_byte_shards, op7_piece_codec, op8_license_scan, op9_warc_chunks, op10_simhash_dedup,
        op11_merkle_manifest, op12_fill_in_middle, op13_exact_dedup,
    )
}

ORACLES = {
    "op9_warc_chunks": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
q AS (SELECT page_id, octet_length(b) AS n, sha256(b) AS d FROM p),
f AS (SELECT d, n, min(page_id) AS first FROM q GROUP BY d, n)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
  CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
FROM q JOIN f USING (d, n)""",
    "op5_vector_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
link AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x),
comp AS (SELECT x, min(y) AS c FROM reach GROUP BY x),
deg AS (SELECT x, count(*) AS n FROM link GROUP BY x)
SELECT v.vec_id, coalesce(deg.n, 0) AS n_links, comp.c AS component_id, v.vec_id = comp.c AS kept
FROM v JOIN comp ON comp.x = v.vec_id LEFT JOIN deg ON deg.x = v.vec_id""",
    "op11_merkle_manifest": f"""
WITH RECURSIVE h AS (SELECT doc_id, coalesce('=' || lang, '-') AS g, crc % 7 = 0 AS tampered, n_chars, {_counted('doc_id')} || {_counted('source')} || {_counted('lang')} AS head, {_counted('text')} AS tail FROM (SELECT *, {_CRC} AS crc FROM documents)),
l AS (SELECT doc_id, g, row_number() OVER (PARTITION BY g ORDER BY doc_id) - 1 AS i, sha256(concat(head, {_counted('n_chars')}, tail)) AS leaf,
    sha256(concat(head, {_counted('n_chars + CAST(tampered AS INT)')}, tail)) AS found FROM h),
up AS (SELECT g, 0 AS k, list(leaf ORDER BY i) AS a FROM l GROUP BY g
  UNION ALL SELECT g, k + 1, list_transform(range(0, (len(a) + 1) // 2), lambda j: sha256(concat(a[2 * j + 1], coalesce(a[2 * j + 2], '')))) FROM up WHERE len(a) > 1),
sub AS (SELECT g, a[1] AS subroot, row_number() OVER (ORDER BY g) - 1 AS i FROM up WHERE len(a) = 1),
top AS (SELECT 0 AS k, list(subroot ORDER BY i) AS a FROM sub
  UNION ALL SELECT k + 1, list_transform(range(0, (len(a) + 1) // 2), lambda j: sha256(concat(a[2 * j + 1], coalesce(a[2 * j + 2], '')))) FROM top WHERE len(a) > 1),
steps AS (SELECT g, k, a, false AS high FROM up WHERE len(a) > 1 UNION ALL SELECT s.g, t.k + 1000, t.a, true FROM sub s, top t WHERE len(t.a) > 1),
way AS (SELECT l.doc_id, row_number() OVER (PARTITION BY l.doc_id ORDER BY s.k) AS nth, CASE WHEN high THEN sub.i >> (s.k - 1000) ELSE l.i >> s.k END AS j, s.a
  FROM l JOIN sub USING (g) JOIN steps s USING (g)),
beside AS (SELECT doc_id, nth, j % 2 = 1 AS odd, coalesce(CASE WHEN j % 2 = 1 THEN a[j] ELSE a[j + 2] END, '') AS sib FROM way),
fold AS (SELECT doc_id, 0 AS nth, found AS x FROM l
  UNION ALL SELECT f.doc_id, b.nth, sha256(CASE WHEN odd THEN concat(sib, x) ELSE concat(x, sib) END) FROM fold f JOIN beside b ON b.doc_id = f.doc_id AND b.nth = f.nth + 1),
proof AS (SELECT doc_id, sha256(string_agg(sib, '' ORDER BY nth)) AS proof_sha256 FROM beside GROUP BY 1)
SELECT l.doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, x AS folded_root, x = root AS verified
FROM l JOIN sub USING (g) JOIN (SELECT a[1] AS root FROM top WHERE len(a) = 1) ON true LEFT JOIN proof USING (doc_id) JOIN (SELECT doc_id, arg_max(x, nth) AS x FROM fold GROUP BY 1) USING (doc_id)""",
    "op12_fill_in_middle": r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256(concat('42:', CAST(doc_id AS VARCHAR))) AS h,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM documents),
w AS (SELECT *, len(u) AS n, CAST(concat('0x', h[1:8]) AS BIGINT) AS h1, CAST(concat('0x', h[9:16]) AS BIGINT) AS h2, CAST(concat('0x', h[17:24]) AS BIGINT) AS h3, CAST(concat('0x', h[25:32]) AS BIGINT) AS h4 FROM t),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM w),
p AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN concat('<P>', pre, '<S>', suf, '<M>', mid) ELSE concat('<S>', suf, '<P>', pre, '<M>', mid) END) AS output_sha256, sha256(text) AS restored_sha256 FROM p""",
    "op13_exact_dedup": """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
}
