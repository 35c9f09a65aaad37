"""The queries of this subpackage for __spark_entry__.py, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .conversation_repair import damaged, repair_conversations
from .exact_dedup import exact_dedup
from .fingerprints import fingerprint_edits
from .lm_scoring import score_documents
from .mixing import curriculum
from .near_dedup import near_dedup
from .pii import KINDS, find_pii
from .secrets import find_secrets
from .sentencepiece_bpe import tokenize
from .substring_dedup import substring_dedup
from .token_shards import documents_of, read_shards, write_shards
from .toxicity import score_toxicity
from .yinyang import cluster


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(_documents(spark, sf_dir), k=2, percent=80)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = curriculum(_documents(spark, sf_dir))
    return out.select("doc_id", "size", "source_size", "target", "taken", F.array_min("positions").alias("first_position"))


def public_tokenizer(name: str) -> str:
    """The path of a vocabulary file of the public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    out = tokenize(_documents(spark, sf_dir), public_tokenizer("piece_bpe_32k.model"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(_documents(spark, sf_dir))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_documents(spark, sf_dir), digests=True)


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_secrets(_documents(spark, sf_dir))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "guess")
    return out.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), count("guess"), F.array_max(F.transform("spans", lambda s: s["cost"])).alias("max_cost"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fingerprint_edits(_documents(spark, sf_dir))
    return out.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(_documents(spark, sf_dir))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), F.col("shared").cast("long").alias("shared_passage"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    shards = write_shards(_documents(spark, sf_dir), public_tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    rows = read_shards(spark, shards).select("doc_id", "slot", "shard", "byte_offset", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"))
    return rows.join(documents_of(spark, shards).select("slot", F.col("docs").alias("doc_ids")), "slot")


def op11_yinyang(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256).alias("centroid_sha256"))


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_pii(_documents(spark, sf_dir))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS))
    return out.select("doc_id", *[count(k) for k in KINDS], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), (F.size("spans") - F.size(base)).cast("long").alias("n_added"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_dedup": op1_near_dedup,
    "op2_mixing": op2_mixing,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_secrets": op6_secrets,
    "op7_fingerprints": op7_fingerprints,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_token_shards": op10_token_shards,
    "op11_yinyang": op11_yinyang,
    "op12_pii": op12_pii,
    "op13_conversation_repair": op13_conversation_repair,
}


def _kmeans_sql(k: int = 16, rounds: int = 3) -> str:
    """Whole scans in each round; squared distances as doubles that are exact."""
    dot = "list_dot_product({}, {})".format
    parts = [
        """kept AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
          WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64)""",
        f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c, v FROM kept QUALIFY c < {k})",
    ]
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS MATERIALIZED (SELECT r, arg_min(c, [d, c]) AS c, min(d) AS d
          FROM (SELECT r, c, {dot('x.v', 'x.v')} - 2 * {dot('x.v', 'y.v')} + {dot('y.v', 'y.v')} AS d FROM kept x, c{i} y) GROUP BY r)""")
        if i < rounds:
            parts.append(f"""c{i + 1} AS MATERIALIZED (SELECT c, coalesce(m.v, o.v) AS v FROM c{i} o LEFT JOIN (
          SELECT c, list(m ORDER BY i) AS v FROM (SELECT c, i, floor(sum(x) / count(*)) AS m
            FROM (SELECT c, unnest(v) AS x, unnest(range(64)) AS i FROM a{i} JOIN kept USING (r)) GROUP BY c, i) GROUP BY c) m USING (c))""")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, c::INT AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(list_transform(y.v, lambda x: x::BIGINT::VARCHAR), ',')) AS centroid_sha256
FROM a{rounds} JOIN kept USING (r) JOIN c{rounds} y USING (c)"""


SQL = {
    "op5_exact_dedup": r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id)
""",
    "op11_yinyang": _kmeans_sql(),
    "op13_conversation_repair": r"""
WITH RECURSIVE keyed AS (
  SELECT *, dense_rank() OVER (ORDER BY conv_id) AS cid,
    list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda ch: ascii(ch)::BIGINT) AS bytes FROM conversations),
hit AS (
  SELECT * EXCLUDE (bytes), xor(list_reduce([4294967295::BIGINT] || bytes, lambda c, b: list_reduce([xor(c, b)] || range(8),
    lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT) % 20 AS kind FROM keyed),
d AS (
  SELECT cid, turn, CASE WHEN kind = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') ELSE coalesce(text, ' ') END AS text,
    unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM hit WHERE kind <> 0),
n AS (
  SELECT *, row_number() OVER (PARTITION BY cid ORDER BY turn NULLS FIRST, role, text, copy) AS i,
    row_number() OVER (PARTITION BY cid, role, text ORDER BY turn NULLS FIRST, copy) AS seen, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last FROM d),
f AS MATERIALIZED (
  SELECT cid, turn, role, text, i, left(role, 1) AS initial, left(lag(role) OVER (PARTITION BY cid ORDER BY i), 1) AS before,
    CASE WHEN last = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM n),
edits(q1, letter, role_initial, q2, base) AS (
  VALUES (0, 'D', NULL, 0, 2), (1, 'D', NULL, 1, 2), (2, 'D', NULL, 2, 2), (3, 'D', NULL, 3, 2), (0, 'K', 's', 1, 0), (0, 'K', 'u', 2, 0), (1, 'K', 'u', 2, 0),
    (2, 'K', 'a', 3, 0), (3, 'K', 'u', 2, 0), (0, 'R', NULL, 2, 1), (1, 'R', NULL, 2, 1), (2, 'R', NULL, 3, 1), (3, 'R', NULL, 2, 1)),
inserts(p, q, extra, put, added) AS (
  VALUES (0, 0, 0, '', []::VARCHAR[]), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []), (0, 2, 5, 'I', ['user:']), (1, 2, 5, 'I', ['user:']), (3, 2, 5, 'I', ['user:']),
    (2, 3, 5, 'I', ['assistant:']), (0, 3, 10, 'II', ['user:', 'assistant:']), (1, 3, 10, 'II', ['user:', 'assistant:'])),
path AS (
  SELECT cid, 1::BIGINT AS i, 0 AS q, {'cost': 0, 'audit': '', 'lines': []::VARCHAR[]} AS m FROM keyed GROUP BY cid
  UNION ALL
  SELECT p.cid, p.i + 1, e.q2, min({'cost': p.m.cost + t.extra + e.base + CASE WHEN e.letter <> 'D' AND f.fault = 'truncated' THEN 5 ELSE 0 END, 'audit': p.m.audit || t.put || e.letter,
      'lines': p.m.lines || t.added || CASE e.letter WHEN 'D' THEN [] WHEN 'K' THEN [f.role || ':' || f.text] ELSE [CASE e.q2 WHEN 2 THEN 'user:' ELSE 'assistant:' END || f.text] END})
  FROM path p JOIN inserts t ON t.p = p.q JOIN f ON f.cid = p.cid AND f.i = p.i
    JOIN edits e ON e.q1 = t.q AND (e.role_initial IS NULL OR e.role_initial = f.initial) AND (e.letter = 'D' OR f.fault NOT IN ('blank', 'duplicate'))
  GROUP BY p.cid, p.i, e.q2),
counts AS (
  SELECT cid, count(*) AS n_rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (i > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY cid),
ends AS (
  SELECT p.cid, min({'cost': p.m.cost + t.extra, 'audit': p.m.audit || t.put, 'lines': p.m.lines || t.added}) AS m
  FROM path p LEFT JOIN counts c USING (cid) JOIN inserts t ON t.p = p.q WHERE p.i = coalesce(c.n_rows, 0) + 1 AND t.q IN (0, 3) GROUP BY p.cid)
SELECT k.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  m.cost::BIGINT AS cost, m.audit AS audit, sha256(array_to_string(m.lines, chr(10))) AS repaired_sha256, coalesce(n_rows, 0) AS n_rows
FROM (SELECT DISTINCT cid, conv_id FROM keyed) k JOIN ends USING (cid) LEFT JOIN counts USING (cid)
""",
}
