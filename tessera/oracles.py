"""SQL for DuckDB that restates the queries of tessera.queries independently."""

from __future__ import annotations

from tessera.chunk_oracle import STRUCTURED, chunks_sql
from tessera.functions.identity import NAMESPACE
from tessera.queries import CHUNK_OVERLAP, CHUNK_SIZE, MODEL, QUERY, QUERY_VECTOR_ID
from tessera.sources.rules import ALLOW

FILES = """files AS (
  SELECT doc_id, source AS section, 'doc_' || doc_id || '.txt' AS rel_path, text, strlen(text) AS size,
         sha256(text) AS content_hash, make_timestamp((1700000000 + doc_id) * 1000000) AS mtime
  FROM documents)"""
POINTS = f"""{FILES}, points AS (
  SELECT f.doc_id, section, rel_path AS source_file, text, content_hash, doc_id % 7 <> 3 AS in_use, embedding AS dense
  FROM files f LEFT JOIN embeddings e ON e.vec_id = f.doc_id)"""
STATE = f"""{FILES}, state AS (
  SELECT doc_id, section,
         CASE m WHEN 2 THEN 'old/' || rel_path WHEN 0 THEN 'gone_' || doc_id || '.txt' ELSE rel_path END AS rel_path,
         CASE WHEN m IN (0, 1) THEN sha256('old' || doc_id) ELSE content_hash END AS content_hash,
         CASE WHEN m = 1 THEN size + 1 ELSE size END AS size, mtime,
         m + 1 AS total_chunks, CASE WHEN m = 5 THEN 2 ELSE m + 1 END AS chunks_done, m NOT IN (4, 6, 7) AS in_use,
         CASE m WHEN 3 THEN 'error' WHEN 4 THEN 'skipped_size' WHEN 5 THEN 'ingesting' ELSE 'ingested' END AS status,
         CASE m WHEN 3 THEN 'broken' WHEN 4 THEN 'too_large' END AS error_reason,
         CASE WHEN m = 6 THEN make_timestamp((1717200000 + (doc_id % 7 - 3) * 86400) * 1000000) END AS delete_after
  FROM (SELECT *, doc_id % 10 AS m FROM files) WHERE m <> 0 OR doc_id % 40 = 0)"""
TERMS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+')"
TOKENS = r"CASE WHEN {0} = '' THEN 0 ELSE greatest(len(list_filter(regexp_split_to_array({0}, '[\s\x1c-\x1f\x0b\x85\xa0\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+'), lambda w: w <> '')), length({0}) // 3) END"

TF = f"""tf AS (
  SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TERMS.format('text')}) AS term FROM points) GROUP BY ALL)"""
IDF = "ln(1 + (n - df + 0.5) / (df + 0.5))"
KEYWORD = f"""{POINTS}, live AS (SELECT * FROM points WHERE in_use),
tf AS (SELECT source_file, term, count(*) AS tf FROM (SELECT source_file, unnest({TERMS.format('text')}) AS term FROM live) GROUP BY ALL),
q AS (SELECT term, count(*) AS qtf FROM (SELECT unnest({TERMS.format("'" + QUERY + "'")}) AS term) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), total AS (SELECT count(*) AS n FROM live),
keyword AS (SELECT source_file, round(sum(qtf * {IDF} * tf), 9) AS score FROM tf JOIN q USING (term) JOIN df USING (term), total GROUP BY source_file)"""
COSINE = "list_cosine_similarity({}::DOUBLE[], {}::DOUBLE[])"
VECTOR = f"""vector AS (
  SELECT source_file, round({COSINE.format('dense', 'v.embedding')}, 9) AS score
  FROM points, (SELECT embedding FROM embeddings WHERE vec_id = {QUERY_VECTOR_ID}) v WHERE in_use AND dense IS NOT NULL)"""


def _uuid(name: str) -> str:
    h = f"sha1(unhex('{NAMESPACE.replace('-', '')}') || encode({name}))"
    return f"""(SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' ||
      substr('89ab89ab89ab89ab', instr('0123456789abcdef', substr(h, 17, 1)), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) FROM (SELECT {h} AS h))"""


_ID = _uuid("section || chr(0) || source_file || chr(0) || content_hash || chr(0) || '0'")
#: Completeness, restated from each side rather than by a full join.
COMPLETE = f"""{STATE}, category AS (
  SELECT f.section, f.rel_path, CASE
      WHEN s.rel_path IS NULL THEN 'pending' WHEN s.status LIKE 'skipped%' THEN NULL WHEN s.status = 'ingesting' THEN 'in_progress'
      WHEN s.status = 'ingested' AND s.in_use THEN 'ok' WHEN s.status = 'ingested' THEN 'changed' ELSE 'pending' END AS category
  FROM files f LEFT JOIN state s USING (section, rel_path)
  UNION ALL
  SELECT section, rel_path, CASE WHEN status = 'ingesting' THEN 'in_progress' ELSE 'stale' END FROM state s
  WHERE NOT EXISTS (FROM files f WHERE f.section = s.section AND f.rel_path = s.rel_path) AND (status = 'ingesting' OR status = 'ingested' AND in_use))"""
DISPATCH = f"""{STATE}, fresh AS (
  SELECT f.section, f.rel_path, f.content_hash, row_number() OVER (PARTITION BY f.section, f.content_hash ORDER BY f.rel_path) AS k
  FROM files f WHERE NOT EXISTS (FROM state s WHERE s.section = f.section AND s.rel_path = f.rel_path)),
gone AS (
  SELECT s.section, s.rel_path, s.content_hash, row_number() OVER (PARTITION BY s.section, s.content_hash ORDER BY s.rel_path) AS k
  FROM state s WHERE status = 'ingested' AND NOT EXISTS (FROM files f WHERE s.section = f.section AND s.rel_path = f.rel_path)),
dispatch AS (
  SELECT f.section, f.rel_path, f.content_hash, CASE
      WHEN s.status IS NULL AND g.rel_path IS NOT NULL THEN 'moved' WHEN s.status IS NULL THEN 'new'
      WHEN s.status = 'ingested' AND s.content_hash = f.content_hash THEN CASE WHEN s.in_use THEN 'unchanged' ELSE 'restored' END
      WHEN s.status = 'ingesting' AND s.content_hash = f.content_hash THEN 'resumed' ELSE 'changed' END AS action,
    g.rel_path AS moved_from,
    CASE WHEN s.status = 'ingesting' AND s.content_hash = f.content_hash THEN least(s.chunks_done, s.total_chunks) ELSE 0 END AS resume_from
  FROM files f LEFT JOIN state s USING (section, rel_path) LEFT JOIN fresh n USING (section, rel_path)
  LEFT JOIN gone g ON g.section = n.section AND g.content_hash = n.content_hash AND g.k = n.k)"""
_counts = ", ".join(f"count(*) FILTER (category = '{c}') AS n_{c}" for c in ("pending", "changed", "in_progress", "stale"))
_capped = ", ".join(
    f"""coalesce(array_to_string(CASE WHEN n_{c} > 3 THEN (l_{c}[1:3]) || ['...(+' || (n_{c} - 3) || ' more)'] ELSE l_{c} END, ';'), '') AS {c}""" for c in ("pending", "changed", "in_progress", "stale")
)
_lists = ", ".join(f"list(rel_path ORDER BY rel_path) FILTER (category = '{c}') AS l_{c}" for c in ("pending", "changed", "in_progress", "stale"))
_summary = "concat_ws(', ', " + ", ".join(f"CASE WHEN n_{c} > 0 THEN n_{c} || ' {c}' END" for c in ("pending", "changed", "in_progress", "stale")) + ")"
_names = ", ".join(f"'{x}'" for x in ALLOW)

_WIKI_CHUNKS = chunks_sql("SELECT doc_id AS k, 0 AS page_number, text FROM documents", "k", 512, 51)

SQL: dict[str, str] = {
    "keyword_topk": f"WITH {KEYWORD} SELECT source_file, round(score, 6) AS score FROM keyword ORDER BY keyword.score DESC, source_file LIMIT 10",
    "semantic_topk": f"WITH {POINTS}, {VECTOR} SELECT source_file, round(score, 6) AS score FROM vector ORDER BY vector.score DESC, source_file LIMIT 10",
    "hybrid_rrf": f"""WITH {KEYWORD}, {VECTOR},
        a AS (SELECT source_file, row_number() OVER (ORDER BY score DESC, source_file) AS rank FROM keyword QUALIFY rank <= 50),
        b AS (SELECT source_file, row_number() OVER (ORDER BY score DESC, source_file) AS rank FROM vector QUALIFY rank <= 50),
        fused AS (SELECT source_file, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (FROM a UNION ALL FROM b) GROUP BY source_file)
        SELECT source_file, round(score, 6) AS score FROM fused ORDER BY fused.score DESC, source_file LIMIT 10""",
    "sparse_tf": f"WITH {POINTS}, {TF} SELECT * FROM tf",
    "doc_freq_idf": f"""WITH {POINTS}, {TF}, df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), total AS (SELECT count(*) AS n FROM points)
        SELECT term, df, round({IDF}, 6) AS idf FROM df, total""",
    "query_batch_topk": f"""WITH {POINTS}, live AS (SELECT * FROM points WHERE in_use), total AS (SELECT count(*) AS n FROM live),
        tf AS (SELECT source_file, term, count(*) AS tf FROM (SELECT source_file, unnest({TERMS.format('text')}) AS term FROM live) GROUP BY ALL),
        q AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({TERMS.format('text')}) AS term FROM benchmark) GROUP BY ALL),
        df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
        s AS (SELECT item_id, source_file, round(sum(qtf * {IDF} * tf), 9) AS score FROM tf JOIN q USING (term) JOIN df USING (term), total GROUP BY ALL)
        SELECT item_id, source_file, row_number() OVER (PARTITION BY item_id ORDER BY s.score DESC, source_file) AS rank, round(score, 5) AS score FROM s QUALIFY rank <= 3""",
    "semantic_batch_topk": f"""WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, round({COSINE.format('e.embedding', 'q.embedding')}, 9) AS score
        FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0 AND e.vec_id <> q.vec_id)
        SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY s.score DESC, vec_id) AS rank, round(score, 6) AS score FROM s QUALIFY rank <= 5""",
    "estimate_tokens": f"SELECT doc_id, {TOKENS.format('text')} AS tokens, length(text) AS chars FROM documents",
    "sentence_pack": rf"""WITH s AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS parts FROM documents),
        c AS (SELECT doc_id, list_transform(parts, lambda p: {{'text': p, 'cost': {TOKENS.format('p')}}}) AS parts FROM s),
        p AS (SELECT doc_id, list_reduce(parts, lambda a, x: CASE WHEN a.used + x.cost > {CHUNK_SIZE} AND a.open IS NOT NULL
            THEN {{'done': a.done || [a.open], 'open': x.open, 'used': x.cost, 'cost': 0::BIGINT}}
            ELSE {{'done': a.done, 'open': CASE WHEN a.open IS NULL THEN x.open ELSE a.open || ' ' || x.open END, 'used': a.used + x.cost, 'cost': 0::BIGINT}} END,
            {{'done': []::VARCHAR[], 'open': NULL::VARCHAR, 'used': 0::BIGINT, 'cost': 0::BIGINT}}) AS r
          FROM (SELECT doc_id, list_transform(parts, lambda p: {{'done': []::VARCHAR[], 'open': p.text, 'used': 0::BIGINT, 'cost': p.cost::BIGINT}}) AS parts FROM c))
        SELECT doc_id, unnest(range(len(r.done) + 1)) AS piece, unnest(r.done || [r.open]) AS text FROM p""",
    "content_hash": "SELECT doc_id, sha256(text) AS content_hash FROM documents",
    "exact_duplicates": f"WITH {FILES} SELECT content_hash, count(*) AS n, min(rel_path) AS first_path FROM files GROUP BY content_hash HAVING count(*) > 1",
    "point_ids": f"WITH {POINTS} SELECT doc_id, {_ID} AS id FROM points",
    "classify_extension": f"""WITH e AS (SELECT page_id, lower(regexp_extract(split_part(regexp_replace(url, '[?#].*$', ''), '/', -1), '^.+?(\\.[^.]+)$', 1)) AS ext FROM pages)
        SELECT page_id, ext, CASE WHEN ext = '.pdf' THEN 'known_binary' WHEN ext IN ({_names}) THEN 'known_text' ELSE 'other' END AS file_class FROM e""",
    "size_cap_sniff": f"""WITH {FILES}, f AS (SELECT *, CASE WHEN doc_id % 5 = 0 THEN 'other' WHEN doc_id % 17 = 0 THEN 'known_binary' ELSE 'known_text' END AS file_class FROM files)
        SELECT doc_id, file_class, CASE WHEN file_class = 'known_binary' THEN NULL
          WHEN file_class = 'known_text' AND size > 5000 THEN 'too_large:' || size || '>5000' WHEN file_class = 'other' AND size > 1000 THEN 'too_large:' || size || '>1000'
          WHEN doc_id % 13 = 0 AND size < 8192 THEN 'binary' END AS skip_reason FROM f""",
    "list_files": """SELECT 'conv_' || conv_id AS source_file, count(*) AS total_chunks, max(turn + 1)::INT AS max_page FROM conversations
        WHERE (conv_id + turn) % 11 <> 5 GROUP BY conv_id""",
    "get_chunks": """SELECT text, 'conv_3' AS source_file, (turn + 1)::INT AS page_number, turn::INT AS chunk_index FROM conversations
        WHERE conv_id = 3 AND turn BETWEEN 1 AND 4 AND (conv_id + turn) % 11 <> 5""",
    "section_resolve": f"""WITH s AS (SELECT DISTINCT source AS section, regexp_extract(source, '([0-9]+)$', 1)::INT AS n FROM documents),
        r AS (SELECT section, CASE WHEN n % 3 = 0 THEN '{MODEL}' WHEN n % 3 = 1 THEN 'big' WHEN n % 7 = 5 THEN 'missing' ELSE '{MODEL}' END AS embed_model,
          CASE WHEN n % 4 = 1 THEN 600 WHEN n % 4 = 3 THEN 2000 ELSE 512 END AS chunk_size, CASE WHEN n % 5 = 2 THEN 0.25::DOUBLE ELSE 0.1::DOUBLE END AS chunk_overlap_ratio FROM s)
        SELECT section, embed_model, chunk_size, chunk_overlap_ratio, 0.02::DOUBLE AS headroom_ratio, trunc(chunk_size * chunk_overlap_ratio)::INT AS chunk_overlap,
          CASE embed_model WHEN 'big' THEN 32 ELSE 16 END AS embed_batch_size,
          CASE WHEN embed_model = 'missing' THEN 'unknown model missing' WHEN embed_model = '{MODEL}' AND chunk_size > 2007 THEN 'chunk_size ' || chunk_size || ' exceeds 2007' END AS disabled_reason FROM r""",
    "validity_gate": f"""WITH s AS (SELECT DISTINCT source AS section FROM documents), m AS (SELECT section, section = 'src1' AS never,
          CASE WHEN section LIKE '%5' THEN 'embed_model {MODEL} -> other-model' END AS a, CASE WHEN section LIKE '%3' THEN 'chunk_size 512 -> 256' END AS b,
          CASE WHEN section LIKE '%3' THEN 'chunk_overlap 51 -> 25' END AS c FROM s)
        SELECT section, never OR concat_ws('; ', a, b, c) = '' AS valid, CASE WHEN NOT never THEN nullif(concat_ws('; ', a, b, c), '') END AS reason FROM m""",
    "completeness_gate": f"WITH {COMPLETE} SELECT * FROM category WHERE category IS NOT NULL",
    "completeness_verdicts": f"""WITH {COMPLETE}, g AS (SELECT section, {_counts}, {_lists} FROM category WHERE category IS NOT NULL GROUP BY section)
        SELECT section, {_summary} = '' AS complete, CASE WHEN {_summary} = '' THEN 'complete' ELSE {_summary} END AS summary, {_capped} FROM g""",
    "section_coverage": f"""WITH {COMPLETE}, d AS (SELECT section, count(*) AS on_disk FROM files GROUP BY section),
        s AS (SELECT section, count(*) FILTER (status = 'ingested' AND in_use) AS ingested, count(*) FILTER (NOT in_use AND delete_after IS NOT NULL) AS marked_for_deletion,
          coalesce(sum(total_chunks) FILTER (status = 'ingested' AND in_use), 0)::BIGINT AS total_chunks FROM state GROUP BY section),
        c AS (SELECT section, count(*) FILTER (category = 'pending') AS pending, count(*) FILTER (category = 'changed') AS changed,
          count(*) FILTER (category = 'in_progress') AS in_progress FROM category GROUP BY section)
        SELECT section, on_disk, coalesce(ingested, 0) AS ingested, coalesce(pending, 0) AS pending, coalesce(changed, 0) AS changed, coalesce(in_progress, 0) AS in_progress,
          coalesce(marked_for_deletion, 0) AS marked_for_deletion, coalesce(total_chunks, 0) AS total_chunks
        FROM d LEFT JOIN s USING (section) LEFT JOIN c USING (section)""",
    "status_counts": f"""WITH {STATE} SELECT section, {", ".join(f"count(*) FILTER (status = '{k}') AS n_{k}" for k in ("ingested", "ingesting", "error", "skipped_size"))},
        coalesce(string_agg(rel_path || ':' || error_reason, ';' ORDER BY rel_path || ':' || error_reason) FILTER (status = 'error'), '') AS errors,
        coalesce(string_agg(rel_path || ':' || error_reason, ';' ORDER BY rel_path || ':' || error_reason) FILTER (status = 'skipped_size'), '') AS skipped FROM state GROUP BY section""",
    "ingest_dispatch": f"WITH {DISPATCH} SELECT * FROM dispatch",
    "ingest_counters": f"WITH {DISPATCH} SELECT section, action, count(*) AS n FROM dispatch GROUP BY ALL",
    "daemon_diff": f"""WITH {DISPATCH}, lost AS (SELECT section, rel_path, content_hash, row_number() OVER (PARTITION BY section, content_hash ORDER BY rel_path) AS k FROM state s
          WHERE status = 'ingested' AND in_use AND NOT EXISTS (FROM files f WHERE s.section = f.section AND s.rel_path = f.rel_path))
        SELECT f.section, f.rel_path, 'changed' AS action, NULL::VARCHAR AS new_path FROM files f JOIN state s USING (section, rel_path)
          WHERE s.status = 'ingested' AND s.in_use AND f.size <> s.size AND f.content_hash <> s.content_hash
        UNION ALL SELECT l.section, l.rel_path, CASE WHEN n.rel_path IS NULL THEN 'delete' ELSE 'move' END, n.rel_path FROM lost l LEFT JOIN fresh n USING (section, content_hash, k)""",
    "cheap_change": "SELECT doc_id, doc_id % 11 = 0 OR doc_id % 9 = 0 OR doc_id % 5 * 0.0005 > 0.001 AS changed FROM documents",
    "purge_expired": f"WITH {STATE} SELECT section, rel_path FROM state WHERE NOT in_use AND delete_after <= TIMESTAMP '2024-06-01'",
    "purge_totals": f"WITH {STATE} SELECT section, count(*) AS n FROM state WHERE NOT in_use AND delete_after <= TIMESTAMP '2024-06-01' GROUP BY section",
    "orphan_sections": f"WITH {STATE} SELECT DISTINCT section FROM state WHERE section LIKE '%7'",
    "repath_points": f"""WITH {DISPATCH}, p AS (SELECT s.section, coalesce(d.rel_path, s.rel_path) AS source_file, s.content_hash, 0 AS chunk_index
          FROM state s LEFT JOIN dispatch d ON d.action = 'moved' AND d.section = s.section AND d.moved_from = s.rel_path) SELECT *, {_ID} AS id FROM p""",
    "latest_state": """SELECT 's' || (user_id % 5) AS section, 'f' || user_id AS rel_path, event_type AS status FROM events
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1 AND event_id % 10 <> 0""",
    "live_points": f"""WITH {STATE} SELECT f.doc_id, f.section, f.rel_path AS source_file FROM files f WHERE EXISTS (FROM state s
        WHERE s.section = f.section AND s.rel_path = f.rel_path AND s.content_hash = f.content_hash AND s.in_use AND s.status IN ('ingested', 'ingesting', 'error'))""",
    "store_transitions": """WITH f AS (SELECT doc_id, 'part' || doc_id % 2 AS section, 'doc_' || doc_id || '.txt' AS rel_path, sha256(text) AS content_hash, strlen(text) AS size,
          doc_id % 12 AS m, (doc_id % 5 + 1)::INT AS total_chunks FROM documents)
        SELECT section, CASE m WHEN 9 THEN 'moved/' || rel_path ELSE rel_path END AS rel_path, content_hash, CASE m WHEN 4 THEN 7 WHEN 5 THEN 8 ELSE size END AS size, total_chunks,
          CASE m WHEN 0 THEN 0 WHEN 1 THEN least(total_chunks, 2) ELSE total_chunks END AS chunks_done, m NOT IN (4, 5, 6, 8) AS in_use,
          CASE m WHEN 0 THEN 'ingesting' WHEN 1 THEN 'ingesting' WHEN 3 THEN 'error' WHEN 4 THEN 'skipped_size' WHEN 5 THEN 'skipped_binary' ELSE 'ingested' END AS status,
          CASE m WHEN 3 THEN 'broken' WHEN 4 THEN 'too_large' WHEN 5 THEN 'binary' END AS error_reason, CASE m WHEN 6 THEN '2024-06-08' END AS delete_after
        FROM f WHERE m <> 10""",
    "store_points": f"""WITH {FILES}, p AS (SELECT doc_id, 'part' || doc_id % 2 AS section, rel_path AS source_file, content_hash, 0 AS chunk_index FROM files),
        i AS (SELECT *, {_ID} AS id FROM p WHERE source_file NOT LIKE '%7.txt')
        SELECT section, count(*) AS points, count(*) FILTER (doc_id % 3 <> 1) AS second, min(id) AS first_id, '{MODEL}' AS embed_model, 512 AS chunk_size, 51 AS chunk_overlap, '2024-06-01' AS ingested_on
        FROM i WHERE section <> (SELECT min(section) FROM p) GROUP BY section""",
    "chunk_documents": chunks_sql("SELECT doc_id AS k, 0 AS page_number, text FROM documents", "doc_id", CHUNK_SIZE, CHUNK_OVERLAP),
    "chunk_conversations": chunks_sql("SELECT conv_id AS k, turn + 1 AS page_number, text FROM conversations", "conv_id", CHUNK_SIZE, CHUNK_OVERLAP),
    "structured_chunks": chunks_sql(STRUCTURED, "l_orderkey", 32, 8),
    "engine_search": f"""WITH chunks AS MATERIALIZED ({_WIKI_CHUNKS}),
        tf AS (SELECT k, chunk_index, term, count(*) AS tf FROM (SELECT k, chunk_index, unnest({TERMS.format('text')}) AS term FROM chunks) GROUP BY ALL),
        q AS (SELECT term, count(*) AS qtf FROM (SELECT unnest({TERMS.format("'" + QUERY + "'")}) AS term) GROUP BY ALL),
        df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), total AS (SELECT count(*) AS n FROM chunks),
        s AS (SELECT k, chunk_index, round(sum(qtf * {IDF} * tf), 9) AS score FROM tf JOIN q USING (term) JOIN df USING (term), total GROUP BY ALL)
        SELECT 'doc_' || k || '.txt' AS source_file, chunk_index, page_number, text, round(score, 6) AS score FROM s JOIN chunks USING (k, chunk_index) ORDER BY s.score DESC, source_file, chunk_index LIMIT 10""",
    "engine_lifecycle": f"""WITH chunks AS MATERIALIZED (SELECT k AS doc_id, count(*)::INT AS n FROM ({_WIKI_CHUNKS}) GROUP BY k),
        f AS (SELECT doc_id, 'doc_' || doc_id || '.txt' AS rel_path, sha256(text) AS content_hash, strlen(text) AS size, coalesce(n, 0) AS n, doc_id % 10 AS m FROM documents LEFT JOIN chunks USING (doc_id)),
        gone AS (SELECT doc_id, content_hash, row_number() OVER (PARTITION BY content_hash ORDER BY rel_path) AS k FROM f WHERE m IN (1, 3)),
        come AS (SELECT 'moved/' || rel_path AS new_path, content_hash, row_number() OVER (PARTITION BY content_hash ORDER BY rel_path) AS k FROM f WHERE m = 3),
        r AS (SELECT f.*, new_path, m = 2 AS changed, m IN (1, 3) AND new_path IS NULL AS lost FROM f LEFT JOIN gone USING (doc_id) LEFT JOIN come ON come.content_hash = gone.content_hash AND come.k = gone.k)
        SELECT coalesce(new_path, rel_path) AS rel_path, content_hash, size, 'ingested' AS status, NOT changed AND NOT lost AS in_use, n AS total_chunks, n AS chunks_done,
          CASE WHEN lost THEN '2024-06-08' END AS delete_after, (CASE WHEN changed OR lost THEN 0 ELSE n END)::BIGINT AS searched FROM r""",
}
SQL["keyword_index_topk"] = SQL["keyword_topk"]
SQL["query_batch_index_topk"] = SQL["query_batch_topk"]
SQL["engine_index_search"] = SQL["engine_search"]
SQL["vector_index_recall"] = """SELECT count(DISTINCT query_id) AS queries, count(*) AS wanted, true AS reached FROM (SELECT q.vec_id AS query_id,
    row_number() OVER (PARTITION BY q.vec_id) AS rank FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0 AND e.vec_id <> q.vec_id QUALIFY rank <= 10)"""
#: By groups: what was seen at a time and, of the times that nothing was found before the next, the first.
SQL["lifecycle_stream"] = """WITH e AS (SELECT user_id, epoch_us(ts) AS us, event_id, event_type = 'error' AS gone, sha256(event_type) AS h,
      count(*) FILTER (event_type <> 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM events),
    s AS (SELECT user_id, g, min(us) FILTER (NOT gone) AS us, min(h) FILTER (NOT gone) AS h, min(us) FILTER (gone) AS lost FROM e WHERE g > 0 GROUP BY ALL),
    n AS (SELECT *, lag(h) OVER w AS h0, lag(lost) OVER w AS lost0, lead(us) OVER w AS us1, 86400000000 AS day, (SELECT max(us) FROM e) AS last FROM s WINDOW w AS (PARTITION BY user_id ORDER BY g)),
    a AS (SELECT user_id, us AS at_us, h, CASE WHEN h0 IS NULL OR us >= lost0 + day THEN 'new' WHEN h <> h0 THEN 'changed' WHEN lost0 IS NOT NULL THEN 'restored' END AS action FROM n
      UNION ALL SELECT user_id, lost, h, 'delete' FROM n WHERE lost IS NOT NULL
      UNION ALL SELECT user_id, lost + day, h, 'purge' FROM n WHERE coalesce(us1, last) >= lost + day)
    SELECT 's' || user_id % 5 AS section, 'f' || user_id AS rel_path, action, at_us, h AS content_hash FROM a WHERE action IS NOT NULL"""
SQL["store_counts"] = """WITH p AS (SELECT doc_id, unnest([doc_id % 10 + CASE doc_id % 3 WHEN 1 THEN 0 ELSE 1000 END, strlen(text) % 7 + 100]) AS term FROM documents WHERE doc_id % 10 <> 7)
    SELECT 'term' AS kind, term, count(*) AS n FROM p GROUP BY term UNION ALL SELECT 'all', NULL, count(*) FROM documents WHERE doc_id % 10 <> 7"""
#: Fixed answers, and counts of files and chunks.
_ANSWERS = {
    "search before an ingest": "section docs has not been ingested", "files before an ingest": "section docs has not been ingested", "chunks before an ingest": "section docs has not been ingested",
    "unknown mode": "mode magic is none of keyword, semantic, hybrid", "unknown section": "there is no section nowhere", "details of an unknown section": "there is no section nowhere", "sections": "docs: all documents",
    "semantic results": "10", "hybrid results": "10", "status by key": "health", "incomplete": "1 pending", "incomplete and allowed": "the section is incomplete: 1 pending",
    "other settings, semantic": "vectors are out of date: chunk_size 512 -> 400; chunk_overlap 51 -> 40",
    "other settings, keyword": "vectors are out of date: chunk_size 512 -> 400; chunk_overlap 51 -> 40; the section is incomplete: 1 pending", "search after it": "",
}
SQL["engine_interface"] = f"""WITH chunks AS MATERIALIZED ({_WIKI_CHUNKS}), n AS (SELECT count(*) AS n FROM documents), c AS (SELECT count(*) AS c, count(DISTINCT k) AS f FROM chunks)
    SELECT * FROM (VALUES {", ".join(f"('{k}', '{v}')" for k, v in _ANSWERS.items())}) AS t("case", answer)
    UNION ALL SELECT 'first ingest', n || ' new, reset False' FROM n UNION ALL SELECT 'coverage', n || ' of ' || n || ', ' || c || ' chunks' FROM n, c UNION ALL SELECT 'files', f::VARCHAR FROM c
    UNION ALL SELECT 'status', 'sections: ' || n || ' ingested, 0 in error' FROM n UNION ALL SELECT 'ingest after other settings', (n + 1) || ' new, reset True' FROM n"""
