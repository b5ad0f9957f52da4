"""The same table rules as `bindings.py`, in SQL, for checking."""

from .registry import cte

WS = (
    r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)


def norm(c: str) -> str:
    return f"trim(regexp_replace({c}, '[{WS}]+', ' ', 'g'))"


def fold(c: str) -> str:
    return f"replace(lower({c}), 'ß', 'ss')"


def comp(c: str) -> str:
    return f"regexp_replace({fold(c)}, '[^\\p{{L}}\\p{{N}}_{WS}]', '', 'g')"


def half_even(x: str, digits: int) -> str:
    return f"CAST(printf('%.{digits}f', CAST({x} AS DOUBLE)) AS DOUBLE)"


cte("reviews", f"""
SELECT 'd' || doc_id AS review_id, doc_id AS ord, source AS run_id, source AS app_id,
       text AS content_original,
       CAST(1 + unicode(substr({norm('text')}, 1, 1)) % 5 AS INTEGER) AS rating,
       lang AS language,
       CASE WHEN doc_id % 10 = 9 THEN 'social' WHEN doc_id % 2 = 0 THEN 'app-store' ELSE 'google-play' END AS platform,
       '1.' || (doc_id % 3) AS app_version,
       TIMESTAMP '2024-01-01' + to_hours(doc_id) AS published_at
FROM documents
""")
cte("shared_id_reviews", "SELECT * REPLACE ('d' || (ord // 2) AS review_id) FROM reviews")
cte("known_reviews", "SELECT run_id, review_id, ord FROM reviews WHERE ord % 23 <> 0")
cte("labelled", """
SELECT d.source AS run_id,
       CASE d.lang WHEN 'de' THEN 0 WHEN 'en' THEN 1 WHEN 'es' THEN 2 ELSE 3 END AS finding_index,
       d.doc_id, l.quality
FROM documents d JOIN labels l USING (doc_id)
""")
cte("drafts", """
SELECT DISTINCT run_id, finding_index, 'Finding ' || run_id || ' ' || finding_index AS title,
       'Topic ' || (finding_index // 2) AS topic_label, 'topic_' || (finding_index // 2) AS topic_key
FROM labelled
""")
cte("draft_evidence", """
SELECT run_id, finding_index, 'supporting' AS role, 'd' || doc_id AS review_id, doc_id AS pos FROM labelled WHERE quality = 1
UNION ALL SELECT run_id, finding_index, 'supporting', 'd' || doc_id, doc_id + 1000000000 FROM labelled WHERE quality = 1 AND doc_id % 10 = 3
UNION ALL SELECT run_id, finding_index, 'conflicting', 'd' || doc_id, doc_id FROM labelled WHERE quality = 1 AND doc_id % 9 = 0
UNION ALL SELECT run_id, finding_index, 'conflicting', 'd' || doc_id, doc_id FROM labelled WHERE quality = 0
UNION ALL SELECT run_id, finding_index, 'supporting', 'x' || doc_id, doc_id + 2000000000 FROM labelled WHERE doc_id % 41 = 0
""")
cte("audits", """
SELECT * FROM (
  SELECT run_id, finding_index, 'd' || doc_id AS review_id,
         CASE WHEN doc_id % 11 = 0 THEN 'irrelevant' WHEN doc_id % 11 = 1 THEN 'conflicting' ELSE 'supporting' END AS role,
         'reason ' || doc_id AS rationale, doc_id AS pos
  FROM labelled WHERE doc_id % 13 <> 0 AND doc_id % 23 <> 0
  UNION ALL SELECT run_id, finding_index, 'd' || doc_id, 'conflicting', 'reason ' || doc_id, doc_id + 1000000000
  FROM labelled WHERE doc_id % 13 <> 0 AND doc_id % 23 <> 0 AND doc_id % 17 = 0
  UNION ALL SELECT run_id, finding_index, 'u' || doc_id, 'supporting', 'reason ' || doc_id, doc_id + 2000000000
  FROM labelled WHERE doc_id % 29 = 0
) WHERE NOT (run_id = 'src3' AND finding_index = 0)
""")
cte("requirement_drafts", """
SELECT run_id, finding_index * 3 + k AS draft_no, 'Need ' || run_id || ' ' || finding_index || ' ' || k AS title,
       1 + (finding_index + k) % 5 AS impact,
       CASE (finding_index * 3 + k) % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS complexity
FROM drafts, (VALUES (0), (1), (2)) v(k)
""")
cte("requirement_draft_links", """
SELECT run_id, draft_no, 0 AS pos, printf('F-%03d', draft_no // 3 + 1) AS finding_id FROM requirement_drafts WHERE draft_no % 3 < 2
UNION ALL SELECT run_id, draft_no, 1, printf('F-%03d', (draft_no // 3 + 1) % 4 + 1) FROM requirement_drafts WHERE draft_no % 3 = 1
UNION ALL SELECT run_id, draft_no, 2, printf('F-%03d', draft_no // 3 + 1) FROM requirement_drafts WHERE draft_no % 3 = 1
UNION ALL SELECT run_id, draft_no, 0, 'F-099' FROM requirement_drafts WHERE draft_no % 3 = 2
UNION ALL SELECT run_id, draft_no, 1, printf('F-%03d', draft_no // 3 + 1) FROM requirement_drafts WHERE draft_no % 3 = 2
""")
cte("test_drafts", """
SELECT run_id, draft_no, pos, 'Check ' || draft_no || ' ' || pos AS title,
       CASE pos % 4 WHEN 0 THEN 'normal' WHEN 1 THEN 'exception' WHEN 2 THEN 'boundary' ELSE 'regression' END AS case_type
FROM requirement_drafts, (VALUES (0), (1), (2), (3), (4)) v(pos) WHERE pos <= draft_no % 5
""")
cte("analysis_runs", """
SELECT run_id, input_count,
       CASE WHEN n % 7 = 0 THEN 'partial' WHEN n % 7 = 1 THEN 'running' ELSE 'completed' END AS status,
       CASE WHEN n % 2 = 0 THEN 'online' ELSE 'import' END AS source_type,
       40 + n AS review_limit, CASE WHEN n % 3 = 0 THEN 'replay' ELSE 'live' END AS mode, n % 3 <> 0 AS is_live
FROM (SELECT run_id, count(*) AS input_count, CAST(regexp_extract(run_id, '([0-9]+)$', 1) AS INTEGER) AS n
      FROM reviews GROUP BY run_id)
""")
cte("corpus", """
SELECT review_id, ord, app_id, content_original AS content, language, platform,
       CASE WHEN ord % 5 = 0 THEN 'import:csv' ELSE 'import:json' END AS source
FROM reviews
""")
cte("bench_queries", f"""
SELECT 'q' || item_id || form AS query_id, item_id AS query_ord,
       CASE form WHEN '' THEN {norm('text')} ELSE array_to_string(list_slice(string_split({norm('text')}, ' '), 1, 4), ' ') END AS query,
       CASE WHEN item_id % 2 = 0 THEN 'en' ELSE 'zh' END AS language
FROM benchmark, (VALUES (''), ('s')) f(form)
""")
cte("model_usage", """
SELECT event_id AS id, user_id AS run_id, CASE WHEN event_id % 10 = 7 THEN NULL ELSE event_type END AS stage,
       CASE event_id % 4 WHEN 0 THEN 'deepseek-chat' WHEN 1 THEN 'deepseek-chat-x' WHEN 2 THEN 'gpt-4o-mini' ELSE 'other-model' END AS model,
       CAST(floor(value * 10) AS BIGINT) AS prompt_tokens, event_id % 500 AS completion_tokens,
       value AS latency_ms, ts AS created_at
FROM events
""")
cte("priced_usage", """
SELECT *, prompt_tokens + completion_tokens AS total_tokens,
       CASE WHEN model LIKE 'gpt-4o-mini%' THEN prompt_tokens * 15 + completion_tokens * 60
            ELSE prompt_tokens * 27 + completion_tokens * 110 END AS cost_e8
FROM model_usage
""")
cte("job_status", """
SELECT event_id AS ord, user_id AS job_id,
       CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'waiting_for_model' ELSE 'completed' END AS status, ts
FROM events
""")
cte("ops_runs", """
SELECT o_orderkey AS run_id, o_custkey AS app_url,
       (['pending','running','waiting_for_model','completed','partial','failed','timed_out','cancelled'])[CAST(o_orderkey % 8 + 1 AS INTEGER)] AS status,
       CASE WHEN o_orderkey % 16 = 0 THEN 'owner' END AS lease_owner,
       o_orderdate AS updated_at, o_orderdate - to_hours(o_orderkey % 100) AS created_at,
       CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate END AS heartbeat_at
FROM orders
""")
cte("reports", """
SELECT o_orderkey AS report_id, o_custkey AS app_url, o_orderdate AS created_at, o_orderkey % 4 AS findings_count FROM orders
""")
