"""Evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as el, search as se
from .registry import cte, query
from .search import K, Search, fallback, vector_hits
from .sqlbase import half_even

# ---- dataset checks: planted faults over the bound tables ----

cte("case_rows", """
SELECT n AS case_no, CASE WHEN n = 4 THEN NULL WHEN n = 5 THEN 'src1' ELSE run_id END AS case_id, CASE WHEN n = 6 THEN 'go' ELSE 'find problems' END AS goal
FROM (SELECT DISTINCT run_id, CAST(regexp_extract(run_id, '([0-9]+)$', 1) AS INTEGER) AS n FROM reviews)
""")
cte("case_reviews", """
SELECT CAST(regexp_extract(run_id, '([0-9]+)$', 1) AS INTEGER) AS case_no,
  CASE WHEN ord % 53 = 0 THEN '' WHEN ord % 31 = 0 THEN 'dup' ELSE review_id END AS review_id,
  CASE WHEN ord % 29 = 0 THEN '2.5' ELSE CAST(rating AS VARCHAR) END AS rating, CASE WHEN ord % 37 = 0 THEN '  ' ELSE content_original END AS content
FROM reviews WHERE run_id <> 'src7'
""")
cte("case_expected", """
SELECT CAST(regexp_extract(run_id, '([0-9]+)$', 1) AS INTEGER) AS case_no, review_id FROM draft_evidence WHERE role = 'supporting'
""")


@query("eval_dataset_issues", "EVL-1", sql="""
SELECT CAST(case_no AS VARCHAR) AS label, 'missing case_id' AS problem, NULL AS item FROM case_rows WHERE case_id IS NULL
UNION ALL SELECT CAST(case_no AS VARCHAR), 'repeated case_id', case_id FROM case_rows QUALIFY case_id IS NOT NULL AND case_no > min(case_no) OVER (PARTITION BY case_id)
UNION ALL SELECT CAST(case_no AS VARCHAR), 'goal missing or short', NULL FROM case_rows WHERE length(goal) < 3
UNION ALL SELECT CAST(case_no AS VARCHAR), 'no reviews', NULL FROM case_rows WHERE case_no NOT IN (SELECT case_no FROM case_reviews)
UNION ALL SELECT CAST(case_no AS VARCHAR), 'review without id', NULL FROM case_reviews WHERE review_id = ''
UNION ALL SELECT CAST(case_no AS VARCHAR), 'repeated review id', review_id FROM case_reviews WHERE review_id <> '' GROUP BY case_no, review_id HAVING count(*) > 1
UNION ALL SELECT CAST(case_no AS VARCHAR), 'rating not a whole number 1-5', review_id FROM case_reviews WHERE review_id <> '' AND rating = '2.5'
UNION ALL SELECT CAST(case_no AS VARCHAR), 'blank content', review_id FROM case_reviews WHERE review_id <> '' AND trim(content) = ''
UNION ALL SELECT CAST(case_no AS VARCHAR), 'expected review unknown', review_id FROM case_expected WHERE case_no <> 7 AND (case_no, review_id) NOT IN (SELECT (case_no, review_id) FROM case_reviews)
UNION ALL SELECT CAST(case_no AS VARCHAR), 'topic not comparable', '订阅' FROM case_rows WHERE case_no % 5 = 0 AND case_no <> 7
""")
def _(t):
    n = F.regexp_extract("run_id", r"(\d+)$", 1).cast("int")
    o = F.col("ord")
    cases = t.analysis_runs.select(
        n.alias("case_no"), F.when(n == 4, F.lit(None)).when(n == 5, "src1").otherwise(F.col("run_id")).alias("case_id"),
        F.when(n == 6, "go").otherwise("find problems").alias("goal"))
    reviews = t.reviews.where("run_id <> 'src7'").select(
        n.alias("case_no"), F.when(o % 53 == 0, "").when(o % 31 == 0, "dup").otherwise(F.col("review_id")).alias("review_id"),
        F.when(o % 29 == 0, "2.5").otherwise(F.col("rating").cast("string")).alias("rating"),
        F.when(o % 37 == 0, "  ").otherwise(F.col("content_original")).alias("content"))
    expected = t.draft_evidence.where("role = 'supporting'").select(n.alias("case_no"), "review_id")
    topics = cases.select("case_no", F.when(F.col("case_no") % 5 == 0, "订阅").otherwise("Billing Terms").alias("topic"))
    return el.eval_dataset_issues(cases, reviews, expected, topics)


cte("qs", """SELECT query_ord AS query_no, CASE WHEN query_ord % 11 = 3 THEN '' WHEN query_ord % 11 = 4 THEN 'q1' ELSE query_id END AS query_id,
  CASE WHEN query_ord % 7 = 2 THEN ' ab ' ELSE query END AS query, CASE WHEN query_ord % 5 = 1 THEN 'fr' ELSE language END AS language FROM bench_queries""")
cte("ex", "SELECT query_ord AS query_no, 'd' || (query_ord * 50) AS review_id FROM bench_queries WHERE query_ord % 6 <> 0")


@query("eval_query_issues", "EVL-2", sql="""
SELECT CAST(query_no AS VARCHAR) AS label, 'missing query_id' AS problem, NULL AS item FROM qs WHERE query_id = ''
UNION ALL (SELECT CAST(query_no AS VARCHAR), 'repeated query_id', query_id FROM (SELECT * FROM qs WHERE query_id <> '') QUALIFY query_no > min(query_no) OVER (PARTITION BY query_id))
UNION ALL SELECT CAST(query_no AS VARCHAR), 'query too short', NULL FROM qs WHERE length(trim(query)) < 5
UNION ALL SELECT CAST(query_no AS VARCHAR), 'language not zh or en', NULL FROM qs WHERE language NOT IN ('zh', 'en')
UNION ALL SELECT CAST(query_no AS VARCHAR), 'no expected review', NULL FROM qs WHERE query_no NOT IN (SELECT query_no FROM ex)
UNION ALL SELECT CAST(query_no AS VARCHAR), 'expected review unknown', review_id FROM ex WHERE review_id NOT IN (SELECT review_id FROM reviews)
""")
def _(t):
    n = F.col("query_ord")
    queries = t.queries.select(
        n.alias("query_no"), F.when(n % 11 == 3, "").when(n % 11 == 4, "q1").otherwise(F.col("query_id")).alias("query_id"),
        F.when(n % 7 == 2, " ab ").otherwise(F.col("query")).alias("query"), F.when(n % 5 == 1, "fr").otherwise(F.col("language")).alias("language"))
    expected = t.queries.where("query_ord % 6 <> 0").select(n.alias("query_no"), F.concat(F.lit("d"), n * 50).alias("review_id"))
    return el.query_dataset_issues(queries, expected, t.reviews)


@query("topic_keys", "EVL-3", sql="""
SELECT ord, lower(regexp_replace(regexp_replace(regexp_replace(content_original, '[^\\x00-\\x7F]', '', 'g'), '[^0-9a-zA-Z]+', '_', 'g'), '^_+|_+$', '', 'g')) AS topic_key FROM reviews
""")
def _(t):
    from ..functions import text as X

    return t.reviews.select("ord", X.topic_key("content_original").alias("topic_key"))


# ---- retrieval scores: some expected reviews are found, some are not ----

cte("gold", """
SELECT query_id, 'd' || ord AS review_id FROM bq_found JOIN bench_queries USING (query_id) WHERE (place + query_ord) % 3 = 0
UNION SELECT query_id, review_id FROM bench_queries JOIN reviews ON ord % 97 = query_ord
""")


def scores_sql(found: str) -> str:
    hit = lambda k: f"count(DISTINCT f.review_id) FILTER (WHERE g.review_id IS NOT NULL AND f.place <= {k})"
    return f"""
SELECT q.query_id, q.language, {', '.join(half_even(f"CASE WHEN w = 0 THEN 1 ELSE CAST(h{k} AS DOUBLE) / w END", 3) + f' AS recall_{k}' for k in (1, 3, 5))},
  {half_even('coalesce(CAST(1 AS DOUBLE) / first_hit, 0)', 3)} AS mrr,
  {half_even('CASE WHEN n = 0 AND w = 0 THEN 1 WHEN n = 0 THEN 0 ELSE CAST(h5 AS DOUBLE) / n END', 3)} AS precision_5
FROM bench_queries q
JOIN (SELECT q.query_id, (SELECT count(*) FROM gold x WHERE x.query_id = q.query_id) AS w, {hit(1)} AS h1, {hit(3)} AS h3, {hit(5)} AS h5,
        min(f.place) FILTER (WHERE g.review_id IS NOT NULL) AS first_hit, count(f.review_id) AS n
      FROM bench_queries q LEFT JOIN (SELECT query_id, 'd' || ord AS review_id, place FROM {found}) f USING (query_id)
      LEFT JOIN gold g ON g.query_id = f.query_id AND g.review_id = f.review_id GROUP BY q.query_id) s USING (query_id)"""


cte("keyword_scores", scores_sql("bq_found"))


def gold_and_found(t):
    found = Search(t).found.select("query_id", F.concat(F.lit("d"), "ord").alias("review_id"), "place")
    lucky = found.join(t.queries.select("query_id", "query_ord"), "query_id").where("(place + query_ord) % 3 = 0").select("query_id", "review_id")
    other = t.reviews.select("review_id", (F.col("ord") % 97).alias("query_ord")).join(t.queries.select("query_id", "query_ord"), "query_ord").select("query_id", "review_id")
    return lucky.unionByName(other).distinct(), found


@query("eval_retrieval_scores", "EVL-4", sql="SELECT * FROM keyword_scores")
def _(t):
    gold, found = gold_and_found(t)
    return el.retrieval_scores(t.queries, gold, found)


@query("eval_retrieval_ranks", "EVL-4", sql="SELECT g.query_id, g.review_id, min(f.place) AS rank FROM gold g LEFT JOIN bq_found f ON f.query_id = g.query_id AND 'd' || f.ord = g.review_id GROUP BY ALL")
def _(t):
    return el.retrieval_ranks(*gold_and_found(t))


def mean_sql(c: str) -> str:
    return half_even(f"CAST(sum(CAST(round({c} * 1000) AS BIGINT)) AS DOUBLE) / CAST(1000 AS DOUBLE) / count({c})", 3)


@query("eval_retrieval_summary", "EVL-5", sql=f"""
SELECT language, count(*) AS queries, {', '.join(f'{mean_sql(m)} AS {m}' for m in ('recall_1', 'recall_3', 'recall_5', 'mrr', 'precision_5'))}
FROM keyword_scores GROUP BY GROUPING SETS ((), (language))
""")
def _(t):
    gold, found = gold_and_found(t)
    return el.retrieval_summary(el.retrieval_scores(t.queries, gold, found))


cte("hybrid_found", f"""
SELECT query_id, ord, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, w_rank NULLS LAST, v_rank NULLS LAST) AS place FROM (
  SELECT coalesce(w.query_id, v.query_id) AS query_id, coalesce(w.ord, v.ord) AS ord, w.rank AS w_rank, v.rank AS v_rank,
         round(CAST(0.6 AS DOUBLE) * coalesce(w.score, 0) + CAST(0.4 AS DOUBLE) * coalesce(v.score, 0), 9) AS s, w.ord IS NOT NULL OR v.platform <> 'social' AS ok
  FROM bq_allowed w FULL JOIN (SELECT * FROM vec_hits WHERE query_id IN (SELECT query_id FROM bq_allowed)) v ON w.query_id = v.query_id AND w.ord = v.ord)
WHERE ok QUALIFY place <= {K}
""")


@query("eval_compare_configs", "EVL-6", sql=f"""
SELECT count(*) FILTER (WHERE h.recall_5 > k.recall_5) AS improved, count(*) FILTER (WHERE h.recall_5 < k.recall_5) AS worse,
  count(*) FILTER (WHERE h.recall_5 = k.recall_5) AS tied, count(f.query_id) AS fallbacks, {mean_sql('h.recall_3')} >= 0.5 AS passed
FROM keyword_scores k JOIN ({scores_sql('hybrid_found')}) h USING (query_id) LEFT JOIN (SELECT DISTINCT parent AS query_id FROM fallback) f USING (query_id)
""")
def _(t):
    s = Search(t)
    gold, found = gold_and_found(t)
    keyword = el.retrieval_scores(t.queries, gold, found)
    fused = se.hybrid_fuse(s.ranked.where("platform <> 'social'"), vector_hits(t), K)
    hybrid = el.retrieval_scores(t.queries, gold, fused.select("query_id", F.concat(F.lit("d"), "ord").alias("review_id"), "place"))
    return el.compare_configs(keyword, hybrid, "recall_5", se.fallback_queries(*fallback(t)), 0.5)


# ---- extraction scores: three repeats of the bound drafts ----

cte("eval_runs", "SELECT DISTINCT run_id AS case_id, rep FROM reviews, (VALUES (0), (1), (2)) r(rep)")
cte("eval_findings", """
SELECT run_id AS case_id, rep, finding_index, CASE WHEN finding_index = 3 THEN '' ELSE topic_key END AS topic_key
FROM drafts, (VALUES (0), (1), (2)) r(rep) WHERE (finding_index + rep) % 3 <> 0
""")
cte("eval_predicted", """
SELECT DISTINCT f.case_id, f.rep, e.review_id FROM eval_findings f JOIN draft_evidence e ON e.run_id = f.case_id AND e.finding_index = f.finding_index WHERE e.role = 'supporting'
""")
cte("eval_expected", "SELECT run_id AS case_id, 'd' || doc_id AS review_id FROM labelled WHERE quality = 1 AND doc_id % 2 = 0")
cte("eval_topics", "SELECT run_id AS case_id, unnest(['Topic 0', 'billing-terms', '订阅']) AS topic FROM analysis_runs WHERE run_id <> 'src2'")
cte("eval_topic_keys", "SELECT case_id, unnest(['topic_0', 'billing_terms']) AS k FROM (SELECT DISTINCT case_id FROM eval_topics)")


class Eval:
    def __init__(self, t):
        reps = F.explode(F.sequence(F.lit(0), F.lit(2)))
        self.runs = t.analysis_runs.select(F.col("run_id").alias("case_id"), reps.alias("rep"))
        self.findings = t.drafts.select(F.col("run_id").alias("case_id"), reps.alias("rep"), "finding_index", "topic_key").where(
            "(finding_index + rep) % 3 <> 0").withColumn("topic_key", F.when(F.col("finding_index") == 3, "").otherwise(F.col("topic_key")))
        support = t.draft_evidence.where("role = 'supporting'").select(F.col("run_id").alias("case_id"), "finding_index", "review_id")
        self.predicted = self.findings.join(support, ["case_id", "finding_index"]).select("case_id", "rep", "review_id")
        self.expected = t._labelled.where("quality = 1 and doc_id % 2 = 0").select(
            F.col("run_id").alias("case_id"), F.concat(F.lit("d"), "doc_id").alias("review_id"))
        words = F.array(F.lit("Topic 0"), F.lit("billing-terms"), F.lit("订阅"))
        self.topics = t.analysis_runs.where("run_id <> 'src2'").select(F.col("run_id").alias("case_id"), F.explode(words).alias("topic"))
        self.reviews = t.reviews.select(F.col("run_id").alias("case_id"), "review_id")

    def scores(self):
        return el.score_predictions(self.runs, self.expected, self.topics, self.findings, self.predicted)

    def quality(self):
        return el.prediction_quality(self.runs, self.reviews, self.expected, self.topics, self.findings, self.predicted)


def share(common, size, other):
    return half_even(f"CASE WHEN {size} = 0 AND {other} = 0 THEN 1 WHEN {size} = 0 THEN 0 ELSE CAST({common} AS DOUBLE) / {size} END", 3)


cte("eval_scores", f"""
SELECT case_id, rep, {share('tc', 'te', 'tp')} AS topic_recall, {share('rc', 'rp', 're')} AS reference_precision, {share('rc', 're', 'rp')} AS reference_recall FROM (
  SELECT case_id, rep,
    (SELECT count(*) FROM eval_topic_keys k WHERE k.case_id = r.case_id) AS te,
    (SELECT count(DISTINCT topic_key) FROM eval_findings f WHERE f.case_id = r.case_id AND f.rep = r.rep AND topic_key <> '') AS tp,
    (SELECT count(DISTINCT topic_key) FROM eval_findings f JOIN eval_topic_keys k ON k.case_id = f.case_id AND k.k = f.topic_key WHERE f.case_id = r.case_id AND f.rep = r.rep) AS tc,
    (SELECT count(*) FROM eval_expected e WHERE e.case_id = r.case_id) AS re,
    (SELECT count(*) FROM eval_predicted p WHERE p.case_id = r.case_id AND p.rep = r.rep) AS rp,
    (SELECT count(*) FROM eval_predicted p JOIN eval_expected e USING (case_id, review_id) WHERE p.case_id = r.case_id AND p.rep = r.rep) AS rc
  FROM eval_runs r)
""")
cte("eval_quality", f"""
SELECT case_id, rep, {half_even('CASE WHEN cited = 0 THEN 0 ELSE CAST(invented AS DOUBLE) / cited END', 3)} AS hallucination_rate,
  {half_even('CASE WHEN n = 0 THEN 1 ELSE CAST(keyed AS DOUBLE) / n END', 3)} AS topic_key_coverage,
  CASE WHEN wanted = 0 OR found > 0 THEN CAST(1 AS DOUBLE) ELSE 0 END AS topic_found_by_evidence,
  {half_even('CASE WHEN te = 0 THEN 1 ELSE CAST(tp AS DOUBLE) / te END', 3)} AS topic_granularity FROM (
  SELECT case_id, rep,
    (SELECT count(*) FROM eval_predicted p WHERE p.case_id = r.case_id AND p.rep = r.rep) AS cited,
    (SELECT count(*) FROM eval_predicted p WHERE p.case_id = r.case_id AND p.rep = r.rep AND p.review_id LIKE 'x%') AS invented,
    (SELECT count(*) FROM eval_predicted p JOIN eval_expected e USING (case_id, review_id) WHERE p.case_id = r.case_id AND p.rep = r.rep) AS found,
    (SELECT count(*) FROM eval_expected e WHERE e.case_id = r.case_id) AS wanted,
    (SELECT count(*) FROM eval_findings f WHERE f.case_id = r.case_id AND f.rep = r.rep) AS n,
    (SELECT count(*) FROM eval_findings f WHERE f.case_id = r.case_id AND f.rep = r.rep AND topic_key <> '') AS keyed,
    (SELECT count(DISTINCT topic_key) FROM eval_findings f WHERE f.case_id = r.case_id AND f.rep = r.rep) AS tp,
    (SELECT count(*) FROM eval_topics k WHERE k.case_id = r.case_id) AS te
  FROM eval_runs r)
""")
cte("eval_stability", f"""
SELECT case_id, CAST(3 AS BIGINT) AS runs, {half_even('sum(j) / 3', 3)} AS stability FROM (
  SELECT a.case_id, CASE WHEN len(list_distinct(list_concat(a.s, b.s))) = 0 THEN 1 ELSE len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))) END AS j
  FROM (SELECT r.case_id, r.rep, coalesce(list(DISTINCT topic_key) FILTER (WHERE topic_key IS NOT NULL), []) AS s FROM eval_runs r LEFT JOIN eval_findings USING (case_id, rep) GROUP BY ALL) a
  JOIN (SELECT r.case_id, r.rep, coalesce(list(DISTINCT topic_key) FILTER (WHERE topic_key IS NOT NULL), []) AS s FROM eval_runs r LEFT JOIN eval_findings USING (case_id, rep) GROUP BY ALL) b
  ON a.case_id = b.case_id AND a.rep < b.rep) GROUP BY case_id
""")


@query("eval_predictions", "EVL-7", sql="SELECT * FROM eval_scores")
def _(t):
    return Eval(t).scores()


@query("eval_quality", "EVL-8", sql="SELECT * FROM eval_quality")
def _(t):
    return Eval(t).quality()


@query("eval_stability", "EVL-9", sql="SELECT * FROM eval_stability")
def _(t):
    e = Eval(t)
    return el.topic_stability(e.runs, e.findings)


METRICS = ["topic_recall", "reference_precision", "reference_recall", "hallucination_rate", "topic_key_coverage", "topic_found_by_evidence", "topic_granularity"]


@query("eval_aggregate", "EVL-10", sql=f"""
SELECT count(*) AS cases, {', '.join(f'{mean_sql(m)} AS {m}' for m in METRICS)},
  {half_even("CAST(count(*) FILTER (WHERE case_id <> 'src5') AS DOUBLE) / count(*)", 3)} AS structured_output_success, {mean_sql('stability')} AS stability
FROM (SELECT s.*, q.* EXCLUDE (case_id, rep), CASE WHEN length(case_id) = 5 THEN t.stability END AS stability FROM eval_scores s JOIN eval_quality q USING (case_id, rep) JOIN eval_stability t USING (case_id) WHERE rep = 0)
""")
def _(t):
    e = Eval(t)
    rows = e.scores().join(e.quality(), ["case_id", "rep"]).where("rep = 0").join(el.topic_stability(e.runs, e.findings), "case_id")
    rows = rows.withColumn("stability", F.when(F.length("case_id") == 5, F.col("stability"))).withColumn(
        "structured_output_success", F.col("case_id") != "src5")
    return el.aggregate_eval(rows, METRICS)


def long(df, rep):
    return df.where(F.col("rep") == rep).unpivot(["case_id"], METRICS[:4], "metric", "value")


@query("eval_compare_reports", "EVL-11", sql="""
SELECT case_id, metric, a.value AS before, b.value AS after, CAST(printf('%.3f', b.value - a.value) AS DOUBLE) AS delta,
  coalesce(CASE WHEN metric = 'hallucination_rate' THEN CAST(printf('%.3f', b.value - a.value) AS DOUBLE) ELSE -CAST(printf('%.3f', b.value - a.value) AS DOUBLE) END > CAST(0.05 AS DOUBLE), false) AS regressed
FROM (SELECT * FROM (UNPIVOT (SELECT s.case_id, topic_recall, reference_precision, reference_recall, hallucination_rate FROM eval_scores s JOIN eval_quality USING (case_id, rep) WHERE rep = 0)
        ON topic_recall, reference_precision, reference_recall, hallucination_rate INTO NAME metric VALUE value) WHERE metric <> 'topic_recall' OR case_id <> 'src4') a
FULL JOIN (UNPIVOT (SELECT s.case_id, topic_recall, reference_precision, reference_recall, hallucination_rate FROM eval_scores s JOIN eval_quality USING (case_id, rep) WHERE rep = 1)
        ON topic_recall, reference_precision, reference_recall, hallucination_rate INTO NAME metric VALUE value) b USING (case_id, metric)
""")
def _(t):
    e = Eval(t)
    both = e.scores().join(e.quality(), ["case_id", "rep"])
    before = long(both, 0).where("metric <> 'topic_recall' or case_id <> 'src4'")
    return el.compare_reports(before, long(both, 1), ["case_id"], 0.05)


@query("eval_report_mismatch", "EVL-11", sql="""
SELECT o_orderkey AS report_id, o_orderkey % 5 <> o_orderkey % 7 AS fingerprint_differs, o_custkey % 2 = 1 AS dataset_differs FROM orders
""")
def _(t):
    o = t.raw("orders")
    a = o.select(F.col("o_orderkey").alias("report_id"), (F.col("o_orderkey") % 5).alias("fingerprint"), F.lit("gold").alias("dataset"))
    b = o.select(F.col("o_orderkey").alias("report_id"), (F.col("o_orderkey") % 7).alias("fingerprint"),
                 F.when(F.col("o_custkey") % 2 == 1, "other").otherwise("gold").alias("dataset"))
    return el.report_mismatch(a, b, ["report_id"])


@query("eval_metric_trend", "EVL-12", sql="""
SELECT event_id AS ord, user_id % 5 AS fingerprint, event_type AS metric, value,
  value - lag(value) OVER (PARTITION BY user_id % 5, event_type ORDER BY event_id) AS delta FROM events
""")
def _(t):
    history = t.raw("events").select(F.col("event_id").alias("ord"), (F.col("user_id") % 5).alias("fingerprint"), F.col("event_type").alias("metric"), "value")
    return el.metric_trend(history)
