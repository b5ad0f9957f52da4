"""Search queries."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import search as se
from ..operators import text_index
from ..session import stage_path
from .bindings import Tables
from .registry import cte, query

K = 5

TOKENS = r"""list_filter(string_split_regex(strip_accents(regexp_replace(lower({c}), '([\x{{4e00}}-\x{{9fff}}])', ' \1 ', 'g')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"""
cte("doc_tokens", f"SELECT ord, review_id, app_id, platform, content, {TOKENS.format(c='content')} AS t FROM corpus")
cte("token_rows", "SELECT ord, app_id, platform, len(t) AS n_tokens, unnest(t) AS term, unnest(range(len(t))) AS pos FROM doc_tokens")
cte("corpus_totals", "SELECT count(*) AS n_docs, sum(len(t)) AS n_tokens FROM doc_tokens")


def phrase_cte(prefix: str, source: str) -> None:
    """Latin queries only: every run is one phrase, split where the tokenizer splits it."""
    cte(f"{prefix}_phrases", f"""
SELECT query_id, phrase_no, count(*) OVER (PARTITION BY query_id, phrase_no) AS n_terms, off, term FROM (
  SELECT query_id, phrase_no, unnest(range(len(ts))) AS off, unnest(ts) AS term FROM (
    SELECT query_id, phrase_no, list_filter(string_split(run, '_'), lambda x: x <> '') AS ts FROM (
      SELECT query_id, unnest(range(len(r))) AS phrase_no, unnest(r) AS run FROM (
        SELECT query_id, regexp_extract_all(lower(query), '[a-z0-9_]+') AS r FROM {source})))) """)
    cte(f"{prefix}_hits", f"""
SELECT query_id, phrase_no, ord, app_id, platform, n_tokens, count(*) AS tf FROM (
  SELECT p.query_id, p.phrase_no, p.n_terms, k.ord, k.app_id, k.platform, k.n_tokens, k.pos - p.off AS start
  FROM {prefix}_phrases p JOIN token_rows k USING (term)
  GROUP BY ALL HAVING count(*) = p.n_terms)
GROUP BY ALL""")
    cte(f"{prefix}_scored", f"""
SELECT query_id, ord, app_id, platform, count(*) = any_value(n_all) AS strict,
       round(sum(CASE WHEN idf <= 0 THEN 1e-6 ELSE idf END * (tf * 2.2) / (tf + CAST(1.2 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * h.n_tokens / (c.n_tokens / c.n_docs)))), 9) AS raw_score
FROM {prefix}_hits h
JOIN (SELECT query_id, phrase_no, ln((any_value(n_docs) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM {prefix}_hits, corpus_totals GROUP BY ALL) f USING (query_id, phrase_no)
JOIN (SELECT query_id, count(DISTINCT phrase_no) AS n_all FROM {prefix}_phrases GROUP BY ALL) n USING (query_id), corpus_totals c
GROUP BY query_id, ord, app_id, platform""")


def ranked(scored: str, group: str, limit: int) -> str:
    return f"""
SELECT *, CASE WHEN max(raw_score) OVER w > min(raw_score) OVER w
  THEN (raw_score - min(raw_score) OVER w) / (max(raw_score) OVER w - min(raw_score) OVER w) ELSE 1 END AS score FROM (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY strict DESC, raw_score DESC, ord) AS rank FROM {scored})
  WHERE rank <= {limit} QUALIFY strict = max(strict) OVER (PARTITION BY {group}))
WINDOW w AS (PARTITION BY {group})"""


phrase_cte("bq", "bench_queries")
cte("bq_ranked", ranked("bq_scored", "query_id", 3 * K))
cte("bq_allowed", "SELECT * FROM bq_ranked WHERE platform <> 'social'")
cte("bq_found", f"SELECT query_id, ord, app_id, platform, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS place FROM bq_allowed QUALIFY place <= {K}")


_INDEXES: dict[tuple[str, str], text_index.Index] = {}


def index(t: Tables) -> text_index.Index:
    """The stored index of the corpus; made once for a session and its input."""
    key = (t.spark.sparkContext.applicationId, t.sf_dir)
    if key not in _INDEXES:
        _INDEXES[key] = text_index.create(t.corpus, stage_path(t.spark, "text-index"))
    return _INDEXES[key]


class Search:
    """Shared steps of the search queries."""

    def __init__(self, t: Tables):
        self.t = t

    @cached_property
    def ranked(self):
        return se.bm25_topk(self.t.queries, self.t.corpus, 3 * K, index=index(self.t))

    @cached_property
    def found(self):
        return se.search_app(self.ranked, K)

    @cached_property
    def with_text(self):
        docs = self.t.corpus.select("ord", "review_id", "content")
        return self.found.join(docs, "ord")


@query("search_tokens", "RET-1", sql="SELECT ord, count(*) AS n, CAST(sum(length(term)) AS BIGINT) AS chars, CAST(bit_xor(CAST('0x' || substr(sha256(term || '|' || pos), 1, 15) AS BIGINT)) AS BIGINT) AS digest FROM token_rows GROUP BY ord")
def _(t):
    return se.tokenize(t.corpus).groupBy("ord").agg(
        F.count("*").alias("n"), F.sum(F.length("term")).alias("chars"),
        F.bit_xor(X.sha_int(F.concat_ws("|", "term", "pos"))).alias("digest"),
    )


@query("search_index", "RET-2", sql="""
SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS tf, CAST(sum(n_tokens) AS BIGINT) AS n_tokens,
       CAST(bit_xor(CAST('0x' || substr(sha256(ord || '|' || positions), 1, 15) AS BIGINT)) AS BIGINT) AS digest
FROM (SELECT term, ord, n_tokens, count(*) AS tf, string_agg(pos, ',' ORDER BY pos) AS positions FROM token_rows GROUP BY ALL) GROUP BY term
""")
def _(t):
    where = F.concat_ws("|", "ord", F.array_join(F.col("positions").cast("array<string>"), ","))
    return index(t).postings().groupBy("term").agg(
        F.count("*").alias("df"), F.sum(F.size("positions")).alias("tf"), F.sum("n_tokens").alias("n_tokens"), F.bit_xor(X.sha_int(where)).alias("digest"))


@query("search_term_stats", "RET-2", sql="SELECT term, count(DISTINCT ord) AS df, count(*) AS occurrences FROM token_rows GROUP BY term")
def _(t):
    return index(t).blocks().groupBy("term").agg(F.sum("n").alias("df"), F.sum(F.aggregate("docs", F.lit(0).cast("bigint"), lambda n, d: n + d["tf"])).alias("occurrences"))


@query("search_phrases", "RET-3", sql="SELECT query_id, CAST(phrase_no AS VARCHAR) || '.0' AS phrase_no, term, CAST(off AS INTEGER) AS \"offset\" FROM bq_phrases")
def _(t):
    return se.compile_queries(t.queries).select("query_id", "phrase_no", "term", "offset")


@query("search_matches", "RET-4", sql="SELECT query_id, CAST(phrase_no AS VARCHAR) || '.0' AS phrase_no, ord, CAST(tf AS INTEGER) AS tf FROM bq_hits")
def _(t):
    phrases = se.compile_queries(t.queries)
    return se.match_phrases(phrases, index(t).postings(phrases)).select("query_id", "phrase_no", "ord", "tf")


@query("search_bm25", "RET-5", "RET-6", sql="SELECT query_id, ord, strict, rank, round(raw_score, 6) AS raw_score, round(score, 5) AS score FROM bq_ranked")
def _(t):
    return Search(t).ranked.select(
        "query_id", "ord", "strict", "rank", F.round("raw_score", 6).alias("raw_score"), F.round("score", 5).alias("score"))


@query("search_app", "RET-7", sql="SELECT query_id, ord, place, round(score, 5) AS score FROM bq_found")
def _(t):
    return Search(t).found.select("query_id", "ord", "place", F.round("score", 5).alias("score"))


APPS = "SELECT query_id, 'src' || ((query_ord * 3 + i) % 20) AS app_id, i AS app_ord FROM bench_queries, range(4) r(i)"
cte("query_apps", APPS)
cte("many_ranked", ranked("(SELECT s.*, a.app_ord FROM bq_scored s JOIN query_apps a USING (query_id, app_id))", "query_id, app_id", 3 * K))
cte("many_found", f"""
SELECT query_id, app_id, ord, score, rank, app_ord, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, app_ord, rank) AS place FROM (
  SELECT * FROM many_ranked WHERE platform <> 'social' QUALIFY row_number() OVER (PARTITION BY query_id, app_id ORDER BY score DESC, rank) <= {K}) QUALIFY place <= {K}""")


def query_apps(t):
    return t.queries.select("query_id", "query_ord", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("app_ord")).select(
        "query_id", "app_ord", F.concat(F.lit("src"), (F.col("query_ord") * 3 + F.col("app_ord")) % 20).alias("app_id"))


@query("search_many_apps", "RET-10", sql="SELECT query_id, app_id, ord, place, round(score, 5) AS score FROM many_found")
def _(t):
    return se.search_many(t.queries, t.corpus, query_apps(t), K, index=index(t)).select("query_id", "app_id", "ord", "place", F.round("score", 5).alias("score"))


cte("vec_hits", f"""
SELECT q.query_id, v.vec_id AS ord, c.platform, round(list_cosine_similarity(q.e, CAST(v.embedding AS DOUBLE[])), 9) AS score,
       row_number() OVER (PARTITION BY q.query_id ORDER BY round(list_cosine_similarity(q.e, CAST(v.embedding AS DOUBLE[])), 9) DESC, v.vec_id) AS rank
FROM (SELECT b.query_id, CAST(e.embedding AS DOUBLE[]) AS e FROM bench_queries b JOIN embeddings e ON e.vec_id = b.query_ord) q, embeddings v JOIN corpus c ON c.ord = v.vec_id
WHERE round(list_cosine_similarity(q.e, CAST(v.embedding AS DOUBLE[])), 9) > 0 QUALIFY rank <= {3 * K}""")


def vector_hits(t):
    e = t.raw("embeddings").select(F.col("vec_id").alias("ord"), "embedding")
    docs = e.join(t.corpus.select("ord", "platform"), "ord")
    asked = t.queries.join(e, F.col("query_ord") == F.col("ord")).select("query_id", "embedding")
    return se.vector_topk(asked, docs, 3 * K, keep=["platform"])


@query("search_vectors", "RET-8", sql="SELECT query_id, ord, rank, round(score, 6) AS score FROM vec_hits")
def _(t):
    return vector_hits(t).select("query_id", "ord", "rank", F.round("score", 6).alias("score"))


@query("search_hybrid", "RET-9", sql=f"""
SELECT query_id, ord, round(s, 5) AS score, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, w_rank NULLS LAST, v_rank NULLS LAST) AS place FROM (
  SELECT coalesce(w.query_id, v.query_id) AS query_id, coalesce(w.ord, v.ord) AS ord, w.rank AS w_rank, v.rank AS v_rank,
         round(CAST(0.6 AS DOUBLE) * coalesce(w.score, 0) + CAST(0.4 AS DOUBLE) * coalesce(v.score, 0), 9) AS s, w.ord IS NOT NULL OR v.platform <> 'social' AS ok
  FROM bq_allowed w FULL JOIN (SELECT * FROM vec_hits WHERE query_id IN (SELECT query_id FROM bq_allowed)) v ON w.query_id = v.query_id AND w.ord = v.ord)
WHERE ok QUALIFY place <= {K}
""")
def _(t):
    keyword = Search(t).ranked.where("platform <> 'social'")
    return se.hybrid_fuse(keyword, vector_hits(t), K).select("query_id", "ord", F.round("score", 5).alias("score"), "place")


# Queries that miss (a made-up word) with variants taken from the real text.
cte("odd_queries", "SELECT query_id, CASE WHEN query_ord % 2 = 0 THEN 'zzqx' || query_ord ELSE query END AS query FROM bench_queries")
cte("variants", """
SELECT query_id, 0 AS variant_ord, 'zzqx' || query_ord AS variant FROM bench_queries
UNION ALL SELECT query_id, 1, ' ' || query || ' ' FROM bench_queries
UNION ALL SELECT query_id, 2, string_split(query, ' ')[1] || ' ' || string_split(query, ' ')[2] FROM bench_queries
UNION ALL SELECT query_id, 3, query FROM bench_queries
""")
cte("fallback", """
SELECT v.query_id AS parent, v.query_id || '/' || min(variant_ord) AS query_id, min(variant_ord) AS variant_ord, trim(variant) AS query
FROM variants v JOIN odd_queries q USING (query_id) WHERE v.query_id NOT IN (SELECT query_id FROM oq_ranked WHERE platform <> 'social') AND trim(variant) <> q.query GROUP BY v.query_id, trim(variant)
""")
phrase_cte("oq", "odd_queries")
cte("oq_ranked", ranked("oq_scored", "query_id", 3 * K))
phrase_cte("fb", "fallback")
cte("fb_ranked", ranked("fb_scored", "query_id", 3 * K))
cte("fb_found", f"SELECT query_id, ord, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS place FROM fb_ranked WHERE platform <> 'social' QUALIFY place <= {K}")


def fallback(t):
    odd = F.concat(F.lit("zzqx"), "query_ord")
    queries = t.queries.withColumn("query", F.when(F.col("query_ord") % 2 == 0, odd).otherwise(F.col("query")))
    words = F.split("query", " ")
    v = F.array(odd, F.concat(F.lit(" "), "query", F.lit(" ")), F.concat_ws(" ", words[0], words[1]), F.col("query"))
    variants = t.queries.select("query_id", F.posexplode(v).alias("variant_ord", "variant"))
    hits = se.search_app(se.bm25_topk(queries, t.corpus, 3 * K, index=index(t)), K)
    return queries, hits, variants


@query("search_rewrite_gate", "RET-11", sql="SELECT query_id AS variant_id, parent AS query_id, CAST(variant_ord AS INTEGER) AS variant_ord, query FROM fallback")
def _(t):
    return se.fallback_queries(*fallback(t))


@query("search_rewrite_merge", "RET-11", sql=f"""
SELECT query_id, ord, row_number() OVER (PARTITION BY query_id ORDER BY best.place, best.variant_ord) AS place FROM (
  SELECT f.parent AS query_id, h.ord, min({{'place': h.place, 'variant_ord': f.variant_ord}}) AS best FROM fb_found h JOIN fallback f USING (query_id) GROUP BY ALL)
QUALIFY place <= {K}
""")
def _(t):
    gate = se.fallback_queries(*fallback(t))
    rounds = se.search_app(se.bm25_topk(gate.select(F.col("variant_id").alias("query_id"), "query"), t.corpus, 3 * K, index=index(t)), K)
    named = rounds.withColumnRenamed("query_id", "variant_id").join(gate.select("variant_id", "query_id", "variant_ord"), "variant_id")
    return se.merge_rounds(named, K).select("query_id", "ord", "place")


@query("search_context", "RET-12", sql="""
SELECT query_id, string_agg('[' || place || '] review_id=' || review_id || ' app=' || f.app_id || ' platform=' || f.platform || chr(10) || content, chr(10) ORDER BY place) AS context
FROM bq_found f JOIN doc_tokens d USING (ord) GROUP BY query_id
""")
def _(t):
    return se.render_evidence(Search(t).with_text)


# Citations made from the hits: a true quote, a false one, one without text, one of an unknown id.
cte("citations", """
SELECT query_id, place * 10 AS pos, review_id, CASE WHEN place % 3 = 0 THEN 'never said this at all' WHEN place % 3 = 1 THEN substr(content, 3, 30) ELSE ' ' END AS quote
FROM bq_found JOIN doc_tokens USING (ord) WHERE query_id NOT IN ('q1', 'q3')
UNION ALL SELECT query_id, place * 10 + 1, review_id, substr(content, 1, 20) FROM bq_found JOIN doc_tokens USING (ord) WHERE place % 2 = 0 AND query_id NOT IN ('q1', 'q3')
UNION ALL SELECT query_id, 999, 'd-none', 'text' FROM bench_queries WHERE query_ord % 5 = 0
""")
cte("valid_citations", """
SELECT c.query_id, c.review_id, min(c.pos) AS pos, arg_min(c.quote, c.pos) AS quote
FROM citations c JOIN doc_tokens d USING (review_id) JOIN bq_found f ON f.query_id = c.query_id AND f.ord = d.ord
WHERE regexp_replace(c.quote, '\\s+', '', 'g') <> '' AND contains(regexp_replace(d.content, '\\s+', '', 'g'), regexp_replace(c.quote, '\\s+', '', 'g'))
GROUP BY ALL
""")


def citations(t, hits):
    h = hits.where(~F.col("query_id").isin("q1", "q3"))
    p = F.col("place")
    quote = F.when(p % 3 == 0, "never said this at all").when(p % 3 == 1, F.substring("content", 3, 30)).otherwise(" ")
    a = h.select("query_id", (p * 10).alias("pos"), "review_id", quote.alias("quote"))
    b = h.where(p % 2 == 0).select("query_id", (p * 10 + 1).alias("pos"), "review_id", F.substring("content", 1, 20).alias("quote"))
    c = t.queries.where("query_ord % 5 = 0").select("query_id", F.lit(999).alias("pos"), F.lit("d-none").alias("review_id"), F.lit("text").alias("quote"))
    return a.unionByName(b).unionByName(c)


@query("search_citations", "RET-13", sql="SELECT query_id, review_id, CAST(pos AS INTEGER) AS pos, quote FROM valid_citations")
def _(t):
    hits = Search(t).with_text
    return se.verify_citations(citations(t, hits), hits)


@query("search_answers", "RET-14", sql="""
SELECT q.query_id, coalesce(v.n, 0) AS n_citations, coalesce(v.n, 0) > 0 AS evidence_sufficient,
  CASE WHEN coalesce(h.n, 0) = 0 THEN '语料为空或无匹配评论' WHEN q.query_ord % 9 = 8 THEN '模型调用失败' WHEN coalesce(v.n, 0) > 0 THEN ''
       WHEN coalesce(g.n, 0) > 0 THEN '模型引用未通过校验，视为证据不足' WHEN q.query_ord % 2 = 1 THEN 'too little' ELSE '模型未提供证据引用' END AS limitation
FROM bench_queries q LEFT JOIN (SELECT query_id, count(*) AS n FROM bq_found GROUP BY ALL) h USING (query_id)
LEFT JOIN (SELECT query_id, count(*) AS n FROM valid_citations GROUP BY ALL) v USING (query_id)
LEFT JOIN (SELECT query_id, count(*) AS n FROM citations GROUP BY ALL) g USING (query_id)
""")
def _(t):
    hits = Search(t).with_text
    limitation = F.when(F.col("query_ord") % 2 == 1, "too little").otherwise("")
    answers = t.queries.where("query_ord % 9 <> 8").select("query_id", limitation.alias("limitation"))
    return se.answer_status(t.queries, hits, answers, citations(t, hits))


@query("search_answers_no_model", "RET-14", sql="""
SELECT q.query_id, least(coalesce(h.n, 0), 5) AS n_citations, coalesce(h.n, 0) > 0 AS evidence_sufficient,
  CASE WHEN coalesce(h.n, 0) = 0 THEN '语料为空或无匹配评论' ELSE '模型未配置，仅展示检索结果' END AS limitation
FROM bench_queries q LEFT JOIN (SELECT query_id, count(*) AS n FROM bq_found GROUP BY ALL) h USING (query_id)
""")
def _(t):
    return se.answer_status(t.queries, Search(t).found, None, None)


@query("corpus_distribution", "RET-15", sql="SELECT app_id, language, source, count(*) AS n FROM corpus GROUP BY GROUPING SETS ((app_id), (language), (source))")
def _(t):
    return se.corpus_distribution(t.corpus)


@query("corpus_apps", "RET-15", sql="SELECT DISTINCT app_id FROM corpus ORDER BY app_id")
def _(t):
    return t.corpus.select("app_id").distinct().orderBy("app_id")


@query("embeddings_backfilled", "RET-16", sql="""
SELECT ord, CASE WHEN v.vec_id IS NULL THEN CAST(length(content) AS DOUBLE) ELSE round(CAST(v.embedding[1] AS DOUBLE), 6) END AS first
FROM corpus c LEFT JOIN embeddings v ON v.vec_id = c.ord
UNION ALL SELECT vec_id, round(CAST(embedding[1] AS DOUBLE), 6) FROM embeddings WHERE vec_id NOT IN (SELECT ord FROM corpus)
""")
def _(t):
    def embed(texts):
        return [[float(len(x)), 1.0] for x in texts]

    known = t.raw("embeddings").select(F.col("vec_id").alias("ord"), "embedding")
    return se.backfill_embeddings(t.corpus, known, embed).select("ord", F.round(F.col("embedding")[0].cast("double"), 6).alias("first"))


@query("embeddings_refused", "RET-16", sql="""
SELECT ord, 'ValueError' AS error FROM corpus WHERE length(content) % 7 = 0 AND ord NOT IN (SELECT vec_id FROM embeddings)
UNION ALL SELECT ord, 'vector' FROM corpus WHERE length(content) % 7 <> 0 OR ord IN (SELECT vec_id FROM embeddings)
UNION ALL SELECT vec_id, 'vector' FROM embeddings WHERE vec_id NOT IN (SELECT ord FROM corpus)
""")
def _(t):
    """An embedder that refuses some texts: their errors are rows, all others get their vectors."""
    def embed(texts):
        if any(len(x) % 7 == 0 for x in texts):
            raise ValueError("refused")
        return [[float(len(x)), 1.0] for x in texts]

    known = t.raw("embeddings").select(F.col("vec_id").alias("ord"), "embedding")
    vectors, failed = se.embed_missing(t.corpus, known, embed, 16)
    return failed.unionByName(vectors.select("ord", F.lit("vector").alias("error")))
