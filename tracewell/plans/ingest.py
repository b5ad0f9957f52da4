"""Ingestion, sink and inference queries over landed texts made from the given tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import clean, inference as inf, model_chain as mc
from ..session import stage_path, staged
from ..sources import feeds, keyed, reviews as rv, sinks
from .cleaning import batched
from .ops import NOW, priced
from .registry import cte, query
from .sqlbase import norm
from ..operators.usage import budget_status

# ---- review files: one landed text per 20 documents, with planted faults ----


def landed(t):
    """JSON texts of 20 records each: alternating shapes and field names, a byte order mark, bad rows."""
    d = t.raw("documents").select("doc_id", X.normalize_text("text").alias("body"))
    n = F.col("doc_id")
    date = F.when(n % 19 == 4, "03/02/2026").when(n % 2 == 0, F.concat(F.lit("2026-01-"), F.lpad((n % 28 + 1).cast("string"), 2, "0"))).otherwise(
        F.concat(F.lit("2026-01-"), F.lpad((n % 28 + 1).cast("string"), 2, "0"), F.lit("T10:00:00+02:00")))
    rating = F.when(n % 23 == 5, "2.5").when(n % 23 == 6, "9").when(n % 23 == 7, "true").when(n % 2 == 0, F.concat((n % 5 + 1).cast("string"), F.lit(".0"))).otherwise((n % 5 + 1).cast("string"))
    even = F.to_json(F.struct(
        F.when(n % 6 != 0, F.concat(F.lit("d"), n)).alias("review_id"), F.when(n % 17 != 3, F.col("body")).alias("content"),
        rating.alias("rating"), date.alias("date"), F.lit("").alias("language"), F.lit("de").alias("语言")))
    odd = F.to_json(F.struct(
        F.lit("").alias("review_id"), F.concat(F.lit("d"), n).alias("评论 ID"), F.when(n % 17 != 3, F.col("body")).alias("评论原文"),
        rating.alias("评分"), date.alias("发布时间"), F.lit("1.2").alias("App 版本")))
    rows = d.select(F.expr("doc_id div 20").alias("file"), "doc_id", F.when(n % 2 == 0, even).otherwise(odd).alias("j"))
    grouped = rows.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("doc_id", "j"))).alias("l"))
    array = F.concat(F.lit("["), F.array_join(F.col("l.j"), ","), F.lit("]"))
    value = F.when(F.col("file") % 7 == 3, "{broken").when(F.col("file") % 7 == 5, F.concat(F.lit("﻿"), array)).when(
        F.col("file") % 2 == 0, array).otherwise(F.concat(F.lit('{"reviews":'), array, F.lit("}")))
    return grouped.select("file", value.alias("value"))


cte("landed_rows", """
SELECT doc_id // 20 AS file, doc_id % 20 + 1 AS n, doc_id, CASE WHEN doc_id % 2 = 1 OR doc_id % 6 <> 0 THEN 'd' || doc_id ELSE 'import-app-' || (doc_id % 20 + 1) END AS review_id,
  CASE WHEN doc_id % 17 <> 3 THEN length(trim(regexp_replace(text, '[""" + r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}" + """]+', ' ', 'g'))) END AS chars,
  CASE WHEN doc_id % 23 = 5 THEN '2.5' WHEN doc_id % 23 = 6 THEN '9' WHEN doc_id % 23 = 7 THEN 'true' WHEN doc_id % 2 = 0 THEN (doc_id % 5 + 1) || '.0' ELSE CAST(doc_id % 5 + 1 AS VARCHAR) END AS rating,
  CASE WHEN doc_id % 2 = 0 THEN 'de' END AS language, CASE WHEN doc_id % 2 = 1 THEN '1.2' END AS app_version,
  doc_id % 19 = 4 AS bad_date, doc_id % 28 + 1 AS day
FROM documents WHERE (doc_id // 20) % 7 <> 3
""")


def imported(t):
    rows = rv.record_columns(rv.parse_records(landed(t)))
    return rv.normalize_review_columns(rows.withColumns({"app_id": F.lit("app"), "source": F.lit("import:json"), "ord": F.col("n")}))


@query("ingest_json_columns", "SRC-1", "SRC-3", sql="""
SELECT file, n, NULL AS error, review_id, chars, rating, language, app_version, 'us' AS storefront, '' AS title FROM landed_rows
UNION ALL SELECT DISTINCT doc_id // 20, NULL, 'not JSON', NULL, NULL, NULL, NULL, NULL, 'us', '' FROM documents WHERE (doc_id // 20) % 7 = 3
""")
def _(t):
    return imported(t).select(
        "file", "n", "error", "review_id", F.length("content_original").alias("chars"), "rating", "language", "app_version", "storefront", "title")


@query("ingest_valid_rows", "SRC-4", sql="""
SELECT file, n, review_id, CAST(CAST(rating AS DOUBLE) AS INTEGER) AS rating,
  strftime(TIMESTAMP '2026-01-01 00:00:00' + to_days(CAST(day - 1 AS INTEGER)) + CASE WHEN doc_id % 2 = 1 THEN INTERVAL 8 HOUR ELSE INTERVAL 0 HOUR END, '%Y-%m-%d %H:%M:%S') AS published_at
FROM landed_rows WHERE chars IS NOT NULL AND NOT bad_date AND rating NOT IN ('2.5', '9', 'true')
""")
def _(t):
    good, _rejects = rv.validate_import(imported(t))
    return good.select("file", "n", "review_id", "rating", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published_at"))


@query("ingest_rejects", "SRC-4", sql="""
SELECT file, n, concat_ws('; ', CASE WHEN chars IS NULL THEN 'missing content' END,
  CASE WHEN rating IN ('2.5', 'true') THEN 'rating is not a whole number' END, CASE WHEN rating = '9' THEN 'rating outside 1-5' END,
  CASE WHEN bad_date THEN 'date is not ISO 8601' END) AS reasons
FROM landed_rows WHERE chars IS NULL OR bad_date OR rating IN ('2.5', '9', 'true')
UNION ALL SELECT DISTINCT doc_id // 20, NULL, 'not JSON; missing content; missing rating; missing date' FROM documents WHERE (doc_id // 20) % 7 = 3
""")
def _(t):
    _good, rejects = rv.validate_import(imported(t))
    return rejects.select("file", "n", F.array_join("reasons", "; ").alias("reasons"))


# ---- feed pages: 10 documents per page, five pages per app ----


def feed_entries(t):
    d = t.raw("documents").select("doc_id", X.normalize_text("text").alias("body"))
    n = F.col("doc_id")
    label = lambda c: F.struct(c.cast("string").alias("label"))
    return d.select(
        F.concat(F.lit("app"), F.expr("doc_id div 50")).alias("app_id"), (F.expr("doc_id div 10") % 5 + 1).alias("page"), "doc_id",
        F.to_json(F.struct(
            F.when(n % 11 != 3, label(F.concat(F.lit("e"), n % 40))).alias("id"), label(F.lit("t")).alias("title"),
            label(F.col("body")).alias("content"), F.when(n % 10 != 0, label(F.when(n % 13 == 5, "x").otherwise((n % 5 + 1).cast("string")))).alias("im:rating"),
            label(F.lit("1.0")).alias("im:version"), label(F.when(n % 12 == 7, "soon").otherwise("2026-02-01T00:00:00-07:00")).alias("updated"),
            F.struct(label(F.concat(F.lit("user"), n)).alias("name")).alias("author"))).alias("j"))


def pages_of(entries, keys, before, after):
    grouped = entries.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("doc_id", "j"))).alias("l"))
    return grouped.select(*keys, F.concat(F.lit(before), F.array_join(F.col("l.j"), ","), F.lit(after)).alias("body"))


@query("ingest_store_feed", "SRC-5", sql=f"""
SELECT app_id, review_id, rating, author, ord, n_chars, digest FROM (
  SELECT *, row_number() OVER (PARTITION BY app_id ORDER BY page, idx) AS ord FROM (
    SELECT app_id, page, idx, length(body) AS n_chars, md5(body) AS digest, 'user' || doc_id AS author, CAST(doc_id % 5 + 1 AS INTEGER) AS rating, CASE WHEN doc_id % 11 <> 3 THEN 'e' || (doc_id % 40) ELSE 'apple-' || page || '-' || idx END AS review_id
    FROM (SELECT doc_id, {norm('text')} AS body, 'app' || (doc_id // 50) AS app_id, (doc_id // 10) % 5 + 1 AS page, row_number() OVER (PARTITION BY doc_id // 10 ORDER BY doc_id) - 1 AS idx FROM documents WHERE doc_id % 10 <> 0)
    WHERE doc_id % 13 <> 5 AND doc_id % 12 <> 7
    QUALIFY row_number() OVER (PARTITION BY app_id, CASE WHEN doc_id % 11 <> 3 THEN 'e' || (doc_id % 40) ELSE 'apple-' || page || '-' || idx END ORDER BY page, idx) = 1))
WHERE ord <= 30
""")
def _(t):
    pages = pages_of(feed_entries(t), ["app_id", "page"], '{"feed":{"entry":[', "]}}").withColumn("storefront", F.lit("us"))
    rows = feeds.parse_store_feed(pages, 30)
    return rows.select("app_id", "review_id", "rating", "author", "ord", F.length("content_original").cast("bigint").alias("n_chars"), F.md5("content_original").alias("digest"))


def json_text(column):
    """A text as a JSON string."""
    whole = F.to_json(F.struct(F.col(column).alias("t")))
    return F.substr(whole, F.lit(6), F.length(whole) - 6)


@query("ingest_play_pages", "SRC-6", sql=r"""
SELECT 'g' || doc_id AS review_id, CASE WHEN doc_id % 4 = 1 THEN 3 ELSE CAST(doc_id % 5 + 1 AS INTEGER) END AS rating,
  CASE WHEN doc_id % 9 = 2 THEN '（无正文）' ELSE regexp_replace('title ' || doc_id || chr(10) || text, '\s+$', '') END AS content_original,
  CASE doc_id % 4 WHEN 3 THEN '2020-01-01' ELSE '2026-01-05' END AS day
FROM documents
""")
def _(t):
    n = F.col("doc_id")
    date = F.when(n % 4 == 0, "2026-01-05").when(n % 4 == 1, "2026/01/05").when(n % 4 == 2, "Jan 5, 2026").otherwise("yesterday")
    rating = F.when(n % 4 == 1, '"many"').otherwise((n % 5 + 1).cast("string"))
    body = F.when(n % 9 == 2, '["",[""],null]').otherwise(F.concat(F.lit('["title '), n, F.lit('",['), json_text("text"), F.lit("],null]")))
    row = F.concat(F.lit('["g'), n, F.lit('",["a","u","","'), date, F.lit('"],'), rating, F.lit(",null,"), body, F.lit(",null]"))
    entries = t.raw("documents").select((F.expr("doc_id div 40")).alias("page"), "doc_id", row.alias("j"))
    pages = pages_of(entries, ["page"], ")]}'\n[[null,[", "]],null,[]]").withColumns({"package": F.lit("com.app"), "lang": F.lit("en_US")})
    out = feeds.parse_play_pages(pages, F.lit("2020-01-01 00:00:00").cast("timestamp"))
    return out.select("review_id", "rating", "content_original", F.date_format("published_at", "yyyy-MM-dd").alias("day"))


@query("ingest_social_posts", "SRC-7", sql="""
SELECT conv_id, CASE WHEN turn % 3 = 1 THEN 'reddit-' || (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) ELSE 'reddit-' || conv_id || 'x' || turn END AS review_id,
  length(trim(text)) + 2 AS chars, strftime(make_timestamp(CAST(conv_id * 86400 AS BIGINT) * 1000000), '%Y-%m-%d') AS day
FROM conversations WHERE role = 'user'
""")
def _(t):
    c = t.raw("conversations")
    post = F.to_json(F.struct(F.struct(
        F.when(F.col("turn") % 3 == 1, "").otherwise(F.concat_ws("x", "conv_id", "turn")).alias("id"),
        F.when(F.col("role") == "user", "T").otherwise(" ").alias("title"), F.when(F.col("role") == "user", F.trim("text")).otherwise("").alias("selftext"),
        (F.col("conv_id") * 86400).cast("double").alias("created_utc"), F.lit("me").alias("author")).alias("data")))
    grouped = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", post.alias("j")))).alias("l"))
    raw = grouped.select("conv_id", F.concat(F.lit('{"data":{"children":['), F.array_join(F.col("l.j"), ","), F.lit("]}}")).alias("body"))
    out = feeds.parse_social_posts(raw, "reddit")
    return out.select("conv_id", "review_id", F.length("content_original").alias("chars"), F.date_format("published_at", "yyyy-MM-dd").alias("day"))


@query("ingest_app_urls", "SRC-8", sql="""
SELECT page_id, CASE k WHEN 0 THEN 'app-store' WHEN 1 THEN 'google-play' WHEN 2 THEN 'google-play' END AS store,
  CASE WHEN k = 0 THEN 'us' END AS country, CASE WHEN k = 0 THEN 'slug-' || page_id END AS slug,
  CASE k WHEN 0 THEN CAST(page_id + 100 AS VARCHAR) WHEN 1 THEN 'com.p' || page_id WHEN 2 THEN 'com.p' || page_id END AS app_id,
  CASE k WHEN 1 THEN 'en_US' WHEN 2 THEN 'de' END AS lang, k > 2 AS rejected FROM (SELECT page_id, page_id % 5 AS k FROM pages)
""")
def _(t):
    p, k = F.col("page_id"), F.col("page_id") % 5
    url = (
        F.when(k == 0, F.concat(F.lit(" https://Apps.apple.com/US/app/slug-"), p, F.lit("/id"), p + 100, F.lit("?mt=8")))
        .when(k == 1, F.concat(F.lit("https://play.google.com/store/apps/details?id=com.p"), p))
        .when(k == 2, F.concat(F.lit("https://play.google.com/store/apps/details?id=com.p"), p, F.lit("&hl=de")))
        .when(k == 3, F.lit("https://play.google.com/store/apps/details?x=1")).otherwise(F.col("url")))
    return feeds.extract_app_urls(t.raw("pages").select("page_id", url.alias("u")), "u").drop("u")


# ---- sinks ----


cte("upserted", """
SELECT review_id, arg_max(length(content), (load, ord)) AS chars, arg_max(app_id, (load, ord)) AS app_id, max(load) AS load FROM (
  SELECT review_id, content, app_id, 0 AS load, ord FROM corpus
  UNION ALL SELECT CASE WHEN ord % 5 < 2 THEN 'd' || (ord - ord % 2) ELSE 'n' || ord END, content || '!', app_id || 'n', 1, ord FROM corpus) GROUP BY review_id
""")


def second_load(t):
    """Every review once more: two of five under the id of an even one, the rest under new ids."""
    ids = F.when(F.col("ord") % 5 < 2, F.concat(F.lit("d"), F.col("ord") - F.col("ord") % 2)).otherwise(F.concat(F.lit("n"), "ord"))
    return t.corpus.withColumns({"review_id": ids, "content": F.concat("content", F.lit("!")), "app_id": F.concat("app_id", F.lit("n"))})


@query("corpus_upserted", "SNK-1", sql="SELECT review_id, chars, app_id FROM upserted")
def _(t):
    table = keyed.create(t.corpus, stage_path(t.spark, "corpus"), "review_id", ["ord"])
    table.upsert(second_load(t), ["ord"])
    return table.read().select("review_id", F.length("content").alias("chars"), "app_id")


@query("corpus_upserted_plain", "SNK-1", sql="SELECT review_id, chars, app_id FROM upserted")
def _(t):
    """The same as one aggregate over both loads, nothing stored."""
    return sinks.upsert_corpus(t.corpus, second_load(t)).select("review_id", F.length("content").alias("chars"), "app_id")


@query("corpus_compacted", "SNK-1", "STR-2", sql="""
SELECT app_id, count(*) AS n, CAST(sum(chars) AS BIGINT) AS chars FROM (
  SELECT CASE WHEN load = 0 THEN app_id ELSE left(app_id, length(app_id) - 1) END AS app_id, chars FROM upserted) WHERE app_id <> 'src3' GROUP BY app_id
""")
def _(t):
    """Two loads, an app deleted, old versions merged and emptied: what readers see stays the same."""
    table = keyed.create(t.corpus, stage_path(t.spark, "corpus"), "review_id", ["ord"])
    table.upsert(second_load(t), ["ord"])
    table.delete(F.col("app_id").isin("src3", "src3n"))
    table.compact()
    table.vacuum()
    app = F.when(F.col("app_id").endswith("n"), F.substr("app_id", F.lit(1), F.length("app_id") - 1)).otherwise(F.col("app_id"))
    return table.read().groupBy(app.alias("app_id")).agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("chars"))


@query("corpus_app_deleted", "SNK-2", sql="""
SELECT 'corpus' AS "table", count(*) FILTER (WHERE app_id <> 'src3') AS kept FROM corpus
UNION ALL SELECT 'embeddings', count(*) FROM embeddings WHERE 'd' || vec_id NOT IN (SELECT review_id FROM corpus WHERE app_id = 'src3')
UNION ALL SELECT 'removed', count(*) FROM corpus WHERE app_id = 'src3'
""")
def _(t):
    vectors = t.raw("embeddings").select(F.concat(F.lit("d"), "vec_id").alias("review_id"))
    corpus, kept, removed = sinks.delete_app(t.corpus, "src3", {"embeddings": vectors})
    count = lambda df, name: df.agg(F.count("*").alias("kept")).select(F.lit(name).alias("table"), "kept")
    return count(corpus, "corpus").unionByName(count(kept["embeddings"], "embeddings")).unionByName(
        removed.select(F.lit("removed").alias("table"), F.col("removed").alias("kept")))


@query("export_provenance", "SNK-5", sql="""
SELECT r.run_id, CASE WHEN a.is_live THEN '{"run_id":"' || r.run_id || '","review_id":"' || r.review_id || '","rating":' || r.rating || '}'
  ELSE '{"run_id":"' || r.run_id || '","review_id":"' || r.review_id || '","rating":' || r.rating || ',"mode":"' || a.mode || '","is_live":false}' END AS json
FROM reviews r JOIN analysis_runs a USING (run_id)
""")
def _(t):
    return sinks.provenance_json(t.reviews.select("run_id", "review_id", "rating"), t.analysis_runs)


# ---- inference ----

SYSTEM = "Find problems."
MODEL = ("deepseek-chat", 0, 4096)


def requests(t):
    """The requests of all batches, written once per query however often it reads them."""
    if "requests" not in t.__dict__:
        t.__dict__["requests"] = staged(built_requests(t), "requests")
    return t.__dict__["requests"]


def built_requests(t):
    content = clean.normalize_reviews(t.reviews)
    rows = batched(t).select("run_id", "ord", "batch").join(content.select("ord", "review_id", "rating", F.col("content_original").alias("content")), "ord")
    built = inf.build_requests(rows, ["run_id", "batch"], "ord", ["review_id", "rating", "content"], F.concat(F.lit("Goal: "), "run_id", F.lit("\n")), "\nEnd.")
    user = F.when(F.col("batch") % 5 == 4, F.concat(F.lit("same for "), "run_id")).otherwise(F.col("user"))
    return built.withColumns({"user": user, "schema_name": F.lit("batch"), "system": F.lit(SYSTEM)}).withColumn(
        "key", inf.cache_key(*MODEL, F.col("schema_name"), F.col("system"), F.col("user")))


cte("request_rows", """
SELECT p.run_id, p.batch, CASE WHEN p.batch % 5 = 4 THEN 'same for ' || p.run_id ELSE 'Goal: ' || p.run_id || chr(10)
  || CAST(to_json(list({'review_id': c.review_id, 'rating': c.rating, 'content': c.content} ORDER BY c.ord)) AS VARCHAR) || chr(10) || 'End.' END AS "user"
FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ord) - 1 AS row_index FROM clean_reviews) c JOIN packed p USING (run_id, row_index) GROUP BY p.run_id, p.batch
""")
cte("keyed_requests", """
SELECT *, sha256('deepseek-chat' || chr(31) || '0.0' || chr(31) || '4096' || chr(31) || 'batch' || chr(31) || 'Find problems.' || chr(31) || "user") AS key FROM request_rows
""")


@query("infer_requests", "INF-1", sql="SELECT run_id, batch, length(\"user\") AS chars, substr(sha256(\"user\"), 1, 16) AS digest FROM request_rows")
def _(t):
    return requests(t).select("run_id", "batch", F.length("user").alias("chars"), X.sha("user", 16).alias("digest"))


def cache(t):
    """Two thirds of the requests were answered before, half of those too long ago."""
    age = F.when(F.col("batch") % 3 == 0, "2024-01-29 00:00:00").otherwise("2024-01-01 00:00:00").cast("timestamp_ntz")
    answer = F.concat(F.lit('{"findings":[{"title":"'), "run_id", F.lit('","problem_statement":"p","topic_label":"L","topic_key":"Price Up!","reasoning_summary":"r","supporting_review_ids":["d1","d2"]}]}'))
    first = requests(t).where("batch % 3 < 2").groupBy("key").agg(F.min_by(F.struct("run_id", "batch"), "batch").alias("r")).select("key", "r.*")
    return first.select("key", F.lit("batch").alias("schema_name"), F.lit(MODEL[0]).alias("model"), answer.alias("response"), age.alias("created_at"), (F.col("batch") % 4).alias("hits"))


cte("cache_rows", """
SELECT key, min(batch) AS batch, CASE WHEN min(batch) % 3 = 0 THEN TIMESTAMP '2024-01-29' ELSE TIMESTAMP '2024-01-01' END AS created_at FROM keyed_requests WHERE batch % 3 < 2 GROUP BY key
""")


@query("infer_cache_lookup", "INF-2", sql="""
SELECT r.run_id, r.batch, r.key, c.key IS NOT NULL AS hit FROM keyed_requests r LEFT JOIN (SELECT * FROM cache_rows WHERE created_at >= TIMESTAMP '2024-01-23 12:00:00') c USING (key)
""")
def _(t):
    return inf.lookup_cache(requests(t), cache(t), NOW, 7).select("run_id", "batch", "key", "hit")


@query("infer_misses", "INF-3", sql="""
SELECT key, CASE WHEN any_value("user") LIKE 'same%' THEN NULL ELSE '{"n":' || any_value(length("user")) || '}' END AS response,
  CASE WHEN any_value("user") LIKE 'same%' THEN 'waiting' ELSE 'done' END AS status
FROM keyed_requests WHERE key NOT IN (SELECT key FROM cache_rows WHERE created_at >= TIMESTAMP '2024-01-23 12:00:00') GROUP BY key
""")
def _(t):
    def call(systems, users):
        if users[0].startswith("same"):
            raise TimeoutError("model busy")
        return [f'{{"n":{len(u)}}}' for u in users]

    looked = inf.lookup_cache(requests(t), cache(t), NOW, 7)
    return inf.infer_misses(looked, call, batch=1).select("key", "response", "status")


# Requests of equal text have one recording per schema: the latest. A text recorded under another schema alone is a miss of its own kind.
@query("infer_replay", "INF-4", sql="""
SELECT r.run_id, r.batch, CASE WHEN a.answer IS NOT NULL THEN 'answer ' || a.answer END AS response,
  CASE WHEN a.answer IS NOT NULL THEN NULL WHEN a.other THEN 'other schema recorded' ELSE 'not recorded' END AS miss
FROM request_rows r LEFT JOIN (
  SELECT "user", max(batch) FILTER (batch % 3 = 0) AS answer, bool_or(batch % 3 = 1) AS other FROM request_rows WHERE batch % 3 < 2 GROUP BY "user") a USING ("user")
""")
def _(t):
    r = requests(t)
    schema = F.when(F.col("batch") % 3 == 0, "batch").otherwise("audit")
    recording = r.where("batch % 3 < 2").select(
        inf.recording_key(schema, F.col("system"), F.col("user")).alias("key"), schema.alias("schema_name"), "system", "user",
        F.concat(F.lit("answer "), "batch").alias("response"), F.col("batch").alias("ord"))
    return inf.replay(r, recording).select("run_id", "batch", "response", "miss")


@query("infer_parsed", "INF-5", sql="""
SELECT key, 0 AS finding_index, 'price_up' AS topic_key, 'd' || i AS review_id, 'supporting' AS role FROM cache_rows, range(1, 3) r(i) WHERE batch % 4 <> 3
""")
def _(t):
    broken = F.when(F.col("hits") == 3, F.lit('{"findings":[{"title":"t","supporting_review_ids":[]}]}')).otherwise(F.col("response"))
    good, _bad = inf.parse_responses(cache(t).withColumn("response", broken), "batch")
    drafts, evidence = inf.finding_drafts(good, ["key"])
    return drafts.join(evidence, ["key", "finding_index"]).select("key", "finding_index", "topic_key", "review_id", "role")


@query("infer_cache_updated", "INF-6", sql="""
SELECT key, coalesce(c.batch % 4, 0) AS hits, CASE WHEN r.b % 2 = 0 THEN '2024-01-30' ELSE strftime(c.created_at, '%Y-%m-%d') END AS day
FROM (SELECT key, min(batch) AS b FROM keyed_requests GROUP BY key) r LEFT JOIN cache_rows c USING (key)
WHERE (CASE WHEN r.b % 2 = 0 THEN TIMESTAMP '2024-01-30' ELSE c.created_at END) >= TIMESTAMP '2024-01-23 12:00:00'
""")
def _(t):
    firsts = requests(t).groupBy("key").agg(F.min("batch").alias("b")).where("b % 2 = 0")
    new = firsts.select("key", F.lit("batch").alias("schema_name"), F.lit("m").alias("model"), F.lit("{}").alias("response"),
                        F.lit("2024-01-30 00:00:00").cast("timestamp_ntz").alias("created_at"))
    merged = inf.put_cache(cache(t), new)
    return inf.prune_cache(merged, NOW, 7).select("key", "hits", F.date_format("created_at", "yyyy-MM-dd").alias("day"))


@query("infer_cache_stats", "INF-6", sql="""
SELECT entries, hits, misses, CAST(printf('%.3f', CAST(hits AS DOUBLE) / (hits + misses)) AS DOUBLE) AS hit_rate FROM (
  SELECT count(*) AS entries, CAST(sum(batch % 4) AS BIGINT) AS hits,
    (SELECT count(*) FROM keyed_requests WHERE key NOT IN (SELECT key FROM cache_rows WHERE created_at >= TIMESTAMP '2024-01-23 12:00:00')) AS misses FROM cache_rows)
""")
def _(t):
    looked = inf.lookup_cache(requests(t), cache(t), NOW, 7)
    return inf.cache_stats(cache(t), looked.where("not hit"))


@query("infer_within_budget", "INF-7", sql="""
SELECT run_id, batch FROM request_rows WHERE run_id NOT IN (
  SELECT 'src' || (run_id % 20) FROM priced_usage GROUP BY 1 HAVING CAST(sum(cost_e8) AS DOUBLE) / 1e8 >= 0.2)
""")
def _(t):
    usage = priced(t).withColumn("run_id", F.concat(F.lit("src"), F.col("run_id") % 20))
    runs, _day = budget_status(usage, 0.2, 0, datetime(2024, 1, 30))
    return inf.allow_within_budget(requests(t), runs).select("run_id", "batch")


# ---- the dependent job of five request kinds, answered by rules that SQL can follow ----


def answer(kind):
    """A stand-in for a model: answers follow from the prompt by rule; every fifth consolidation fails."""
    import json

    def texts(systems, users):
        out = []
        for user in users:
            said = json.loads(user)
            if kind == "batch":
                ids = [r["review_id"] for r in said["reviews"]]
                out.append({"findings": [{"title": f"{len(ids)} reviews", "problem_statement": "p", "topic_label": "L", "topic_key": "k", "supporting_review_ids": [*ids[:2], "x9"],
                                          "conflicting_review_ids": ids[-1:], "reasoning_summary": "r", "limitations": []}]})
            elif kind == "consolidation":
                if int(said["analysis_goal"].removeprefix("goal src")) % 5 == 4:
                    raise TimeoutError("busy")
                out.append({"findings": said["candidate_findings"][:3]})
            elif kind == "audit":
                role = lambda e: "irrelevant" if e["rating"] == 3 else "supporting"
                out.append({"findings": [{"finding_index": c["finding_index"], "assessments": [{"review_id": e["review_id"], "role": role(e), "rationale_zh": "因"} for e in c["evidence"]]}
                                         for c in said["candidate_findings"]]})
            elif kind == "requirements":
                out.append({"requirements": [{"finding_ids": [f["finding_id"]], "title": f["title"], "impact": 1 + n, "complexity": "low", "proposed_version": "V1.0"}
                                             for n, f in enumerate(said["findings"])]})
            else:
                out.append({"test_cases": [{"title": f"{said['title']} / {k}", "steps": ["s"], "case_type": k} for k in ("normal", "boundary")]})
        return [json.dumps(x, ensure_ascii=False) for x in out]

    return texts


class ModelChain:
    """All five kinds over all runs, each written once."""

    def __init__(self, t):
        m = mc.Model(lambda kind: answer(kind), {k: f"Do {k}." for k in inf.SCHEMAS}, batch=1)
        content = clean.normalize_reviews(t.reviews)
        self.reviews = staged(batched(t).select("run_id", "ord", "batch").join(
            content.select("ord", "review_id", "rating", F.col("content_original").alias("content")), "ord"), "chain-reviews")
        self.goals = self.reviews.select("run_id").distinct().withColumn("goal", F.concat(F.lit("goal "), "run_id"))
        self.model = m

    def step(self, requests, kind):
        return mc.readable(self.model.ask(requests, kind), kind)

    def consolidation(self):
        good, _ = self.step(mc.batch_requests(self.reviews, self.goals), "batch")
        return mc.consolidation_requests(mc.candidates(good), self.reviews, self.goals)

    def findings(self):
        good, bad = self.step(self.consolidation(), "consolidation")
        return staged(mc.consolidated(good), "chain-findings"), bad

    def audits(self, findings):
        good, _ = self.step(mc.audit_requests(findings, self.reviews, self.goals), "audit")
        return mc.audit_rows(good)

    def plans(self, findings):
        """Findings with support after the audit go on; requirements and tests follow."""
        held = self.audits(findings).where("role = 'supporting'").groupBy("run_id", "finding_index").agg(F.count("*").alias("n"))
        rows = findings.join(held, ["run_id", "finding_index"], "left").select(
            "run_id", "finding_index", F.format_string("F-%03d", F.col("finding_index") + 1).alias("finding_id"), F.col("f.title").alias("title"),
            F.when(F.col("n") > 0, "supported").otherwise("rejected").alias("evidence_status"))
        good, _ = self.step(mc.requirement_requests(rows, self.goals, ["finding_id", "title"]), "requirements")
        return mc.requirement_rows(good)

    def tests(self, drafts):
        good, _ = self.step(mc.test_requests(drafts, ["run_id", "draft_no"], ["title", "impact"]), "tests")
        return mc.test_rows(good, ["run_id", "draft_no"])


cte("chain_items", """
SELECT run_id, batch, c.ord, c.review_id, c.rating, c.content, row_number() OVER (PARTITION BY run_id, batch ORDER BY c.ord) AS n, count(*) OVER (PARTITION BY run_id, batch) AS size
FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ord) - 1 AS row_index FROM clean_reviews) c JOIN packed p USING (run_id, row_index)
""")
cte("chain_candidates", """
SELECT run_id, batch, any_value(size) AS size, list_append(list(review_id ORDER BY n) FILTER (n <= 2), 'x9') AS supporting, list(review_id) FILTER (n = size) AS conflicting FROM chain_items GROUP BY run_id, batch
""")
cte("model_findings", """
SELECT run_id, CAST(batch AS INTEGER) AS finding_index, size || ' reviews' AS title, supporting, conflicting FROM chain_candidates
WHERE batch < 3 AND CAST(regexp_extract(run_id, '([0-9]+)$', 1) AS INTEGER) % 5 <> 4
""")
cte("chain_cited", """
SELECT run_id, finding_index, review_id, min(pos) AS pos FROM (
  SELECT run_id, finding_index, unnest(list_concat(supporting, conflicting)) AS review_id, unnest(range(len(supporting) + len(conflicting))) AS pos FROM model_findings) GROUP BY ALL
""")
cte("chain_audits", """
SELECT c.run_id, c.finding_index, c.review_id, CASE WHEN i.rating = 3 THEN 'irrelevant' ELSE 'supporting' END AS role,
       row_number() OVER (PARTITION BY c.run_id, c.finding_index ORDER BY c.pos) - 1 AS n
FROM chain_cited c JOIN chain_items i ON i.run_id = c.run_id AND i.review_id = c.review_id
""")
cte("chain_plans", """
SELECT f.run_id, row_number() OVER (PARTITION BY f.run_id ORDER BY finding_index) - 1 AS draft_no, printf('F-%03d', finding_index + 1) AS finding_id, title
FROM model_findings f WHERE EXISTS (SELECT 1 FROM chain_audits a WHERE a.run_id = f.run_id AND a.finding_index = f.finding_index AND role = 'supporting')
""")


@query("infer_consolidation_requests", "INF-1", sql="""
SELECT run_id, length(u) AS chars, substr(sha256(u), 1, 16) AS digest FROM (
  SELECT c.run_id, CAST(to_json({'analysis_goal': 'goal ' || c.run_id, 'candidate_findings': c.l, 'evidence_reviews': e.l}) AS VARCHAR) AS u
  FROM (SELECT run_id, list({'title': size || ' reviews', 'problem_statement': 'p', 'topic_label': 'L', 'topic_key': 'k', 'supporting_review_ids': supporting,
               'conflicting_review_ids': conflicting, 'reasoning_summary': 'r', 'limitations': CAST([] AS VARCHAR[])} ORDER BY batch) AS l FROM chain_candidates GROUP BY run_id) c
  JOIN (SELECT run_id, list({'review_id': review_id, 'rating': rating, 'content': content} ORDER BY ord) AS l FROM chain_items WHERE n <= 2 OR n = size GROUP BY run_id) e USING (run_id))
""")
def _(t):
    return ModelChain(t).consolidation().select("run_id", F.length("user").alias("chars"), X.sha("user", 16).alias("digest"))


@query("infer_chain_failures", "INF-3", sql="""
SELECT DISTINCT run_id, 'TimeoutError' AS reason FROM chain_candidates WHERE CAST(regexp_extract(run_id, '([0-9]+)$', 1) AS INTEGER) % 5 = 4
""")
def _(t):
    return ModelChain(t).findings()[1].select("run_id", "reason")


@query("infer_audit_rows", "INF-1", "INF-5", sql="SELECT run_id, finding_index, review_id, role, CAST(finding_index * 2147483648 + n AS BIGINT) AS pos FROM chain_audits")
def _(t):
    chain = ModelChain(t)
    return chain.audits(chain.findings()[0]).select("run_id", "finding_index", "review_id", "role", "pos")


@query("infer_requirement_rows", "INF-1", "INF-5", sql="SELECT run_id, CAST(draft_no AS INTEGER) AS draft_no, title, CAST(draft_no + 1 AS INTEGER) AS impact, finding_id FROM chain_plans")
def _(t):
    chain = ModelChain(t)
    drafts, links = chain.plans(chain.findings()[0])
    return drafts.join(links, ["run_id", "draft_no"]).select("run_id", "draft_no", "title", "impact", "finding_id")


@query("infer_test_rows", "INF-1", "INF-5", sql="""
SELECT run_id, CAST(draft_no AS INTEGER) AS draft_no, CAST(i AS INTEGER) AS pos, title || ' / ' || k AS title, k AS case_type FROM chain_plans, (VALUES (0, 'normal'), (1, 'boundary')) v(i, k)
""")
def _(t):
    chain = ModelChain(t)
    drafts, _ = chain.plans(chain.findings()[0])
    return chain.tests(drafts).select("run_id", "draft_no", "pos", "title", "case_type")
