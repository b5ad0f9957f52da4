"""Readers, writers and streams over files made from the given tables; every file lies in the shared checkpoint folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import stage_path
from ..sources import logs, reviews as rv, sinks
from ..streaming import streams
from .ingest import landed
from .registry import query


@query("read_agent_events", "SRC-9", sql="""
SELECT 'r' || user_id AS run_id, CAST(event_id % 7 AS INTEGER) AS step, event_type AS kind, CASE WHEN event_id % 5 <> 0 THEN 'event ' || event_id END AS message,
       CAST(value AS VARCHAR) AS value, strftime(ts, '%Y-%m-%d %H:%M:%S') AS created_at FROM events
""")
def _(t):
    path = stage_path(t.spark, "agent-events")
    rows = t.raw("events").select(
        F.concat(F.lit("r"), "user_id").alias("run_id"), (F.col("event_id") % 7).alias("step"), F.col("event_type").alias("kind"),
        F.when(F.col("event_id") % 5 != 0, F.concat(F.lit("event "), "event_id")).alias("message"),
        F.create_map(F.lit("value"), F.col("value").cast("string")).alias("payload"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"))
    rows.write.json(path)
    return logs.read_agent_events(t.spark, path).select(
        "run_id", "step", "kind", "message", F.col("payload")["value"].alias("value"), F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"))


def stage_rows(t):
    """Plan payloads, one per document: two requirements with the words of the text as finding ids; some are malformed."""
    n = F.col("doc_id")
    ids = F.split("source", "")
    good = F.to_json(F.struct(
        F.array(F.struct(F.concat(F.lit("a"), n).alias("requirement_id"), ids.alias("finding_ids")), F.struct(F.concat(F.lit("b"), n).alias("requirement_id"), F.array("lang").alias("finding_ids"))).alias("requirements"),
        F.md5("text").alias("quantity_notice")))
    payload = F.when(n % 13 == 5, "{broken").when(n % 13 == 6, '{"requirements": 3}').otherwise(good)
    return t.raw("documents").select(F.col("source").alias("run_id"), F.when(n % 3 == 0, "clean").otherwise("plan").alias("stage"), n.alias("batch_index"), payload.alias("payload"))


@query("read_stage_outputs", "SRC-10", sql="""
SELECT source AS run_id, doc_id AS batch_index, md5(text) AS quantity_notice, CASE k WHEN 1 THEN 'a' ELSE 'b' END || doc_id AS requirement_id, CASE k WHEN 1 THEN length(source) ELSE 1 END AS n_findings
FROM documents, (VALUES (1), (2)) v(k) WHERE doc_id % 3 <> 0 AND doc_id % 13 NOT IN (5, 6)
""")
def _(t):
    good, _bad = logs.read_stage_outputs(stage_rows(t), "plan")
    return good.select("run_id", "batch_index", "quantity_notice", F.explode("requirements").alias("r")).select(
        "run_id", "batch_index", "quantity_notice", "r.requirement_id", F.size("r.finding_ids").alias("n_findings"))


@query("read_stage_rejects", "SRC-10", sql="""
SELECT source AS run_id, doc_id AS batch_index, CASE doc_id % 13 WHEN 5 THEN '{broken' ELSE '{"requirements": 3}' END AS payload
FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 13 IN (5, 6)
""")
def _(t):
    return logs.read_stage_outputs(stage_rows(t), "plan")[1].select("run_id", "batch_index", "payload")


@query("read_eval_history", "SRC-11", sql="""
SELECT source AS dataset, 'p' || length(source) AS fingerprint, metric, CASE metric WHEN 'n' THEN count(*) WHEN 'chars' THEN sum(n_chars) ELSE max(n_chars) END::DOUBLE AS value
FROM documents, (VALUES ('n'), ('chars'), ('longest')) m(metric) GROUP BY source, metric
""")
def _(t):
    path = stage_path(t.spark, "eval-history")
    d = F.col
    summary = F.create_map(F.lit("n"), d("n"), F.lit("chars"), d("chars"), F.lit("longest"), d("longest"), F.lit("none"), F.lit(None).cast("bigint"))
    rows = t.raw("documents").groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.max("n_chars").alias("longest"))
    report = F.to_json(F.struct(F.concat(F.lit("p"), F.length("source")).alias("prompt_fingerprint"), F.col("source").alias("dataset"), summary.alias("summary")), {"pretty": "true"})
    rows.select(F.col("source").alias("report"), report.alias("value")).repartition("report").write.partitionBy("report").text(path)
    return logs.read_eval_history(t.spark, f"{path}/*").select("dataset", "fingerprint", "metric", "value")


@query("csv_round_trip", "SRC-2", "SNK-4", sql="""
SELECT 'd' || doc_id AS review_id, length(text) AS chars, md5(text) AS digest, CAST(doc_id % 5 + 1 AS VARCHAR) AS rating, '["' || lang || '","x"]' AS tags FROM documents
""")
def _(t):
    """Documents exported as CSV, with their line ends, quotes and commas, and read as an import file."""
    path = stage_path(t.spark, "csv")
    d = t.raw("documents").select(
        F.concat(F.lit("d"), "doc_id").alias("review_id"), F.col("text").alias("content"), (F.col("doc_id") % 5 + 1).alias("rating"),
        F.array("lang", F.lit("x")).alias("tags"))
    sinks.export_csv(d, path)
    rows = rv.read_reviews_csv(t.spark, path, "app")
    return rows.select("review_id", F.length("content").alias("chars"), F.md5("content").alias("digest"), "rating", "tags")


@query("stages_pending", "SNK-3", sql="""
SELECT source AS run_id, 'clean' AS stage, doc_id % 50 AS batch_index FROM documents WHERE doc_id % 3 = 0 GROUP BY ALL
EXCEPT SELECT source, 'clean', doc_id % 50 FROM documents WHERE doc_id % 2 = 0
""")
def _(t):
    """Work left after two writes: one of every second document, one without any rows, which still counts as done."""
    path, manifest = stage_path(t.spark, "stages"), stage_path(t.spark, "manifest")
    docs = t.raw("documents").select(F.col("source").alias("run_id"), F.lit("clean").alias("stage"), (F.col("doc_id") % 50).alias("batch_index"), "doc_id", "text")
    even = docs.where("doc_id % 2 = 0")
    sinks.write_stage(even.where("doc_id % 4 = 0"), even.where("doc_id % 4 = 0"), path, manifest)
    sinks.write_stage(docs.where("false"), even.where("doc_id % 4 = 2"), path, manifest)
    return sinks.pending(docs.where("doc_id % 3 = 0").select("run_id", "stage", "batch_index").distinct(), manifest)


@query("stage_rows_read", "SNK-3", sql="""
SELECT source AS run_id, doc_id % 50 AS batch_index, doc_id, md5(text || CASE WHEN doc_id % 5 = 0 THEN '!' ELSE '' END) AS digest FROM documents
""")
def _(t):
    """A part written again replaces what was written for it before."""
    path, manifest = stage_path(t.spark, "stages"), stage_path(t.spark, "manifest")
    docs = t.raw("documents").select(F.col("source").alias("run_id"), F.lit("clean").alias("stage"), (F.col("doc_id") % 50).alias("batch_index"), "doc_id", "text")
    sinks.write_stage(docs, docs, path, manifest)
    again = docs.where("batch_index % 5 = 0").withColumn("text", F.concat("text", F.lit("!")))
    sinks.write_stage(again, again, path, manifest)
    return sinks.read_stages(t.spark, path, manifest).select("run_id", "batch_index", "doc_id", F.md5("text").alias("digest"))


@query("log_appended", "SNK-6", sql="SELECT event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY event_type")
def _(t):
    path = stage_path(t.spark, "log")
    e = t.raw("events").select("event_id", "event_type")
    sinks.append_log(e.where("event_id % 2 = 0"), path, "event_type")
    sinks.append_log(e.where("event_id % 2 = 1"), path, "event_type")
    return t.spark.read.parquet(path).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("log_streamed", "SNK-6", sql="SELECT event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY event_type")
def _(t):
    """Two runs over one checkpoint, the second with new files: every row once."""
    inbox, path, checkpoint = (stage_path(t.spark, name) for name in ("log-inbox", "log", "log-checkpoint"))
    e = t.raw("events").select("event_id", "event_type")
    for rest in (0, 1):
        e.where(F.col("event_id") % 2 == rest).write.mode("append").parquet(inbox)
        sinks.stream_log(t.spark.readStream.schema(e.schema).parquet(inbox), path, checkpoint, "event_type").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(path).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("stream_corpus", "STR-1", "STR-2", sql="""
SELECT review_id, chars, CAST(CAST(rating AS DOUBLE) AS INTEGER) AS rating FROM landed_rows
WHERE chars IS NOT NULL AND NOT bad_date AND rating NOT IN ('2.5', '9', 'true') AND review_id LIKE 'd%'
""")
def _(t):
    """Landed files as a stream, twice over; the corpus holds each review once. Reviews without an id are named by file position, so only named ones compare."""
    inbox, corpus, checkpoint = (stage_path(t.spark, name) for name in ("inbox", "corpus", "corpus-checkpoint"))
    files = landed(t)
    for _ in range(2):
        # One file each, but no folder each: a stream opens a folder per file to list them, which takes longer than to read them.
        files.repartition("file").select("value").write.mode("append").option("maxRecordsPerFile", 1).text(inbox)
        good, _rejects = streams.stream_reviews(t.spark, inbox, "app")
        streams.stream_upsert_corpus(good, corpus, checkpoint).trigger(availableNow=True).start().awaitTermination()
    rows = streams.read_corpus(t.spark, corpus).where("review_id LIKE 'd%'")
    return rows.select("review_id", F.length("content_original").alias("chars"), "rating")


@query("stream_late_rows", "STR-8", sql="""
SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'malformed' WHEN wave = 1 AND ts < (SELECT max(ts) FROM events WHERE event_id % 2 = 0 AND event_id % 11 <> 0) - INTERVAL 10 DAY THEN 'late' END AS reject_reason
FROM (SELECT event_id, ts, event_id % 2 AS wave FROM events)
""")
def _(t):
    """Two waves of events; rows without a time and rows far behind the first wave go to the side table."""
    inbox, good, bad, progress, checkpoint = (stage_path(t.spark, name) for name in ("late-in", "late-good", "late-bad", "late-progress", "late-checkpoint"))
    e = t.raw("events").select("event_id", F.when(F.col("event_id") % 11 != 0, F.col("ts")).alias("ts"))
    for wave in (0, 1):
        e.where(F.col("event_id") % 2 == wave).coalesce(1).write.mode("append").parquet(inbox)
        rows = t.spark.readStream.schema(e.schema).parquet(inbox)
        streams.late_rejects(rows, good, bad, progress, 10 * 86_400, checkpoint).trigger(availableNow=True).start().awaitTermination()
    kept = t.spark.read.parquet(good).select("event_id", F.lit(None).cast("string").alias("reject_reason"))
    return kept.unionByName(t.spark.read.parquet(bad).select("event_id", "reject_reason"))
