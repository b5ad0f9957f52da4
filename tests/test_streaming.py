"""Stream jobs give what their batch twins give, and repeating a batch changes nothing."""

import json

from pyspark.sql import functions as F

from tracewell.operators import alerts as al
from tracewell.streaming import streams as st


def run(stream, out, checkpoint):
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination(120)


def landed(spark, df, path, parts, by):
    """Write the rows as consecutive files so that the stream sees several micro-batches."""
    n = df.count()
    for i in range(parts):
        df.where((F.col(by) >= i * n // parts) & (F.col(by) < (i + 1) * n // parts)).coalesce(1).write.mode("append").parquet(path)


def source(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_status_alerts_and_tail(spark, tmp_path):
    rows = [(i, i % 3, ["completed", "failed", "failed", "waiting", "completed"][(i * 7 // 3) % 5]) for i in range(60)]
    jobs = spark.createDataFrame(rows, "ord bigint, job_id bigint, status string")
    path = str(tmp_path / "in")
    landed(spark, jobs, path, 3, "ord")
    run(st.status_alerts(source(spark, path, jobs.schema)), str(tmp_path / "out"), str(tmp_path / "c"))
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("job_id", "ord", "status", "alert").collect())
    assert got == sorted(tuple(r) for r in al.status_alerts(jobs).collect())

    events = jobs.select(F.col("job_id").alias("run_id"), F.col("ord").alias("id"), F.when(F.col("ord") > 20, F.col("status")).otherwise("x").alias("status"))
    run(st.tail_events(source(spark, path, jobs.schema).select(
        F.col("job_id").alias("run_id"), F.col("ord").alias("id"), F.when(F.col("ord") > 20, F.col("status")).otherwise("x").alias("status"))),
        str(tmp_path / "out2"), str(tmp_path / "c2"))
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out2")).select("run_id", "id", "status").collect())
    assert got == sorted(tuple(r) for r in al.tail_events(events).collect())


def test_budget_meter(spark, tmp_path):
    usage = spark.createDataFrame([(i, "a" if i % 2 else "b", 10 + i) for i in range(40)], "id bigint, run_id string, cost_e8 bigint")
    path = str(tmp_path / "in")
    landed(spark, usage, path, 2, "id")
    run(st.budget_meter(source(spark, path, usage.schema), "run_id", 200), str(tmp_path / "out"), str(tmp_path / "c"))
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("run_id", "id").collect())
    want = []
    for k in "ab":
        total = 0
        for i in range(40):
            if ("a" if i % 2 else "b") == k:
                total += 10 + i
                if total >= 200:
                    want.append((k, i))
                    break
    assert got == want


def test_reviews_to_corpus(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    record = lambda i, text: {"review_id": f"r{i}", "content": text, "rating": 3, "date": "2026-01-01"}
    (inbox / "a.json").write_text(json.dumps([record(1, "one"), record(2, "two"), {"content": "x"}]))
    (inbox / "b.json").write_text(json.dumps({"reviews": [record(2, "two again"), record(3, "three")]}))
    reviews, rejects = st.stream_reviews(spark, str(inbox), "app", files_per_trigger=1)
    corpus, checkpoint = str(tmp_path / "corpus"), str(tmp_path / "c")
    for _ in range(2):  # the second start finds nothing new
        st.stream_upsert_corpus(reviews, corpus, checkpoint).trigger(availableNow=True).start().awaitTermination(120)
    got = sorted((r.review_id) for r in st.read_corpus(spark, corpus).collect())
    assert got == ["r1", "r2", "r3"]
    # A review that is older than everything before it arrives late: it is kept, and invalid rows are kept apart.
    old = {"review_id": "r4", "content": "old", "rating": 2, "date": "2020-01-01"}
    (inbox / "c.json").write_text(json.dumps([old, {"review_id": "r5", "content": "", "rating": 1, "date": "2020-01-01"}]))
    st.stream_upsert_corpus(reviews, corpus, checkpoint).trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(r.review_id for r in st.read_corpus(spark, corpus).collect()) == ["r1", "r2", "r3", "r4"]
    run(rejects, str(tmp_path / "rejects"), str(tmp_path / "c3"))
    assert spark.read.parquet(str(tmp_path / "rejects")).count() == 2


def test_late_rejects(spark, tmp_path):
    rows = [(0, "2026-01-01 10:00:00"), (1, None), (2, "2026-01-01 09:59:00"), (3, "2026-01-01 08:00:00")]
    df = spark.createDataFrame(rows, "id bigint, s string").withColumn("ts", F.col("s").cast("timestamp")).drop("s")
    path = str(tmp_path / "in")
    landed(spark, df, path, 2, "id")
    p = lambda x: str(tmp_path / x)
    q = st.late_rejects(source(spark, path, df.schema), p("good"), p("bad"), p("progress"), 600, p("c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.id for r in spark.read.parquet(p("good")).collect()) == [0, 2]
    assert sorted((r.id, r.reject_reason) for r in spark.read.parquet(p("bad")).collect()) == [(1, "malformed"), (3, "late")]


def test_small_files_share_a_micro_batch(spark, tmp_path):
    """Micro-batches go by bytes: 250 small files took three of them before."""
    inbox, corpus = tmp_path / "inbox", str(tmp_path / "corpus")
    inbox.mkdir()
    for i in range(250):
        (inbox / f"{i}.json").write_text(json.dumps([{"id": f"d{i}", "content": "ok", "rating": 3, "date": "2026-01-02"}]))
    good, _ = st.stream_reviews(spark, str(inbox), "app")
    q = st.stream_upsert_corpus(good, corpus, str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    rows = spark.read.parquet(corpus)
    assert rows.select("batch").distinct().count() == 1 and rows.select("review_id").distinct().count() == 250
