"""The domain tables as views of the given parquet tables.

Every rule here is row-level and has the same form in the checking SQL (`plans/sqlbase.py`).
Long form throughout: lists of ids are rows with a position, so no list has to fit in a cell.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X

PRICES = [  # fixed values: model prefix, cents per million prompt and completion tokens
    ("deepseek-chat", 27, 110),
    ("deepseek-reasoner", 55, 219),
    ("gpt-4o-mini", 15, 60),
]


TEXT_KEYS = {"documents": "doc_id", "pages": "page_id", "conversations": "conv_id"}


SPREAD_BYTES = 256 << 20


def in_parallel(df: DataFrame, key: str) -> DataFrame:
    """Spread a text table of at most SPREAD_BYTES, by its file sizes; a larger one has splits enough and is never moved."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, key) if int(size) <= SPREAD_BYTES else df


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return in_parallel(df, TEXT_KEYS[name]) if name in TEXT_KEYS else df

    # ---- reviews ----

    @cached_property
    def reviews(self) -> DataFrame:
        """One review per document; copies of a text get the same rating."""
        d = self.raw("documents")
        initial = F.regexp_extract("text", X.SOMETHING, 0)
        return d.select(
            F.concat(F.lit("d"), F.col("doc_id")).alias("review_id"),
            F.col("doc_id").alias("ord"),
            F.col("source").alias("run_id"),
            F.col("source").alias("app_id"),
            F.col("text").alias("content_original"),
            (F.lit(1) + F.ascii(initial) % 5).cast("int").alias("rating"),
            F.col("lang").alias("language"),
            F.when(F.col("doc_id") % 10 == 9, "social")
            .when(F.col("doc_id") % 2 == 0, "app-store")
            .otherwise("google-play")
            .alias("platform"),
            F.concat(F.lit("1."), F.col("doc_id") % 3).alias("app_version"),
            F.expr(
                "timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, cast(doc_id as int), 0, 0)"
            ).alias("published_at"),
        )

    @cached_property
    def shared_id_reviews(self) -> DataFrame:
        """Reviews whose incoming ids repeat in pairs."""
        return self.reviews.withColumn(
            "review_id", F.concat(F.lit("d"), F.expr("ord div 2"))
        )

    @cached_property
    def known_reviews(self) -> DataFrame:
        return self.reviews.where("ord % 23 <> 0").select("run_id", "review_id", "ord")

    # ---- evidence drafts ----

    @cached_property
    def _labelled(self) -> DataFrame:
        docs = self.raw("documents").select("doc_id", "source", "lang")
        labels = self.raw("labels").select("doc_id", "quality")
        index = F.when(F.col("lang") == "de", 0).when(F.col("lang") == "en", 1)
        index = index.when(F.col("lang") == "es", 2).otherwise(3)
        return docs.join(labels, "doc_id").select(
            F.col("source").alias("run_id"), index.alias("finding_index"), "doc_id", "quality"
        )

    @cached_property
    def drafts(self) -> DataFrame:
        return (
            self._labelled.select("run_id", "finding_index")
            .distinct()
            .select(
                "run_id",
                "finding_index",
                F.concat_ws(" ", F.lit("Finding"), "run_id", "finding_index").alias("title"),
                F.concat(F.lit("Topic "), F.expr("finding_index div 2")).alias("topic_label"),
                F.array(F.lit("small sample"), F.lit("small sample")).alias("limitations"),
            )
            .withColumn("topic_key", X.topic_key("topic_label"))
        )

    @cached_property
    def draft_evidence(self) -> DataFrame:
        """Cited ids with role and position: repeats, overlaps and invented ids included."""
        x = self._labelled
        rid = F.concat(F.lit("d"), F.col("doc_id"))
        def row(cond, role, ident, pos):
            return F.when(cond, F.struct(F.lit(role).alias("role"), ident.alias("review_id"), pos.alias("pos")))
        q, d = F.col("quality"), F.col("doc_id")
        rows = F.array(
            row(q == 1, "supporting", rid, d),
            row((q == 1) & (d % 10 == 3), "supporting", rid, d + 1_000_000_000),
            row((q == 1) & (d % 9 == 0), "conflicting", rid, d),
            row(q == 0, "conflicting", rid, d),
            row(d % 41 == 0, "supporting", F.concat(F.lit("x"), d), d + 2_000_000_000),
        )
        return x.select(
            "run_id", "finding_index", F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("e")
        ).select("run_id", "finding_index", "e.*")

    @cached_property
    def audit_items(self) -> DataFrame:
        return (
            self.drafts.where("not (run_id = 'src3' and finding_index = 0)")
            .select("run_id", "finding_index", F.array(F.lit("audited from text only")).alias("audit_limitations"))
        )

    @cached_property
    def audits(self) -> DataFrame:
        x = self._labelled.where("not (run_id = 'src3' and finding_index = 0)")
        d = F.col("doc_id")
        rid = F.concat(F.lit("d"), d)
        role = F.when(d % 11 == 0, "irrelevant").when(d % 11 == 1, "conflicting").otherwise("supporting")
        def row(cond, ident, r, pos):
            return F.when(cond, F.struct(
                ident.alias("review_id"), r.alias("role"),
                F.concat(F.lit("reason "), d).alias("rationale"), pos.alias("pos")))
        kept = (d % 13 != 0) & (d % 23 != 0)
        rows = F.array(
            row(kept, rid, role, d),
            row(kept & (d % 17 == 0), rid, F.lit("conflicting"), d + 1_000_000_000),
            row(d % 29 == 0, F.concat(F.lit("u"), d), F.lit("supporting"), d + 2_000_000_000),
        )
        return x.select(
            "run_id", "finding_index", F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("e")
        ).select("run_id", "finding_index", "e.*")

    @cached_property
    def requirement_drafts(self) -> DataFrame:
        """Three drafts per finding draft."""
        return (
            self.drafts.select("run_id", "finding_index")
            .withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(2))))
            .select(
                "run_id",
                (F.col("finding_index") * 3 + F.col("k")).alias("draft_no"),
                F.concat_ws(" ", F.lit("Need"), "run_id", "finding_index", "k").alias("title"),
                (F.lit(1) + (F.col("finding_index") + F.col("k")) % 5).alias("impact"),
                F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")),
                             (F.col("finding_index") * 3 + F.col("k")) % 3 + 1).alias("complexity"),
                F.lit("V1.0").alias("proposed_version"),
            )
        )

    @cached_property
    def requirement_draft_links(self) -> DataFrame:
        fid = lambda n: F.format_string("F-%03d", n)
        i, k = F.expr("draft_no div 3").cast("int"), F.col("draft_no") % 3
        ids = F.when(k == 0, F.array(fid(i + 1))).when(
            k == 1, F.array(fid(i + 1), fid((i + 1) % 4 + 1), fid(i + 1))
        ).otherwise(F.array(F.lit("F-099"), fid(i + 1)))
        return self.requirement_drafts.select("run_id", "draft_no", F.posexplode(ids).alias("pos", "finding_id"))

    @cached_property
    def test_drafts(self) -> DataFrame:
        """One to five tests per requirement draft."""
        n = F.col("draft_no")
        return self.requirement_drafts.select(
            "run_id", "draft_no", F.explode(F.sequence(F.lit(0), (n % 5).cast("int"))).alias("pos")
        ).select(
            "run_id", "draft_no", "pos",
            F.concat_ws(" ", F.lit("Check"), "draft_no", "pos").alias("title"),
            F.element_at(F.array(F.lit("normal"), F.lit("exception"), F.lit("boundary"), F.lit("regression")),
                         (F.col("pos") % 4 + 1).cast("int")).alias("case_type"),
        )

    @cached_property
    def analysis_runs(self) -> DataFrame:
        """One run per source."""
        n = F.regexp_extract("run_id", r"(\d+)$", 1).cast("int")
        return (
            self.reviews.groupBy("run_id").agg(F.count("*").alias("input_count"))
            .withColumn("n", n)
            .withColumn("status", F.when(n % 7 == 0, "partial").when(n % 7 == 1, "running").otherwise("completed"))
            .withColumn("source_type", F.when(n % 2 == 0, "online").otherwise("import"))
            .withColumn("review_limit", F.lit(40) + n)
            .withColumn("mode", F.when(n % 3 == 0, "replay").otherwise("live"))
            .withColumn("is_live", n % 3 != 0)
            .drop("n")
        )

    # ---- search ----

    @cached_property
    def corpus(self) -> DataFrame:
        return self.reviews.select(
            "review_id", "ord", "app_id", F.col("content_original").alias("content"), "language", "platform",
            F.when(F.col("ord") % 5 == 0, "import:csv").otherwise("import:json").alias("source"),
        )

    @cached_property
    def queries(self) -> DataFrame:
        """Benchmark texts as queries, whole (q…), and their first four words as further ones (q…s)."""
        text = X.normalize_text("text")
        short = F.array_join(F.slice(F.split(text, " "), 1, 4), " ")
        forms = F.array(F.struct(F.lit("").alias("form"), text.alias("query")), F.struct(F.lit("s").alias("form"), short.alias("query")))
        return self.raw("benchmark").select("item_id", F.explode(forms).alias("f")).select(
            F.concat(F.lit("q"), "item_id", "f.form").alias("query_id"),
            F.col("item_id").alias("query_ord"),
            F.col("f.query").alias("query"),
            F.when(F.col("item_id") % 2 == 0, "en").otherwise("zh").alias("language"),
        )

    # ---- operations ----

    @cached_property
    def model_usage(self) -> DataFrame:
        e = self.raw("events")
        m = F.col("event_id") % 4
        return e.select(
            F.col("event_id").alias("id"),
            F.col("user_id").alias("run_id"),
            F.when(F.col("event_id") % 10 == 7, F.lit(None)).otherwise(F.col("event_type")).alias("stage"),
            F.when(m == 0, "deepseek-chat").when(m == 1, "deepseek-chat-x")
            .when(m == 2, "gpt-4o-mini").otherwise("other-model").alias("model"),
            F.floor(F.col("value") * 10).cast("bigint").alias("prompt_tokens"),
            (F.col("event_id") % 500).alias("completion_tokens"),
            F.col("value").alias("latency_ms"),
            F.col("ts").alias("created_at"),
        )

    @cached_property
    def prices(self) -> DataFrame:
        rows = [(i, *p) for i, p in enumerate(PRICES)]
        return self.spark.createDataFrame(rows, "ord int, prefix string, prompt_cents int, completion_cents int")

    @cached_property
    def stage_timings(self) -> DataFrame:
        return self.raw("events").select(
            F.col("event_id").alias("id"), F.col("user_id").alias("run_id"),
            F.col("event_type").alias("stage"), F.col("value").alias("duration_ms"), F.col("ts").alias("started_at"),
        )

    @cached_property
    def job_status(self) -> DataFrame:
        return self.raw("events").select(
            F.col("event_id").alias("ord"), F.col("user_id").alias("job_id"),
            F.when(F.col("event_type") == "error", "failed")
            .when(F.col("event_type") == "signup", "waiting_for_model")
            .otherwise("completed").alias("status"),
            F.col("ts"),
        )

    @cached_property
    def run_events(self) -> DataFrame:
        return self.raw("events").select(
            F.col("event_id").alias("id"), F.col("user_id").alias("run_id"),
            F.col("event_type").alias("stage"), F.col("ts").alias("created_at"),
        )

    @cached_property
    def ops_runs(self) -> DataFrame:
        statuses = [
            "pending", "running", "waiting_for_model", "completed",
            "partial", "failed", "timed_out", "cancelled",
        ]
        k = F.col("o_orderkey")
        return self.raw("orders").select(
            k.alias("run_id"),
            F.col("o_custkey").alias("app_url"),
            F.element_at(F.array(*[F.lit(s) for s in statuses]), (k % 8 + 1).cast("int")).alias("status"),
            F.when(k % 16 == 0, F.lit("owner")).alias("lease_owner"),
            F.col("o_orderdate").alias("updated_at"),
            F.expr("o_orderdate - make_dt_interval(0, cast(o_orderkey % 100 as int), 0, 0)").alias("created_at"),
            F.when(k % 3 == 0, F.col("o_orderdate")).alias("heartbeat_at"),
        )

    @cached_property
    def reports(self) -> DataFrame:
        return self.raw("orders").select(
            F.col("o_orderkey").alias("report_id"), F.col("o_custkey").alias("app_url"),
            F.col("o_orderdate").alias("created_at"), (F.col("o_orderkey") % 4).alias("findings_count"),
        )

    @cached_property
    def heartbeats(self) -> DataFrame:
        return self.raw("events").select(
            F.concat(F.lit("owner-"), F.col("user_id")).alias("owner"), F.col("ts").alias("heartbeat_at")
        )
