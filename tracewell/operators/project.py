"""Request filters, display labels and redaction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.contained import spots, stands
from ..functions.scan import row_numbers

REVIEW_PLATFORMS = ("app-store", "google-play")  # fixed values


def filter_request(reviews: DataFrame, requests: DataFrame) -> DataFrame:
    """Reviews a run asked for: rating and version lists (empty version list = all), then the limit.

    The request table has one row per run; the review limit is at most 1,000 per run, but the head
    of a run of any size is found block by block.
    """
    asked = reviews.join(requests.select("run_id", "ratings", "app_versions", "review_limit"), "run_id")
    wanted = asked.where(
        F.array_contains("ratings", F.col("rating"))
        & ((F.size("app_versions") == 0) | F.array_contains("app_versions", F.col("app_version")))
    )
    return row_numbers(wanted, ["run_id"], "ord", "place").where("place <= review_limit")


def allowed_platform(c: Column, include_social: bool = False) -> Column:
    """Store reviews only, unless social posts are wanted; no platform means app-store."""
    if include_social:
        return F.lit(True)
    return F.coalesce(c, F.lit("app-store")).isin(*REVIEW_PLATFORMS)


def localize(df: DataFrame, labels: DataFrame, columns: list[str], summary: str | None = None, blank: str = "待生成") -> DataFrame:
    """Codes to display labels; unknown codes stay. `labels` has column, code, label (a fixed list)."""
    for name in columns:
        names = labels.where(F.col("column") == name).select(F.col("code").alias(name), "label")
        df = df.join(F.broadcast(names), name, "left").withColumn(name, F.coalesce("label", name)).drop("label")
    if summary:
        df = df.withColumn(summary, F.when(F.trim(F.coalesce(summary, F.lit(""))) == "", blank).otherwise(F.col(summary)))
    return df


def empty_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column with whether every value is null, for dropping columns from a display."""
    counts = df.agg(*[F.count(c).alias(c) for c in columns])
    return counts.unpivot([], columns, "column", "n").select("column", (F.col("n") == 0).alias("all_null"))


MAX_MESSAGE = 1000
MASKED_REVIEW = "[REDACTED_REVIEW]"
#: What a log message must not show, and what stands there instead, in the order applied. Masked logs of
#: different origin are compared as text, so patterns, masks and order are given.
MASKS = [
    (r"(?i)(api[ _-]?key\s*[=:]\s*)\S+", "$1[REDACTED]"),
    (r"\bsk-[A-Za-z0-9_-]{8,}\b", "[REDACTED]"),
    (r"(?i)\.env(?:\.[\w.-]+)?", "[REDACTED_ENV]"),
]


def redact(c: Column) -> Column:
    """A message for logs: one line, key values, secret tokens and names of environment files masked, 1,000 characters at most."""
    line = F.trim(F.array_join(F.filter(F.split(c, "[\\r\\n]+"), lambda part: part != ""), " "))
    return F.substring(reduce(lambda text, mask: F.regexp_replace(text, *mask), MASKS, line), 1, MAX_MESSAGE)


def mask_reviews(messages: DataFrame, reviews: DataFrame, message: Column | None = None, shared: DataFrame | None = None) -> DataFrame:
    """Mask every review of its run that a message quotes, longest first.

    messages: message_id, run_id, message; reviews: run_id, content_original. Quotes are found by anchors and digests
    (`functions/contained.py`), so neither all pieces of a message nor the texts of reviews are shuffled.

    `message` makes the message from columns of `messages` and of `shared`, one row per run; it is made in the row behind all
    joins by message, so that what the messages of a run have in common is never moved with each of them.
    """

    def whole(rows: DataFrame) -> DataFrame:
        rows = rows if shared is None else rows.join(shared, "run_id", "left")
        return rows if message is None else rows.withColumn("message", message)

    digest = F.sha2("content_original", 256)
    texts = reviews.where("content_original <> ''").select("run_id", F.col("content_original").alias("needle"), F.concat_ws("/", "run_id", digest).alias("needle_id"))
    hay = whole(messages).select("run_id", F.col("message_id").alias("hay_id"), F.col("message").alias("hay"))
    likely = spots(texts, hay, ["run_id"]).groupBy(F.col("hay_id").alias("message_id")).agg(F.collect_set(F.struct("start", "n", "digest")).alias("spots"))
    quoted = F.filter("spots", lambda s: stands(F.col("message"), s["start"], s["n"], s["digest"]))
    longest_first = F.array_sort(F.transform(quoted, lambda s: F.struct((-s["n"]).alias("size"), F.substring("message", s["start"], s["n"]).alias("text"))))
    masked = F.aggregate(F.array_distinct(longest_first), F.col("message"), lambda text, m: F.replace(text, m["text"], F.lit(MASKED_REVIEW)))
    return whole(messages.join(likely, "message_id", "left")).withColumn("message", F.coalesce(masked, "message")).drop("spots")
