"""Evaluation: dataset checks, retrieval and extraction scores, stability, report comparison.

Rounded values follow the binary value, ties to even; averages are taken over the rounded values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.numeric import ratio, round_half_even
from ..functions.scan import previous

CUTOFFS = (1, 3, 5)  # fixed values


def _problem(df: DataFrame, key: str, problem: str, item: Column | None = None) -> DataFrame:
    return df.select(F.col(key).cast("string").alias("label"), F.lit(problem).alias("problem"),
                     (item if item is not None else F.lit(None)).cast("string").alias("item"))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def blank(c: str) -> Column:
    return F.coalesce(X.normalize_text(F.col(c).cast("string")), F.lit("")) == ""


def eval_dataset_issues(cases: DataFrame, reviews: DataFrame, expected: DataFrame, topics: DataFrame) -> DataFrame:
    """Problems of labelled cases. Child tables are keyed by `case_no`, the position of the case."""
    dup = cases.where("case_id is not null and case_id <> ''").groupBy("case_id").agg(F.min("case_no").alias("first"))
    repeated = cases.join(dup, "case_id").where("case_no > first")
    with_reviews = reviews.select("case_no").distinct()
    named = reviews.where("coalesce(review_id, '') <> ''")
    ids = named.groupBy("case_no", "review_id").agg(F.count("*").alias("n"))
    number = F.expr("try_cast(rating as double)")
    good_rating = number.isNotNull() & (number == F.floor(number)) & number.between(1, 5)
    # A case without reviews is reported once and not looked into further.
    looked_at = lambda df: df.join(with_reviews, "case_no", "left_semi")
    return _union([
        _problem(cases.where("coalesce(case_id, '') = ''"), "case_no", "missing case_id"),
        _problem(repeated, "case_no", "repeated case_id", F.col("case_id")),
        _problem(cases.where("coalesce(length(goal), 0) < 3"), "case_no", "goal missing or short"),
        _problem(cases.join(with_reviews, "case_no", "left_anti"), "case_no", "no reviews"),
        _problem(reviews.where("coalesce(review_id, '') = ''"), "case_no", "review without id"),
        _problem(ids.where("n > 1"), "case_no", "repeated review id", F.col("review_id")),
        _problem(named.where(~F.coalesce(good_rating, F.lit(False))), "case_no", "rating not a whole number 1-5", F.col("review_id")),
        _problem(named.where(blank("content")), "case_no", "blank content", F.col("review_id")),
        _problem(looked_at(expected).join(ids, ["case_no", "review_id"], "left_anti"), "case_no", "expected review unknown", F.col("review_id")),
        _problem(looked_at(topics).where(X.topic_key("topic") == ""), "case_no", "topic not comparable", F.col("topic")),
    ])


def query_dataset_issues(queries: DataFrame, expected: DataFrame, corpus: DataFrame) -> DataFrame:
    """Problems of retrieval queries, keyed by `query_no`."""
    dup = queries.where("coalesce(query_id, '') <> ''").groupBy("query_id").agg(F.min("query_no").alias("first"))
    return _union([
        _problem(queries.where("coalesce(query_id, '') = ''"), "query_no", "missing query_id"),
        _problem(queries.join(dup, "query_id").where("query_no > first"), "query_no", "repeated query_id", F.col("query_id")),
        _problem(queries.where(F.coalesce(F.length(X.normalize_text("query")), F.lit(0)) < 5), "query_no", "query too short"),
        _problem(queries.where(~F.coalesce(F.col("language").isin("zh", "en"), F.lit(False))), "query_no", "language not zh or en"),
        _problem(queries.join(expected.select("query_no").distinct(), "query_no", "left_anti"), "query_no", "no expected review"),
        _problem(expected.join(corpus.select("review_id"), "review_id", "left_anti"), "query_no", "expected review unknown", F.col("review_id")),
    ])


def retrieval_scores(queries: DataFrame, expected: DataFrame, retrieved: DataFrame, ks: tuple[int, ...] = CUTOFFS, precision_k: int = 5) -> DataFrame:
    """Recall at every cutoff, reciprocal rank and precision per query, three decimals."""
    if min((*ks, precision_k)) < 1:
        raise ValueError("cutoffs must be positive")
    wanted = expected.select("query_id", "review_id").distinct()
    marked = retrieved.join(wanted.withColumn("__hit", F.lit(True)), ["query_id", "review_id"], "left")
    first = marked.groupBy("query_id", "review_id").agg(F.min("place").alias("place"), F.max("__hit").alias("hit"))
    found = first.groupBy("query_id").agg(
        *[F.count_if(F.col("hit") & (F.col("place") <= k)).alias(f"hits{k}") for k in {*ks, precision_k}],
        F.min(F.when(F.col("hit"), F.col("place"))).alias("first_hit"),
    )
    returned = retrieved.groupBy("query_id").agg(F.count_if(F.col("place") <= precision_k).alias("returned"))
    size = wanted.groupBy("query_id").agg(F.count("*").alias("wanted"))
    rows = queries.select("query_id", "language").join(size, "query_id", "left").join(found, "query_id", "left").join(returned, "query_id", "left")
    rows = rows.fillna(0, ["wanted", "returned", *[f"hits{k}" for k in {*ks, precision_k}]])
    three = lambda c: round_half_even(c, 3)
    precision = F.when((F.col("returned") == 0) & (F.col("wanted") == 0), 1.0).otherwise(
        ratio(F.col(f"hits{precision_k}"), F.col("returned"), 0.0))
    return rows.select(
        "query_id", "language",
        *[three(ratio(F.col(f"hits{k}"), F.col("wanted"), 1.0)).alias(f"recall_{k}") for k in ks],
        three(F.coalesce(F.lit(1.0) / F.col("first_hit"), F.lit(0.0))).alias("mrr"),
        three(precision).alias(f"precision_{precision_k}"),
    )


def retrieval_ranks(expected: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Rank of every expected review, null when it was not returned."""
    places = retrieved.groupBy("query_id", "review_id").agg(F.min("place").alias("rank"))
    return expected.select("query_id", "review_id").distinct().join(places, ["query_id", "review_id"], "left")


def mean_of(c: str) -> Column:
    """Mean of three-decimal values through whole thousandths, so row order cannot matter."""
    return round_half_even(F.sum(F.round(F.col(c) * 1000).cast("bigint")) / F.lit(1000.0) / F.count(c), 3)


def retrieval_summary(scores: DataFrame) -> DataFrame:
    """Means over all queries and per language."""
    language = F.col("language")
    metrics = [c for c in scores.columns if c not in ("query_id", "language")]
    return scores.groupingSets([[], [language]], language).agg(
        F.count("*").alias("queries"), *[mean_of(m).alias(m) for m in metrics]
    )


def compare_configs(before: DataFrame, after: DataFrame, metric: str, fallbacks: DataFrame, gate: float) -> DataFrame:
    """Queries improved, worse and tied between two configurations, fallbacks used, and the gate."""
    both = before.select("query_id", F.col(metric).alias("a")).join(after.select("query_id", F.col(metric).alias("b"), "recall_3"), "query_id")
    both = both.join(fallbacks.select("query_id").distinct().withColumn("f", F.lit(1)), "query_id", "left")
    return both.agg(
        F.count_if(F.col("b") > F.col("a")).alias("improved"), F.count_if(F.col("b") < F.col("a")).alias("worse"),
        F.count_if(F.col("b") == F.col("a")).alias("tied"), F.count("f").alias("fallbacks"),
        (mean_of("recall_3") >= F.lit(gate)).alias("passed"),
    )


def _set_counts(expected: DataFrame, predicted: DataFrame, keys: list[str], item: str) -> DataFrame:
    """Sizes of expected, predicted and common distinct items per key, in one grouped pass."""
    e = expected.select(*keys, item, F.lit(1).alias("e"), F.lit(0).alias("p"))
    p = predicted.select(*keys, item, F.lit(0).alias("e"), F.lit(1).alias("p"))
    each = e.unionByName(p).groupBy(*keys, item).agg(F.max("e").alias("e"), F.max("p").alias("p"))
    return each.groupBy(*keys).agg(
        F.sum("e").alias("n_expected"), F.sum("p").alias("n_predicted"), F.sum(F.col("e") * F.col("p")).alias("n_common")
    )


def _share(common: Column, size: Column, other: Column) -> Column:
    return F.when((size == 0) & (other == 0), 1.0).otherwise(ratio(common, size, 0.0))


CASE = ["case_id", "rep"]


def score_predictions(
    runs: DataFrame, expected_reviews: DataFrame, expected_topics: DataFrame, findings: DataFrame, predicted_reviews: DataFrame
) -> DataFrame:
    """Topic recall, reference precision and recall per (case, rep) of `runs`."""
    spread = lambda df: runs.select(*CASE).join(df, "case_id")
    keyed = lambda df, c: df.withColumn("k", X.topic_key(c)).where("k <> ''")
    topics = _set_counts(spread(keyed(expected_topics, "topic")).select(*CASE, "k"), keyed(findings, "topic_key").select(*CASE, "k"), CASE, "k")
    refs = _set_counts(spread(expected_reviews).select(*CASE, "review_id"), predicted_reviews.select(*CASE, "review_id"), CASE, "review_id")
    named = lambda df, p: df.select(*CASE, *[F.col(c).alias(p + c) for c in ("n_expected", "n_predicted", "n_common")])
    rows = runs.select(*CASE).join(named(topics, "t_"), CASE, "left").join(named(refs, "r_"), CASE, "left").fillna(0)
    c = F.col
    return rows.select(
        *CASE,
        round_half_even(_share(c("t_n_common"), c("t_n_expected"), c("t_n_predicted")), 3).alias("topic_recall"),
        round_half_even(_share(c("r_n_common"), c("r_n_predicted"), c("r_n_expected")), 3).alias("reference_precision"),
        round_half_even(_share(c("r_n_common"), c("r_n_expected"), c("r_n_predicted")), 3).alias("reference_recall"),
    )


def prediction_quality(
    runs: DataFrame, case_reviews: DataFrame, expected_reviews: DataFrame, expected_topics: DataFrame,
    findings: DataFrame, predicted_reviews: DataFrame,
) -> DataFrame:
    """Hallucination rate, key coverage, found-by-evidence and topic granularity per (case, rep)."""
    predicted = predicted_reviews.select(*CASE, "review_id").distinct()
    exists = case_reviews.select("case_id", "review_id").distinct().withColumn("real", F.lit(1))
    wanted = expected_reviews.select("case_id", "review_id").distinct().withColumn("wanted", F.lit(1))
    cited = predicted.join(exists, ["case_id", "review_id"], "left").join(wanted, ["case_id", "review_id"], "left").groupBy(*CASE).agg(
        F.count("*").alias("cited"), F.count_if(F.col("real").isNull()).alias("invented"), F.count("wanted").alias("found"))
    keys = findings.groupBy(*CASE).agg(
        F.count("*").alias("n_findings"), F.count_if(F.col("topic_key") != "").alias("with_key"), F.count_distinct("topic_key").alias("topics"))
    n_topics = expected_topics.groupBy("case_id").agg(F.count_distinct("topic").alias("n_topics"))
    n_wanted = wanted.groupBy("case_id").agg(F.count("*").alias("n_wanted"))
    rows = (runs.select(*CASE).join(cited, CASE, "left").join(keys, CASE, "left").join(n_topics, "case_id", "left")
            .join(n_wanted, "case_id", "left").fillna(0))
    c = F.col
    return rows.select(
        *CASE,
        round_half_even(ratio(c("invented"), c("cited"), 0.0), 3).alias("hallucination_rate"),
        round_half_even(ratio(c("with_key"), c("n_findings"), 1.0), 3).alias("topic_key_coverage"),
        F.when((c("n_wanted") == 0) | (c("found") > 0), 1.0).otherwise(0.0).alias("topic_found_by_evidence"),
        round_half_even(ratio(c("topics"), c("n_topics"), 1.0), 3).alias("topic_granularity"),
    )


def topic_stability(runs: DataFrame, findings: DataFrame) -> DataFrame:
    """Mean Jaccard of the topic sets over all pairs of repeats; null for a single run.

    A case has a handful of repeats and a repeat a handful of findings, so the sets are arrays.
    """
    sets = findings.groupBy(*CASE).agg(F.collect_set("topic_key").alias("s"))
    empty = F.array().cast("array<string>")
    rows = runs.select(*CASE).distinct().join(sets, CASE, "left").groupBy("case_id").agg(
        F.count("*").alias("runs"),
        F.transform(F.array_sort(F.collect_list(F.struct("rep", F.coalesce("s", empty).alias("s")))), lambda x: x["s"]).alias("sets"),
    )
    jaccard = lambda a, b: F.when(F.size(F.array_union(a, b)) == 0, 1.0).otherwise(
        F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))
    pairs = F.flatten(F.transform("sets", lambda a, i: F.transform(
        F.slice("sets", i + 2, F.greatest(F.size("sets") - i - 1, F.lit(0))), lambda b: jaccard(a, b))))
    total = F.aggregate("p", F.lit(0.0), lambda acc, x: acc + x)
    return rows.withColumn("p", F.when(F.col("runs") > 1, pairs)).select(
        "case_id", "runs", round_half_even(total / F.size("p"), 3).alias("stability"))


def aggregate_eval(results: DataFrame, metrics: list[str]) -> DataFrame:
    """Means over cases: a missing metric counts zero, a missing stability does not count."""
    filled = results.select(*[F.coalesce(F.col(m), F.lit(0.0)).alias(m) for m in metrics], "structured_output_success", "stability")
    return filled.agg(
        F.count("*").alias("cases"), *[mean_of(m).alias(m) for m in metrics],
        round_half_even(F.count_if(F.col("structured_output_success")) / F.count("*"), 3).alias("structured_output_success"),
        mean_of("stability").alias("stability"),
    )


LOWER_IS_BETTER = ("hallucination_rate",)  # fixed values


def compare_reports(before: DataFrame, after: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """Metric rows of two reports side by side: difference, and whether it is a step back too far."""
    a = before.select(*keys, "metric", F.col("value").alias("before"))
    b = after.select(*keys, "metric", F.col("value").alias("after"))
    rows = a.join(b, [*keys, "metric"], "full").withColumn("delta", round_half_even(F.col("after") - F.col("before"), 3))
    worse = F.when(F.col("metric").isin(*LOWER_IS_BETTER), F.col("delta")).otherwise(-F.col("delta"))
    return rows.withColumn("regressed", F.coalesce(worse > threshold, F.lit(False)))


def report_mismatch(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Whether the two reports used the same prompts and data."""
    pick = lambda df, s: df.select(*keys, F.col("fingerprint").alias("f" + s), F.col("dataset").alias("d" + s))
    rows = pick(before, "1").join(pick(after, "2"), keys)
    return rows.select(*keys, (~F.col("f1").eqNullSafe(F.col("f2"))).alias("fingerprint_differs"),
                       (~F.col("d1").eqNullSafe(F.col("d2"))).alias("dataset_differs"))


def metric_trend(history: DataFrame) -> DataFrame:
    """Change of each metric against the report before, within one prompt fingerprint only."""
    rows = previous(history, ["fingerprint", "metric"], "ord", F.col("value"), "before")
    return rows.withColumn("delta", F.col("value") - F.col("before.v")).drop("before")
