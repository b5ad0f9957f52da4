"""The evidence chain: drafts -> findings -> requirements -> tests, recomputed and checked by rule.

Everything is in long form: one row per cited id with its position, keyed by run. Lists are never
collected, so a finding may cite any number of reviews.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.joins import spread_join
from ..functions.numeric import round_half_even

FKEY = ["run_id", "finding_index"]
RKEY = ["run_id", "requirement_id"]

# Rule names, severities, actions and texts that reports show.
NO_SUPPORT = ("finding_has_support", "error", "Finding 没有可验证的支持评论，已拒绝进入结果。", "reject_finding")
FINDING_RULES = {
    "invalid_ids": ("review_reference_exists", "error", "删除不存在的评论引用", "remove_invalid_references"),
    "unknown_ids": ("evidence_audit_reference_exists", "error", "证据复核引用了未被该 Finding 引用的评论", "remove_unknown_audit_references"),
    "repeated_ids": ("evidence_audit_unique", "warning", "证据复核重复返回评论", "deduplicate_audit_references"),
    "missing_ids": ("evidence_audit_complete", "warning", "以下引用缺少语义复核", "audit_missing_references"),
}
BELOW_SUPPORT = ("finding_support_threshold", "warning", "支持证据不足，Finding 标记为 Assumption。", None)
LIMIT_INVALID = "模型引用了不存在的评论 ID，已由系统删除。"
LIMIT_NO_AUDIT = "该 Finding 缺少证据语义复核结果。"
LIMIT_UNKNOWN = "证据语义复核包含未知引用，已由系统删除。"
LIMIT_MISSING = "部分引用缺少语义复核，未计入有效证据。"
LIMIT_IRRELEVANT = "语义复核移除了 %d 条无关评论。"
LIMIT_SUPPORT = "支持证据少于当前样本要求的 %d 条，按假设展示。"
LIMIT_CONFLICT = "存在 %d 条冲突评论。"
FEW_REQUIREMENTS = "可验证证据不足，因此本次输出少于 5 个核心需求。"
NO_SUMMARY = "待生成"
NO_REVIEW = "未找到原评论（引用存在性校验未通过）。"
NO_RATIONALE = "尚未完成证据语义复核。"


def explode_drafts(drafts: DataFrame) -> DataFrame:
    """Nested drafts (two id arrays) to long evidence rows."""
    part = lambda role, c: drafts.select(*FKEY, F.lit(role).alias("role"), F.posexplode(c).alias("pos", "review_id"))
    return part("supporting", "supporting_review_ids").unionByName(part("conflicting", "conflicting_review_ids"))


def resolve_references(evidence: DataFrame, known: DataFrame) -> DataFrame:
    """One row per cited id: supporting, conflicting (support wins) or invalid, with its position."""
    at = lambda role: F.min(F.when(F.col("role") == role, F.col("pos")))
    cited = evidence.groupBy(*FKEY, "review_id").agg(at("supporting").alias("s"), at("conflicting").alias("c"))
    exists = known.select("run_id", "review_id").distinct().withColumn("known", F.lit(True))
    return cited.join(exists, ["run_id", "review_id"], "left").select(
        *FKEY,
        "review_id",
        F.when(F.col("known").isNull(), "invalid").when(F.col("s").isNotNull(), "supporting")
        .otherwise("conflicting").alias("role"),
        F.coalesce("s", "c").alias("pos"),
    )


def merge_audit(resolved: DataFrame, audits: DataFrame) -> DataFrame:
    """Citations against assessments; the first assessment of an id wins."""
    first = audits.groupBy(*FKEY, "review_id").agg(
        F.min_by(F.struct("role", "rationale"), "pos").alias("a"),
        F.min("pos").alias("audit_pos"),
        F.count("*").alias("n_assessments"),
    )
    cited = resolved.where("role <> 'invalid'").withColumnRenamed("role", "cited_role")
    return cited.join(first, [*FKEY, "review_id"], "full").select(
        *FKEY,
        "review_id",
        "cited_role",
        "pos",
        F.col("a.role").alias("audit_role"),
        F.col("a.rationale").alias("rationale"),
        F.coalesce("n_assessments", F.lit(0)).alias("n_assessments"),
        F.when(F.col("cited_role").isNull(), "unknown").when(F.col("a").isNull(), "missing")
        .otherwise("assessed").alias("state"),
    )


def reclassify_evidence(merged: DataFrame) -> DataFrame:
    """Final roles: what the audit says of the assessed citations."""
    return merged.where((F.col("state") == "assessed") & F.col("audit_role").isin("supporting", "conflicting")).select(
        *FKEY, "review_id", F.col("audit_role").alias("role"), "cited_role", "pos"
    )


def audit_counts(merged: DataFrame) -> DataFrame:
    counted = merged.groupBy(*FKEY).agg(
        F.count_if((F.col("state") == "assessed") & (F.col("audit_role") == "irrelevant")).alias("irrelevant"),
        F.count_if(F.col("state") == "missing").alias("missing_ids"),
        F.count_if(F.col("state") == "unknown").alias("unknown_ids"),
        F.count_if((F.col("state") == "assessed") & (F.col("n_assessments") > 1)).alias("repeated_ids"),
    )
    return counted.withColumn(
        "semantic_validated", F.expr("missing_ids = 0 and unknown_ids = 0 and repeated_ids = 0")
    )


def confidence(support: Column, conflicts: Column) -> Column:
    """Volume of support on a log scale, reduced by the share of conflicting evidence."""
    volume = F.least(F.lit(1.0), F.log1p(support.cast("double")) / F.log1p(F.lit(10.0)))
    total = F.greatest(F.lit(1), support + conflicts).cast("double")
    share = conflicts.cast("double") / total
    return F.greatest(F.lit(0.0), volume * (F.lit(1.0) - F.lit(0.5) * share))


def score_findings(
    drafts: DataFrame,
    resolved: DataFrame,
    known: DataFrame,
    audits: DataFrame | None = None,
) -> DataFrame:
    """One row per draft with counts, confidence, status and whether it is rejected."""
    by_role = lambda role: F.count_if(F.col("role") == role)
    cited = resolved.groupBy(*FKEY).agg(
        by_role("supporting").alias("support_count"),
        by_role("conflicting").alias("conflict_count"),
        by_role("invalid").alias("invalid_ids"),
    )
    if audits is None:
        counts = cited.selectExpr(
            "*", "0L as irrelevant", "0L as missing_ids", "0L as unknown_ids", "0L as repeated_ids",
            "false as semantic_validated",
        )
    else:
        merged = merge_audit(resolved, audits)
        assessed = F.col("state") == "assessed"
        final = merged.groupBy(*FKEY).agg(
            F.count_if(assessed & (F.col("audit_role") == "supporting")).alias("support_count"),
            F.count_if(assessed & (F.col("audit_role") == "conflicting")).alias("conflict_count"),
            F.count_if(assessed & (F.col("audit_role") == "irrelevant")).alias("irrelevant"),
            F.count_if(F.col("state") == "missing").alias("missing_ids"),
            F.count_if(F.col("state") == "unknown").alias("unknown_ids"),
            F.count_if(assessed & (F.col("n_assessments") > 1)).alias("repeated_ids"),
        )
        counts = cited.select(*FKEY, "invalid_ids").join(final, FKEY, "left").withColumn(
            "semantic_validated",
            F.expr("coalesce(missing_ids, 0) = 0 and coalesce(unknown_ids, 0) = 0 and coalesce(repeated_ids, 0) = 0"),
        )
    sizes = known.groupBy("run_id").agg(F.count("*").alias("run_reviews"))
    rows = drafts.join(counts, FKEY, "left").join(sizes, "run_id", "left")
    numbers = ["support_count", "conflict_count", "invalid_ids", "irrelevant", "missing_ids", "unknown_ids", "repeated_ids"]
    rows = rows.fillna(0, [*numbers, "run_reviews"])
    exact = confidence(F.col("support_count"), F.col("conflict_count"))
    return (
        rows.withColumn("finding_id", finding_id(F.col("finding_index")))
        .withColumn("minimum_support", F.when(F.col("run_reviews") < 20, 1).otherwise(2))
        .withColumn("rejected", F.col("support_count") == 0)
        .withColumn("confidence", round_half_even(exact, 2))
        .withColumn(
            "evidence_status",
            F.when(F.col("rejected"), "rejected")
            .when(
                (F.col("support_count") >= F.col("minimum_support"))
                & (F.col("invalid_ids") == 0)
                & (F.col("semantic_validated") | F.lit(audits is None)),
                "validated",
            )
            .otherwise("assumption"),
        )
    )


def finding_id(index: Column) -> Column:
    return F.format_string("F-%03d", index + 1)


def _issue(condition: Column, rule: tuple, ids: Column) -> Column:
    name, severity, message, action = rule
    return F.when(
        condition,
        F.struct(
            F.lit(name).alias("rule"), F.lit(severity).alias("severity"), F.lit(message).alias("message"),
            F.lit(action).cast("string").alias("revision_action"), ids.cast("bigint").alias("n_ids"),
        ),
    )


def finding_issues(scored: DataFrame) -> DataFrame:
    """Rule rows per finding; `finding_issue_ids` lists the ids behind the counts."""
    none = F.lit(None)
    found = [_issue(F.col(c) > 0, rule, F.col(c)) for c, rule in FINDING_RULES.items()]
    found.append(_issue(F.col("rejected"), NO_SUPPORT, none))
    found.append(
        _issue(~F.col("rejected") & (F.col("support_count") < F.col("minimum_support")), BELOW_SUPPORT, none)
    )
    return scored.select(
        "run_id",
        F.lit("finding").alias("entity_type"),
        F.col("finding_id").alias("entity_id"),
        F.explode(F.filter(F.array(*found), lambda i: i.isNotNull())).alias("i"),
    ).select("run_id", "entity_type", "entity_id", "i.*")


def finding_issue_ids(resolved: DataFrame, audits: DataFrame | None = None) -> DataFrame:
    """The ids behind each finding issue, one per row."""
    fid = finding_id(F.col("finding_index")).alias("entity_id")
    rows = resolved.where("role = 'invalid'").select("run_id", fid, F.lit("review_reference_exists").alias("rule"), "review_id")
    if audits is None:
        return rows
    rule = (
        F.when(F.col("state") == "unknown", "evidence_audit_reference_exists")
        .when(F.col("state") == "missing", "evidence_audit_complete")
        .when(F.col("n_assessments") > 1, "evidence_audit_unique")
    )
    audit_rows = merge_audit(resolved, audits).select("run_id", fid, rule.alias("rule"), "review_id")
    return rows.unionByName(audit_rows.where("rule is not null"))


def report_validity(issues: DataFrame, runs: DataFrame) -> DataFrame:
    """A report is valid when it has no error."""
    errors = issues.groupBy("run_id").agg(
        F.count_if(F.col("severity") == "error").alias("errors"), F.count("*").alias("issues")
    )
    return runs.select("run_id").join(errors, "run_id", "left").fillna(0).withColumn("valid", F.col("errors") == 0)


def finding_limitations(scored: DataFrame, audit_items: DataFrame | None = None) -> DataFrame:
    """Distinct limitation texts in order, for accepted findings."""
    rows = scored
    audited = audit_items is not None
    if audited:
        rows = rows.join(audit_items.withColumn("has_audit", F.lit(True)), FKEY, "left")
    else:
        rows = rows.withColumn("audit_limitations", F.lit(None).cast("array<string>")).withColumn("has_audit", F.lit(True))
    text = lambda cond, value: F.when(cond, F.array(value)).otherwise(F.array().cast("array<string>"))
    n = F.col
    parts = [
        F.array_distinct("limitations"),
        text(n("invalid_ids") > 0, F.lit(LIMIT_INVALID)),
        text(n("has_audit").isNull(), F.lit(LIMIT_NO_AUDIT)),
        F.coalesce(n("audit_limitations"), F.array().cast("array<string>")),
        text(n("unknown_ids") > 0, F.lit(LIMIT_UNKNOWN)),
        text(n("missing_ids") > 0, F.lit(LIMIT_MISSING)),
        text(n("irrelevant") > 0, F.format_string(LIMIT_IRRELEVANT, n("irrelevant"))),
        text(n("support_count") < n("minimum_support"), F.format_string(LIMIT_SUPPORT, n("minimum_support"))),
        text(n("conflict_count") > 0, F.format_string(LIMIT_CONFLICT, n("conflict_count"))),
    ]
    return rows.where(~F.col("rejected")).select(
        "run_id", "finding_id", F.posexplode(F.array_distinct(F.concat(*parts))).alias("pos", "limitation")
    )


def consolidate_by_topic(drafts: DataFrame, evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Merge drafts of a run that share a topic key; the first draft's text stays."""
    lead = drafts.where("topic_key <> ''").groupBy("run_id", "topic_key").agg(F.min("finding_index").alias("lead"))
    mapped = drafts.select(*FKEY, "topic_key").join(lead, ["run_id", "topic_key"], "left").select(
        *FKEY, F.coalesce("lead", "finding_index").alias("lead")
    )
    merged_drafts = drafts.join(mapped.where("lead = finding_index").select(*FKEY), FKEY, "left_semi")
    moved = spread_join(evidence, mapped, FKEY, ["review_id"])
    merged_evidence = (
        moved.groupBy("run_id", F.col("lead").alias("finding_index"), "role", "review_id")
        .agg(F.min(F.struct(F.col("finding_index").alias("draft"), "pos")).alias("at"))
        .select(*FKEY, "role", "review_id", F.col("at.draft").alias("draft"), F.col("at.pos").alias("pos"))
    )
    return merged_drafts, merged_evidence


# ---- requirements and tests ----

COMPLEXITY_COST = {"low": 1.0, "medium": 2.0, "high": 3.0}  # fixed values
MAX_REQUIREMENTS = 10


def link_findings(links: DataFrame, findings: DataFrame) -> DataFrame:
    """Distinct links of each draft to accepted findings, at their first position."""
    eligible = findings.where("evidence_status <> 'rejected'").select("run_id", "finding_id", "confidence", "evidence_status")
    return (
        links.groupBy("run_id", "draft_no", "finding_id").agg(F.min("pos").alias("pos"))
        .join(eligible, ["run_id", "finding_id"])
    )


def requirement_sources(linked: DataFrame, support: DataFrame) -> DataFrame:
    """Distinct supporting ids behind each draft, at their first (link, evidence) position."""
    many = support.select("run_id", "finding_id", "review_id", F.col("pos").alias("evidence_pos"))
    few = linked.select("run_id", "finding_id", "draft_no", F.col("pos").alias("link_pos"))
    joined = spread_join(many, few, ["run_id", "finding_id"], ["review_id"])
    return joined.groupBy("run_id", "draft_no", "review_id").agg(
        F.min(F.struct("link_pos", "evidence_pos")).alias("at")
    )


def plan_requirements(
    drafts: DataFrame, linked: DataFrame, sources: DataFrame, totals: DataFrame
) -> DataFrame:
    """Priority, target version and rank: the ten best drafts of each run, numbered by score."""
    link_stats = linked.groupBy("run_id", "draft_no").agg(
        (F.sum(F.round(F.col("confidence") * 100).cast("bigint")) / F.lit(100.0) / F.count("*")).alias("mean_confidence"),
        F.bool_or(F.col("evidence_status") == "assumption").alias("has_assumption"),
        F.count("*").alias("n_findings"),
    )
    source_counts = sources.groupBy("run_id", "draft_no").agg(F.count("*").alias("n_reviews"))
    cost = F.create_map(*[F.lit(v) for kv in COMPLEXITY_COST.items() for v in kv])
    frequency = F.col("n_reviews").cast("double") / F.greatest(F.col("total_reviews"), F.lit(1)).cast("double")
    score = F.col("impact").cast("double") * frequency * F.col("mean_confidence") * 100.0 / cost[F.col("complexity")]
    place = F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("priority_score"), "draft_no"))
    return (
        drafts.join(link_stats, ["run_id", "draft_no"])
        .join(source_counts, ["run_id", "draft_no"], "left")
        .join(totals, "run_id")
        .fillna(0, ["n_reviews"])
        .withColumn("priority_score", round_half_even(score, 2))
        .withColumn("target_version", F.when(F.col("has_assumption"), "Future").otherwise(F.col("proposed_version")))
        .withColumn("place", place)
        .where(F.col("place") <= MAX_REQUIREMENTS)
        .withColumn("requirement_id", F.format_string("REQ-%03d", "place"))
    )


def quantity_notice(requirements: DataFrame, runs: DataFrame) -> DataFrame:
    counts = requirements.groupBy("run_id").agg(F.count("*").alias("n_requirements"))
    return runs.select("run_id").join(counts, "run_id", "left").fillna(0).withColumn(
        "notice", F.when(F.col("n_requirements") < 5, FEW_REQUIREMENTS)
    )


def inherit_tests(test_drafts: DataFrame, requirements: DataFrame) -> DataFrame:
    """Number the tests of a run in requirement order; a run has at most ten requirements."""
    rows = test_drafts.join(requirements.select("run_id", "draft_no", "requirement_id", "place"), ["run_id", "draft_no"])
    number = F.row_number().over(Window.partitionBy("run_id").orderBy("place", "pos"))
    return rows.withColumn("test_case_id", F.format_string("TC-%03d", number)).drop("place")


# ---- traceability ----

# Rule name and message.
TRACE = {
    "review_to_finding": "Finding 引用了不存在的评论。",
    "finding_to_requirement": "Requirement 缺少有效且唯一的 Finding 路径。",
    "requirement_uses_eligible_finding": "Requirement 不能基于已拒绝的 Finding。",
    "requirement_reviews_inherit_findings": "Requirement 未完整继承 Finding 的评论来源。",
    "test_without_requirement": "TestCase 关联了不存在的 Requirement。",
    "test_sources": "TestCase 未完整继承 Requirement 的评论来源。",
    "test_case_count_per_requirement": "每个 Requirement 必须关联 2–4 条 TestCase。",
}


def _trace(df: DataFrame, kind: str, ident: str, rule: str, message: str) -> DataFrame:
    return df.select(
        "run_id", F.lit(kind).alias("entity_type"), F.col(ident).alias("entity_id"),
        F.lit(rule).alias("rule"), F.lit(message).alias("message"),
    )


def unequal_sets(left: DataFrame, right: DataFrame, keys: list[str], item: str = "review_id") -> DataFrame:
    """Keys whose two item sets differ, by one grouped pass; keys missing on one side count."""
    a = left.select(*keys, item, F.lit(1).alias("l"), F.lit(0).alias("r"))
    b = right.select(*keys, item, F.lit(0).alias("l"), F.lit(1).alias("r"))
    sides = a.unionByName(b).groupBy(*keys, item).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    return sides.where("l <> r").select(*keys).distinct()


def trace_issues(
    reviews: DataFrame,
    findings: DataFrame,
    finding_evidence: DataFrame,
    requirements: DataFrame,
    requirement_links: DataFrame,
    requirement_reviews: DataFrame,
    tests: DataFrame,
    test_reviews: DataFrame,
) -> DataFrame:
    """All trace rules over all runs."""
    out = []
    for frame, kind, ident in ((findings, "finding", "finding_id"), (requirements, "requirement", "requirement_id"),
                               (tests, "test_case", "test_case_id")):
        repeated = frame.groupBy("run_id", ident).agg(F.count("*").alias("n")).where("n > 1")
        out.append(_trace(repeated, kind, ident, "entity_id_unique", f"{kind} ID 重复，追溯链不唯一。"))

    dangling = finding_evidence.join(reviews.select("run_id", "review_id").distinct(), ["run_id", "review_id"], "left_anti")
    out.append(_trace(dangling.select("run_id", "finding_id").distinct(), "finding", "finding_id",
                      "review_to_finding", TRACE["review_to_finding"]))

    index = findings.groupBy("run_id", "finding_id").agg(F.max_by("evidence_status", "finding_index").alias("status"))
    linked = requirement_links.join(index, ["run_id", "finding_id"], "left").groupBy(*RKEY).agg(
        F.count("status").alias("linked"),
        F.count_distinct("finding_id").alias("named"),
        F.bool_or(F.coalesce(F.col("status") == "rejected", F.lit(False))).alias("uses_rejected"),
    )
    per_requirement = requirements.select(*RKEY).distinct().join(linked, RKEY, "left").fillna(0, ["linked", "named"])
    out.append(_trace(per_requirement.where("linked <> named"), "requirement", "requirement_id",
                      "finding_to_requirement", TRACE["finding_to_requirement"]))
    out.append(_trace(per_requirement.where("uses_rejected"), "requirement", "requirement_id",
                      "requirement_uses_eligible_finding", TRACE["requirement_uses_eligible_finding"]))

    support = finding_evidence.where("role = 'supporting'")
    expected = spread_join(
        support.select("run_id", "finding_id", "review_id"),
        requirement_links.select(*RKEY, "finding_id").distinct(), ["run_id", "finding_id"], ["review_id"],
    )
    own = requirement_reviews.join(requirements.select(*RKEY).distinct(), RKEY, "left_semi")
    out.append(_trace(unequal_sets(expected, own, RKEY), "requirement", "requirement_id",
                      "requirement_reviews_inherit_findings", TRACE["requirement_reviews_inherit_findings"]))

    ids = requirements.select(*RKEY).distinct()
    orphans = tests.join(ids, RKEY, "left_anti")
    out.append(_trace(orphans, "test_case", "test_case_id", "requirement_to_test_case", TRACE["test_without_requirement"]))
    owned = tests.join(ids, RKEY, "left_semi")
    wanted = spread_join(
        own.select(*RKEY, "review_id"), owned.select(*RKEY, "test_case_id"), RKEY, ["review_id"]
    ).select("run_id", "test_case_id", "review_id")
    given = test_reviews.join(owned.select("run_id", "test_case_id").distinct(), ["run_id", "test_case_id"], "left_semi")
    out.append(_trace(unequal_sets(wanted, given, ["run_id", "test_case_id"]), "test_case", "test_case_id",
                      "requirement_to_test_case", TRACE["test_sources"]))

    counts = ids.join(tests.groupBy(*RKEY).agg(F.count("*").alias("n")), RKEY, "left").fillna(0, ["n"])
    out.append(_trace(counts.where("n not between 2 and 4"), "requirement", "requirement_id",
                      "test_case_count_per_requirement", TRACE["test_case_count_per_requirement"]))
    result = out[0]
    for frame in out[1:]:
        result = result.unionByName(frame)
    return result


def trace_rows(findings: DataFrame, support: DataFrame, requirement_links: DataFrame, tests: DataFrame) -> DataFrame:
    """Test, linked finding and each of its supporting reviews with its position; unresolved links are skipped.

    The list of reviews of a (test, finding) stays in long form, however long it is.
    """
    return (
        tests.select(*RKEY, "test_case_id")
        .join(requirement_links.select(*RKEY, "finding_id"), RKEY)
        .join(findings.select("run_id", "finding_id"), ["run_id", "finding_id"])
        .join(support.select("run_id", "finding_id", "review_id", "pos"), ["run_id", "finding_id"])
        .select("run_id", "test_case_id", "requirement_id", "finding_id", "pos", "review_id")
    )


def trace_rollup(requirements: DataFrame, links: DataFrame, sources: DataFrame, tests: DataFrame) -> DataFrame:
    """Per requirement, in long form: its findings, source reviews and tests, each with its place in that list."""
    known = requirements.select(*RKEY)
    row = lambda df, kind, pos, value: df.select(*RKEY, F.lit(kind).alias("kind"), F.col(pos).cast("string").alias("pos"), F.col(value).alias("id"))
    listed = row(links, "finding", "pos", "finding_id").unionByName(row(sources, "review", "review_id", "review_id")).unionByName(row(tests, "test", "test_case_id", "test_case_id"))
    return known.join(listed, RKEY)


def evidence_detail(resolved: DataFrame, reviews: DataFrame, audits: DataFrame, labels: dict[str, str]) -> DataFrame:
    """One row per cited id with role label, text or a placeholder, summary and rationale."""
    first = audits.groupBy(*FKEY, "review_id").agg(
        F.max_by(F.struct(F.col("role").alias("audit_role"), "rationale"), "pos").alias("a")
    )
    rows = resolved.join(first, [*FKEY, "review_id"], "left").join(
        reviews.select("run_id", "review_id", "content_original", "content_summary"), ["run_id", "review_id"], "left"
    )
    role = F.coalesce("a.audit_role", "role")
    names = F.create_map(*[F.lit(v) for kv in labels.items() for v in kv])
    blank = F.trim(F.coalesce("content_summary", F.lit(""))) == ""
    return rows.select(
        *FKEY, "review_id",
        F.coalesce(F.try_element_at(names, role), role).alias("role"),
        F.coalesce("content_original", F.lit(NO_REVIEW)).alias("content"),
        F.when(blank, NO_SUMMARY).otherwise(F.col("content_summary")).alias("summary"),
        F.coalesce("a.rationale", F.lit(NO_RATIONALE)).alias("rationale"),
    )


# ---- whole-run views ----


def limitations_union(runs: DataFrame, limitations: DataFrame) -> DataFrame:
    """Run limitations (online shortfall, id collisions) and finding limitations in one table."""
    shortfall = F.when(
        (F.col("source_type") == "online") & (F.col("input_count") < F.col("review_limit")),
        F.format_string("在线采集目标 %d 条，实际获得 %d 条；样本短缺会降低证据覆盖度。", "review_limit", "input_count"),
    )
    collided = F.when(
        F.col("review_id_collisions") > 0,
        F.format_string(
            "发现 %d 个重复评论 ID 对应不同正文；已稳定重命名，后续证据链使用重命名后的唯一 ID。", "review_id_collisions"
        ),
    )
    run_rows = runs.select(
        "run_id", F.lit("run").alias("scope"), F.col("run_id").alias("entity_id"),
        F.explode(F.filter(F.array(shortfall, collided), lambda v: v.isNotNull())).alias("limitation"),
    )
    finding_rows = limitations.select(
        "run_id", F.lit("finding").alias("scope"), F.col("finding_id").alias("entity_id"), "limitation"
    )
    return run_rows.unionByName(finding_rows)


def review_gate(runs: DataFrame, trace: DataFrame) -> DataFrame:
    """Deterministic verdict per requested run.

    `runs`: run_id, status (null when the run does not exist), trace_state (null when no trace was
    stored, else 'ok' or 'malformed'). `trace`: issues with `ord`. Only the first three messages
    of a run are shown; the aggregate keeps just those.
    """
    place = F.row_number().over(Window.partitionBy("run_id").orderBy("ord"))
    top = trace.withColumn("place", place).where("place <= 3")
    shown = top.groupBy("run_id").agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("place", "message")))["message"], "; ").alias("shown")
    )
    feedback = (
        F.when(F.col("status").isNull(), "分析运行不存在")
        .when(F.col("status") != "completed", F.concat(F.lit("分析未完成（状态："), F.col("status"), F.lit("）")))
        .when(F.col("trace_state").isNull(), "缺少追溯校验结果")
        .when(F.col("trace_state") != "ok", "追溯校验结果格式异常")
        .when(F.col("shown").isNotNull(), F.concat(F.lit("证据链校验未通过："), F.col("shown")))
        .otherwise("")
    )
    return runs.join(shown, "run_id", "left").select("run_id", (feedback == "").alias("approved"), feedback.alias("feedback"))


def run_outcome(runs: DataFrame, trace: DataFrame) -> DataFrame:
    """Valid trace: completed at coverage 1; otherwise partial, at most 0.99."""
    issues = trace.groupBy("run_id").agg(F.count("*").alias("n_issues"))
    return runs.select("run_id", "coverage_ratio").join(issues, "run_id", "left").fillna(0, ["n_issues"]).select(
        "run_id", "n_issues",
        F.when(F.col("n_issues") == 0, "completed").otherwise("partial").alias("status"),
        F.when(F.col("n_issues") == 0, 1.0).otherwise(F.least("coverage_ratio", F.lit(0.99))).alias("coverage_ratio"),
    )


def batch_progress(manifest: DataFrame, outputs: DataFrame) -> DataFrame:
    """Batches done, the first one missing (the total when none is) and coverage."""
    done = outputs.select("run_id", "batch").distinct().withColumn("done", F.lit(True))
    return (
        manifest.join(done, ["run_id", "batch"], "left").groupBy("run_id")
        .agg(
            F.count("*").alias("total"),
            F.count("done").alias("completed"),
            F.min(F.when(F.col("done").isNull(), F.col("batch"))).alias("missing"),
        )
        .select(
            "run_id", "total", "completed",
            F.coalesce("missing", "total").alias("first_missing"),
            F.least(F.col("completed") / F.col("total"), F.lit(0.99)).alias("coverage_ratio"),
        )
    )


def overview(stats: DataFrame, findings: DataFrame, requirements: DataFrame, tests: DataFrame) -> DataFrame:
    """Per run: reviews in, kept, removed, and the size of each later table."""
    count = lambda df, name: df.groupBy("run_id").agg(F.count("*").alias(name))
    return (
        stats.join(count(findings, "findings"), "run_id", "left")
        .join(count(requirements, "requirements"), "run_id", "left")
        .join(count(tests, "tests"), "run_id", "left")
        .fillna(0, ["findings", "requirements", "tests"])
        .select(
            "run_id", "input_count", "output_count",
            (F.col("exact_duplicates") + F.col("near_duplicates")).alias("duplicates"),
            "empty_removed", "findings", "requirements", "tests",
        )
    )


def pipeline_invariants(
    runs: DataFrame, reviews: DataFrame, findings: DataFrame, finding_evidence: DataFrame,
    requirements: DataFrame, requirement_links: DataFrame, requirement_reviews: DataFrame,
    tests: DataFrame, test_reviews: DataFrame, trace: DataFrame, notices: DataFrame,
) -> DataFrame:
    """(run, check, entity, ok) for the whole chain; a run that is not completed has one row only.

    notices (run_id, notice): what the runs said about too few requirements.
    """
    check = lambda df, name, entity, ok: df.select(
        "run_id", F.lit(name).alias("check"), entity.cast("string").alias("entity"), ok.alias("ok")
    )
    none = F.lit(None)
    live = runs.where("status = 'completed'").select("run_id")
    on = lambda df: df.join(live, "run_id", "left_semi")
    counted = lambda df, agg: live.join(df.groupBy("run_id").agg(agg.alias("n")), "run_id", "left").fillna(0, ["n"])

    out = [check(runs, "run_completed", none, F.col("status") == "completed")]
    out.append(check(counted(reviews, F.count("*")), "cleaned_reviews_nonempty", none, F.col("n") > 0))
    blank = F.count_if(F.coalesce(F.col("content_summary"), F.lit("")) == "")
    out.append(check(counted(reviews, blank), "summaries_cover_cleaned_reviews", none, F.col("n") == 0))
    out.append(check(counted(findings, F.count("*")), "findings_exist", none, F.col("n") > 0))

    f = on(findings)
    evidence = on(finding_evidence).join(
        reviews.select("run_id", "review_id").withColumn("known", F.lit(1)), ["run_id", "review_id"], "left"
    ).groupBy("run_id", "finding_id").agg(
        F.count_if(F.col("known").isNull()).alias("dangling"),
        F.count_if(F.col("role") == "supporting").alias("s"),
        F.count_if(F.col("role") == "conflicting").alias("c"),
    )
    fe = f.join(evidence, ["run_id", "finding_id"], "left").fillna(0, ["dangling", "s", "c"])
    fid = F.col("finding_id")
    out.append(check(fe, "finding_references_exist", fid, F.col("dangling") == 0))
    out.append(check(fe, "finding_counts_match", fid, F.expr("support_count = s and conflict_count = c")))
    out.append(check(f, "finding_confidence_range", fid, F.expr("confidence > 0 and confidence <= 1")))
    out.append(check(f, "finding_status_allowed", fid, F.col("evidence_status").isin("validated", "assumption")))

    r = on(requirements).select(*RKEY)
    said = notices.where(F.coalesce("notice", F.lit("")) != "").select("run_id").distinct().withColumn("said", F.lit(True))
    numbers = counted(requirements, F.count("*")).join(said, "run_id", "left")
    out.append(check(numbers, "requirement_count_in_range_or_notice", none, F.col("n").between(5, 10) | F.coalesce("said", F.lit(False))))
    expected = spread_join(
        on(finding_evidence).where("role = 'supporting'").select("run_id", "finding_id", "review_id"),
        on(requirement_links).select(*RKEY, "finding_id").distinct(), ["run_id", "finding_id"], ["review_id"],
    )
    broken = unequal_sets(expected, on(requirement_reviews), RKEY).withColumn("broken", F.lit(True))
    out.append(check(r.join(broken, RKEY, "left"), "requirement_inherits_reviews", F.col("requirement_id"), F.col("broken").isNull()))

    t = on(tests).select(*RKEY, "test_case_id").join(r.distinct().withColumn("known", F.lit(True)), RKEY, "left")
    tid = F.col("test_case_id")
    out.append(check(t, "test_links_requirement", tid, F.col("known").isNotNull()))
    owned = t.where("known")
    wanted = spread_join(on(requirement_reviews).select(*RKEY, "review_id"), owned.select(*RKEY, "test_case_id"), RKEY, ["review_id"])
    tkey = ["run_id", "test_case_id"]
    uneven = unequal_sets(wanted, on(test_reviews).join(owned.select(*tkey), tkey, "left_semi"), tkey).withColumn("broken", F.lit(True))
    out.append(check(owned.join(uneven, tkey, "left"), "test_inherits_reviews", tid, F.col("broken").isNull()))
    sizes = owned.groupBy(*RKEY).agg(F.count("*").alias("k")).groupBy("run_id").agg(F.count_if(~F.col("k").between(2, 4)).alias("n"))
    out.append(check(live.join(sizes, "run_id", "left").fillna(0, ["n"]), "test_case_count_2_to_4_per_requirement", none, F.col("n") == 0))
    out.append(check(counted(trace, F.count("*")), "traceability_valid", none, F.col("n") == 0))
    result = out[0]
    for frame in out[1:]:
        result = result.unionByName(frame)
    return result


def apply_summaries(reviews: DataFrame, summaries: DataFrame) -> DataFrame:
    """The first summary of each known id, in batch order; other reviews stay as they are."""
    first = summaries.groupBy("run_id", "review_id").agg(
        F.min_by("summary", F.struct("batch", "pos")).alias("content_summary")
    )
    return reviews.join(first, ["run_id", "review_id"], "left")


def cited_reviews(evidence: DataFrame, reviews: DataFrame, fields: list[str]) -> DataFrame:
    """Projection of the reviews some draft cites."""
    return reviews.select("run_id", *fields).join(
        evidence.select("run_id", "review_id").distinct(), ["run_id", "review_id"], "left_semi"
    )
