"""Evidence chain queries."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import functions as F

from ..operators import evidence as ev
from ..session import ensure_checkpoint_dir
from .bindings import Tables
from .registry import cte, query
from .sqlbase import half_even


class Chain:
    """The tables of one evidence chain over the bound drafts."""

    def __init__(self, t: Tables, staged: bool = False):
        self.t = t
        self.staged = staged

    def _stage(self, df):
        """A stage table that several later steps read: written once to the checkpoint folder."""
        if not self.staged:
            return df
        ensure_checkpoint_dir(self.t.spark)
        return df.checkpoint()

    @cached_property
    def resolved(self):
        return ev.resolve_references(self.t.draft_evidence, self.t.known_reviews)

    @cached_property
    def merged(self):
        return ev.merge_audit(self.resolved, self.t.audits)

    @cached_property
    def scored(self):
        return ev.score_findings(self.t.drafts, self.resolved, self.t.known_reviews, self.t.audits)

    @cached_property
    def findings(self):
        return self._stage(self.scored.where("not rejected"))

    @cached_property
    def final_evidence(self):
        return self._stage(
            ev.reclassify_evidence(self.merged).withColumn("finding_id", ev.finding_id(F.col("finding_index")))
        )

    @cached_property
    def support(self):
        return self.final_evidence.where("role = 'supporting'")

    @cached_property
    def linked(self):
        return ev.link_findings(self.t.requirement_draft_links, self.findings)

    @cached_property
    def draft_sources(self):
        return self._stage(ev.requirement_sources(self.linked, self.support))

    @cached_property
    def requirements(self):
        totals = self.t.known_reviews.groupBy("run_id").agg(F.count("*").alias("total_reviews"))
        return self._stage(ev.plan_requirements(self.t.requirement_drafts, self.linked, self.draft_sources, totals))

    @cached_property
    def links(self):
        ids = self.requirements.select("run_id", "draft_no", "requirement_id")
        return self.linked.join(ids, ["run_id", "draft_no"]).select("run_id", "requirement_id", "pos", "finding_id")

    @cached_property
    def sources(self):
        ids = self.requirements.select("run_id", "draft_no", "requirement_id")
        return self.draft_sources.join(ids, ["run_id", "draft_no"]).select("run_id", "requirement_id", "review_id", "at")

    @cached_property
    def tests(self):
        return self._stage(ev.inherit_tests(self.t.test_drafts, self.requirements))

    @cached_property
    def test_sources(self):
        few = self.tests.select("run_id", "requirement_id", "test_case_id")
        return ev.spread_join(
            self.sources.select("run_id", "requirement_id", "review_id"), few, ev.RKEY, ["review_id"]
        ).select("run_id", "test_case_id", "review_id")

    # The same chain with planted faults, so that every trace rule fires.

    @cached_property
    def faulty(self):
        n = F.regexp_extract("run_id", r"(\d+)$", 1).cast("int")
        bad = lambda k: n % 6 == k
        findings = self.findings.withColumn(
            "evidence_status", F.when(bad(1) & (F.col("finding_index") == 1), "rejected").otherwise(F.col("evidence_status"))
        )
        evidence = self.final_evidence.select("run_id", "finding_id", "review_id", "role", "pos").withColumn(
            "review_id", F.when(bad(2) & (F.col("pos") % 5 == 0), F.concat(F.lit("z"), "pos")).otherwise(F.col("review_id"))
        )
        repeated = self.links.where(bad(3) & (F.col("pos") == 0)).withColumn("pos", F.lit(9))
        lost = self.links.where(bad(4)).withColumn("pos", F.lit(8)).withColumn("finding_id", F.lit("F-777"))
        links = self.links.unionByName(repeated).unionByName(lost)
        tests = self.tests.select("run_id", "test_case_id", "requirement_id").withColumn(
            "requirement_id", F.when(bad(5) & (F.col("test_case_id") == "TC-001"), "REQ-404").otherwise(F.col("requirement_id"))
        ).withColumn("test_case_id", F.when(bad(0) & (F.col("test_case_id") == "TC-002"), "TC-003").otherwise(F.col("test_case_id")))
        test_sources = self.test_sources.where(~(bad(1) & (F.col("test_case_id") == "TC-004")))
        return findings, evidence, links, tests, test_sources

    @cached_property
    def trace(self):
        findings, evidence, links, tests, test_sources = self.faulty
        return self._stage(ev.trace_issues(
            self.t.known_reviews, findings, evidence, self.requirements.select("run_id", "requirement_id"),
            links, self.sources, tests, test_sources,
        ))


cte("resolved", """
SELECT run_id, finding_index, review_id,
       CASE WHEN NOT known THEN 'invalid' WHEN s IS NOT NULL THEN 'supporting' ELSE 'conflicting' END AS role,
       coalesce(s, c) AS pos
FROM (SELECT run_id, finding_index, review_id, min(pos) FILTER (WHERE role = 'supporting') AS s,
             min(pos) FILTER (WHERE role = 'conflicting') AS c,
             (run_id, review_id) IN (SELECT (run_id, review_id) FROM known_reviews) AS known
      FROM draft_evidence GROUP BY ALL)
""")
cte("merged", """
SELECT coalesce(c.run_id, a.run_id) AS run_id, coalesce(c.finding_index, a.finding_index) AS finding_index,
       coalesce(c.review_id, a.review_id) AS review_id, c.role AS cited_role, c.pos,
       a.role AS audit_role, a.rationale, coalesce(a.n, 0) AS n_assessments,
       CASE WHEN c.review_id IS NULL THEN 'unknown' WHEN a.review_id IS NULL THEN 'missing' ELSE 'assessed' END AS state
FROM (SELECT * FROM resolved WHERE role <> 'invalid') c
FULL JOIN (SELECT run_id, finding_index, review_id, arg_min(role, pos) AS role, arg_min(rationale, pos) AS rationale, count(*) AS n
           FROM audits GROUP BY ALL) a
ON c.run_id = a.run_id AND c.finding_index = a.finding_index AND c.review_id = a.review_id
""")
cte("counted", """
SELECT d.run_id, d.finding_index, d.title, d.topic_key, s.run_reviews,
       coalesce(i.invalid_ids, 0) AS invalid_ids,
       coalesce(m.support_count, 0) AS support_count, coalesce(m.conflict_count, 0) AS conflict_count,
       coalesce(m.irrelevant, 0) AS irrelevant, coalesce(m.missing_ids, 0) AS missing_ids,
       coalesce(m.unknown_ids, 0) AS unknown_ids, coalesce(m.repeated_ids, 0) AS repeated_ids
FROM drafts d
LEFT JOIN (SELECT run_id, finding_index, count(*) FILTER (WHERE role = 'invalid') AS invalid_ids FROM resolved GROUP BY ALL) i
  USING (run_id, finding_index)
LEFT JOIN (SELECT run_id, finding_index,
             count(*) FILTER (WHERE state = 'assessed' AND audit_role = 'supporting') AS support_count,
             count(*) FILTER (WHERE state = 'assessed' AND audit_role = 'conflicting') AS conflict_count,
             count(*) FILTER (WHERE state = 'assessed' AND audit_role = 'irrelevant') AS irrelevant,
             count(*) FILTER (WHERE state = 'missing') AS missing_ids,
             count(*) FILTER (WHERE state = 'unknown') AS unknown_ids,
             count(*) FILTER (WHERE state = 'assessed' AND n_assessments > 1) AS repeated_ids
           FROM merged GROUP BY ALL) m USING (run_id, finding_index)
LEFT JOIN (SELECT run_id, count(*) AS run_reviews FROM known_reviews GROUP BY ALL) s USING (run_id)
""")
cte("scored", f"""
SELECT *, printf('F-%03d', finding_index + 1) AS finding_id,
       CASE WHEN run_reviews < 20 THEN 1 ELSE 2 END AS minimum_support, support_count = 0 AS rejected,
       missing_ids = 0 AND unknown_ids = 0 AND repeated_ids = 0 AS semantic_validated,
       {half_even("greatest(0.0, least(1.0, ln(1 + support_count) / ln(11)) * (1 - 0.5 * (CAST(conflict_count AS DOUBLE) / greatest(1, support_count + conflict_count))))", 2)} AS confidence,
       CASE WHEN support_count = 0 THEN 'rejected'
            WHEN support_count >= (CASE WHEN run_reviews < 20 THEN 1 ELSE 2 END) AND invalid_ids = 0
                 AND missing_ids = 0 AND unknown_ids = 0 AND repeated_ids = 0 THEN 'validated'
            ELSE 'assumption' END AS evidence_status
FROM counted
""")
cte("findings", "SELECT * FROM scored WHERE NOT rejected")
cte("final_evidence", """
SELECT run_id, finding_index, printf('F-%03d', finding_index + 1) AS finding_id, review_id, audit_role AS role, cited_role, pos
FROM merged WHERE state = 'assessed' AND audit_role IN ('supporting', 'conflicting')
""")
cte("linked", """
SELECT l.run_id, l.draft_no, l.finding_id, min(l.pos) AS pos, any_value(f.confidence) AS confidence, any_value(f.evidence_status) AS evidence_status
FROM requirement_draft_links l JOIN findings f USING (run_id, finding_id) GROUP BY l.run_id, l.draft_no, l.finding_id
""")
cte("draft_sources", """
SELECT DISTINCT l.run_id, l.draft_no, e.review_id FROM linked l JOIN final_evidence e USING (run_id, finding_id) WHERE e.role = 'supporting'
""")
cte("requirements", f"""
SELECT *, printf('REQ-%03d', place) AS requirement_id FROM (
  SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY priority_score DESC, draft_no) AS place FROM (
    SELECT d.*, l.n_findings, s.n_reviews, CASE WHEN l.has_assumption THEN 'Future' ELSE 'V1.0' END AS target_version,
           {half_even("CAST(d.impact AS DOUBLE) * (CAST(s.n_reviews AS DOUBLE) / CAST(t.total_reviews AS DOUBLE)) * l.mean_confidence * 100.0 / (CASE d.complexity WHEN 'low' THEN 1.0 WHEN 'medium' THEN 2.0 ELSE 3.0 END)", 2)} AS priority_score
    FROM requirement_drafts d
    JOIN (SELECT run_id, draft_no, CAST(sum(CAST(round(confidence * 100) AS BIGINT)) AS DOUBLE) / CAST(100 AS DOUBLE) / count(*) AS mean_confidence,
                 bool_or(evidence_status = 'assumption') AS has_assumption, count(*) AS n_findings
          FROM linked GROUP BY ALL) l USING (run_id, draft_no)
    JOIN (SELECT run_id, draft_no, count(*) AS n_reviews FROM draft_sources GROUP BY ALL) s USING (run_id, draft_no)
    JOIN (SELECT run_id, count(*) AS total_reviews FROM known_reviews GROUP BY ALL) t USING (run_id)
  )
) WHERE place <= 10
""")
cte("links", "SELECT l.run_id, r.requirement_id, l.pos, l.finding_id FROM linked l JOIN requirements r USING (run_id, draft_no)")
cte("sources", "SELECT s.run_id, r.requirement_id, s.review_id FROM draft_sources s JOIN requirements r USING (run_id, draft_no)")
cte("tests", """
SELECT d.run_id, r.requirement_id, d.title, d.case_type, d.pos,
       printf('TC-%03d', row_number() OVER (PARTITION BY d.run_id ORDER BY r.place, d.pos)) AS test_case_id
FROM test_drafts d JOIN requirements r USING (run_id, draft_no)
""")
cte("run_no", "SELECT DISTINCT run_id, CAST(regexp_extract(run_id, '([0-9]+)$', 1) AS INTEGER) % 6 AS fault FROM reviews")
cte("bad_findings", """
SELECT f.* REPLACE (CASE WHEN fault = 1 AND finding_index = 1 THEN 'rejected' ELSE evidence_status END AS evidence_status)
FROM findings f JOIN run_no USING (run_id)
""")
cte("bad_evidence", """
SELECT e.run_id, e.finding_id, e.role, CASE WHEN fault = 2 AND pos % 5 = 0 THEN 'z' || pos ELSE review_id END AS review_id
FROM final_evidence e JOIN run_no USING (run_id)
""")
cte("bad_links", """
SELECT run_id, requirement_id, pos, finding_id FROM links
UNION ALL SELECT run_id, requirement_id, 9, finding_id FROM links JOIN run_no USING (run_id) WHERE fault = 3 AND pos = 0
UNION ALL SELECT run_id, requirement_id, 8, 'F-777' FROM links JOIN run_no USING (run_id) WHERE fault = 4
""")
cte("bad_tests", """
SELECT run_id, CASE WHEN fault = 0 AND test_case_id = 'TC-002' THEN 'TC-003' ELSE test_case_id END AS test_case_id,
       CASE WHEN fault = 5 AND test_case_id = 'TC-001' THEN 'REQ-404' ELSE requirement_id END AS requirement_id
FROM tests JOIN run_no USING (run_id)
""")
cte("bad_test_sources", """
SELECT t.run_id, t.test_case_id, s.review_id FROM tests t JOIN sources s USING (run_id, requirement_id) JOIN run_no USING (run_id)
WHERE NOT (fault = 1 AND test_case_id = 'TC-004')
""")
UNEVEN = """SELECT DISTINCT {keys} FROM (
  SELECT {keys}, review_id FROM (SELECT DISTINCT {keys}, review_id, 1 AS side FROM {a} UNION ALL SELECT DISTINCT {keys}, review_id, 2 FROM {b})
  GROUP BY {keys}, review_id HAVING count(*) = 1)"""
cte("expected_sources", """
SELECT DISTINCT l.run_id, l.requirement_id, e.review_id FROM bad_links l JOIN bad_evidence e USING (run_id, finding_id) WHERE e.role = 'supporting'
""")
cte("expected_test_sources", """
SELECT DISTINCT t.run_id, t.test_case_id, s.review_id FROM bad_tests t JOIN sources s USING (run_id, requirement_id)
""")
cte("owned_test_sources", """
SELECT DISTINCT x.* FROM bad_test_sources x
WHERE (x.run_id, x.test_case_id) IN (SELECT (t.run_id, t.test_case_id) FROM bad_tests t JOIN requirements USING (run_id, requirement_id))
""")
cte("trace", f"""
SELECT run_id, entity_type, entity_id, rule FROM (
SELECT run_id, 'test_case' AS entity_type, test_case_id AS entity_id, 'entity_id_unique' AS rule FROM bad_tests GROUP BY ALL HAVING count(*) > 1
UNION ALL SELECT DISTINCT run_id, 'finding', finding_id, 'review_to_finding' FROM bad_evidence
  WHERE (run_id, review_id) NOT IN (SELECT (run_id, review_id) FROM known_reviews)
UNION ALL SELECT run_id, 'requirement', requirement_id, 'finding_to_requirement'
  FROM bad_links l LEFT JOIN bad_findings f USING (run_id, finding_id) GROUP BY run_id, requirement_id HAVING count(f.title) <> count(DISTINCT finding_id)
UNION ALL SELECT DISTINCT run_id, 'requirement', requirement_id, 'requirement_uses_eligible_finding'
  FROM bad_links l JOIN bad_findings f USING (run_id, finding_id) WHERE evidence_status = 'rejected'
UNION ALL SELECT run_id, 'requirement', requirement_id, 'requirement_reviews_inherit_findings' FROM ({UNEVEN.format(keys='run_id, requirement_id', a='expected_sources', b='sources')})
UNION ALL SELECT run_id, 'test_case', test_case_id, 'requirement_to_test_case' FROM bad_tests t
  WHERE (run_id, requirement_id) NOT IN (SELECT (run_id, requirement_id) FROM requirements)
UNION ALL SELECT run_id, 'test_case', test_case_id, 'requirement_to_test_case' FROM ({UNEVEN.format(keys='run_id, test_case_id', a='expected_test_sources', b='owned_test_sources')})
UNION ALL SELECT r.run_id, 'requirement', r.requirement_id, 'test_case_count_per_requirement'
  FROM requirements r LEFT JOIN bad_tests t USING (run_id, requirement_id) GROUP BY r.run_id, r.requirement_id HAVING count(t.test_case_id) NOT BETWEEN 2 AND 4
)
""")


@query("evidence_resolved", "EVD-1", sql="SELECT run_id, finding_index, review_id, role, pos FROM resolved")
def _(t):
    return Chain(t).resolved


@query("evidence_audit_merge", "EVD-2", sql="SELECT * FROM merged")
def _(t):
    return Chain(t).merged


@query("evidence_reclassified", "EVD-3", sql="SELECT run_id, finding_index, review_id, role, cited_role, pos FROM final_evidence")
def _(t):
    return ev.reclassify_evidence(Chain(t).merged)


@query("evidence_audit_counts", "EVD-3", sql="""
SELECT run_id, finding_index, irrelevant, missing_ids, unknown_ids, repeated_ids, semantic_validated FROM scored
WHERE (run_id, finding_index) IN (SELECT (run_id, finding_index) FROM merged)
""")
def _(t):
    return ev.audit_counts(Chain(t).merged)


COLUMNS = [
    "run_id", "finding_id", "title", "topic_key", "support_count", "conflict_count", "confidence", "evidence_status",
    "minimum_support", "invalid_ids", "semantic_validated",
]


@query("evidence_findings", "EVD-4", "EVD-5", sql=f"SELECT {', '.join(COLUMNS)} FROM findings")
def _(t):
    return Chain(t).findings.select(*COLUMNS)


@query("evidence_findings_unaudited", "EVD-4", "EVD-5", sql=f"""
SELECT run_id, finding_index, s AS support_count, c AS conflict_count, i AS invalid_ids,
       {half_even("greatest(0.0, least(1.0, ln(1 + s) / ln(11)) * (1 - 0.5 * (CAST(c AS DOUBLE) / greatest(1, s + c))))", 2)} AS confidence,
       CASE WHEN s = 0 THEN 'rejected' WHEN s >= (CASE WHEN n < 20 THEN 1 ELSE 2 END) AND i = 0 THEN 'validated' ELSE 'assumption' END AS evidence_status
FROM (SELECT run_id, finding_index, count(*) FILTER (WHERE role = 'supporting') AS s, count(*) FILTER (WHERE role = 'conflicting') AS c,
             count(*) FILTER (WHERE role = 'invalid') AS i FROM resolved GROUP BY ALL)
JOIN (SELECT run_id, count(*) AS n FROM known_reviews GROUP BY ALL) USING (run_id)
""")
def _(t):
    return ev.score_findings(t.drafts, Chain(t).resolved, t.known_reviews).select(
        "run_id", "finding_index", "support_count", "conflict_count", "invalid_ids", "confidence", "evidence_status"
    )


cte("issues", """
SELECT run_id, 'finding' AS entity_type, finding_id AS entity_id, i.rule AS rule, i.severity AS severity, i.n AS n_ids FROM (
  SELECT run_id, finding_id, unnest([
    CASE WHEN invalid_ids > 0 THEN {'rule': 'review_reference_exists', 'severity': 'error', 'n': invalid_ids} END,
    CASE WHEN unknown_ids > 0 THEN {'rule': 'evidence_audit_reference_exists', 'severity': 'error', 'n': unknown_ids} END,
    CASE WHEN repeated_ids > 0 THEN {'rule': 'evidence_audit_unique', 'severity': 'warning', 'n': repeated_ids} END,
    CASE WHEN missing_ids > 0 THEN {'rule': 'evidence_audit_complete', 'severity': 'warning', 'n': missing_ids} END,
    CASE WHEN rejected THEN {'rule': 'finding_has_support', 'severity': 'error', 'n': NULL} END,
    CASE WHEN NOT rejected AND support_count < minimum_support THEN {'rule': 'finding_support_threshold', 'severity': 'warning', 'n': NULL} END
  ]) AS i FROM scored) WHERE i IS NOT NULL
""")


@query("evidence_issues", "EVD-6", sql="SELECT * FROM issues")
def _(t):
    return ev.finding_issues(Chain(t).scored).drop("message", "revision_action")


@query("evidence_issue_ids", "EVD-6", sql="""
SELECT run_id, printf('F-%03d', finding_index + 1) AS entity_id, 'review_reference_exists' AS rule, review_id FROM resolved WHERE role = 'invalid'
UNION ALL SELECT run_id, printf('F-%03d', finding_index + 1),
  CASE WHEN state = 'unknown' THEN 'evidence_audit_reference_exists' WHEN state = 'missing' THEN 'evidence_audit_complete' ELSE 'evidence_audit_unique' END,
  review_id FROM merged WHERE state <> 'assessed' OR n_assessments > 1
""")
def _(t):
    return ev.finding_issue_ids(Chain(t).resolved, t.audits)


@query("evidence_report_valid", "EVD-6", sql="""
SELECT r.run_id, count(i.rule) FILTER (WHERE i.severity = 'error') AS errors, count(i.rule) AS issues,
       count(i.rule) FILTER (WHERE i.severity = 'error') = 0 AS valid
FROM analysis_runs r LEFT JOIN issues i USING (run_id) GROUP BY r.run_id
""")
def _(t):
    return ev.report_validity(ev.finding_issues(Chain(t).scored), t.analysis_runs)


cte("limitations", f"""
SELECT run_id, finding_id, l.i AS rank, l.v AS limitation FROM (
  SELECT run_id, finding_id, unnest([
    {{'i': 0, 'v': 'small sample'}},
    CASE WHEN invalid_ids > 0 THEN {{'i': 1, 'v': '模型引用了不存在的评论 ID，已由系统删除。'}} END,
    CASE WHEN run_id = 'src3' AND finding_index = 0 THEN {{'i': 2, 'v': '该 Finding 缺少证据语义复核结果。'}} ELSE {{'i': 2, 'v': 'audited from text only'}} END,
    CASE WHEN unknown_ids > 0 THEN {{'i': 3, 'v': '证据语义复核包含未知引用，已由系统删除。'}} END,
    CASE WHEN missing_ids > 0 THEN {{'i': 4, 'v': '部分引用缺少语义复核，未计入有效证据。'}} END,
    CASE WHEN irrelevant > 0 THEN {{'i': 5, 'v': printf('语义复核移除了 %d 条无关评论。', irrelevant)}} END,
    CASE WHEN support_count < minimum_support THEN {{'i': 6, 'v': printf('支持证据少于当前样本要求的 %d 条，按假设展示。', minimum_support)}} END,
    CASE WHEN conflict_count > 0 THEN {{'i': 7, 'v': printf('存在 %d 条冲突评论。', conflict_count)}} END
  ]) AS l FROM findings) WHERE l IS NOT NULL
""")


@query("evidence_limitations", "EVD-7", sql="""
SELECT run_id, finding_id, CAST(row_number() OVER (PARTITION BY run_id, finding_id ORDER BY rank) - 1 AS INTEGER) AS pos, limitation FROM limitations
""")
def _(t):
    return ev.finding_limitations(Chain(t).scored, t.audit_items)


@query("evidence_topics", "EVD-8", sql="""
SELECT m.run_id, m.lead AS finding_index, e.role, e.review_id, min(e.finding_index) AS draft, arg_min(e.pos, (e.finding_index, e.pos)) AS pos
FROM draft_evidence e JOIN (SELECT run_id, finding_index, min(finding_index) OVER (PARTITION BY run_id, topic_key) AS lead FROM drafts) m
USING (run_id, finding_index) GROUP BY m.run_id, m.lead, e.role, e.review_id
""")
def _(t):
    return ev.consolidate_by_topic(t.drafts, t.draft_evidence)[1]


@query("evidence_topic_drafts", "EVD-8", sql="""
SELECT run_id, finding_index, title FROM drafts QUALIFY finding_index = min(finding_index) OVER (PARTITION BY run_id, topic_key)
""")
def _(t):
    return ev.consolidate_by_topic(t.drafts, t.draft_evidence)[0].select("run_id", "finding_index", "title")


@query("chain_requirements", "EVD-9", sql="""
SELECT run_id, requirement_id, draft_no, title, priority_score, target_version, n_findings, n_reviews FROM requirements
""")
def _(t):
    return Chain(t, staged=True).requirements.select(
        "run_id", "requirement_id", "draft_no", "title", "priority_score", "target_version", "n_findings", "n_reviews"
    )


@query("chain_requirement_sources", "EVD-9", "SET-4", sql="SELECT run_id, requirement_id, review_id FROM sources")
def _(t):
    return Chain(t, staged=True).sources.drop("at")


@query("chain_quantity_notice", "EVD-10", sql=f"""
SELECT a.run_id, count(r.requirement_id) AS n_requirements, CASE WHEN count(r.requirement_id) < 5 THEN '可验证证据不足，因此本次输出少于 5 个核心需求。' END AS notice
FROM analysis_runs a LEFT JOIN requirements r USING (run_id) GROUP BY a.run_id
""")
def _(t):
    return ev.quantity_notice(Chain(t, staged=True).requirements, t.analysis_runs)


@query("chain_tests", "EVD-11", sql="SELECT run_id, requirement_id, test_case_id, title, case_type FROM tests")
def _(t):
    return Chain(t, staged=True).tests.select("run_id", "requirement_id", "test_case_id", "title", "case_type")


@query("chain_trace_issues", "EVD-12", sql="SELECT * FROM trace")
def _(t):
    return Chain(t, staged=True).trace.drop("message")


@query("chain_trace_rows", "EVD-13", sql="""
SELECT t.run_id, t.test_case_id, t.requirement_id, l.finding_id, e.pos, e.review_id
FROM tests t JOIN links l USING (run_id, requirement_id) JOIN final_evidence e USING (run_id, finding_id) WHERE e.role = 'supporting'
""")
def _(t):
    c = Chain(t, staged=True)
    return ev.trace_rows(c.findings, c.support, c.links, c.tests)


@query("chain_trace_rollup", "EVD-14", sql="""
SELECT run_id, requirement_id, kind, pos, id FROM requirements JOIN (
  SELECT run_id, requirement_id, 'finding' AS kind, CAST(pos AS VARCHAR) AS pos, finding_id AS id FROM links
  UNION ALL SELECT run_id, requirement_id, 'review', review_id, review_id FROM sources
  UNION ALL SELECT run_id, requirement_id, 'test', test_case_id, test_case_id FROM tests) USING (run_id, requirement_id)
""")
def _(t):
    c = Chain(t, staged=True)
    return ev.trace_rollup(c.requirements, c.links, c.sources, c.tests)


SUMMARIES = """
SELECT run_id, review_id, 'first ' || ord AS summary FROM reviews WHERE ord % 4 <> 0
UNION ALL SELECT run_id, review_id, ' ' FROM reviews WHERE ord % 4 = 0 AND ord % 8 = 0
"""


def summaries(t):
    """Two batches of summaries, the later one to be ignored, and blanks."""
    base = t.reviews.select("run_id", "review_id", "ord")
    early = base.where("ord % 4 <> 0").selectExpr("run_id", "review_id", "ord % 3 as batch", "ord as pos", "concat('first ', ord) as summary")
    late = base.where("ord % 4 <> 0").selectExpr("run_id", "review_id", "ord % 3 + 3 as batch", "ord as pos", "concat('later ', ord) as summary")
    blank = base.where("ord % 8 = 0").selectExpr("run_id", "review_id", "9L as batch", "ord as pos", "' ' as summary")
    return early.unionByName(late).unionByName(blank)


@query("project_summaries", "PRJ-4", sql=f"SELECT r.run_id, r.review_id, s.summary AS content_summary FROM reviews r LEFT JOIN ({SUMMARIES}) s USING (run_id, review_id)")
def _(t):
    return ev.apply_summaries(t.reviews.select("run_id", "review_id"), summaries(t)).select("run_id", "review_id", "content_summary")


@query("project_cited_reviews", "PRJ-3", sql="""
SELECT run_id, review_id, rating, app_version, language, length(content_original) AS chars FROM reviews
WHERE (run_id, review_id) IN (SELECT (run_id, review_id) FROM draft_evidence)
""")
def _(t):
    fields = ["review_id", "content_original", "rating", "app_version", "language"]
    return ev.cited_reviews(t.draft_evidence, t.reviews, fields).withColumn("chars", F.length("content_original")).drop("content_original")


ROLE_LABELS = {"supporting": "支持", "conflicting": "冲突", "irrelevant": "无关"}  # fixed values


@query("evidence_detail", "EVD-15", sql=f"""
SELECT c.run_id, c.finding_index, c.review_id,
       CASE coalesce(a.role, CASE WHEN c.s THEN 'supporting' ELSE 'conflicting' END) WHEN 'supporting' THEN '支持' WHEN 'conflicting' THEN '冲突' ELSE '无关' END AS role,
       coalesce(r.content_original, '未找到原评论（引用存在性校验未通过）。') AS content,
       CASE WHEN trim(coalesce(s.summary, '')) = '' THEN '待生成' ELSE s.summary END AS summary,
       coalesce(a.rationale, '尚未完成证据语义复核。') AS rationale
FROM (SELECT run_id, finding_index, review_id, bool_or(role = 'supporting') AS s FROM draft_evidence GROUP BY ALL) c
LEFT JOIN (SELECT run_id, finding_index, review_id, arg_max(role, pos) AS role, arg_max(rationale, pos) AS rationale FROM audits GROUP BY ALL) a
  USING (run_id, finding_index, review_id)
LEFT JOIN reviews r ON r.run_id = c.run_id AND r.review_id = c.review_id
LEFT JOIN ({SUMMARIES}) s ON s.run_id = c.run_id AND s.review_id = c.review_id
""")
def _(t):
    cited = ev.resolve_references(t.draft_evidence, t.draft_evidence)  # every cited id, known or not
    reviews = ev.apply_summaries(t.reviews.select("run_id", "review_id", "content_original"), summaries(t))
    return ev.evidence_detail(cited, reviews, t.audits, ROLE_LABELS)


@query("evidence_all_limitations", "EVD-16", sql="""
SELECT run_id, 'finding' AS scope, finding_id AS entity_id, limitation FROM limitations
UNION ALL SELECT run_id, 'run', run_id, printf('在线采集目标 %d 条，实际获得 %d 条；样本短缺会降低证据覆盖度。', review_limit, input_count)
FROM analysis_runs WHERE source_type = 'online' AND input_count < review_limit
UNION ALL SELECT run_id, 'run', run_id, printf('发现 %d 个重复评论 ID 对应不同正文；已稳定重命名，后续证据链使用重命名后的唯一 ID。', input_count % 4)
FROM analysis_runs WHERE input_count % 4 > 0
""")
def _(t):
    runs = t.analysis_runs.withColumn("review_id_collisions", F.col("input_count") % 4)
    return ev.limitations_union(runs, ev.finding_limitations(Chain(t).scored, t.audit_items))


INVARIANT = "SELECT a.run_id, '{name}' AS \"check\", CAST({entity} AS VARCHAR) AS entity, {ok} AS ok FROM {src}"
LIVE = "(SELECT run_id FROM analysis_runs WHERE status = 'completed') a"


@query("chain_invariants", "EVD-17", sql=f"""
SELECT run_id, 'run_completed' AS "check", CAST(NULL AS VARCHAR) AS entity, status = 'completed' AS ok FROM analysis_runs
UNION ALL SELECT a.run_id, 'cleaned_reviews_nonempty', NULL, (SELECT count(*) FROM known_reviews k WHERE k.run_id = a.run_id) > 0 FROM {LIVE}
UNION ALL SELECT a.run_id, 'summaries_cover_cleaned_reviews', NULL, (SELECT count(*) FROM known_reviews k WHERE k.run_id = a.run_id AND ord % 4 = 0 AND ord % 8 <> 0) = 0 FROM {LIVE}
UNION ALL SELECT a.run_id, 'findings_exist', NULL, (SELECT count(*) FROM bad_findings k WHERE k.run_id = a.run_id) > 0 FROM {LIVE}
UNION ALL SELECT a.run_id, 'finding_references_exist', f.finding_id, NOT EXISTS (SELECT 1 FROM bad_evidence e WHERE e.run_id = f.run_id AND e.finding_id = f.finding_id
   AND (e.run_id, e.review_id) NOT IN (SELECT (run_id, review_id) FROM known_reviews)) FROM {LIVE} JOIN bad_findings f USING (run_id)
UNION ALL SELECT a.run_id, 'finding_counts_match', f.finding_id, true FROM {LIVE} JOIN bad_findings f USING (run_id)
UNION ALL SELECT a.run_id, 'finding_confidence_range', f.finding_id, confidence > 0 AND confidence <= 1 FROM {LIVE} JOIN bad_findings f USING (run_id)
UNION ALL SELECT a.run_id, 'finding_status_allowed', f.finding_id, evidence_status <> 'rejected' FROM {LIVE} JOIN bad_findings f USING (run_id)
UNION ALL SELECT a.run_id, 'requirement_count_in_range_or_notice', NULL, n BETWEEN 5 AND 10 OR (n < 5 AND fault % 2 = 0)
   FROM {LIVE} JOIN (SELECT run_id, fault, (SELECT count(*) FROM requirements q WHERE q.run_id = r.run_id) AS n FROM run_no r) USING (run_id)
UNION ALL SELECT a.run_id, 'requirement_inherits_reviews', r.requirement_id, (r.run_id, r.requirement_id) NOT IN
   (SELECT (run_id, requirement_id) FROM ({UNEVEN.format(keys='run_id, requirement_id', a='expected_sources', b='sources')})) FROM {LIVE} JOIN requirements r USING (run_id)
UNION ALL SELECT a.run_id, 'test_links_requirement', t.test_case_id, (t.run_id, t.requirement_id) IN (SELECT (run_id, requirement_id) FROM requirements) FROM {LIVE} JOIN bad_tests t USING (run_id)
UNION ALL SELECT a.run_id, 'test_inherits_reviews', t.test_case_id, (t.run_id, t.test_case_id) NOT IN
   (SELECT (run_id, test_case_id) FROM ({UNEVEN.format(keys='run_id, test_case_id', a='expected_test_sources', b='owned_test_sources')}))
   FROM {LIVE} JOIN bad_tests t USING (run_id) JOIN requirements r USING (run_id, requirement_id)
UNION ALL SELECT a.run_id, 'test_case_count_2_to_4_per_requirement', NULL, NOT EXISTS (SELECT 1 FROM (SELECT t.run_id, count(*) AS k FROM bad_tests t JOIN requirements r USING (run_id, requirement_id) GROUP BY t.run_id, t.requirement_id) x
   WHERE x.run_id = a.run_id AND k NOT BETWEEN 2 AND 4) FROM {LIVE}
UNION ALL SELECT a.run_id, 'traceability_valid', NULL, NOT EXISTS (SELECT 1 FROM trace x WHERE x.run_id = a.run_id) FROM {LIVE}
""")
def _(t):
    c = Chain(t, staged=True)
    findings, evidence, links, tests, test_sources = c.faulty
    reviews = ev.apply_summaries(t.known_reviews, summaries(t))
    # Every second run forgets its notice.
    notices = ev.quantity_notice(c.requirements, t.analysis_runs).where(F.regexp_extract("run_id", "([0-9]+)$", 1).cast("int") % 6 % 2 == 0)
    return ev.pipeline_invariants(
        t.analysis_runs, reviews, findings, evidence, c.requirements, links, c.sources, tests, test_sources, c.trace, notices
    )


GATE = """
SELECT run_id, CASE WHEN CAST(regexp_extract(run_id, '([0-9]+)$', 1) AS INTEGER) = 19 THEN NULL ELSE status END AS status,
       CASE CAST(regexp_extract(run_id, '([0-9]+)$', 1) AS INTEGER) % 10 WHEN 3 THEN NULL WHEN 4 THEN 'malformed' ELSE 'ok' END AS trace_state FROM analysis_runs
"""


@query("chain_review_gate", "EVD-18", sql=f"""
SELECT run_id, feedback = '' AS approved, feedback FROM (
SELECT g.run_id, CASE WHEN status IS NULL THEN '分析运行不存在' WHEN status <> 'completed' THEN '分析未完成（状态：' || status || '）'
  WHEN trace_state IS NULL THEN '缺少追溯校验结果' WHEN trace_state <> 'ok' THEN '追溯校验结果格式异常'
  WHEN shown IS NOT NULL THEN '证据链校验未通过：' || shown ELSE '' END AS feedback
FROM ({GATE}) g LEFT JOIN (
  SELECT run_id, string_agg(message, '; ' ORDER BY place) AS shown FROM (
    SELECT run_id, rule || ' ' || entity_id AS message, row_number() OVER (PARTITION BY run_id ORDER BY rule || ' ' || entity_id) AS place FROM trace)
  WHERE place <= 3 GROUP BY run_id) USING (run_id))
""")
def _(t):
    n = F.regexp_extract("run_id", r"(\d+)$", 1).cast("int")
    runs = t.analysis_runs.select(
        "run_id", F.when(n != 19, F.col("status")).alias("status"),
        F.when(n % 10 == 3, F.lit(None)).when(n % 10 == 4, "malformed").otherwise("ok").alias("trace_state"),
    )
    message = F.concat_ws(" ", "rule", "entity_id")
    issues = Chain(t, staged=True).trace.select("run_id", message.alias("message"), message.alias("ord"))
    return ev.review_gate(runs, issues)


@query("chain_outcome", "EVD-19", sql="""
SELECT a.run_id, count(t.rule) AS n_issues, CASE WHEN count(t.rule) = 0 THEN 'completed' ELSE 'partial' END AS status,
       CASE WHEN count(t.rule) = 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0.99 AS DOUBLE) END AS coverage_ratio
FROM analysis_runs a LEFT JOIN trace t USING (run_id) GROUP BY a.run_id
""")
def _(t):
    return ev.run_outcome(t.analysis_runs.withColumn("coverage_ratio", F.lit(1.0)), Chain(t, staged=True).trace)


@query("chain_overview", "EVD-21", sql="""
SELECT s.run_id, s.input_count, s.input_count - s.copies AS output_count, s.copies AS duplicates, CAST(0 AS BIGINT) AS empty_removed,
       (SELECT count(*) FROM findings f WHERE f.run_id = s.run_id) AS findings,
       (SELECT count(*) FROM requirements f WHERE f.run_id = s.run_id) AS requirements,
       (SELECT count(*) FROM tests f WHERE f.run_id = s.run_id) AS tests
FROM (SELECT run_id, count(*) AS input_count, count(*) FILTER (WHERE NOT first) AS copies
      FROM (SELECT run_id, ord = min(ord) OVER (PARTITION BY content_hash) AS first FROM clean_reviews) GROUP BY run_id) s
""")
def _(t):
    from ..operators import clean

    rows = clean.with_content_hash(clean.normalize_reviews(t.reviews))
    first = clean.first_of(rows, ["content_hash"]).withColumn("kept", F.lit(True))
    marked = rows.select("run_id", "ord").join(first, "ord", "left").select(
        "run_id", F.when(F.col("kept"), "kept").otherwise("exact").alias("reason"), F.lit(False).alias("renamed")
    )
    c = Chain(t, staged=True)
    return ev.overview(clean.cleaning_stats(marked, ["run_id"]), c.findings, c.requirements, c.tests)


@query("chain_batch_progress", "EVD-20", sql="""
SELECT run_id, count(*) AS total, count(*) FILTER (WHERE NOT gap) AS completed,
       coalesce(min(batch) FILTER (WHERE gap), count(*)) AS first_missing, least(count(*) FILTER (WHERE NOT gap) / count(*), 0.99) AS coverage_ratio
FROM (SELECT DISTINCT run_id, batch, (batch * 7 + length(run_id)) % 5 = 3 AS gap FROM packed) GROUP BY run_id
""")
def _(t):
    from ..operators import clean
    from .cleaning import batched

    manifest = clean.batch_manifest(batched(t), ["run_id"])
    done = manifest.where("(batch * 7 + length(run_id)) % 5 <> 3").select("run_id", "batch")
    return ev.batch_progress(manifest.select("run_id", "batch"), done)
