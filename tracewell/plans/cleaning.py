"""Cleaning queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.scan import row_numbers
from ..operators import clean, neardup, setsim
from .registry import cte, query
from .sqlbase import comp, fold, norm

HASH = f"substr(sha256(CAST(rating AS VARCHAR) || '|' || {fold('content')}), 1, 20)"
cte("clean_reviews", f"""
SELECT *, {HASH} AS content_hash, {fold('content')} AS folded
FROM (SELECT review_id, ord, run_id, rating, language, {norm('content_original')} AS content FROM reviews) WHERE content <> ''
""")
cte("clean_shared", f"""
SELECT *, {HASH} AS content_hash, {fold('content')} AS folded
FROM (SELECT review_id, ord, run_id, rating, language, {norm('content_original')} AS content FROM shared_id_reviews) WHERE content <> ''
""")


def hashed(reviews):
    return clean.with_content_hash(clean.normalize_reviews(reviews))


@query("clean_normalized", "CLN-1", sql="""
SELECT review_id, length(content) AS chars, substr(sha256(content), 1, 12) AS digest FROM clean_reviews
""")
def _(t):
    c = F.col("content_original")
    return clean.normalize_reviews(t.reviews).select("review_id", F.length(c).alias("chars"), X.sha(c, 12).alias("digest"))


@query("clean_content_hash", "CLN-2", sql="SELECT review_id, content_hash FROM clean_reviews")
def _(t):
    return hashed(t.reviews).select("review_id", "content_hash")


@query("clean_exact_marks", "CLN-3", sql="""
SELECT ord, review_id, ord > min(ord) OVER (PARTITION BY content_hash) AS same_hash,
       ord > min(ord) OVER (PARTITION BY review_id, folded) AS same_id_text
FROM clean_shared
""")
def _(t):
    return clean.exact_duplicates(hashed(t.shared_id_reviews)).select("ord", "review_id", "same_hash", "same_id_text")


@query("clean_id_collisions", "CLN-7", sql="""
SELECT ord, review_id AS incoming_id,
       CASE WHEN n = 1 THEN review_id ELSE review_id || '--' || substr(content_hash, 1, 8) END AS review_id, n > 1 AS renamed
FROM (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY ord) AS n
      FROM (SELECT * FROM clean_shared QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY ord) = 1))
""")
def _(t):
    kept = clean.drop_exact_copies(hashed(t.shared_id_reviews))
    return clean.rename_id_collisions(kept).select("ord", "incoming_id", "review_id", "renamed")


@query("clean_stats_exact", "CLN-9", sql=f"""
SELECT r.run_id, count(*) AS input_count,
       count(*) FILTER (WHERE c.first) AS output_count,
       count(*) FILTER (WHERE NOT c.first) AS exact_duplicates,
       CAST(0 AS BIGINT) AS near_duplicates,
       count(*) FILTER (WHERE c.ord IS NULL) AS empty_removed,
       count(*) FILTER (WHERE c.first AND NOT c.owner) AS review_id_collisions
FROM shared_id_reviews r LEFT JOIN (
  SELECT ord, first, row_number() OVER (PARTITION BY review_id, first ORDER BY ord) = 1 AS owner
  FROM (SELECT ord, review_id, ord = min(ord) OVER (PARTITION BY content_hash) AS first FROM clean_shared)
) c USING (ord)
GROUP BY r.run_id
""")
def _(t):
    kept = clean.rename_id_collisions(clean.drop_exact_copies(hashed(t.shared_id_reviews)))
    marks = kept.select("ord", "renamed")
    content = X.normalize_text("content_original")
    rows = t.shared_id_reviews.select("ord", "run_id", (content == "").alias("is_empty")).join(marks, "ord", "left")
    reason = F.when(F.col("is_empty"), "empty").when(F.col("renamed").isNull(), "exact").otherwise("kept")
    return clean.cleaning_stats(
        rows.withColumn("reason", reason).withColumn("renamed", F.coalesce("renamed", F.lit(False))), ["run_id"]
    )


cte("lang_grams", f"""
SELECT ord, language, unnest(list_transform(range(1, length(p) - 1), lambda i: substr(p, i, 3))) AS gram
FROM (SELECT ord, language, ' ' || {fold('content')} || ' ' AS p FROM clean_reviews)
""")
cte("lang_profiles", """
SELECT language AS of, gram, ln(n / sum(n) OVER (PARTITION BY language)) AS log_p
FROM (SELECT language, gram, count(*) AS n FROM lang_grams WHERE ord % 2 = 0 AND language IS NOT NULL GROUP BY ALL)
""")
cte("lang_found", """
SELECT ord, arg_max(of, score) AS found FROM (SELECT ord, of, sum(log_p + 14) AS score FROM lang_grams JOIN lang_profiles USING (gram) GROUP BY ALL) GROUP BY ord
""")


@query("clean_language_fill", "CLN-8", sql="""
SELECT r.language AS given, CASE WHEN length(r.content) >= 12 THEN f.found END AS language, count(*) AS n
FROM clean_reviews r LEFT JOIN lang_found f USING (ord) GROUP BY ALL
""")
def _(t):
    rows = clean.normalize_reviews(t.reviews).select("ord", "run_id", "language", "content_original")
    profiles = clean.fit_language_profiles(rows.where("ord % 2 = 0"))
    unknown = rows.withColumn("given", F.col("language")).withColumn("language", F.lit(None).cast("string"))
    return clean.fill_language(unknown, profiles).groupBy("given", "language").agg(F.count("*").alias("n"))


cte("pack_rows", "SELECT run_id, ord, length(content) AS chars, row_number() OVER (PARTITION BY run_id ORDER BY ord) - 1 AS row_index FROM clean_reviews")
cte("packed", """
SELECT run_id, row_index, chars, CAST(0 AS BIGINT) AS batch, 1 AS in_batch, chars AS total FROM pack_rows WHERE row_index = 0
UNION ALL
SELECT n.run_id, n.row_index, n.chars,
       CASE WHEN p.in_batch >= 8 OR p.total + n.chars > 9000 THEN p.batch + 1 ELSE p.batch END,
       CASE WHEN p.in_batch >= 8 OR p.total + n.chars > 9000 THEN 1 ELSE p.in_batch + 1 END,
       CASE WHEN p.in_batch >= 8 OR p.total + n.chars > 9000 THEN n.chars ELSE p.total + n.chars END
FROM packed p JOIN pack_rows n ON n.run_id = p.run_id AND n.row_index = p.row_index + 1
""")


def batched(t):
    rows = clean.normalize_reviews(t.reviews).select(
        "run_id", "ord", F.length("content_original").cast("bigint").alias("chars")
    )
    return clean.pack_batches(rows, ["run_id"], 8, 9000)


@query("clean_batches", "CLN-10", sql="SELECT run_id, row_index, batch FROM packed")
def _(t):
    return batched(t).select("run_id", "row_index", "batch")


@query("clean_batch_manifest", "CLN-11", sql="""
SELECT run_id, batch, min(row_index) AS first_index, max(row_index) AS last_index, count(*) AS size FROM packed GROUP BY run_id, batch
""")
def _(t):
    return clean.batch_manifest(batched(t), ["run_id"])


@query("clean_manifest_check", "CLN-11", sql="SELECT DISTINCT run_id, run_id <> 'src2' AS valid FROM reviews")
def _(t):
    manifest = clean.batch_manifest(batched(t), ["run_id"])
    damaged = manifest.where("not (run_id = 'src2' and batch = 1)")
    totals = clean.normalize_reviews(t.reviews).groupBy("run_id").agg(F.count("*").alias("n"))
    return clean.verify_manifest(damaged, totals, ["run_id"])


@query("clean_fingerprint", "CLN-12", sql="""
SELECT run_id, count(*) AS n, CAST(sum(d) AS VARCHAR) AS digest_sum, bit_xor(d) AS digest_xor
FROM (SELECT run_id, CAST('0x' || substr(sha256(review_id || chr(31) || content), 1, 15) AS BIGINT) AS d FROM clean_reviews)
GROUP BY run_id
""")
def _(t):
    return clean.input_fingerprint(clean.normalize_reviews(t.reviews), ["run_id"])


@query("clean_language_summary", "CLN-1", "CLN-2", "CLN-3", "CLN-9", sql="""
SELECT language, count(*) AS n, count(*) - count(*) FILTER (WHERE first) AS exact_copies
FROM (SELECT language, ord = min(ord) OVER (PARTITION BY content_hash) AS first FROM clean_reviews) GROUP BY language
""")
def _(t):
    rows = hashed(t.reviews)
    kept = clean.first_of(rows, ["content_hash"]).withColumn("kept", F.lit(1))
    return rows.select("ord", "language").join(kept, "ord", "left").groupBy("language").agg(
        F.count("*").alias("n"), F.count_if(F.col("kept").isNull()).alias("exact_copies")
    )


def duplicate_ctes(name: str, rows: str) -> None:
    """The keep rule at threshold 100, where near means that one text contains the other: in order, a row stays unless a kept one conflicts."""
    cte(f"{name}_texts", f"SELECT ord, review_id, rating, content_hash, folded, {comp('content')} AS comp FROM {rows}")
    cte(f"{name}_pairs", f"""
SELECT * FROM (
  SELECT a.ord AS i, b.ord AS j, a.content_hash = b.content_hash OR (a.review_id = b.review_id AND a.folded = b.folded) AS exact,
         CASE WHEN a.rating = b.rating AND a.comp <> '' AND b.comp <> '' AND least(length(a.comp), length(b.comp)) >= 0.8 * greatest(length(a.comp), length(b.comp))
              THEN contains(a.comp, b.comp) OR contains(b.comp, a.comp) ELSE false END AS near
  FROM {name}_texts a JOIN {name}_texts b ON a.ord < b.ord) WHERE exact OR near
""")
    cte(f"{name}_asked", f"""
SELECT j, list(i) AS partners, bool_or(i NOT IN (SELECT j FROM {name}_pairs)) AS gone, row_number() OVER (ORDER BY j) AS n FROM {name}_pairs GROUP BY j
""")
    cte(f"{name}_walk", f"""
SELECT CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS kept
UNION ALL
SELECT a.n, CASE WHEN a.gone OR list_has_any(a.partners, w.kept) THEN w.kept ELSE list_append(w.kept, a.j) END FROM {name}_walk w JOIN {name}_asked a ON a.n = w.n + 1
""")
    cte(f"{name}_kept", f"""
SELECT ord FROM {name}_texts WHERE ord NOT IN (SELECT j FROM {name}_pairs)
UNION ALL SELECT unnest(kept) FROM {name}_walk WHERE n = (SELECT max(n) FROM {name}_walk)
""")
    cte(f"{name}_reasons", f"""
SELECT t.ord, CASE WHEN t.ord IN (SELECT ord FROM {name}_kept) THEN 'kept' WHEN coalesce(bool_or(p.exact), false) THEN 'exact' ELSE 'near' END AS reason, min(p.i) FILTER (p.near) AS i
FROM {name}_texts t LEFT JOIN (SELECT * FROM {name}_pairs WHERE i IN (SELECT ord FROM {name}_kept)) p ON p.j = t.ord GROUP BY t.ord
""")


duplicate_ctes("dup", "clean_reviews")
duplicate_ctes("dupid", "clean_shared")


@query("clean_duplicates_resolved", "CLN-4", "CLN-6", sql="SELECT ord, reason, CASE WHEN reason = 'near' THEN i END AS match FROM dup_reasons")
def _(t):
    return neardup.resolve_duplicates(hashed(t.reviews), threshold=100)


@query("clean_duplicates_fuzzy", "CLN-4", "CLN-6")
def _(t):
    """The same job at the usual threshold; SQL has no partial ratio."""
    return neardup.resolve_duplicates(hashed(t.reviews))


@query("clean_stats_full", "CLN-6", "CLN-7", "CLN-9", sql="""
SELECT s.run_id, count(*) AS input_count, count(*) FILTER (WHERE r.reason = 'kept') AS output_count, count(*) FILTER (WHERE r.reason = 'exact') AS exact_duplicates,
       count(*) FILTER (WHERE r.reason = 'near') AS near_duplicates, count(*) FILTER (WHERE r.ord IS NULL) AS empty_removed,
       count(*) FILTER (WHERE r.reason = 'kept' AND r.place > 1) AS review_id_collisions
FROM shared_id_reviews s LEFT JOIN (
  SELECT d.ord, d.reason, row_number() OVER (PARTITION BY t.review_id, d.reason ORDER BY d.ord) AS place FROM dupid_reasons d JOIN dupid_texts t USING (ord)
) r USING (ord) GROUP BY s.run_id
""")
def _(t):
    return clean.cleaning_stats(neardup.clean_reviews(t.shared_id_reviews, threshold=100), ["run_id"])


# Word shingles: texts, their distinct runs of five words, and one representative per set.
cte("set_words", f"SELECT ord, list_filter(string_split({fold(norm('content'))}, ' '), lambda w: w <> '') AS w FROM corpus")
cte("set_rows", """
SELECT ord, list_sort(list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i : i + 4], ' ')))) AS s FROM set_words WHERE len(w) > 0
""")
cte("set_members", """
SELECT w.ord, coalesce(r.rep, min(w.ord) FILTER (len(w.w) = 0) OVER ()) AS rep, coalesce(r.size, 0) AS size
FROM set_words w LEFT JOIN (SELECT ord, min(ord) OVER (PARTITION BY s) AS rep, len(s) AS size FROM set_rows) r USING (ord)
""")
cte("set_tokens", "SELECT ord AS rep, len(s) AS size, unnest(s) AS token FROM set_rows WHERE ord IN (SELECT rep FROM set_members)")
cte("set_pairs", """
SELECT a, b, shared, sa + sb - shared AS "union" FROM (
  SELECT x.rep AS a, y.rep AS b, any_value(x.size) AS sa, any_value(y.size) AS sb, count(*) AS shared FROM set_tokens x JOIN set_tokens y USING (token) WHERE x.rep < y.rep GROUP BY ALL)
WHERE shared >= 0.8 * (sa + sb - shared)
""")


@query("jaccard_near_pairs", "CLN-5", sql='SELECT a, b, CAST(shared AS INTEGER) AS shared, CAST("union" AS INTEGER) AS "union" FROM set_pairs')
def _(t):
    return setsim.jaccard_near_pairs(t.corpus)[0]


@query("jaccard_members", "CLN-5", sql="""
SELECT m.ord, m.rep, CAST(m.size AS INTEGER) AS size, coalesce(n, 0) AS links
FROM set_members m LEFT JOIN (SELECT rep, count(*) AS n FROM (SELECT a AS rep FROM set_pairs UNION ALL SELECT b FROM set_pairs) GROUP BY rep) l USING (rep)
""")
def _(t):
    """Every review with the representative of its shingle set and how many other sets are near it."""
    pairs, rows = setsim.jaccard_near_pairs(t.corpus)
    links = pairs.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    return rows.join(links, "rep", "left").select("ord", "rep", "size", F.coalesce("links", F.lit(0)).alias("links"))
