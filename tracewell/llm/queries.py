"""The registered queries of this folder, and the SQL that checks those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stage_path, tune
from . import ann, archive, chat, decontamination, hard_negatives, lm_scoring, mixing, quality, repair, secrets, simhash, site_lines, token_files
from .common import remainder, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(tune(spark), sf_dir)

        QUERIES[name] = run
        if sql:
            ORACLE_SQL[name] = sql.strip()
        return run

    return register


@query("op5_mix_sources", sql=r"""
WITH slim AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         (CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':mix-1'), 1, 13) AS BIGINT) * 2 + 1)::DOUBLE / 9007199254740992.0 AS u
  FROM documents
), sizes AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM slim GROUP BY source
), ranked AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w,
         row_number() OVER (ORDER BY source NULLS LAST) AS rank, source_size * 3 AS cap
  FROM sizes
), levels AS (
  SELECT *, ((SELECT sum(source_size) FROM sizes)
             - coalesce(sum(cap) OVER (ORDER BY cap / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY cap / w, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM ranked
), water AS (
  SELECT coalesce(min_by(level, cap / w) FILTER (level <= cap / w), 0) AS water FROM levels
), targets AS (
  SELECT source, source_size, least(CAST(cap AS DOUBLE), water * w) AS target FROM ranked, water
), drawn AS (
  SELECT s.doc_id, s.source, s.size, t.source_size, t.target, s.u,
         least(3.0, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END) AS e
  FROM slim s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), odds AS (
  SELECT *, CASE WHEN e - floor(e) > 0 THEN (u / (1 - u)) / ((e - floor(e)) / (1 - (e - floor(e)))) END AS q,
         target - sum(floor(e) * size) OVER (PARTITION BY source) AS open
  FROM drawn
), running AS (
  SELECT *, CASE WHEN q IS NOT NULL AND size > 0
            THEN sum(CASE WHEN q IS NOT NULL AND size > 0 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY q) END AS upto
  FROM odds
), cut AS (
  SELECT source, coalesce(max(q) FILTER (upto <= open), -1) AS cut, coalesce(max(upto) FILTER (upto <= open), 0) AS taken
  FROM running WHERE upto IS NOT NULL GROUP BY source
), tied AS (
  SELECT r.source, r.q, sum(r.size) AS size, any_value(r.open - c.taken) AS gap
  FROM running r JOIN cut c ON r.source IS NOT DISTINCT FROM c.source WHERE r.upto IS NOT NULL AND r.q > c.cut GROUP BY r.source, r.q
), extra AS (
  SELECT source, (min(struct_pack(off := abs(gap - size), q := q))).q AS extra FROM tied WHERE abs(gap - size) < gap GROUP BY source
)
SELECT r.doc_id, CAST(r.size AS BIGINT) AS size, r.source_size, r.target,
       CAST((floor(r.e) + CASE WHEN r.size > 0 AND (r.q <= c.cut OR r.q = x.extra) THEN 1 ELSE 0 END) * r.size AS BIGINT) AS taken
FROM running r LEFT JOIN cut c ON r.source IS NOT DISTINCT FROM c.source LEFT JOIN extra x ON r.source IS NOT DISTINCT FROM x.source
""")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.allocate(table(spark, sf_dir, "documents"))
    return rows.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


@query("op6_warc_archive", sql="""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), h AS (
  SELECT payload_digest, max(page_id) AS holder FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN holder IS NULL OR holder = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN holder <> page_id THEN holder END AS refers_to
FROM p LEFT JOIN h USING (payload_digest)
""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = stage_path(spark, "warc")
    archive.write(table(spark, sf_dir, "pages"), path)
    return archive.records(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op7_token_files")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = table(spark, sf_dir, "documents"), stage_path(spark, "tokens")
    token_files.write(docs, path, word_bpe(), end_id=1)
    return token_files.by_key(docs.select("doc_id"), path).select("doc_id", "start", "n_tokens", "ids_crc32")


@query("op8_simhash_classes")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


WORD9 = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOWER9 = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("op9_benchmark_overlap", sql=f"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all({LOWER9.format("coalesce(text, '')")}, '{WORD9}') AS w FROM documents
), i AS (
  SELECT item_id, regexp_extract_all({LOWER9.format("coalesce(text, '')")}, '{WORD9}') AS w FROM benchmark
), iw AS (
  SELECT item_id, n, array_to_string(w[s : s + n - 1], ' ') AS words
  FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM i WHERE len(w) > 0)
), dw AS (
  SELECT r, n, s, array_to_string(w[s : s + n - 1], ' ') AS words
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)
), hits AS (
  SELECT DISTINCT r, n, s, words FROM dw WHERE words IN (SELECT words FROM iw)
), hit AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM hits) GROUP BY r
), owners AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hits JOIN iw USING (words)) GROUP BY r
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN owners USING (r)
""")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op10_lattice_scores")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return lm_scoring.scores(docs, remainder("doc_id", 10) == 0, public_tokenizers.path("piece_bpe_32k.model"))


@query("op3_quality_scores")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = remainder("doc_id", 4) == 2
    model = quality.train(docs, table(spark, sf_dir, "labels"), ~out)
    return quality.classified(docs, model).select("doc_id", out.alias("held_out"), "score", "predicted")


@query("op1_graph_neighbours")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


@query("op2_chat_tokens")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    path = public_tokenizers.path("byte_bpe_50k.json")
    read = chat.read_back(chat.formatted(turns, path), path)
    return read.withColumn("conv_id", F.col("conv_id").cast("bigint"))


def _lines_sql() -> str:
    q = lambda x: "'" + x.replace("'", "''") + "'"
    text = f"regexp_replace(coalesce(html, ''), {q(site_lines.HIDDEN)}, chr(10), 'g')"
    text = f"regexp_replace(regexp_replace({text}, {q(site_lines.BLOCK)}, chr(10), 'g'), {q(site_lines.TAG)}, '', 'g')"
    for entity, char in site_lines.ENTITIES.items():
        text = f"replace({text}, {q(entity)}, {q(char)})"
    text = f"regexp_replace(regexp_replace({text}, '[ \\t\\r]+', ' ', 'g'), ' ?\\n[ \\n]*', chr(10), 'g')"
    return f"""
WITH p AS (
  SELECT row_number() OVER () AS r, page_id, nullif(lower(regexp_extract(url, {q(site_lines.HOST)}, 1)), '') AS host,
         list_filter(string_split(trim({text}), chr(10)), lambda x: x <> '') AS lines
  FROM pages
), ln AS (
  SELECT r, host, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM p
), dropped AS (
  SELECT host, line FROM (SELECT DISTINCT r, host, line FROM ln) s GROUP BY host, line
  HAVING count(*) > (SELECT count(*) FROM p q WHERE q.host = s.host) * 0.3 AND count(*) > 1
)
SELECT page_id, p.host, CAST(len(lines) AS BIGINT) AS n_lines, CAST(count(d.line) AS BIGINT) AS n_dropped,
       coalesce(string_agg(l.line, chr(10) ORDER BY pos) FILTER (d.line IS NULL AND l.line IS NOT NULL), '') AS text
FROM p LEFT JOIN ln l USING (r) LEFT JOIN dropped d ON d.host = l.host AND d.line = l.line GROUP BY r, page_id, p.host, lines
"""


@query("op4_site_lines", sql=_lines_sql())
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_lines.without_boilerplate(table(spark, sf_dir, "pages"))


#: The CRC of an ASCII text, bit by bit (DuckDB has no function for it).
CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split({}, ''), lambda c: unicode(c)::BIGINT)),
           lambda crc, c: list_reduce(list_prepend(xor(crc, c), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))))"""


def _audit_sql() -> str:
    """The edit program as a recursion over the rows: cost (9 digits) and audit of the four states e, s, u, a; ~ for none."""
    plus = lambda x, cost, char: f"CASE WHEN {x} = '~' THEN '~' ELSE printf('%09d', CAST(left({x}, 9) AS BIGINT) + {cost}) || substr({x}, 10) || '{char}' END"
    to_user = f"least(u, {plus('e', 2, 'I')}, {plus('s', 2, 'I')}, {plus('a', 2, 'I')})"
    closed = f"e, s, {to_user} AS u, least(a, {plus('u', 2, 'I')}, {plus(f'({to_user})', 2, 'I')}) AS a"
    keep = lambda role, x: f"CASE WHEN initial = '{role}' AND fault NOT IN ('blank', 'duplicate') THEN {plus(x, 'extra', 'K')} ELSE '~' END"
    rerole = lambda x: f"CASE WHEN fault NOT IN ('blank', 'duplicate') THEN {plus(x, '2 + extra', 'R')} ELSE '~' END"
    step = f"""{plus('e', 3, 'D')} AS e, least({plus('s', 3, 'D')}, {keep('s', 'e')}) AS s,
      least({plus('u', 3, 'D')}, {keep('u', 'e')}, {keep('u', 's')}, {keep('u', 'a')}, {rerole('e')}, {rerole('s')}, {rerole('a')}) AS u,
      least({plus('a', 3, 'D')}, {keep('a', 'u')}, {rerole('u')}) AS a"""
    return f"""
WITH RECURSIVE damaged AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {CRC32.format("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS code FROM conversations
), kept AS (
  SELECT conv_id, turn, CASE code WHEN 4 THEN 'user' ELSE role END AS role,
         CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE code WHEN 3 THEN 2 ELSE 1 END)) AS again
  FROM damaged WHERE code <> 0
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), again) AS n,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, again) AS nth,
         regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS ending FROM kept
), faults AS (
  SELECT *, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) AS before,
         CASE WHEN ending = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN ending NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         CASE WHEN ending NOT IN ('', '.', '!', '?') AND nth = 1 THEN 1 ELSE 0 END AS extra FROM numbered
), steps AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, '000000000' AS e, '~' AS s, '000000002I' AS u, '000000004II' AS a FROM kept
  UNION ALL
  SELECT conv_id, n, {closed} FROM (SELECT f.conv_id, f.n, {step} FROM steps p JOIN faults f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.n = p.i + 1)
), found AS (
  SELECT conv_id, least(e, a) AS best FROM steps QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1
), edits AS (
  SELECT conv_id, CAST(left(best, 9) AS BIGINT) AS cost, substr(best, 10) AS audit FROM found
), chars AS (
  SELECT conv_id, j, audit[j] AS edit, len(regexp_replace(audit[1:j], '[^KRD]', '', 'g')) AS n, len(regexp_replace(audit[1:j], '[^KRI]', '', 'g')) AS m
  FROM (SELECT conv_id, audit, unnest(range(1, len(audit) + 1)) AS j FROM edits)
), said AS (
  SELECT c.conv_id, c.j, c.edit, c.m, f.role, coalesce(f.text, '') AS text,
         first_value(CASE WHEN c.edit = 'K' AND f.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY c.conv_id ORDER BY c.j) AS system
  FROM chars c LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM c.conv_id AND f.n = c.n AND c.edit <> 'I' WHERE c.edit <> 'D'
), repaired AS (
  SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (m - system) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY j) AS lines
  FROM said GROUP BY conv_id
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (n > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP BY conv_id
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(lines, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN edits e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM o.conv_id
"""


@query("op11_repaired_conversations", sql=_audit_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    code = F.crc32(key.cast("binary")) % 20
    text = F.coalesce("text", F.lit(" "))
    damaged = turns.where(code != 0).select(
        "conv_id", "turn", F.when(code == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(code == 1, "").when(code == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(F.when(code == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    found = repair.repair(damaged).withColumnRenamed("conv_id", "id")
    out = turns.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("id")), "left")
    counts = [F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


@query("op13_hard_negatives", sql="""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank,
       n.vec_id AS negative_id, positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same AND 80 * positive_score <= 100 * n.score AND n.score <= positive_score
QUALIFY rank <= 5
""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.mine(rows, F.col("id") % 100 == 0)


def _secrets_sql() -> str:
    rules = secrets.BASE + secrets.ADDED
    q = lambda x: "'" + x.replace("'", "''") + "'"
    found = "\nUNION ALL\n".join(f"""  SELECT r, {n} AS number, {q(rule.kind)} AS kind, regexp_extract_all(text, {q(rule.pattern)}) AS m,
         string_split_regex(text, {q(rule.pattern)}) AS p, regexp_extract_all(text, {q(rule.pattern)}, {rule.group}) AS g, {rule.least} AS least FROM d""" for n, rule in enumerate(rules))
    base = f"number < {len(secrets.BASE)}"
    counts = ", ".join(f"count(*) FILTER (number = {n}) AS n_{r.kind}" for n, r in enumerate(secrets.BASE))
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents
), found AS (
{found}
), spans AS (
  SELECT r, number, kind, i, list_sum(list_transform(p[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: len(x))), 0) AS start, len(m[i]) AS n
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM found) WHERE len(g[i]) >= least
), lines AS (
  SELECT r, number, start, kind || ':' || CAST(start AS BIGINT) || ':' || CAST(start + n AS BIGINT) AS line FROM spans
), sums AS (
  SELECT r, {counts}, string_agg(line, ',' ORDER BY start, number) FILTER ({base}) AS base, string_agg(line, ',' ORDER BY start, number) AS spans FROM lines GROUP BY r
)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in secrets.BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN sums USING (r)
"""


@query("op12_secret_spans", sql=_secrets_sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = secrets.BASE + secrets.ADDED
    found = secrets.find(table(spark, sf_dir, "documents"), rules)
    of_kind = lambda n: F.size(F.filter("spans", lambda s: s["kind"] == n)).cast("bigint")
    base = F.filter("spans", lambda s: s["kind"] < len(secrets.BASE))
    return found.select(
        F.col("id").alias("doc_id"), *[of_kind(n).alias(f"n_{r.kind}") for n, r in enumerate(secrets.BASE)],
        F.sha2(secrets.written(base, rules), 256).alias("base_sha256"), secrets.written(F.col("spans"), rules).alias("spans"))
