"""Keyword (BM25), vector and combined search over the review corpus, all queries in one plan.

Postings are an ordinary table: one row per term and document with positions, document length and
the columns that filters need. `text_index` keeps them on disk; without it every search scores the corpus whole.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import staged
from .project import allowed_platform

K1, B, RARE = 1.2, 0.75, 1e-6  # fixed values of the ranking function
KEYWORD_WEIGHT, VECTOR_WEIGHT = 0.6, 0.4  # fixed values of the combined score


def tokenize(corpus: DataFrame, column: str = "content") -> DataFrame:
    """One row per token with its position."""
    return corpus.select("ord", F.posexplode(X.tokens(column)).alias("pos", "term"))


def document_lengths(corpus: DataFrame, column: str = "content") -> DataFrame:
    return corpus.select("ord", "app_id", F.size(X.tokens(column)).alias("n_tokens"))


def build_index(corpus: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """Postings of the corpus, or only of the given terms."""
    docs = corpus.withColumn("__t", X.tokens("content")).withColumn("n_tokens", F.size("__t"))
    rows = docs.select("ord", "app_id", "platform", "n_tokens", F.posexplode("__t").alias("pos", "term"))
    if terms is not None:
        wanted = terms.select("term").distinct()
        rows = rows.join(wanted, "term", "left_semi")
    return rows.groupBy("term", "ord", "app_id", "platform", "n_tokens").agg(
        F.array_sort(F.collect_list("pos")).alias("positions")
    )


def term_stats(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count("*").alias("df"), F.sum(F.size("positions")).alias("occurrences"))


# ---- query compilation ----


def compile_queries(queries: DataFrame) -> DataFrame:
    """Phrases of every query: (query_id, phrase_no, term, offset, n_terms, in_all, in_any, n_all).

    Strict search needs every `in_all` phrase; loose search takes any `in_any` phrase. They differ
    only for runs of more than two CJK characters: one phrase strictly, overlapping pairs loosely.
    """
    runs = F.regexp_extract_all(F.lower("query"), F.lit(f"[{X.CJK}]+|[a-z0-9_]+"), F.lit(0))
    run = F.col("run")
    long_cjk = run.rlike(f"^[{X.CJK}]") & (F.length("run") > 2)
    pairs = F.transform(F.sequence(F.lit(1), F.length("run") - 1), lambda i: F.substr(run, i, F.lit(2)))
    piece = lambda v, a, o: F.struct(v.alias("phrase"), F.lit(a).alias("in_all"), F.lit(o).alias("in_any"))
    pieces = F.when(
        long_cjk, F.concat(F.array(piece(run, True, False)), F.transform(pairs, lambda p: piece(p, False, True)))
    ).otherwise(F.array(piece(run, True, True)))
    phrases = (
        queries.select("query_id", F.posexplode(runs).alias("run_no", "run"))
        .select("query_id", "run_no", F.posexplode(pieces).alias("piece_no", "p"))
        .select("query_id", F.concat_ws(".", "run_no", "piece_no").alias("phrase_no"), "p.*")
        .withColumn("terms", X.tokens("phrase"))
        .withColumn("n_terms", F.size("terms"))
    )
    counted = phrases.withColumn("n_all", F.count_if(F.col("in_all")).over(Window.partitionBy("query_id")))
    return counted.select(
        "query_id", "phrase_no", "n_terms", "in_all", "in_any", "n_all", F.posexplode("terms").alias("offset", "term")
    )


# ---- matching and ranking ----

PHRASE = ["query_id", "phrase_no"]
DOC = ["ord", "app_id", "platform", "n_tokens"]


def match_phrases(phrases: DataFrame, postings: DataFrame) -> DataFrame:
    """Occurrences of each phrase in each document: adjacent positions for phrases of several terms."""
    joined = postings.join(phrases, "term")
    carried = [*PHRASE, "in_all", "in_any", "n_all", *DOC]
    single = joined.where("n_terms = 1").select(*carried, F.size("positions").alias("tf"))
    starts = joined.where("n_terms > 1").select(
        *carried, "n_terms", F.explode(F.transform("positions", lambda p: p - F.col("offset"))).alias("start")
    )
    several = (
        starts.groupBy(*carried, "n_terms", "start").agg(F.count("*").alias("met")).where("met = n_terms")
        .groupBy(*carried).agg(F.count("*").cast("int").alias("tf"))
    )
    return single.unionByName(several)


def corpus_totals(corpus: DataFrame) -> DataFrame:
    """One row: number of documents and of tokens in the whole corpus."""
    return document_lengths(corpus).agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


def score_documents(hits: DataFrame, totals: DataFrame) -> DataFrame:
    """BM25 per query and document, strict and loose, with statistics over the whole corpus."""
    frequency = hits.groupBy(*PHRASE).agg(F.count("*").alias("df"))
    rows = hits.join(frequency, PHRASE)
    n = totals.select(F.col("n_docs").cast("double")).scalar()
    mean = totals.select(F.col("n_tokens") / F.col("n_docs")).scalar()
    idf = F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.when(idf <= 0, F.lit(RARE)).otherwise(idf)
    length = F.lit(1 - B) + F.lit(B) * F.col("n_tokens") / mean
    part = idf * (F.col("tf") * F.lit(K1 + 1)) / (F.col("tf") + F.lit(K1) * length)
    scored = rows.withColumn("part", part).groupBy("query_id", *DOC).agg(
        F.count_if(F.col("in_all")).alias("met_all"),
        F.max("n_all").alias("n_all"),
        F.sum(F.when(F.col("in_all"), F.col("part"))).alias("all_score"),
        F.sum(F.when(F.col("in_any"), F.col("part"))).alias("any_score"),
    )
    strict = F.col("met_all") == F.col("n_all")
    # Nine decimals: the order of additions must not decide ranks.
    return scored.select(
        "query_id", *DOC, strict.alias("strict"),
        F.round(F.when(strict, F.col("all_score")).otherwise(F.col("any_score")), 9).alias("raw_score"),
    ).where(F.col("raw_score").isNotNull())


def rank_hits(scored: DataFrame, group: list[str], limit: int) -> DataFrame:
    """Best `limit` per group: strict hits where there are any, else loose ones; scores scaled to 0…1.

    Strict hits sort first, so one bounded ranking also settles whether loose ones count.
    """
    w = Window.partitionBy(*group)
    order = [F.desc("strict"), F.desc("raw_score"), F.asc("ord")]
    top = scored.withColumn("rank", F.row_number().over(w.orderBy(*order))).where(F.col("rank") <= limit)
    kept = top.withColumn("any_strict", F.max("strict").over(w)).where(F.col("strict") == F.col("any_strict"))
    low, high = F.min("raw_score").over(w), F.max("raw_score").over(w)
    return kept.withColumn(
        "score", F.when(high > low, (F.col("raw_score") - low) / (high - low)).otherwise(1.0)
    ).drop("any_strict")


def bm25_topk(queries: DataFrame, corpus: DataFrame, limit: int, postings: DataFrame | None = None,
              totals: DataFrame | None = None, group: list[str] = ("query_id",), query_apps: DataFrame | None = None, index=None) -> DataFrame:
    """Keyword search of all queries. `query_apps` restricts rows, never the statistics.

    With an `index` (`text_index.Index`) only its blocks that can matter are read; otherwise the corpus is scored whole.
    """
    if index is not None:
        from .text_index import score_topk

        scored = score_topk(queries, index, limit, query_apps if "app_id" in group else None)
        if query_apps is not None:
            scored = scored.join(query_apps.select("query_id", "app_id", *[c for c in ("app_ord",) if c in query_apps.columns]), ["query_id", "app_id"])
        return rank_hits(scored, list(group), limit)
    phrases = compile_queries(queries)
    if postings is None:
        postings = build_index(corpus, phrases)
    scored = score_documents(match_phrases(phrases, postings), totals if totals is not None else corpus_totals(corpus))
    if query_apps is not None:
        few = query_apps.select("query_id", "app_id", *[c for c in ("app_ord",) if c in query_apps.columns])
        scored = scored.join(few, ["query_id", "app_id"])
    return rank_hits(scored, list(group), limit)


def clamp(k: int) -> int:
    return max(1, min(k, 100))


def trim(hits: DataFrame, group: list[str], k: int, order: list[Column]) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return hits.withColumn("place", place).where(F.col("place") <= k)


def search_app(hits: DataFrame, k: int, group: list[str] = ("query_id",), include_social: bool = False) -> DataFrame:
    """`hits` holds the best 3k; the platform filter comes after that cut, then the best k remain."""
    allowed = hits.where(allowed_platform(F.col("platform"), include_social))
    return trim(allowed, list(group), clamp(k), [F.desc("score"), F.asc("rank")])


def search_many(queries: DataFrame, corpus: DataFrame, query_apps: DataFrame, k: int, **index) -> DataFrame:
    """Every app searched and scaled on its own, then merged per query: score, app order, rank."""
    group = ["query_id", "app_id"]
    hits = bm25_topk(queries, corpus, 3 * clamp(k), group=group, query_apps=query_apps, **index)
    per_app = search_app(hits, k, group).drop("place")
    return trim(per_app, ["query_id"], clamp(k), [F.desc("score"), F.asc("app_ord"), F.asc("rank")])


# ---- vectors ----

QUERY_BLOCK = 1_024
VECTOR_BLOCK = 4_096


def vector_topk(queries: DataFrame, vectors: DataFrame, limit: int, id_col: str = "ord", keep: list[str] = ()) -> DataFrame:
    """Cosine similarity of every query vector, positive scores only, best `limit` per query.

    Vectors are compared block by block: each task multiplies one block of vectors with one block
    of queries and keeps the best `limit` per query, so at most that many rows leave a task.
    """
    columns = [id_col, *keep]
    fields = {f.name: f.dataType.simpleString() for f in vectors.schema.fields}
    query_type = dict(queries.dtypes)["query_id"]
    schema = f"query_id {query_type}, " + ", ".join(f"{c} {fields[c]}" for c in columns) + ", score double"

    def unit(m: np.ndarray) -> np.ndarray:
        norm = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)

    def best(ids: np.ndarray, q: np.ndarray, pdf: pd.DataFrame) -> pd.DataFrame:
        lengths = {len(e) for e in pdf["embedding"]}
        if lengths != {q.shape[1]}:
            raise ValueError(f"vector lengths {sorted(lengths)} differ from the query length {q.shape[1]}")
        pdf = pdf.sort_values(id_col, kind="stable").reset_index(drop=True)
        m = unit(np.stack(pdf["embedding"].to_list()).astype("float64"))
        out = []
        for i, row in enumerate(np.round(q @ m.T, 9)):
            order = np.argsort(-row, kind="stable")[:limit]
            order = order[row[order] > 0]
            part = pdf.loc[order, columns].assign(score=row[order])
            part.insert(0, "query_id", ids[i])
            out.append(part)
        return pd.concat(out)

    # Blocks go by a hash of the id, whatever ids look like; every block of vectors meets every block of queries once.
    slim = vectors.select(*columns, "embedding")
    n_vectors, n_queries = (max(1, -(-df.count() // rows)) for df, rows in ((slim, VECTOR_BLOCK), (queries, QUERY_BLOCK)))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    placed = slim.withColumn("vector_block", block(id_col, n_vectors)).withColumn("query_block", every(n_queries))
    asked = queries.select("query_id", F.col("embedding").alias("asked"), block("query_id", n_queries).alias("query_block")).withColumn("vector_block", every(n_vectors))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame(columns=["query_id", *columns, "score"])
        q = unit(np.stack(right["asked"].to_list()).astype("float64"))
        return best(right["query_id"].to_numpy(), q, left)

    keys = ["query_block", "vector_block"]
    candidates = placed.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(meet, schema)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc(id_col)))
    return candidates.withColumn("rank", place).where(F.col("rank") <= limit)


def hybrid_fuse(keyword: DataFrame, vector: DataFrame, k: int, include_social: bool = False) -> DataFrame:
    """Weighted sum over both result lists, only for queries that have a keyword hit.

    `keyword` is the platform-filtered list of the best 3k, `vector` the best 3k by cosine.
    """
    answered = keyword.select("query_id").distinct()
    v = vector.join(answered, "query_id", "left_semi").select(
        "query_id", "ord", F.col("score").alias("v"), F.col("rank").alias("v_rank"), F.col("platform").alias("v_platform")
    )
    w = keyword.select("query_id", "ord", F.col("score").alias("w"), F.col("rank").alias("w_rank"))
    both = w.join(v, ["query_id", "ord"], "full")
    both = both.where(F.col("w").isNotNull() | allowed_platform(F.col("v_platform"), include_social))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    score = F.round(F.lit(KEYWORD_WEIGHT) * zero("w") + F.lit(VECTOR_WEIGHT) * zero("v"), 9)
    order = [F.desc("score"), F.asc_nulls_last("w_rank"), F.asc_nulls_last("v_rank")]
    return trim(both.select("query_id", "ord", "w_rank", "v_rank", score.alias("score")), ["query_id"], clamp(k), order)


# ---- fallback, citations, answers ----


def fallback_queries(queries: DataFrame, hits: DataFrame, variants: DataFrame) -> DataFrame:
    """Distinct variants of the queries without any hit, in order, under ids of their own."""
    missed = queries.join(hits.select("query_id").distinct(), "query_id", "left_anti")
    text = F.trim("variant")
    usable = (
        variants.withColumn("variant", text).where("variant <> ''")
        .groupBy("query_id", "variant").agg(F.min("variant_ord").alias("variant_ord"))
        .join(missed.select("query_id", F.col("query").alias("original")), "query_id").where("variant <> original")
    )
    return usable.select(
        F.concat_ws("/", "query_id", "variant_ord").alias("variant_id"), "query_id", "variant_ord", F.col("variant").alias("query")
    )


def merge_rounds(rounds: DataFrame, k: int) -> DataFrame:
    """Round-robin by rank over the variants of a query; the first occurrence of a review stays."""
    first = rounds.groupBy("query_id", "ord").agg(F.min(F.struct("place", "variant_ord")).alias("at"))
    merged = first.select("query_id", "ord", F.col("at.place").alias("round"), F.col("at.variant_ord").alias("variant_ord"))
    return trim(merged, ["query_id"], clamp(k), [F.asc("round"), F.asc("variant_ord")])


def render_evidence(hits: DataFrame) -> DataFrame:
    """Numbered context text of each query; a query has at most 100 hits."""
    line = F.format_string(
        "[%d] review_id=%s app=%s platform=%s\n%s", "place", "review_id", "app_id", "platform", "content"
    )
    rows = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))).alias("l"))
    return rows.select("query_id", F.array_join(F.col("l.line"), "\n").alias("context"))


def verify_citations(citations: DataFrame, hits: DataFrame) -> DataFrame:
    """Citations whose quote stands in the cited hit, compared in NFKC without whitespace; first valid per id."""
    content = hits.select("query_id", "review_id", X.nfkc_compact("content").alias("whole"))
    asked = citations.withColumn("part", X.nfkc_compact("quote")).where("part <> ''")
    valid = asked.join(content, ["query_id", "review_id"]).where(F.contains("whole", "part"))
    return valid.groupBy("query_id", "review_id").agg(F.min(F.struct("pos", "quote")).alias("c")).select(
        "query_id", "review_id", "c.pos", "c.quote"
    )


def answer_status(queries: DataFrame, hits: DataFrame, answers: DataFrame | None, citations: DataFrame | None) -> DataFrame:
    """Whether the evidence suffices and why not, per query."""
    found = hits.groupBy("query_id").agg(F.count("*").alias("n_hits"))
    rows = queries.select("query_id").join(found, "query_id", "left").fillna(0, ["n_hits"])
    if answers is None:
        return rows.select(
            "query_id", F.least("n_hits", F.lit(5)).alias("n_citations"), (F.col("n_hits") > 0).alias("evidence_sufficient"),
            F.when(F.col("n_hits") == 0, "语料为空或无匹配评论").otherwise("模型未配置，仅展示检索结果").alias("limitation"),
        )
    given = citations.groupBy("query_id").agg(F.count("*").alias("n_given"))
    good = verify_citations(citations, hits).groupBy("query_id").agg(F.count("*").alias("n_citations"))
    rows = rows.join(answers.select("query_id", "limitation", F.lit(True).alias("answered")), "query_id", "left")
    rows = rows.join(given, "query_id", "left").join(good, "query_id", "left").fillna(0, ["n_given", "n_citations"])
    text = (
        F.when(F.col("n_hits") == 0, "语料为空或无匹配评论")
        .when(F.col("answered").isNull(), "模型调用失败")
        .when(F.col("n_citations") > 0, "")
        .when(F.col("n_given") > 0, "模型引用未通过校验，视为证据不足")
        .when(F.coalesce("limitation", F.lit("")) != "", F.col("limitation"))
        .otherwise("模型未提供证据引用")
    )
    return rows.select("query_id", "n_citations", (F.col("n_citations") > 0).alias("evidence_sufficient"), text.alias("limitation"))


def corpus_distribution(corpus: DataFrame) -> DataFrame:
    """Counts by app, by language and by source in one pass."""
    app, language, source = F.col("app_id"), F.col("language"), F.col("source")
    return corpus.groupingSets([[app], [language], [source]], app, language, source).agg(F.count("*").alias("n"))


def backfill_embeddings(corpus: DataFrame, embeddings: DataFrame, embed, batch: int = 256) -> DataFrame:
    """Vectors of the documents that have none, then the union of both; `embed` takes a list of texts."""
    missing = corpus.join(embeddings.select("ord"), "ord", "left_anti").select("ord", "content")

    def run(batches):
        for pdf in batches:
            for i in range(0, len(pdf), batch):
                part = pdf.iloc[i : i + batch]
                yield pd.DataFrame({"ord": part["ord"].to_numpy(), "embedding": embed(part["content"].tolist())})

    made = missing.mapInPandas(run, "ord bigint, embedding array<float>")
    return embeddings.select("ord", "embedding").unionByName(made)


def embed_missing(corpus: DataFrame, embeddings: DataFrame, embed, batch: int = 256) -> tuple[DataFrame, DataFrame]:
    """Vectors of all documents that have one now, and (ord, error) of those whose text the embedder refused.

    What the embedder said is written once, so neither result asks it again. If it fails on several texts, each is tried alone:
    one text that it can't take costs no other its vector, and the text index does not depend on any of them.
    """
    missing = corpus.join(embeddings.select("ord"), "ord", "left_anti").select("ord", "content")

    def tried(texts: list[str]) -> list[tuple]:
        try:
            return [(vector, None) for vector in embed(texts)]
        except Exception as error:  # noqa: BLE001 - the error becomes the row of its text
            return [(None, type(error).__name__)] if len(texts) == 1 else [tried([text])[0] for text in texts]

    def run(batches):
        for pdf in batches:
            for i in range(0, len(pdf), batch):
                part = pdf.iloc[i : i + batch]
                vectors, errors = zip(*tried(part["content"].tolist()), strict=True)
                yield pd.DataFrame({"ord": part["ord"].to_numpy(), "embedding": list(vectors), "error": list(errors)})

    made = staged(missing.mapInPandas(run, "ord bigint, embedding array<float>, error string"), "embedded")
    good = made.where("error IS NULL").select("ord", "embedding")
    return embeddings.select("ord", "embedding").unionByName(good), made.where("error IS NOT NULL").select("ord", "error")
