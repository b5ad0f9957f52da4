"""Keyword search against the full-text engine of Python's own sqlite3, and the fusion rules."""

import random
import re
import sqlite3

from pyspark.sql import functions as F

from tracewell.operators import search as se

WORDS = ["price", "timer", "café", "订阅", "价格", "太贵", "app", "free_trial", "ok", "续费太贵", "Größe"]
CJK = "[一-鿿]"


def sqlite_search(docs, query, mode):
    def spaced(t):
        return re.sub(f"({CJK})", r" \1 ", t)

    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE d USING fts5(content)")
    con.executemany("INSERT INTO d(rowid, content) VALUES (?, ?)", [(i, spaced(t)) for i, t in docs])
    terms = []
    for run in re.findall(f"{CJK}+|[a-z0-9_]+", query.lower()):
        cjk = re.match(CJK, run)
        if cjk and mode == "or" and len(run) > 2:
            terms += [run[i : i + 2] for i in range(len(run) - 1)]
        else:
            terms.append(run)
    if not terms:
        return {}
    match = (" OR " if mode == "or" else " AND ").join(f'"{spaced(t)}"' for t in terms)
    return {r[0]: -r[1] for r in con.execute("SELECT rowid, bm25(d) FROM d WHERE d MATCH ?", (match,))}


def test_bm25_matches_sqlite(spark):
    rng = random.Random(4)
    docs = [(i, rng.choice(["", " "]).join(rng.choice(WORDS) + rng.choice([" ", "，", ""]) for _ in range(rng.randint(1, 9)))) for i in range(60)]
    texts = ["price timer", "订阅价格", "太贵", "free_trial ok", "app订阅", "续费太贵吗", "price price", "nothing here", "café", "！", "timer，太贵了"]
    corpus = spark.createDataFrame([(i, "a", "app-store", t) for i, t in docs], "ord bigint, app_id string, platform string, content string")
    queries = spark.createDataFrame([(f"q{i}", t) for i, t in enumerate(texts)], "query_id string, query string")
    got = {}
    for r in se.bm25_topk(queries, corpus, 1000).collect():
        got.setdefault(r.query_id, {})[r.ord] = r.raw_score
    for i, text in enumerate(texts):
        want = sqlite_search(docs, text, "and") or sqlite_search(docs, text, "or")
        mine = got.get(f"q{i}", {})
        assert set(mine) == set(want), text
        assert all(abs(mine[k] - want[k]) < 1e-6 for k in want), text


def test_hybrid_weights_and_gate(spark):
    keyword = spark.createDataFrame([("q", 1, 1.0, 1), ("q", 2, 1.0, 2)], "query_id string, ord bigint, score double, rank int")
    vector = spark.createDataFrame([("q", 2, 1.0, 1, None), ("z", 9, 1.0, 1, None), ("q", 7, 0.9, 2, "social")],
                                   "query_id string, ord bigint, score double, rank int, platform string")
    out = [(r.query_id, r.ord, r.score) for r in se.hybrid_fuse(keyword, vector, 5).orderBy("place").collect()]
    assert out == [("q", 2, 1.0), ("q", 1, 0.6)]


def test_vector_search_same_in_blocks(spark, monkeypatch):
    rng = random.Random(1)
    vec = lambda: [rng.uniform(-1, 1) for _ in range(8)]
    vectors = spark.createDataFrame([(i, vec()) for i in range(200)], "ord bigint, embedding array<float>")
    queries = spark.createDataFrame([(f"q{i}", vec()) for i in range(30)], "query_id string, embedding array<float>")
    rows = lambda: sorted((r.query_id, r.rank, r.ord, round(r.score, 6)) for r in se.vector_topk(queries, vectors, 5).collect())
    whole = rows()
    monkeypatch.setattr(se, "QUERY_BLOCK", 10)
    monkeypatch.setattr(se, "VECTOR_BLOCK", 64)
    assert rows() == whole and len(whole) == 150


def test_citations(spark):
    hits = spark.createDataFrame([("q", "r1", "Ａ very  good app"), ("q", "r2", "bad")], "query_id string, review_id string, content string")
    cites = spark.createDataFrame(
        [("q", 1, "r1", "not there"), ("q", 2, "r1", "A very good"), ("q", 3, "r1", "good app"), ("q", 4, "r2", " "), ("q", 5, "r9", "bad")],
        "query_id string, pos int, review_id string, quote string")
    assert [(r.review_id, r.pos) for r in se.verify_citations(cites, hits).collect()] == [("r1", 2)]
