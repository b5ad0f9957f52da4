"""The pipeline's stages on documents with planted cases."""

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tracewell.llm import similar

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")


def text(seed, n):
    random = np.random.default_rng(seed)
    return " ".join("".join(random.choice(list("aeioustrn"), 6)) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").head().text
    rows = [(i, text(i, 300)) for i in range(20)]
    rows += [(100, text(3, 300)), (101, text(4, 300) + " one"), (102, text(5, 300).upper()), (103, text(50, 40) + " " + benchmark + " " + text(51, 40))]
    rows += [(7, text(7, 300)), (None, text(60, 100)), (None, text(60, 100)), (104, None), (105, "")]
    return spark.createDataFrame([(i, t, "en", "s", 0 if t is None else len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3)


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "SimHash near-dedup", "benchmark decontamination", "mixing sources to target weights", "token-ID output"]


def test_one_of_each_group_stays(spark, docs):
    kept = corpus_pipeline.distinct(spark, docs, SF)
    assert kept.columns == docs.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=repr)
    assert ids == sorted([*range(20), 103, None, 104], key=repr)


def planted(levels, each=60, shingles=200):
    """Rows (doc_id, text): base texts, and by level copies cut to that share of the shingles or with words replaced."""
    random, rows, copies = np.random.default_rng(9), [], {level: [] for level in levels}
    for n, (level, i) in enumerate((level, i) for level in levels for i in range(each)):
        words = text(1000 + n, shingles + 4).split(" ")
        edits = int(shingles * (1 - level) / (1 + level) / 5)
        if i % 2 and (shingles - 5 * edits) / (shingles + 5 * edits) >= level:
            copy = list(words)
            for at in random.permutation(range(4, shingles, 6))[:edits]:
                copy[at] = "edited"
        else:
            copy = words[: round(shingles * level) + 4]
        rows += [(n, " ".join(words)), (10_000 + n, " ".join(copy))]
        copies[level].append(10_000 + n)
    return rows, copies


def test_near_copies_are_found_by_similarity_and_confirmed(spark):
    found_from = 0.8
    rows, copies = planted([0.95, 0.9, 0.85, found_from, 0.77, 0.7])
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = {r.doc_id for r in corpus_pipeline.distinct(spark, docs, SF).select("doc_id").collect()}
    found = {level: 1 - len(kept.intersection(ids)) / len(ids) for level, ids in copies.items()}
    assert all(share >= 0.98 if level >= found_from else share == 0 for level, share in found.items()), found
    assert kept.issuperset(i for i, _ in rows if i < 10_000)


def test_contaminated_documents_go(spark, docs):
    kept = corpus_pipeline.uncontaminated(spark, docs, SF)
    assert kept.count() == docs.count() - 1 and kept.where("doc_id = 103").count() == 0


def test_short_items_keep_clean_documents(spark, tmp_path):
    ten = "one two three four five six seven eight nine ten"
    items = [(1, "yes"), (2, "Lake Como"), (3, ten + " eleven twelve")]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, "oh yes it rained"), (2, "we saw lake como"), (3, "Yes!"), (4, "lake como"), (5, "yes yes"), (6, f"so {ten} so"), (7, ten[:-4]), (8, None), (9, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = corpus_pipeline.uncontaminated(spark, docs, str(tmp_path))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 5, 7, 8, 9]


def test_whole_run(spark):
    out = corpus_pipeline.run(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert 0 < out.count() and out.join(docs, "doc_id", "left_anti").count() == 0
    rows = sorted((r.start, r.n_tokens) for r in out.collect())
    assert rows[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(rows, rows[1:], strict=False))
    good = corpus_pipeline.good(spark, docs, SF)
    assert good.columns == docs.columns and good.count() < docs.count()
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert labels.where("quality = 0").join(good.select("doc_id"), "doc_id").count() <= 0.2 * labels.where("quality = 0").count()
    assert labels.where(F.col("quality") == 1).join(good.select("doc_id"), "doc_id").count() >= 0.95 * labels.where("quality = 1").count()


def test_a_large_group_of_near_copies_hands_on_few_pairs(spark, monkeypatch):
    random, base, n = np.random.default_rng(11), text(77, 300).split(" "), 400
    rows = []
    for i in range(n):
        words = list(base)
        for at in random.permutation(300)[:3]:
            words[at] = f"edit{i}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    asked, judge = [], similar.confirmed

    def counting(pairs, *rest):
        asked.append(pairs.count())
        return judge(pairs, *rest)

    monkeypatch.setattr(similar, "confirmed", counting)
    kept = [r.doc_id for r in corpus_pipeline.distinct(spark, docs, SF).collect()]
    assert kept == [0] and sum(asked) <= 60 * n, asked


def test_forests_leave_out_pairs_until_one_is_refuted():
    fps, ids, sketches = [0, 1, 3, 7], [10, 11, 12, 13], np.zeros((4, 3), np.int64)
    pairs, more = similar.run_pairs(fps, sketches, ids, ids, set(), 3, True)
    assert len(pairs) == 3 and more
    rest, more = similar.run_pairs(fps, sketches, ids, ids, set(pairs), 3, False)
    assert len(rest) == 3 and not more and not set(rest) & set(pairs)
    assert similar.run_pairs(fps, sketches, ids, [5, 5, 5, 5], set(), 3, True) == ([], False)
    far = sketches.copy()
    far[0] = -1
    assert {x for p in similar.run_pairs(fps, far, ids, ids, set(), 3, False)[0] for x in p} == {11, 12, 13}


def test_near_misses_are_refuted_and_hide_nothing(spark):
    """Texts at 0.74 to each other, and one true near copy of each: all copies go, all others stay."""
    shared, rows = text(5, 170).split(" "), []
    for i in range(12):
        own = text(100 + i, 26).split(" ")
        rows += [(i, " ".join(shared + own)), (100 + i, " ".join(shared + own + ["more"]))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = sorted(r.doc_id for r in corpus_pipeline.distinct(spark, docs, SF).collect())
    assert kept == list(range(12))


def test_similar_edges(spark):
    long = text(9, 60_000)
    rows = [(1, long), (2, long + " end"), (3, None), (4, ""), (5, "one two three"), (5, "one two three"), (None, "no id"), (6, "ONE two three")]
    columns = "id bigint, words string, key int, node string, fps int, class double, combo string, left_text string"
    docs = spark.createDataFrame([(*r, 1, "n", 2, 0.5, "c", "l") for r in rows], columns)
    named, found = similar.groups(docs, 5, 0.8, "id", "words")
    classes = {}
    for r in named.join(found.withColumnRenamed("id", "node"), "node", "left").collect():
        classes.setdefault(r.component if r.component is not None else r.node, []).append(r.key)
    assert sorted(map(sorted, classes.values())) == [[1, 2], [3, 4], [5, 5, 6]]
    named, found = similar.groups(docs.where("false"), 5, 0.8, "id", "words")
    assert named.count() == 0 and found.count() == 0


def test_a_large_group_of_near_misses_hands_on_few_pairs(spark, monkeypatch):
    """Texts at 0.74 to each other: comparing all of their pairs makes no rows of them, and links among them are found."""
    shared, rows, n = text(5, 170).split(" "), [], 300
    for i in range(n):
        rows.append((i, " ".join(shared + text(100 + i, 26).split(" "))))
    rows += [(1000 + i, rows[i][1] + " more") for i in range(0, n, 10)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    asked, judge = [], similar.confirmed

    def counting(pairs, *rest):
        asked.append(pairs.select("a", "b").distinct().count())
        return judge(pairs, *rest)

    monkeypatch.setattr(similar, "confirmed", counting)
    kept = sorted(r.doc_id for r in corpus_pipeline.distinct(spark, docs, SF).collect())
    assert kept == list(range(n)) and sum(asked) <= 60 * n, asked


def test_only_the_part_of_a_shard_that_left_out_a_pair_names_its_members():
    """Members that no pair connects to a left-out pair aren't worked once more."""
    near, alone, pair = [7, 7 ^ 1, 7 ^ 2, 7 ^ 4], [1 << 60 | 0xFFFF_0000, 0xABCD_EF01_2345], [0xFFFF_FFFF << 20, 0xFFFF_FFFF << 20 ^ 8]
    fps = np.array([*near, *alone, *pair], np.int64)
    ids = np.arange(1, 9)
    batch = pd.DataFrame({"combo": 0, "masked": 0, "fp": fps, "id": ids, "class": 0, "s0": fps})
    out = pd.concat(similar._shards(iter([batch]), 3, 0.8))
    assert set(out[out["member"]]["a"]) == {1, 2, 3, 4}
    pairs = out[~out["member"]]
    assert len(pairs) == 4 and set(pairs[pairs["more"]]["a"]) | set(pairs[pairs["more"]]["b"]) == {1, 2, 3, 4}
    assert set(pairs[~pairs["more"]]["a"]) | set(pairs[~pairs["more"]]["b"]) == {7, 8}
    assert pairs[pairs["more"]]["part"].nunique() == 1 and set(out[out["member"]]["part"]) == set(pairs[pairs["more"]]["part"])


def test_texts_that_no_pair_asks_for_are_dropped_where_they_are_read(spark):
    texts = spark.range(-1000, 1000).selectExpr("id", "concat('t', id) AS text").unionByName(spark.range(5).selectExpr("id", "concat('t', id) AS text"))
    needed = spark.range(-3, 4)
    assert similar.maybe_needed(texts, needed).count() <= 30
    assert sorted((r.id, r.text) for r in similar.texts_of(texts, needed).collect()) == [(i, f"t{i}") for i in range(-3, 4)]
    assert similar.texts_of(texts, needed.where("false")).count() == 0
