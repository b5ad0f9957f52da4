"""What the review of round 4 found."""

import sys

from pyspark.sql import functions as F

from tracewell.functions import contained, text as X
from tracewell.operators import neardup, setsim
from tracewell.sources import reviews as rv


def test_fields_are_read_once_a_row(spark):
    """fall-backs between names aren't put into every check and filter again, and the rows are as they were."""
    text = '[{"id": "a", "review": "x", "评分": "4.0", "date": "20260102"}, {"id": "b", "content": "y", "rating": "2.5", "date": "2026-01-02"}]'
    files = spark.createDataFrame([(text,)], "value string")
    rows = rv.record_columns(rv.parse_records(files)).withColumns({"app_id": F.lit("app"), "source": F.lit("s"), "ord": F.col("n")})
    good, rejects = rv.validate_import(rv.normalize_review_columns(rows))
    plan = good._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("try_variant_get") <= 2 * len(rv.ALL_NAMES) + 4
    assert [(r.review_id, r.content_original, r.rating) for r in good.collect()] == [("a", "x", 4)]
    assert [(r.review_id, r.rating, r.reasons) for r in rejects.collect()] == [("b", "2.5", ["rating is not a whole number"])]


def test_anchors_leave_a_haystack_in_pieces(spark, monkeypatch):
    """what a task holds of a batch of texts is arrays of some anchors, no list of all anchors of all its texts."""
    monkeypatch.setattr(contained, "ROWS_OUT", 5)
    texts = [(i, None if i == 3 else "abcdefgh" * (i % 4) + "zy") for i in range(9)]
    hay = spark.createDataFrame(texts, "hay_id int, hay string").coalesce(1).withColumn("hay", F.coalesce("hay", F.lit("")))
    held = lambda text: [(1, *contained.anchors(contained._codes(text), 1, 1))] if text else []
    rows = contained.placed(hay, held)
    assert "MapInArrow" in rows._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.hay_id, r.size, r.tier, r.place) for r in rows.collect())
    assert got == sorted((i, len(t), 1, p) for i, t in texts if t for p in range(len(t)))


def test_pieces_move_as_numbers(spark):
    """a row for every run of characters carries a 32-bit key and the number of its class, and isn't sent to all tasks."""
    texts = spark.createDataFrame([(i, 1, f"some words of review {i % 2} that are long enough to be cut") for i in range(4)], "cid bigint, rating int, comp string").withColumn("m", F.length("comp"))
    assert dict(neardup._grams(texts, 96).dtypes)["gram"] == dict(neardup._pieces(texts, 96).dtypes)["gram"] == "int"
    named = texts.select(F.concat(F.lit("c"), "cid").alias("cid"), "rating", "comp", "m", F.col("cid").alias("num"))
    assert {(r.a, r.b) for r in neardup._near_classes(named, named, 96, True).collect()} == {(f"c{a}", f"c{b}") for a in range(4) for b in range(a + 1, 4)}
    assert "BroadcastHashJoin [rating" not in neardup.near_pairs(texts, texts, 96, True)._jdf.queryExecution().executedPlan().toString()


def test_folding_looks_up_only_what_may_need_it(spark):
    """every character folds as in Python; a text without rare ones is told by one range, not by a look-up of each character."""
    codes = [c for c in range(1, sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF and len(chr(c).lower()) == 1]
    texts = ["a" + "".join(map(chr, codes[i : i + 500])) + " É" for i in range(0, len(codes), 500)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select(F.lower("t").alias("lower"), X.casefold("t").alias("f"))
    # Java's lower case: its Unicode tables are older than Python's.
    assert all(r.f == r.lower.casefold() for r in df.collect())
    assert "[µŉ-" in df._jdf.queryExecution().analyzed().toString()


def test_shingle_sets_stay_where_they_were_written(spark):
    """telling copies their representative doesn't shuffle the sets of all rows."""
    df = spark.createDataFrame([(i, f"one two three four five six {i // 2}") for i in range(8)], "ord bigint, content string")
    held = setsim.members(df, 5)
    assert sorted((r.ord, r.rep, r.size) for r in held.collect()) == [(i, i - i % 2, 3) for i in range(8)]
    plan = held._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" not in plan and "SortMergeJoin" not in plan
