"""Whole texts in others by anchors and digests, against plain search."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.functions import contained
from tracewell.operators import neardup, project


@pytest.mark.parametrize("least, q", contained.TIERS)
def test_anchors_depend_on_nothing_outside(least, q):
    rng = random.Random(least)
    for letters in ("a", "ab", "abcdefgh \U0001f600ß"):
        whole = "".join(rng.choice(letters) for _ in range(3 * least + 40))
        at = rng.randrange(len(whole) - least - 5)
        grams, places = contained.anchors(contained._codes(whole[at : at + least + 5]), least, q)
        outer = set(zip(*(x.tolist() for x in contained.anchors(contained._codes(whole), least, q)), strict=True))
        assert len(grams) and all((g, p + at) in outer for g, p in zip(grams.tolist(), places.tolist(), strict=True))


def test_every_needle_is_found(spark):
    rng = random.Random(3)
    words = ["sub", "price", "ti", "was", "日本語", "ok", "\U0001f600", "x"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    hay = [(i, i % 2, text(rng.choice([1, 5, 60, 700]))) for i in range(24)]
    needles = []
    for i, key, whole in hay:
        for size in (1, 2, 3, 6, 13, 30, 50, 100, 200, 500, 1500, len(whole)):
            at = rng.randrange(max(1, len(whole) - size + 1))
            needles.append((len(needles), rng.choice([key, key, 1 - key]), whole[at : at + size]))
    needles += [(len(needles), 0, ""), (len(needles) + 1, 1, "absent " * 40)]
    n = spark.createDataFrame(needles, "needle_id int, k int, needle string")
    h = spark.createDataFrame(hay, "hay_id int, k int, hay string")
    for ratio in (0.0, 0.8):
        rows = contained.spots(n.unionByName(n.limit(5)), h, ["k"], ratio).join(h.select("hay_id", "hay"), "hay_id")
        rows = rows.where(contained.stands(F.col("hay"), F.col("start"), F.col("n"), F.col("digest")))
        got = {(r.hay_id, r.needle_id) for r in rows.select("hay_id", "needle_id").collect()}
        assert got == {(i, j) for i, k, whole in hay for j, of, part in needles if part and k == of and part in whole and len(part) >= len(whole) * ratio - 1e-9}


def test_few_anchors(spark):
    """A long text leaves a few anchors, where it left a row per character before."""
    rng = random.Random(4)
    codes = np.array([rng.randrange(97, 123) for _ in range(100_000)], np.uint64)
    assert len(contained.anchors(codes, 256, 32)[0]) < 1200


def test_masks_of_overlapping_quotes(spark):
    reviews = spark.createDataFrame([("r", "abc def"), ("r", "abc"), ("r", "def ghi"), ("r", "abc"), ("s", "zzz"), ("r", "")], "run_id string, content_original string")
    messages = spark.createDataFrame([(1, "r", "x abc def ghi abc zzz"), (2, "s", "abc zzzz"), (3, "t", "abc"), (4, "r", None)], "message_id int, run_id string, message string")
    got = dict(project.mask_reviews(messages, reviews).select("message_id", "message").collect())
    m = project.MASKED_REVIEW
    assert got == {1: f"x {m} ghi {m} zzz", 2: f"abc {m}z", 3: "abc", 4: None}


def test_containment_without_edits_shuffles_no_grams(spark, monkeypatch):
    def no(*_):
        raise AssertionError("a row per character")

    monkeypatch.setattr(neardup, "_grams", no)
    rows = spark.createDataFrame([("a", 1, "timer freezes after a pause"), ("b", 1, "timer freezes after a pause now"), ("c", 2, "timer freezes after a pause no")], "cid string, rating int, comp string")
    rows = rows.withColumn("m", F.length("comp"))
    assert [tuple(r) for r in neardup.near_pairs(rows, rows, 100, within=True).collect()] == [("a", "b")]


def test_only_asked_anchors_leave_a_haystack(spark):
    """A haystack of 100,000 characters left some hundreds of anchors of the long tiers, whatever was asked for."""
    rng = random.Random(5)
    needle = "".join(chr(rng.randrange(97, 123)) for _ in range(1500))
    far = "".join(chr(rng.randrange(97, 123)) for _ in range(100_000))
    n = spark.createDataFrame([(1, 0, needle)], "needle_id int, k int, needle string")
    h = spark.createDataFrame([(1, 0, far + needle + far[:999])], "hay_id int, k int, hay string")
    chosen = spark.createDataFrame([(int(g),) for g in range(1000)], "gram bigint")
    asked = contained._asked_map(chosen)
    assert len(asked) * 64 >= contained.BITS_EACH * 1000 and sum(int(w).bit_count() for w in asked) == 1000
    rows = contained.spots(n, h, ["k"])
    assert [(r.start, r.n) for r in rows.collect()] == [(100_001, 1500)]


def test_what_messages_share_joins_in_the_row(spark):
    reviews = spark.createDataFrame([("r", 1, "abc def"), ("r", 2, "ghi"), ("s", 3, "zzz")], "run_id string, message_id int, content_original string")
    shared = spark.createDataFrame([("r", "abc def"), ("s", "zzz")], "run_id string, other string")
    message = F.concat("content_original", F.lit(" | "), "other")
    got = dict(project.mask_reviews(reviews, reviews, message, shared).select("message_id", "message").collect())
    m = project.MASKED_REVIEW
    assert got == dict.fromkeys((1, 2, 3), f"{m} | {m}")
