"""Cleaning against known cases and against the sequential rule written out."""

import random
import sys
import unicodedata

import pytest
from pyspark.sql import functions as F

from tracewell.functions import text as X
from tracewell.functions.numeric import round_half_even
from tracewell.functions.similarity import partial_ratio_reaches
from tracewell.operators import clean, neardup

SCHEMA = "ord bigint, review_id string, rating int, content_original string"


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], diagonal + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def slow_partial_ratio(a, b):
    """Every window of the longer text, one by one."""
    def one_way(short, long):
        m, n, best = len(short), len(long), 0.0
        windows = [(0, l) for l in range(1, m)] + [(i, i + m) for i in range(n - m + 1)] + [(i, n) for i in range(n - m + 1, n)]
        for i, j in windows:
            w = long[i:j]
            best = max(best, (1 - (m + len(w) - 2 * lcs(short, w)) / (m + len(w))) * 100)
        return best
    if not a or not b:
        return 0.0
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    best = one_way(short, long)
    return max(best, one_way(long, short)) if len(a) == len(b) else best


def slow_clean(rows, threshold):
    """The sequential rule: first come, first kept."""
    kept, out = [], {}
    for o, rid, rating, content in rows:
        text = " ".join(content.split())
        if not text:
            out[o] = "empty"
            continue
        folded = text.casefold()
        comp = "".join(c for c in folded if c.isalnum() or c == "_" or c.isspace())
        if any((k[0] == rid and k[2] == folded) or (k[1] == rating and k[2] == folded) for k in kept):
            out[o] = "exact"
            continue
        near = False
        for _, r, _, c in kept:
            longest = max(len(c), len(comp))
            if r == rating and longest and min(len(c), len(comp)) / longest >= 0.8 and slow_partial_ratio(c, comp) >= threshold:
                near = True
        if near:
            out[o] = "near"
            continue
        kept.append((rid, rating, folded, comp))
        out[o] = "kept"
    return out


def random_rows(seed, n, words=("sub", "price", "timer", "was", "bad", "ok", "the")):
    rng = random.Random(seed)
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 9))) for _ in range(6)]
    rows = []
    for i in range(n):
        text = rng.choice(base)
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            at = rng.randrange(len(text) + 1)
            text = text[:at] + rng.choice(["", "x", "!", " ", "E"]) + text[at + rng.choice([0, 1]):]
        rows.append((i, f"r{rng.randrange(n)}", rng.randint(1, 2), rng.choice([text, text.upper(), "!!", "  ", text])))
    return rows


def reasons(spark, rows, threshold, **options):
    df = spark.createDataFrame(rows, SCHEMA)
    hashed = clean.with_content_hash(clean.normalize_reviews(df))
    got = {r.ord: r.reason for r in neardup.resolve_duplicates(hashed, threshold, **options).collect()}
    return {r[0]: got.get(r[0], "empty") for r in rows}


def test_known_case(spark):
    rows = [(1, "r-1", 5, "  Timer   freezes after pause. "), (2, "r-2", 5, "Timer freezes after pause."),
            (3, "r-3", 5, "Timer freezes after pausing!"), (4, "r-4", 2, "Subscription price is unclear.")]
    assert reasons(spark, rows, 94) == {1: "kept", 2: "exact", 3: "near", 4: "kept"}


def test_other_rating_longer_text_and_punctuation_are_kept(spark):
    rows = [(1, "a", 1, "The subscription price is unclear."), (2, "b", 5, "The subscription price is unclear!"),
            (3, "c", 3, "Timer freezes after pause."),
            (4, "d", 3, "Timer freezes after pause, and the subscription renewal details are also unclear."),
            (5, "e", 4, "!!!"), (6, "f", 4, "???")]
    assert set(reasons(spark, rows, 90).values()) == {"kept"}


@pytest.mark.parametrize("seed, threshold, options", [(1, 96, {}), (2, 88, {"first_block": 20})])
def test_resolution_matches_sequential_rule(spark, seed, threshold, options):
    rows = random_rows(seed, 70)
    assert reasons(spark, rows, threshold, **options) == slow_clean(rows, threshold)


def test_partial_ratio_helper():
    rng = random.Random(7)
    for _ in range(1500):
        a = "".join(rng.choice("abc d") for _ in range(rng.randint(1, 40)))
        b = list(a)
        for _ in range(rng.randint(0, 5)):
            i = rng.randrange(len(b) + 1)
            b[i:i + rng.choice([0, 1])] = rng.choice(["", "z", "a", "ab"])
        b = "".join(b)
        if not b:
            continue
        exact = slow_partial_ratio(a, b)
        for threshold in (80, 90, 94, 96):
            assert partial_ratio_reaches(a, b, threshold) == (exact >= threshold), (a, b, exact)


def test_id_collisions(spark):
    rows = [(1, "same", 5, "one"), (2, "same", 5, "two"), (3, "other", 5, "three"), (4, "same", 4, "one")]
    kept = clean.with_content_hash(spark.createDataFrame(rows, SCHEMA))
    out = {r.ord: (r.review_id, r.renamed, r.content_hash) for r in clean.rename_id_collisions(kept).collect()}
    assert out[1][0] == "same" and out[3][0] == "other"
    assert out[2][0] == "same--" + out[2][2][:8] and out[4][0] == "same--" + out[4][2][:8]


def slow_batches(sizes, max_reviews, max_chars):
    out, count, total, batch = [], 0, 0, 0
    for s in sizes:
        if count and (count >= max_reviews or total + s > max_chars):
            batch, count, total = batch + 1, 0, 0
        out.append(batch)
        count, total = count + 1, total + s
    return out


@pytest.mark.parametrize("width", [5, 16, 16_384])
def test_batches_match_greedy_packing(spark, width):
    rng = random.Random(width)
    runs = {f"run{i}": [rng.choice([1, 5, 20, 60, 130]) for _ in range(rng.randint(1, 120))] for i in range(4)}
    rows = [(r, i * 3, s) for r, sizes in runs.items() for i, s in enumerate(sizes)]
    df = spark.createDataFrame(rows, "run_id string, ord bigint, chars bigint")
    out = clean.pack_batches(df, ["run_id"], 5, 100, width=width).orderBy("run_id", "ord").collect()
    for r, sizes in runs.items():
        assert [x.batch for x in out if x.run_id == r] == slow_batches(sizes, 5, 100)
        assert [x.row_index for x in out if x.run_id == r] == list(range(len(sizes)))


def test_batch_limits_must_be_positive(spark):
    with pytest.raises(ValueError):
        clean.pack_batches(spark.range(1), [], 0, 10)


def test_casefold_and_comparison_text_for_every_character(spark):
    chars = [chr(c) for c in range(32, sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF and unicodedata.category(chr(c)) not in ("Cn", "Co")]
    df = spark.createDataFrame([(c,) for c in chars], "c string").repartition(4)
    for r in df.select("c", X.casefold("c").alias("f"), X.normalize_text("c").alias("n")).collect():
        assert r.f == r.c.casefold(), (r.c, r.f)
        assert r.n == " ".join(r.c.split()), hex(ord(r.c))


def test_half_even_rounding_matches_python(spark):
    rng = random.Random(3)
    values = [2.675, 0.0625, 0.125, 0.995, 1.005, 0.5, 2.5, 0.0, 1.0] + [rng.random() * 10 for _ in range(2000)] + [i / 2000 for i in range(2000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for r in df.select("v", round_half_even(F.col("v"), 2).alias("a"), round_half_even(F.col("v"), 3).alias("b")).collect():
        assert r.a == round(r.v, 2) and r.b == round(r.v, 3), r


def test_batches_same_for_any_partitioning(spark):
    rows = [("a", i, i % 37) for i in range(300)]
    df = spark.createDataFrame(rows, "run_id string, ord bigint, chars bigint")
    results = [
        sorted((r.ord, r.batch) for r in clean.pack_batches(df.repartition(n), ["run_id"], 7, 90, width=32).collect()) for n in (1, 7)
    ]
    assert results[0] == results[1]


def test_trigrams_of_texts_are_not_moved(spark, monkeypatch):
    """With profiles of the usual size no trigram is shuffled before it is summed up; joined profiles give the same."""
    rows = spark.createDataFrame([(i, "en" if i % 2 else "de", "the price is fine " * 2 if i % 2 else "der preis ist gut " * 2) for i in range(8)], "ord bigint, language string, content_original string")
    unknown = rows.withColumn("language", F.lit(None).cast("string"))
    profiles = clean.fit_language_profiles(rows)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        filled = clean.fill_language(unknown, profiles)
        joins = [x for x in filled._jdf.queryExecution().sparkPlan().toString().splitlines() if "Join" in x and "gram#" in x]
        assert joins and all("BroadcastHashJoin" in x for x in joins)
        monkeypatch.setattr(clean, "PROFILE_BYTES", 0)
        again = clean.fill_language(unknown, profiles)
        want = {i: "en" if i % 2 else "de" for i in range(8)}
        assert dict(filled.select("ord", "language").collect()) == want == dict(again.select("ord", "language").collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_texts_of_blocks_are_written_once(spark, monkeypatch):
    """Over several blocks, texts stay in the table of classes and in that of what is kept, not in a table per step."""
    held, write = [], neardup.staged

    def recording(df, name):
        out = write(df, name)
        held.append((name, out.count() if "comp" in out.columns else 0))
        return out

    monkeypatch.setattr(neardup, "staged", recording)
    rows = [(i, f"r{i}", 3, f"review number {i} of its own kind {i * 7919}") for i in range(80)]
    assert set(reasons(spark, rows, 100, first_block=10).values()) == {"kept"}
    assert len([n for n, _ in held if n == "dup-winners"]) > 2 and sum(n for _, n in held) <= 2 * len(rows), held
