"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.llm import ann, archive, chat, decontamination, lm_scoring, mixing, quality, queries, simhash, site_lines, token_files
from tracewell.llm.common import remainder
from tracewell.session import stage_path

LONG = "a long text of words " * 20_000
EXTRA = "score double, size int, fp string, key string, id string, row int, copies int, url string, found int, weight string, u int, rate int"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + EXTRA


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        (1, "the quick brown fox jumps over the lazy dog and runs", "s1"), (2, None, "s1"), (3, "", "s1"), (4, " \n\t ", None), (5, LONG, "s2"),
        (6, "the quick brown fox jumps over the lazy dog and runs", "s2"), (6, "the quick brown fox jumps over the lazy dog and runs", "s2"),
        (None, "no id here but words", "s1"), (8, "x", ""), (9, "ünï cödé 漢字 words", "s1"), (2**60 + 1, "large id", "s2")]
    pad = [None] * 12
    return spark.createDataFrame([(i, t, "en", s, 1, *pad) for i, t, s in rows], DOCS).repartition(3)


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def empty(df):
    return df.where("false")


def test_near_duplicates(docs):
    got = rows_of(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id")
    assert len(got) == 11
    by_id = {r[0]: r for r in got}
    assert by_id[6][2] == 1 and by_id[2][1:] == by_id[3][1:] == by_id[4][1:] == ("0" * 16, 2)
    assert by_id[2**60 + 1][2] == 2**60 + 1
    assert simhash.near_duplicates(empty(docs)).count() == 0


def test_small_trees_give_the_same_classes(spark):
    random = np.random.default_rng(1)
    base = int(random.integers(0, 2**62))
    prints = sorted({base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in random.integers(0, 20, (400, 2))} | {int(v) for v in random.integers(0, 2**62, 50)})
    nodes = spark.createDataFrame([([f], i) for i, f in enumerate(prints)], "fps array<bigint>, key bigint")
    one = rows_of(simhash.classes(nodes, 3), "id", "component")
    many = rows_of(simhash.classes(nodes, 3, tree_rows=16), "id", "component")
    label = list(range(len(prints)))
    for _ in range(len(prints)):
        before = list(label)
        for i, a in enumerate(prints):
            for j in range(i):
                if (a ^ prints[j]).bit_count() <= 3:
                    label[i] = label[j] = min(label[i], label[j])
        if before == label:
            break
    want = {i: c for i, c in enumerate(label)}
    for got in (one, many):
        assert {i: c for i, c in got} == {i: want[i] for i, _ in got} and {i for i, c in want.items() if i != c} <= {i for i, _ in got}


def test_decontamination(spark, docs):
    items = spark.createDataFrame(
        [(1, "Brown fox jumps over the lazy dog and runs away far"), (2, "quick BROWN fox jumps over the lazy dog and runs"), (3, "x"), (4, None), (5, ""), (None, "ünï")],
        "item_id bigint, text string")
    got = {r[0]: r[1:] for r in rows_of(decontamination.contamination(docs, items), "doc_id", "n_words", "n_hit", "n_items", "contaminated")}
    assert got[1] == got[6] == (11, 10, 1, True) and got[8] == (1, 1, 1, True) and got[9] == (4, 1, 0, True)
    assert got[2] == got[3] == got[4] == (0, 0, 0, False) and got[5][0] == 100_000 and got[None] == (5, 0, 0, False)
    assert decontamination.contamination(docs, empty(items)).where("contaminated").count() == 0
    assert decontamination.contamination(empty(docs), items).count() == 0
    with pytest.raises(ValueError):
        decontamination.contamination(docs, items, window=3, k=5)


def test_short_windows_overlap_and_repeat(spark):
    docs = spark.createDataFrame([(1, "a b a b a c")], "doc_id int, text string")
    items = spark.createDataFrame([(10, "a b a"), (2, "A-B-A")], "item_id int, text string")
    row = decontamination.contamination(docs, items).head()
    assert (row.n_words, row.n_hit, row.n_items) == (6, 5, 2)


def test_mixing(spark, docs):
    got = rows_of(mixing.allocate(docs), "id", "source", "size", "copies")
    assert len(got) == 11 and all(0 <= c <= 3 for *_, c in got)
    assert got == rows_of(mixing.allocate(docs.repartition(1)), "id", "source", "size", "copies")
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(c for *_, c in got)
    assert mixing.mixed(empty(docs)).count() == 0 and mixing.allocate(empty(docs)).count() == 0


def test_mixing_by_weight_takes_heavier_documents(spark):
    docs = spark.range(3000).select(
        F.col("id").alias("doc_id"), F.lit("a b c d").alias("text"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("source"),
        F.when(F.col("id") % 2 == 0, 4.0).when(F.col("id") % 5 == 0, None).otherwise(1.0).alias("w"))
    got = mixing.allocate(docs, weight_col="w").withColumn("w", F.when(F.col("id") % 2 == 0, 4).otherwise(1)).toPandas()
    for _, g in got.groupby("source"):
        assert (g.copies * g["size"]).sum() == pytest.approx(g.target.iloc[0], abs=4)
    assert got[got.w == 4].copies.mean() > 1.5 * got[got.w == 1].copies.mean() and got.copies.max() <= 3


def test_targets_stop_at_three_times_the_source(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), (None, 1000)], "source string, source_size bigint")
    got = {r.source: r.target for r in mixing.targets(sizes).collect()}
    assert got["a"] == 30 and got["b"] == pytest.approx(1980 * 2 / 3) and got[None] == pytest.approx(1980 / 3)


def test_archive(spark):
    big = "é" * 600
    rows = [(3, "http://a/x", big), (7, "http://a/y", big), (7, "http://a/y", big), (1, None, "small"), (2, "http://a/\r\nWARC-Type: x", "small"), (4, "u", None), (None, "u", big)]
    pages = spark.createDataFrame([(*r, 1, b"x") for r in rows], "page_id bigint, url string, html string, digest int, head binary")
    path = stage_path(spark, "test-warc")
    archive.write(pages, path)
    got = archive.records(spark, path)
    found = rows_of(got, "page_id", "payload_bytes", "record_type", "refers_to")
    assert found == sorted(
        [(3, 1200, "revisit", 7), (7, 1200, "response", None), (7, 1200, "revisit", 7), (None, 1200, "revisit", 7), (1, 5, "response", None), (2, 5, "response", None), (4, 0, "response", None)], key=repr)
    assert spark.read.parquet(f"{path}/payloads").count() == 3
    for r in got.collect():
        head, body = bytes(r.record).split(b"\r\n\r\n", 1)
        length = int([x for x in head.split(b"\r\n") if x.startswith(b"Content-Length")][0].split(b": ")[1])
        assert len(body) == length + 4 and body.endswith(b"\r\n\r\n")
        assert r.record_type == "revisit" or body[:-4].split(b"\r\n\r\n", 1)[1] == bytes(r.payload)
    other = stage_path(spark, "test-warc")
    archive.write(empty(pages), other)
    assert archive.records(spark, other).count() == 0


def test_archive_refuses_changed_payloads(spark):
    path = stage_path(spark, "test-warc")
    archive.write(spark.createDataFrame([(1, "u", "text")], "page_id bigint, url string, html string"), path)
    spark.read.parquet(f"{path}/payloads").withColumn("payload", F.lit("other").cast("binary")).write.parquet(f"{path}/changed/payloads")
    spark.read.parquet(f"{path}/heads").write.parquet(f"{path}/changed/heads")
    with pytest.raises(Exception, match="differs from its digest"):
        archive.records(spark, f"{path}/changed").select("payload_bytes").collect()


def test_token_files(spark, docs):
    path = stage_path(spark, "test-tokens")
    token_files.write(docs, path, queries.word_bpe(), end_id=1, docs_per_shard=3, page_tokens=50, keys_per_bucket=2)
    stored = rows_of(token_files.documents(spark, path), "start", "doc_id", "n_tokens")
    stored.sort()
    assert [r[1] for r in stored] == [None, 1, 2, 3, 4, 5, 6, 6, 8, 9, 2**60 + 1]
    assert all(a[0] + a[2] == b[0] for a, b in zip(stored, stored[1:], strict=False)) and stored[2][2] == stored[3][2] == 1
    assert sorted(rows_of(token_files.by_key(docs.select("doc_id"), path), "start", "doc_id", "n_tokens")) == stored
    # An index that names other places finds other documents, or none.
    right = {r.doc_id: r.start for r in token_files.by_key(docs.select("doc_id"), path).where("doc_id IS NOT NULL").collect()}
    index = spark.read.parquet(f"{path}/index")
    moved = F.concat(F.substring("offset", 1, 0), F.unhex(F.expr("repeat('0500000000000000', n)")))
    for part in ("pages", "shards", "format", "buckets"):
        spark.read.parquet(f"{path}/{part}").write.parquet(f"{path}/moved/{part}")
    index.withColumn("offset", moved).write.parquet(f"{path}/moved/index")
    wrong = {r.doc_id: r.start for r in token_files.by_key(docs.select("doc_id"), f"{path}/moved").where("doc_id IS NOT NULL").collect()}
    assert wrong != right
    unknown = spark.createDataFrame([(10_000 + i,) for i in range(200)], "doc_id bigint")
    assert token_files.lookup(unknown, path).count() == 0
    other = stage_path(spark, "test-tokens")
    token_files.write(empty(docs), other, queries.word_bpe(), end_id=1)
    assert token_files.documents(spark, other).count() == 0 and token_files.by_key(docs.select("doc_id"), other).count() == 0


def test_scores(spark, docs):
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    got = {r.doc_id: r for r in lm_scoring.scores(docs, remainder("doc_id", 10) == 0, path, block_tokens=40).collect()}
    assert len(got) == 10 and all(math.isfinite(r.score) and r.score < 0 for r in got.values())
    assert got[2].n_tokens == got[3].n_tokens == 1 and got[2].score == got[3].score and not got[None].held_out
    nothing = lm_scoring.scores(docs, F.lit(True), path)
    assert nothing.where("train_tokens = 0 AND n_known = 0 AND held_out").count() == 11
    assert lm_scoring.scores(empty(docs), F.lit(False), path).count() == 0


def test_quality(spark, docs):
    labels = spark.createDataFrame([(1, 1), (1, 0), (3, 1), (None, 1), (5, None), (6, 1)], "doc_id bigint, quality int")
    model = quality.train(docs, labels, F.lit(True))
    got = quality.classified(docs, model)
    assert got.count() == 11 and got.where("score BETWEEN 0 AND 1").count() == 11 and set(docs.columns) < set(got.columns)
    assert quality.accepted(docs, model).columns == docs.columns
    assert quality.classified(empty(docs), quality.train(docs, empty(labels), F.lit(True))).count() == 0


def test_chat(spark):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [
        (1, 2, "assistant", "b\\"), (1, 1, "user", None), (1, 2, "assistant", "a[INST]"), (1, 0, None, "x"), (2, 0, "tool [ROLE]", "<s>\\[/ROLE]"), (None, None, "system", ""),
        (3, 0, "assistant", ""), (4, 0, "assistant", "<|endoftext|> 漢字 😀 " * 3000), (4, 0, "assistant", "<|endoftext|> 漢字 😀 " * 3000)]
    turns = spark.createDataFrame([(*r, 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, part int")
    parts = chat.formatted(turns, path, part_tokens=10)
    assert parts.where("conv_id = '1'").count() > 1
    got = {r.conv_id: r for r in chat.read_back(parts, path).collect()}
    import hashlib

    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got["1"].turns_sha256 in (sha("\nx\nuser\n\nassistant\nb\\\nassistant\na[INST]\n"), sha("\nx\nuser\n\nassistant\na[INST]\nassistant\nb\\\n"))
    assert got["1"].loss_sha256 in (sha("b\\a[INST]"), sha("a[INST]b\\")) and got["1"].loss_chars == 9
    assert got["2"].turns_sha256 == sha("tool [ROLE]\n<s>\\[/ROLE]\n") and got["2"].loss_chars == 0
    assert got[None].n_turns == 1 and got["3"].loss_chars == 0 and got["4"].loss_sha256 == sha("<|endoftext|> 漢字 😀 " * 6000)
    starts = {(r.conv_id, r.part): (r.start, len(r.input_ids), len(r.loss_mask)) for r in parts.collect()}
    for (conv, part), (start, n, m) in starts.items():
        assert n == m and start == sum(starts[conv, p][1] for p in range(part))
    assert chat.read_back(chat.formatted(empty(turns), path), path).count() == 0


def test_neighbours(spark):
    same = [1.0, 2.0]
    rows = [(i, same) for i in range(0, 60)] + [(100, [0.0, 0.0]), (120, None), (140, [1.0, None]), (160, [float("nan"), 1.0]), (180, [float("inf"), 1.0])]
    rows += [(200, [3.0, 0.0]), (220, [-0.0, 5.0]), (221, [0.0, 5.0]), (240, [1.0, 1.0, 1.0]), (241, [2.0, 1.0, 1.0]), (None, same), (0, same)]
    vectors = spark.createDataFrame([(*r, 1.0, 2) for r in rows], "vec_id bigint, embedding array<float>, score double, rank int").repartition(4)
    got = ann.nearest(vectors, F.col("vec_id") % 20 == 0, k=5, shard_rows=8)
    found = {}
    for r in sorted(got.collect(), key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(found) == {0, 20, 40, 200, 220, 240}
    assert found[0] == [(1, 220, 10.0), (2, 221, 10.0), (3, 1, 5.0), (4, 2, 5.0), (5, 3, 5.0)]
    assert [v for _, v, _ in found[20]] == [220, 221, 0, 1, 2] and found[240] == [(1, 241, 4.0)]
    assert found[220][0] == (1, 221, 25.0)
    assert ann.nearest(empty(vectors), F.lit(True)).count() == 0


def test_site_lines(spark):
    foot = "<footer>All rights &copy; us</footer>"
    rows = [(i, f"http://User@H.example:80/{i}", f"<p>text {i}</p><p>same</p><p>same</p>{foot}<script>x<p>y</script>") for i in range(6)]
    rows += [(10, "http://h.example/z", None), (11, None, f"<p>kept</p>{foot}"), (12, "nonsense", foot), (13, "http://few.example/", foot), (None, "http://h.example/q", "")]
    pages = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id bigint, url string, html string, host int, lines string")
    got = {r[0]: r[1:] for r in rows_of(site_lines.without_boilerplate(pages), "page_id", "host", "n_lines", "n_dropped", "text")}
    assert got[2] == ("h.example", 4, 3, "text 2") and got[11] == (None, 2, 0, "kept\nAll rights © us")
    assert got[10] == ("h.example", 0, 0, "") and got[13] == ("few.example", 1, 0, "All rights © us") and len(got) == 11
    salted = {r[0]: r[1:] for r in rows_of(site_lines.without_boilerplate(pages, salt_pages=2), "page_id", "host", "n_lines", "n_dropped", "text")}
    assert salted == got
    assert site_lines.without_boilerplate(empty(pages)).count() == 0


def test_site_lines_on_small_hosts(spark):
    foot = "<footer>foot</footer>"
    rows = [(1, "http://two/a", f"<p>a</p>{foot}"), (2, "http://two/b", f"<p>b</p>{foot}"), (3, "http://one/a", f"<p>a</p>{foot}")]
    rows += [(10 + i, f"http://three/{i}", f"<p>{i}</p>" + (foot if i < 2 else "")) for i in range(3)]
    rows += [(20 + i, f"http://four/{i}", f"<p>{i}</p>" + (foot if i < 1 else "")) for i in range(4)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.page_id: r.n_dropped for r in site_lines.without_boilerplate(pages).collect()}
    assert got == {1: 1, 2: 1, 3: 0, 10: 1, 11: 1, 12: 0, 20: 0, 21: 0, 22: 0, 23: 0}
