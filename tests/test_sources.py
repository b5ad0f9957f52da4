"""Landed files and pages."""

import pytest

from tracewell.sources import feeds, logs, reviews as rv, sinks

MIXED = """﻿{"reviews": [
 {"review_id": "m1", "content": "Great", "rating": 5, "published_at": "2026-07-01T10:00:00Z", "userName": "u"},
 {"id": "m2", "评论原文": "不好", "评分": "3.0", "发布时间": "2026-07-02", "content": ""},
 {"content": "no id", "rating": 4, "date": "2026-07-03T10:00:00+02:00"},
 {"content": "bad rating", "rating": 2.5, "date": "2026-07-03"},
 {"content": "bool rating", "rating": true, "date": "2026-07-03"},
 {"content": "bad date", "rating": 1, "date": "03/07/2026"}]}"""


def test_json_file(spark, tmp_path):
    (tmp_path / "a.json").write_text(MIXED, encoding="utf-8")
    df = rv.normalize_review_columns(rv.read_reviews_json(spark, str(tmp_path), "app"))
    good, rejects = rv.validate_import(df)
    rows = {r.n: r for r in good.collect()}
    assert [rows[i].review_id for i in (1, 2, 3)] == ["m1", "m2", "import-app-3"]
    assert rows[2].content_original == "不好" and rows[2].rating == 3 and rows[1].author == "u"
    assert str(rows[3].published_at) == "2026-07-03 08:00:00" and rows[1].source == "import:json"
    assert {r.n: r.reasons for r in rejects.collect()} == {
        4: ["rating is not a whole number"], 5: ["rating is not a whole number"], 6: ["date is not ISO 8601"]}
    with pytest.raises(ValueError, match="row 4"):
        rv.validate_import(df, strict=True)


def test_csv_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿review_id,content,rating,date\nr1,"two\nlines, ""quoted""",5,2026-01-01\n,plain,4,2026-01-02\n', encoding="utf-8")
    good, rejects = rv.validate_import(rv.normalize_review_columns(rv.read_reviews_csv(spark, str(tmp_path), "app")))
    rows = good.orderBy("n").collect()
    assert [(r.review_id, r.rating) for r in rows] == [("r1", 5), ("import-app-2", 4)]
    assert rows[0].content_original == 'two\nlines, "quoted"' and rejects.count() == 0


def test_store_feed_json_and_xml(spark):
    json_page = '{"feed":{"entry":[{"id":{"label":"a"}},{"id":{"label":"1"},"title":{"label":"t"},"content":{"label":"c"},"im:rating":{"label":"4"},"updated":{"label":"2026-01-01T00:00:00-07:00"},"author":{"name":{"label":"n"}}}]}}'
    xml_page = """<feed xmlns="http://www.w3.org/2005/Atom" xmlns:im="http://itunes.apple.com/rss"><entry><id>1</id><title>t</title><content type="text">again</content><im:rating>5</im:rating><updated>2026-01-02T00:00:00Z</updated></entry>
    <entry><id>2</id><title>t2</title><content type="text">c2</content><im:rating>3</im:rating><im:version>1.1</im:version><updated>2026-01-02T00:00:00Z</updated><author><name>m</name></author></entry></feed>"""
    pages = spark.createDataFrame([("app", "us", 1, json_page), ("app", "us", 2, xml_page)], "app_id string, storefront string, page int, body string")
    out = {r.review_id: r for r in feeds.parse_store_feed(pages).collect()}
    assert set(out) == {"1", "2"}
    assert out["1"].content_original == "c" and str(out["1"].published_at) == "2026-01-01 07:00:00"
    assert (out["2"].rating, out["2"].app_version, out["2"].author, out["2"].ord) == (3, "1.1", "m", 2)


def test_play_page(spark):
    body = ')]}\'\n[[null,[["g1",["A","x","","2026-01-05"],3,null,["T",["body"],null,[null],null],null],["g2",["B","x","","Jan 4, 2026"],5,null,["",[""],null],null]]],null,[]]'
    pages = spark.createDataFrame([("com.x", "en_US", 0, body)], "package string, lang string, page int, body string")
    out = {r.review_id: r for r in feeds.parse_play_pages(pages).collect()}
    assert out["g1"].content_original == "T\nbody" and out["g2"].content_original == "（无正文）"
    assert str(out["g2"].published_at) == "2026-01-04 00:00:00" and out["g2"].rating == 5


def test_social_posts(spark):
    body = '[{"id":"7","text":" hello ","author":"a","created_at":"2026-01-01T00:00:00Z"},{"id":"8","text":" "}]'
    out = feeds.parse_social_posts(spark.createDataFrame([(body,)], "body string"), "x").collect()
    assert [(r.review_id, r.content_original, r.rating, r.platform) for r in out] == [("x-7", "hello", 3, "social")]


def test_stage_write_is_repeatable_and_skips_done_work(spark, tmp_path):
    path, manifest = str(tmp_path / "stage"), str(tmp_path / "manifest")
    work = spark.createDataFrame([("r1", "clean", -1, "a"), ("r2", "clean", -1, "b")], "run_id string, stage string, batch_index int, v string")
    first = work.where("run_id = 'r1'")
    for _ in range(2):
        sinks.write_stage(first, first, path, manifest)
    assert sinks.read_stages(spark, path, manifest).count() == 1
    assert [r.run_id for r in sinks.pending(work, manifest).collect()] == ["r2"]
    sinks.write_stage(work.where("false"), work.where("run_id = 'r2'"), path, manifest)  # a stage without rows is done as well
    assert sinks.pending(work, manifest).count() == 0 and sinks.read_stages(spark, path, manifest).count() == 1


def test_logs(spark, tmp_path):
    rows = spark.createDataFrame([("r", "plan", -1, '{"requirements":[{"requirement_id":"REQ-001","finding_ids":["F-001"]}]}'), ("r", "plan", -1, "{}")],
                                 "run_id string, stage string, batch_index int, payload string")
    good, bad = logs.read_stage_outputs(rows, "plan")
    assert good.count() == 1 and bad.count() == 1
    (tmp_path / "h.json").write_text('{\n"prompt_fingerprint": "f", "dataset": "d", "summary": {"cases": 30, "topic_recall": 0.033, "stability": null}\n}')
    got = {(r.file, r.metric): r.value for r in logs.read_eval_history(spark, str(tmp_path)).collect()}
    assert got == {("h.json", "cases"): 30.0, ("h.json", "topic_recall"): 0.033}
    (tmp_path / "e.jsonl").write_text('{"run_id":"a","step":1,"kind":"plan","message":"m","payload":{"k":"v"},"created_at":"2026-01-01T00:00:00Z"}\n')
    assert logs.read_agent_events(spark, str(tmp_path / "e.jsonl")).first().payload == {"k": "v"}


def test_export_csv(spark, tmp_path):
    out = str(tmp_path / "x")
    sinks.export_csv(spark.createDataFrame([("a", ["r1", "r2"])], "id string, ids array<string>"), out)
    assert spark.read.csv(out, header=True, escape='"').collect() == [("a", '["r1","r2"]')]
    log = str(tmp_path / "log")
    for i in range(2):
        sinks.append_log(spark.createDataFrame([(i,)], "i int"), log)
    assert spark.read.parquet(log).count() == 2
