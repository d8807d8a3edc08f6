import json

from pyspark.sql import functions as F

from leaklens.operators import diff, locate
from leaklens.sources import readers
from leaklens.streaming import runner


def test_stream_equals_batch(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for k in range(5):
        (src / f"req{k}.diff").write_text(f"diff --git a/x b/x\n+++ b/x\n@@ -0,0 +1,2 @@\n+ok\n+password = topsecret{k}\n")
    q = runner.start_scan(spark, str(src), str(tmp_path / "out"), str(tmp_path / "ck"), max_files=2)
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch_id")
    want = runner.scan_batch(readers.read_diffs(spark, str(src)))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 5
    assert not got.where("match_preview LIKE '%topsecret%'").count()


def test_scanner_output_is_ingested(spark):
    lines = ["noise", "", json.dumps({"DetectorName": "AWS", "Raw": "needle-one", "Verified": True}), json.dumps({"RawV2": "needle-two"}), json.dumps({"Raw": ""}), "{broken"]
    t = readers.trufflehog_findings(spark.createDataFrame([("r", x) for x in lines], "request_id string, value string"))
    assert sorted((r.needle, r.rule, r.verified) for r in t.collect()) == [("needle-one", "AWS", True), ("needle-two", "", False)]
    k = readers.kingfisher_findings(spark.createDataFrame([("r", json.dumps({"rule": "id", "rule_name": "Name", "secret": "needle-one", "path": "f", "line": 3})), ("r", json.dumps({"rule": "id", "match": "m", "path": "f"}))], "request_id string, value string"))
    assert sorted((r.needle, r.rule, r.given_line) for r in k.collect()) == [("m", "id", None), ("needle-one", "Name", 3)]
    added = spark.createDataFrame([("r", 1, "f", 7, "x needle-one y")], "request_id string, ord int, path string, line int, text string")
    assert {r.needle: r.line for r in locate.locate(t, added).collect()} == {"needle-one": 7, "needle-two": 0}


def test_rules_and_corpus_files(spark, tmp_path):
    (tmp_path / "rules.toml").write_text('[[rules]]\nid = "k"\nregex = \'\'\'(?i)key=([^\\s]{3,})\'\'\'\nsecretGroup = 1\nkeywords = ["key"]\n')
    rule = readers.read_rules(str(tmp_path / "rules.toml"))[0]
    assert (rule.id, rule.group, rule.keywords) == ("k", 1, ["key"]) and rule.pattern.startswith("(?iu)")
    (tmp_path / "a_positive.diff").write_text("diff --git a/x b/x\n+++ b/x\n@@ -0,0 +1 @@\n+v\n")
    (tmp_path / "a_positive.expect.json").write_text(json.dumps({"tags": ["positive"], "pair": "a", "expect_secrets": [{"file": "x", "line": 1, "kind": "credential", "value": "v"}]}))
    row = readers.read_corpus(spark, str(tmp_path)).first()
    assert row.name == "a_positive" and row.strict and row.expectation.expect_secrets[0].line == 1
    assert diff.added_lines(diff.diff_lines(spark.createDataFrame([("r", row["diff"])], "request_id string, diff string"))).first().text == "v"


def test_bad_requests_are_rows(spark):
    df = spark.createDataFrame([("a", "", False), ("b", "x" * 50, False), ("c", "fine", False)], "request_id string, diff string, deep boolean")
    ok, bad = readers.accept(df, readers.Config(max_body_bytes=20))
    assert [r.request_id for r in ok.collect()] == ["c"] and {r.request_id: r.error for r in bad.collect()} == {"a": "empty diff", "b": "body too large"}


def test_event_rates_run_on_a_stream(spark, tmp_path):
    src = str(tmp_path / "ev")
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(src)
    stream = spark.readStream.schema(events.schema).parquet(src)
    q = runner.event_rates(stream).writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = runner.event_rates(events)
    assert spark.table("rates").agg(F.sum("n")).first()[0] == want.agg(F.sum("n")).first()[0] == events.count()
