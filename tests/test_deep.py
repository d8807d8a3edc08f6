import json

import pytest
from pyspark.sql import functions as F

from leaklens.functions import constants as C
from leaklens.operators import adjudicate, deep, detect, diff, evaluation, response
from leaklens.sources import readers

DIFF = 'diff --git a/x b/x\n+++ b/x\n@@ -0,0 +1,3 @@\n+password = "s3cret\\\\value9"\n+show("a\\tb")\n+other = \'plain\'\n'
NONE = "request_id string, path string, line int, match string"


def plain_literals(window):
    """Character by character, with the limits."""
    out, line_values = [], []
    for line in window.split("\n"):
        if line.startswith(C.WINDOW_HEADER):
            continue
        at = 0
        while at < len(line):
            if line[at] not in "'\"":
                at += 1
                continue
            stop = at + 1
            while stop < len(line) and line[stop] != line[at]:
                stop += 2 if line[stop] == "\\" else 1
            if stop < len(line):
                line_values.append(line[at + 1 : stop])
            at = stop + 1
    for v in line_values:
        if "\\" not in v or len(v.encode()) > 512 or v in out or any(m in v for m in ("\\n", "\\r", "\\t")) or v.startswith("$") or "${" in v:
            continue
        entries = [{"id": f"literal_{k + 1}", "value": x} for k, x in enumerate([*out, v])]
        text = json.dumps(entries, separators=(",", ":"), ensure_ascii=False)
        if len(text.encode()) + 5 * sum(c in "<>&" for c in text) <= 4096 and len(out) < 32:
            out.append(v)
    return [(f"literal_{k + 1}", v) for k, v in enumerate(out)]


def test_literals_equal_a_plain_scan(spark):
    import random

    r = random.Random(3)
    parts = ['"', '"', "'", "\\", "\\\\", "a", "bc ", "\n", "$", "é", "<&>", "=== ", "x" * 90, "\\x41"]
    windows = ["".join(r.choice(parts) for _ in range(r.randint(1, 60))) for _ in range(300)] + [" ".join(f"'k{k}\\x{'y' * (k * 9)}'" for k in range(60))]
    df = spark.createDataFrame([(str(k), 0, w) for k, w in enumerate(windows)], "request_id string, window_ix int, window string")
    got = {}
    for x in deep.source_literals(df).collect():
        got.setdefault(x.request_id, []).append((x.source_id, x.value))
    assert {k: sorted(v) for k, v in got.items()} == {str(k): sorted(plain_literals(w)) for k, w in enumerate(windows) if plain_literals(w)}


def scan(spark, scorer, text=DIFF, taken=(), **kw):
    requests = spark.createDataFrame([("r", text), ("empty", "")], "request_id string, diff string")
    trace, status = deep.deep_scan(requests, spark.createDataFrame(list(taken), NONE), scorer, **kw)
    return [(x.outcome, x.path, x.line, x.match) for x in trace.orderBy("cand_ix").collect()], {x.request_id: x for x in status.collect()}


def answer(*candidates):
    return json.dumps({"candidates": [{"kind": "credential", "confidence": 0.5, "reason": "r", **c} for c in candidates]})


def test_a_named_literal_is_resolved_and_grounded(spark):
    said = answer({"source_id": "literal_1"}, {"value": "nowhere-at-all", "kind": "test_data"})  # workers do not know this module
    trace, status = scan(spark, lambda prompt: said if "literal_1" in prompt else "")
    assert trace == [("discovered", "x", 1, "s3cret\\\\value9"), ("test_data", "", 0, "")]
    assert (status["r"].status, status["r"].windows, status["r"].calls, status["r"].discovered) == ("complete", 1, 1, 1) and status["empty"].status == "complete"


@pytest.mark.parametrize("bad", [{"source_id": "literal_9"}, {"source_id": "literal_1", "value": "another"}, {"value": "not in the source"}])
def test_a_conflicting_answer_fails_whole(spark, bad):
    said = answer({"source_id": "literal_1"}, bad)
    trace, status = scan(spark, lambda prompt: said)
    assert trace == [] and status["r"].status == "failed"


def test_retries_and_refusals(spark):
    said, note = answer({"source_id": "literal_1"}), C.RECOVERY_PREFIX

    def moody(prompt):
        return said if note in prompt else "not json"

    trace, status = scan(spark, moody)
    assert len(trace) == 1 and status["r"].calls == 2 and status["r"].status == "complete"
    for finish, calls in (("length", 2), ("content_filter", 1)):
        trace, status = scan(spark, lambda prompt, f=finish: (said, f))
        assert trace == [] and status["r"].calls == calls

    def broken(prompt):
        raise OSError("down")

    assert scan(spark, broken)[1]["r"].status == "failed"


def test_requests_that_are_not_read(spark):
    said = answer({"source_id": "literal_1"})
    for limit in ({"require_findings": True}, {"max_added_lines": 2}, {"sample_rate": 1e-9}):
        trace, status = scan(spark, lambda prompt: said, **limit)
        assert trace == [] and (status["r"].status, status["r"].reason) == ("skipped", next(iter(limit)))


def test_discoveries_are_reviewed_as_findings(spark):
    found = spark.createDataFrame([("r", f"id{k}" + "0" * 9, "x", 1, f"value{k}x", "credential", 0.4, "maybe") for k in range(3)], "request_id string, id string, path string, line int, match string, kind string, confidence double, reason string")
    image = diff.post_image(diff.diff_lines(spark.createDataFrame([("r", DIFF)], "request_id string, diff string")))

    def judge(prompt):
        verdicts = {"id0": "confirmed", "id1": "dismissed"}
        return json.dumps([{"finding_id": k + "0" * 9, "verdict": v, "confidence": 0.9, "reason": "sure"} for k, v in verdicts.items() if k in prompt])

    got = {x.id[:3]: (x.outcome, x.confidence) for x in deep.reviewed(found, image, judge).collect()}
    assert got == {"id0": ("confirmed", 0.9), "id1": ("dismissed", 0.4), "id2": ("withheld", 0.4)}


def test_responses_audits_and_counts(spark):
    requests = spark.createDataFrame([("r", "some diff"), ("s", "é")], "request_id string, diff string")
    rows = [("r", "i1", "f", 2, "longsecretvalue", "confirmed", 0.9, "longsecretvalue it is", [("t", "d", "k", True)]), ("r", "i2", "f", 1, "hunter2", "unreviewed", 0.0, C.GAP_REASON, [])]
    v = spark.createDataFrame(rows, "request_id string, id string, path string, line int, match string, verdict string, confidence double, reason string, detections array<struct<detector_type:string,detector_name:string,rule:string,verified:boolean>>")
    d = spark.createDataFrame([("r", "i3", "g", 1, "anothersecret1", "credential", 0.7, "why")], "request_id string, id string, path string, line int, match string, kind string, confidence double, reason string")
    counts = requests.select("request_id", F.lit(2).alias("raw_findings"), F.lit(1).alias("confirmed"))
    out = response.responses(requests, v, d, counts)
    body = {x.request_id: json.loads(x.body) for x in response.response_json(out).collect()}
    assert [x["id"] for x in body["r"]["verdicts"]] == ["i2", "i1"] and body["s"]["verdicts"] == [] and "discoveries" not in body["s"]
    assert body["r"]["verdicts"][1]["detections"][0]["verified"] is True and body["r"]["stats"]["raw_findings"] == 2
    assert "longsecretvalue" not in json.dumps(body) and "anothersecret1" not in json.dumps(body)
    assert {x.request_id: x.alerts for x in response.alert_count(out).collect()} == {"r": 2, "s": 0}
    hidden, shown = (response.audit_entries(out, requests, v, d, reveal).where("request_id = 'r'").first() for reveal in (False, True))
    assert hidden.diff_bytes == 9 and hidden.detectors_named == ["d"] and "match" not in hidden.verdicts[0].asDict()
    assert [x.match for x in shown.verdicts] == ["hunter2", "longsecretvalue"] and shown.discoveries[0].match == "anothersecret1"
    errors = spark.createDataFrame([("r", "d", "boom")], "request_id string, detector string, error string")
    got = {(x.counter, x.label): x.n for x in response.counters(v.withColumn("detector_name", F.lit("d")), errors, v).collect()}
    assert got == {("findings", "d"): 2, ("errors", "d"): 1, ("verdicts", "confirmed"): 1, ("verdicts", "unreviewed"): 1, ("missing", ""): 1}


def test_previews_and_statuses(spark):
    rows = [("abcd****wxyz", "abcd123wxyz", True), ("abcd****wxyz", "abcd123wxy", False), ("****", "x", True), ("****", "", False), ("same", "same", True), ("same", "other", False)]
    df = spark.createDataFrame(rows, "p string, raw string, want boolean")
    assert df.where(response.preview_matches(F.col("p"), F.col("raw")) != F.col("want")).count() == 0
    errors = spark.createDataFrame([(None, 200), ("body too large", 413), ("queue full", 429), ("deadline exceeded", 504), ("invalid JSON body", 400), ("model 500", 502)], "e string, want int")
    assert errors.where(response.status_of(F.col("e")) != F.col("want")).count() == 0
    mark = spark.range(1).select(adjudicate.fingerprint(F.lit("p"), F.lit("a"), F.lit("b")).alias("x")).first().x
    import hashlib

    assert mark == "p:" + hashlib.sha256(b"a\0b").hexdigest()[:12]


def test_requests_are_decoded(spark):
    rows = [
        ("ok-1", "application/json; charset=utf-8", "", '{"diff": "d", "deep": true}'), ("bad id!", "text/plain", "a=1&deep=1", "raw"), ("ok-2", None, None, "x"), ("e1", "application/json", "", "{"), ("e2", "application/json", "", '{"deep": true}'),
        ("e3", "image/png", "", "x"), ("e4", "TEXT/X-DIFF", "", ""), ("e5", "text/plain", "", "y" * 200),
    ]
    good, bad = readers.decode(spark.createDataFrame(rows, "given_id string, content_type string, query string, body string"), 100)
    got = {x.diff: (x.request_id, x.deep) for x in good.collect()}
    assert got["d"] == ("ok-1", True) and got["x"] == ("ok-2", False) and got["raw"][1] and len(got["raw"][0]) == 26
    assert {x.request_id: x.error for x in bad.collect()} == {"e1": "invalid JSON body", "e2": "missing diff field", "e3": "unsupported content-type: image/png", "e4": "empty body", "e5": "body too large"}


def test_block_rules_and_capture_lines(spark):
    rules = [detect.Rule("pem", r"-----BEGIN KEY-----\n([a-z\n]+)-----END KEY-----", 1), detect.Rule(C.KUBERNETES_RULE_ID, r"kind: Secret\n(?:.*\n)*?data:\n +([a-z]+: .*)", 1), detect.Rule("pair", r"key=\s*(v[0-9])", 1)]
    content = "one\n-----BEGIN KEY-----\nabc\ndef\n-----END KEY-----\nkey=v1 key=\nv2\nkind: Secret\nname: n\ndata:\n  password: 'topsecret'\nend"
    blocks = spark.createDataFrame([("r", "f", 10, content)], "request_id string, path string, start_line int, content string")
    got = sorted((x.rule, x.line, x.match) for x in detect.block_findings(blocks, rules).collect())
    assert got == [(C.KUBERNETES_RULE_ID, 20, "topsecret"), ("pair", 15, "v1"), ("pair", 16, "v2"), ("pem", 12, "abc\ndef\n")]
    kept = ["password: 'a", "nocolon", "k: ", "k:v1\nmore", 'k: "q"', "k: it's"]
    df = spark.createDataFrame([(k,) for k in kept], "c string")
    assert [x.s for x in df.select(detect.yaml_scalar(F.col("c")).alias("s")).collect()] == ["'a", "nocolon", "k: ", "k:v1\nmore", "q", "it's"]


def record(name, run, calls, **more):
    base = {"name": name, "run": run, "set": "s", "thinking": False, "latency_ms": 10.0 * run, "diff_sha256": "a", "expectation_sha256": "b", "model": "m", "prompt": "p", "prompt_deep": "q", "http_status": 200, "response": {"stats": {}}, "calls": calls}
    return json.dumps(base | more)


def model_call(stage, text, finish="stop", ms=5.0, error=None, note=False, **kwargs):
    messages = [{"role": "user", "content": text}] + ([{"role": "user", "content": C.RECOVERY_NOTE}] if note else [])
    request = {"messages": messages} | ({"chat_template_kwargs": kwargs} if kwargs else {})
    return {"stage": stage, "latency_ms": ms, "request": request, "error": error, "response": {"choices": [{"finish_reason": finish, "message": {"reasoning": "hm" if kwargs else ""}}], "usage": {"prompt_tokens": 3, "completion_tokens": 2, "total_tokens": 5}}}


def test_runs_are_summed_up_and_compared(spark, tmp_path):
    left = [record("a", 1, [model_call("judge", "x", enable_thinking=True), model_call("judge", "x", "length", 9.0, note=True)]), record("b", 1, [model_call("deep", "y", ms=1.0, error="lost")], http_status=500), record("c", 1, None)]
    right = [record("a", 1, [model_call("judge", "x", enable_thinking=False)]), record("b", 1, [model_call("deep", "z"), model_call("deep", "w")]), record("d", 1, [])]
    for name, lines in (("l", left), ("r", right)):
        (tmp_path / f"{name}.jsonl").write_text("\n".join(lines) + "\n\n")
    a, b = (evaluation.read_records(spark, str(tmp_path / f"{name}.jsonl")) for name in "lr")
    stages = {x.stage: x for x in evaluation.totals_by_stage(a).collect()}
    assert (stages["judge"].calls, stages["judge"].median, stages["judge"].p95, stages["judge"].total_tokens, stages["judge"].finish_reasons) == (2, 7.0, 9.0, 10, {"stop": 1, "length": 1})
    assert stages["deep"].transport_errors == 1
    outcomes = spark.createDataFrame([("a", True, 2, 2), ("b", True, 1, 2), ("c", False, None, None)], "name string, passed boolean, hits int, total int")
    s = evaluation.summary(a, outcomes).first()
    assert (s.cases, s.cases_passed, s.failed_cases, s.requests, s.model_calls, s.recovery_calls, s.calls_with_reasoning, s.http_errors) == (3, 1, ["b", "c"], 3, 3, 1, 1, 1)
    assert (s.request_median, s.call_longest, s.total_tokens, s.model) == (10.0, 9.0, 15, ["m"])
    with pytest.raises(Exception, match="disagree"):
        evaluation.summary(a, outcomes.where("name <> 'c'")).collect()
    got = sorted((x.name, x.call, x.issue) for x in evaluation.compare_runs(a, b).collect())
    assert got == [("b", None, "call_count"), ("c", None, "only_left"), ("d", None, "only_right")]
    again = evaluation.compare_runs(a, a.withColumn("calls", F.transform("calls", lambda c: c.withField("request", F.replace(c["request"], F.lit('"y"'), F.lit('"Y"'))))))
    assert [(x.name, x.call, x.issue) for x in again.collect()] == [("b", 1, "request")]
