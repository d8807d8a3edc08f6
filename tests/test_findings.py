import itertools

from pyspark.sql import functions as F

from leaklens.functions import predicates as P
from leaklens.functions import text as T
from leaklens.operators import adjudicate, detect, grounding, locate, packing

FIND = "request_id string, detector_type string, detector_name string, rule string, path string, line int, match string, verified boolean"


def value(spark, column, v):
    return spark.createDataFrame([(v,)], "v string").select(column(F.col("v")).alias("x")).first().x


def test_dedup_is_the_same_for_every_order(spark):
    rows = [("r", "t", n, "k", "f", 1, m, v) for n, m, v in [("a", "x", False), ("b", "x", True), ("a", "y", False), ("a", "x", False)]]
    seen = set()
    for order in itertools.permutations(rows):
        got = detect.dedup(spark.createDataFrame(list(order), FIND)).orderBy("id").collect()
        seen.add(str([(r.id, r.any_verified, r.detections) for r in got]))
        if len(seen) > 1:
            break
    assert len(seen) == 1 and "b" in seen.pop()


def test_previews_never_show_the_secret(spark):
    for raw in ["hunter2", "abcdefgh", "abcdefghijkl", "postgres://user:longpassword@host/db", "root:longpassword@tcp(h)/db"]:
        shown = value(spark, T.preview, raw)
        assert raw not in shown and "longpassword" not in shown
    assert value(spark, T.preview, "abcdefghijkl") == "abcd****ijkl"
    assert value(spark, T.preview, "") == ""
    assert value(spark, T.preview, "パスワード秘密") is not None


def test_scrub_masks_components(spark):
    df = spark.createDataFrame([("the password longpw of bob in postgres://bob:longpw@h/d", "postgres://bob:longpw@h/d")], "t string, s string")
    out = df.select(T.scrub(F.col("t"), F.col("s")).alias("x")).first().x
    assert "longpw" not in out and "bob" not in out


def test_predicates(spark):
    assert value(spark, P.is_reference, 'os.Getenv("X")') and not value(spark, P.is_reference, "hunter2")
    assert value(spark, P.is_placeholder, "zzzz") and not value(spark, P.is_placeholder, "zzz")
    assert value(spark, P.is_placeholder, "postgres://u:test@h/d") and not value(spark, P.is_placeholder, "postgres://u:pw1@example.com/d")
    assert value(spark, P.is_formatting_text, "a\\nb") and not value(spark, P.is_formatting_text, "-----BEGIN X\\n")
    assert value(spark, P.normalized, " 'abc'; ") == "abc"
    assert value(spark, P.pem_header, "a\n -----BEGIN EC PRIVATE KEY----- \n") == "-----BEGIN EC PRIVATE KEY-----"


def test_key_shape_allowlist_reads_the_key_only(spark):
    lines = spark.createDataFrame([("r", "f", 1, "DB_PASSWORD_FILE=/run/secret1"), ("r", "f", 2, "password = /path/file1"), ("r", "f", 3, "no match here")], "request_id string, path string, line int, text string")
    assert [r.line for r in detect.rule_findings(lines).collect()] == [2]


def test_gap_fill_takes_the_last_verdict_and_its_faults(spark):
    f = spark.createDataFrame([("r", "a"), ("r", "b"), ("r", "c")], "request_id string, id string")
    v = spark.createDataFrame([("r", "a", "dismissed", 0.1, "x", 1), ("r", "a", "confirmed", 0.9, "y", 2), ("r", "b", "confirmed", 0.9, "z", 1), ("r", "b", "maybe", 0.9, "z", 2)], "request_id string, finding_id string, verdict string, confidence double, reason string, ord long")
    assert {r.id: (r.verdict, r.confidence) for r in locate.fill_gaps(f, v).collect()} == {"a": ("confirmed", 0.9), "b": ("unreviewed", 0.0), "c": ("unreviewed", 0.0)}


def test_truncated_findings_are_confirmed_for_parity_or_unreviewed(spark):
    f = spark.createDataFrame([("r", f"id{k}", "f", k, f"m{k}", [], False, "") for k in range(4)], "request_id string, id string, path string, line int, match string, detections array<string>, any_verified boolean, context string")
    for flag, want in (("compat_confirmed", "confirmed"), ("unreviewed", "unreviewed")):
        out = adjudicate.adjudicate(f, lambda p: "[]", max_findings=2, on_truncate=flag)
        assert {r.id: r.verdict for r in out.collect()} == {"id0": "unreviewed", "id1": "unreviewed", "id2": want, "id3": want}


def test_parse_shapes(spark):
    one = '{"finding_id": "a", "verdict": "confirmed", "confidence": 1, "reason": "r"}'
    rows = [("r", 0, f"[{one}]"), ("r", 1, f'{{"verdicts": [{one}, {one}]}}'), ("r", 2, f"```json\n[{one}]\n```"), ("r", 3, "no"), ("r", 4, "")]
    got = adjudicate.parse_verdicts(spark.createDataFrame(rows, "request_id string, batch_id int, answer string"))
    assert sorted((r.batch_id, r.finding_id or "", r.error) for r in got.collect()) == [(0, "a", False), (1, "a", False), (1, "a", False), (2, "a", False), (3, "", True), (4, "", True)]
    assert got.where("error").count() == 2 and got.where("NOT error").count() == 4
    none = adjudicate.parse_candidates(spark.createDataFrame([("r", 0, "")], "request_id string, batch_id int, answer string"))
    assert none.where("error").count() == 0


def test_greedy_batches_stay_in_budget_and_keep_all(spark):
    f = spark.range(300).select(F.lit("r").alias("request_id"), F.lpad(F.col("id").cast("string"), 12, "0").alias("id"), F.lit("f").alias("path"), F.col("id").cast("int").alias("line"), F.repeat(F.lit("m"), (F.col("id") % 40).cast("int")).alias("match"), F.lit("c").alias("context"))
    out = packing.pack_findings(f, 400, 100, 5).collect()
    assert len(out) == 300
    by = {}
    for r in out:
        by.setdefault(r.batch_id, []).append(r.tokens)
    assert all(len(v) <= 5 and (sum(v) <= 270 or len(v) == 1) for v in by.values()) and sorted(by) == list(range(len(by)))


def test_windows_hold_one_file_each_and_every_line(spark):
    blocks = [("r", 1, "a", "\n".join(f"line {k}" for k in range(400))), ("r", 2, "a", "x"), ("r", 3, "b", "y"), ("r", 4, "a", "z"), ("s", 1, "b", "")]
    got = packing.deep_windows(spark.createDataFrame(blocks, "request_id string, blk int, path string, content string"), 256).orderBy("request_id", "window_ix").collect()
    ws = [r.window for r in got if r.request_id == "r"]
    assert [r.window_ix for r in got if r.request_id == "r"] == list(range(len(ws)))
    assert sum(w.count("line ") for w in ws) == 400 and ws[-3].endswith("=== a\nx\n") and ws[-2:] == ["=== b\ny\n", "=== a\nz\n"]
    assert all(-(-len(w.encode()) // 3) <= 256 + 2 for w in ws) and [r.window for r in got if r.request_id == "s"] == ["=== b\n\n"]
    few = packing.deep_windows(spark.createDataFrame(blocks, "request_id string, blk int, path string, content string"), 256, most=2).collect()
    assert {r.request_id: r.truncated for r in few} == {"r": True, "s": False} and len(few) == 3


def test_grounding_outcomes(spark):
    lines = spark.createDataFrame([("r", 1, "f", 1, 'password = "s3cretvalue"'), ("r", 2, "f", 2, "token = $RUNTIMEVALUE and more"), ("r", 3, "f", 3, "call(otherthing)")], "request_id string, ord int, path string, line int, text string")
    findings = spark.createDataFrame([("r", "f", 3, "otherthing")], "request_id string, path string, line int, match string")
    claims = ["s3cretvalue", "s3cretvalue", "RUNTIMEVALUE", "otherthing", "not in there", "changeme", "short", 'password = "s3cretvalue"', "DB_USER=s3cretvalue", "$X", "a\\nbcdef"]
    c = spark.createDataFrame([("r", k, v, "credential", 0.5, "") for k, v in enumerate(claims)] + [("r", 90, "x", "test_data", 0.5, "")], "request_id string, cand_ix int, value string, kind string, confidence double, reason string")
    got = {r.cand_ix: r.outcome for r in grounding.ground(c, lines, findings).collect()}
    assert got == {0: "discovered", 1: "duplicate", 2: "reference", 3: "detector_overlap", 4: "not_found", 5: "placeholder", 6: "invalid_or_reference", 7: "duplicate", 8: "non_secret_assignment", 9: "invalid_or_reference", 10: "formatting_text", 90: "test_data"}


def test_locate_prefers_diff_order_and_falls_back(spark):
    lines = spark.createDataFrame([("r", 1, "z", 5, "has needle1 here"), ("r", 2, "a", 1, "needle1 again")], "request_id string, ord int, path string, line int, text string")
    n = spark.createDataFrame([("r", 1, "needle1"), ("r", 2, '"needle1";'), ("r", 3, "nowhere"), ("r", 4, "")], "request_id string, needle_id int, needle string")
    assert {r.needle_id: (r.path, r.line, r.found) for r in locate.locate_with_fallback(n, lines).collect()} == {1: ("z", 5, "needle1"), 2: ("z", 5, "needle1"), 3: ("", 0, ""), 4: ("", 0, "")}


def test_a_keyword_gates_the_pattern(spark):
    lines = spark.createDataFrame([("r", "f", 1, "access-key: abcdef123456"), ("r", "f", 2, "access_key: abcdef123456")], "request_id string, path string, line int, text string")
    assert [r.line for r in detect.rule_findings(lines).collect()] == [2]
    assert sorted(r.line for r in detect.raw_matches(lines, detect.GENERIC, prefilter=False).collect()) == [1, 2]


def test_another_secret_on_a_known_line_is_new(spark):
    rows = [("r", "t", "d", "k", "f", 1, m, False) for m in ("old", "new")]
    known = spark.createDataFrame([("f", 1, "k", "old")], "path string, line int, rule string, match string")
    assert [r.match for r in detect.subtract_baseline(spark.createDataFrame(rows, FIND), known).collect()] == ["new"]


def outcome(spark, value, text, kind="credential"):
    lines = spark.createDataFrame([("r", 1, "f", 1, text)], "request_id string, ord int, path string, line int, text string")
    claim = spark.createDataFrame([("r", 1, value, kind, 0.5, "")], "request_id string, cand_ix int, value string, kind string, confidence double, reason string")
    none = spark.createDataFrame([], "request_id string, path string, line int, match string")
    return grounding.ground(claim, lines, none).first().outcome


def test_call_shaped_claims_need_a_whole_literal(spark):
    assert outcome(spark, "process.env.SECRET_KEY", 'x = "process.env.SECRET_KEY"') == "invalid_or_reference"
    assert outcome(spark, "getPass(now)", "x = `getPass(now)`") == "invalid_or_reference"
    assert outcome(spark, "load(abc)", 'x = "u:load(abc)@h {"') == "invalid_or_reference"
    assert outcome(spark, "-----BEGIN PUBLIC KEY-----", "-----BEGIN PUBLIC KEY-----") == "invalid_or_reference"
    assert outcome(spark, "getPass(now)", "x = 'getPass(now)'") == "discovered"
    assert outcome(spark, "getPass(now)", "getPass(now); x = 'getPass(now)'") == "invalid_or_reference"
    assert outcome(spark, "load(abc)", 'x = "root:load(abc)@tcp(h)"') == "discovered"
    assert outcome(spark, "load(abc)", 'x = ":load(abc)@h"') == "invalid_or_reference"
    assert outcome(spark, "-----BEGIN EC PRIVATE KEY-----\nabc", "-----BEGIN EC PRIVATE KEY-----", "private_key") == "discovered"


def literal_holds(value, line):
    """Quoted literals one by one, character by character."""
    at, first = 0, line.find(value)
    while at < len(line):
        if line[at] in "\"'":
            stop = at + 1
            while stop < len(line) and line[stop] != line[at]:
                stop += 2 if line[stop] == "\\" else 1
            if stop >= len(line):
                return False
            literal = line[at + 1 : stop]
            if at + 1 <= first and first + len(value) <= stop and not set(literal) & set("$\\{}") and (literal == value or literal.find(f":{value}@") > 0):
                return True
            at = stop
        at += 1
    return False


def dollars_only(value, line):
    places = [k for k in range(len(line)) if line.startswith(value, k)]
    return bool(places) and all(line[:k].endswith(("$", "${")) for k in places)


def test_literals_and_references_equal_a_plain_scan(spark):
    import random

    r = random.Random(8)
    parts = ['"', '"', "'", "\\", "$", "${", "}", "u:", "@", "f(x)", '"f(x)"', ":f(x)@", " ", "aa", "`"]
    rows = [("".join(r.choice(parts) for _ in range(r.randint(1, 8))), r.choice(["f(x)", "f(x)f(x)", "aa", "a"])) for _ in range(4000)]
    df = spark.createDataFrame(rows, "line string, value string").select("line", "value", grounding.quoted_whole(F.col("value"), F.col("line")).alias("q"), grounding.only_in_reference(F.col("value"), F.col("line")).alias("d"))
    got = df.collect()
    assert [x.d for x in got] == [dollars_only(x.value, x.line) for x in got]
    assert [x.q for x in got] == [x.value[0] == "f" and x.value in x.line and literal_holds(x.value, x.line) for x in got]
    assert sum(x.q for x in got) > 10 and sum(x.d for x in got) > 10


def test_ranks_are_those_of_a_sorted_list(spark):
    from leaklens.operators import stats

    xs = [5.0, 1.0, 1.0, 3.0, 2.0, 2.0, 2.0, 9.0]
    df = spark.createDataFrame([("a", x) for x in xs] + [("b", 4.0), ("b", None)], "g string, v double")
    low, high = stats.middles()
    got = {x.g: x for x in stats.ranked(df, "v", "g", {"p95": stats.nearest(0.95), "low": low, "high": high, "m": stats.bench_median(), "b": stats.bench_p95()}).collect()}
    ys = sorted(xs)
    assert (got["a"].n, got["a"].p95, got["a"].low, got["a"].high, got["a"].m, got["a"].b) == (8, 9.0, ys[3], ys[4], ys[4], ys[7])
    assert (got["b"].n, got["b"].m, got["b"].b) == (1, 4.0, 4.0)
