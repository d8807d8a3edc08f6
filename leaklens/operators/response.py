"""Responses, errors and audit entries as relations of a fixed shape, one row per request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import preview, scrub

VERDICT = ["id", "file", "line", "match_preview", "verdict", "confidence", "reason", "detections"]
DISCOVERY = ["id", "file", "line", "match_preview", "kind", "confidence", "reason"]


def _listed(rows: DataFrame, fields: list[Column], name: str) -> DataFrame:
    """request_id and an array of structs in order of place; a request's rows are bounded by its limit of findings."""
    order = F.struct("path", "line", "match")
    return rows.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.struct(*fields).alias("v"))))["v"].alias(name))


def _shown(*more: str) -> list[Column]:
    return [F.col("id"), F.col("path").alias("file"), F.col("line").cast("int").alias("line"), preview(F.col("match")).alias("match_preview"), *[F.col(c) for c in more]]


def responses(requests: DataFrame, verdicts: DataFrame, discoveries: DataFrame, counts: DataFrame) -> DataFrame:
    """request_id, verdicts, discoveries, stats: what each request is answered with. Raw matches do not leave, reasons are scrubbed.

    verdicts: all findings with verdict, confidence, reason, detections; counts: one row per request (see ``stats``).
    """
    clean = verdicts.withColumn("reason", scrub(F.col("reason"), F.col("match")))
    seen = discoveries.withColumn("reason", scrub(F.col("reason"), F.col("match")))
    v = _listed(clean, _shown("verdict", "confidence", "reason", "detections"), "verdicts")
    d = _listed(seen, _shown("kind", "confidence", "reason"), "discoveries")
    s = counts.select("request_id", F.struct(*[c for c in counts.columns if c != "request_id"]).alias("stats"))
    out = requests.select("request_id").join(v, "request_id", "left").join(d, "request_id", "left").join(s, "request_id", "left")
    return out.select("request_id", F.coalesce("verdicts", F.array().cast(v.schema["verdicts"].dataType)).alias("verdicts"), "discoveries", "stats")


def response_json(responses_: DataFrame) -> DataFrame:
    """request_id, status, body: a null list of discoveries is left out, an empty list of verdicts is not."""
    return responses_.select("request_id", F.lit(200).alias("status"), F.to_json(F.struct("request_id", "verdicts", "discoveries", "stats")).alias("body"))


def error_json(errors: DataFrame) -> DataFrame:
    """The same for refused requests (request_id, status, error)."""
    return errors.select("request_id", "status", F.to_json(F.struct("error")).alias("body"))


def status_of(error: Column) -> Column:
    """What a failure is answered with: 400 for a bad request, 413 for its size, 429 for a full queue, 504 for a deadline, else 502."""
    low = F.lower(error)
    return (
        F.when(error.isNull(), 200).when(F.contains(low, F.lit("too large")), 413).when(low.rlike(r"queue|busy"), 429).when(low.rlike(r"deadline|timeout|timed out"), 504)
        .when(low.rlike(r"invalid|missing|empty|unsupported"), 400).otherwise(502)
    )


def audit_entries(responses_: DataFrame, requests: DataFrame, findings: DataFrame, discoveries: DataFrame, reveal: bool = False) -> DataFrame:
    """One entry per response, with the raw match of each verdict and discovery only on request."""
    r = requests.select("request_id", F.octet_length("diff").alias("diff_bytes"), *[F.col(c) for c in ("remote_addr", "timestamp") if c in requests.columns])
    base = responses_.join(r, "request_id")
    if reveal:
        for name, rows in (("verdicts", findings), ("discoveries", discoveries)):
            raw = rows.groupBy("request_id").agg(F.map_from_entries(F.collect_set(F.struct("id", "match"))).alias("raw"))
            with_match = F.transform(name, lambda v: v.withField("match", F.element_at(F.col("raw"), v["id"])))
            base = base.join(raw, "request_id", "left").withColumn(name, with_match).drop("raw")
    slim = F.transform("verdicts", lambda v: v.dropFields("detections"))
    named = F.filter(F.array_sort(F.array_distinct(F.flatten(F.transform("verdicts", lambda v: v["detections"]["detector_name"])))), lambda x: x.isNotNull())
    return base.select("request_id", *[c for c in r.columns if c != "request_id"], named.alias("detectors_named"), "stats.*", slim.alias("verdicts"), "discoveries")


def counters(raw: DataFrame, errors: DataFrame, verdicts: DataFrame) -> DataFrame:
    """counter, label, n: findings by detector, errors by detector, verdicts by outcome, verdicts that a scorer never gave."""
    gap = F.startswith("reason", F.lit("model returned no verdict"))
    parts = [
        raw.groupBy(F.lit("findings").alias("counter"), F.col("detector_name").alias("label")).agg(F.count("*").alias("n")),
        errors.groupBy(F.lit("errors").alias("counter"), F.col("detector").alias("label")).agg(F.count("*").alias("n")),
        verdicts.groupBy(F.lit("verdicts").alias("counter"), F.col("verdict").alias("label")).agg(F.count("*").alias("n")),
        verdicts.where(gap).groupBy(F.lit("missing").alias("counter"), F.lit("").alias("label")).agg(F.count("*").alias("n")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def alert_count(responses_: DataFrame) -> DataFrame:
    """request_id, alerts: discoveries and confirmed verdicts."""
    confirmed = F.size(F.filter("verdicts", lambda v: v["verdict"] == "confirmed"))
    return responses_.select("request_id", (F.coalesce(F.size("discoveries"), F.lit(0)) + confirmed).alias("alerts"))


def preview_matches(shown: Column, raw: Column) -> Column:
    """Whether a raw value can have this preview: equal without a mask, any value under a whole mask, else head and tail agree."""
    at = F.instr(shown, F.lit("****"))
    head, tail = F.substring(shown, F.lit(1), at - 1), F.substring(shown, at + 4, F.length(shown))
    return F.when(at == 0, shown == raw).when((head == "") & (tail == ""), raw != "").otherwise(F.startswith(raw, head) & F.endswith(raw, tail))

