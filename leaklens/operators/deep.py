"""The deep scan end to end: windows of a diff, a catalog of escaped literals, a call per window, candidates, grounding, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import constants as C
from ..functions.predicates import is_formatting_text, is_reference
from . import adjudicate, diff, grounding, packing

_CLOSED = r""""(?:[^"\\]|\\.)*+"|'(?:[^'\\]|\\.)*+'"""
#: Closed literals of a line in order; an open quote takes the rest of the line.
_LITERAL = rf"(?s){_CLOSED}|[\"'].*"


def source_literals(windows: DataFrame) -> DataFrame:
    """request_id, window_ix, source_id, value: the escaped quoted literals of each window that a scorer may name instead of copying.

    In the order of the window, each value once; display text and references are left out. A literal that would take the
    catalog over its bytes is passed over, and a catalog is full at ``MAX_LITERALS``.
    """
    lines = windows.select("request_id", "window_ix", F.posexplode(F.split("window", "\n", -1)).alias("row", "text")).where(~F.startswith("text", F.lit(C.WINDOW_HEADER)))
    whole = F.regexp_extract_all("text", F.lit(_LITERAL), F.lit(0))
    closed = F.filter(whole, lambda x: x.rlike(rf"(?s)\A(?:{_CLOSED})\z"))
    found = lines.where(F.contains("text", F.lit("\\"))).select("request_id", "window_ix", "row", F.posexplode(closed).alias("at", "quoted"))
    found = found.withColumn("value", F.expr("substring(quoted, 2, length(quoted) - 2)"))
    v = F.col("value")
    found = found.where(F.contains(v, F.lit("\\")) & (F.octet_length(v) <= C.MAX_LITERAL_BYTES) & ~is_formatting_text(v) & ~is_reference(v))
    first = found.groupBy("request_id", "window_ix", "value").agg(F.min(F.struct("row", "at")).alias("place"))
    listed = F.array_sort(F.collect_list(F.struct("place", "value")))["value"]  # at most the literals of one window, which is bounded
    kept = F.aggregate(listed, F.struct(F.lit(1).alias("bytes"), F.array().cast("array<string>").alias("out")), _take)["out"]
    return first.groupBy("request_id", "window_ix").agg(kept.alias("values")).select("request_id", "window_ix", F.posexplode("values").alias("at", "value")).select(
        "request_id", "window_ix", F.concat(F.lit("literal_"), (F.col("at") + 1).cast("string")).alias("source_id"), "value"
    )


def literal_json(value: Column) -> Column:
    """A JSON string as encoders that are safe for HTML write it."""
    quoted = F.regexp_extract(F.to_json(F.struct(value.alias("v"))), r"(?s)\A\{\"v\":(.*)\}\z", 1)
    for plain in "<>&  ":
        quoted = F.replace(quoted, F.lit(plain), F.lit(f"\\u{ord(plain):04x}"))
    return quoted


def _take(acc: Column, value: Column) -> Column:
    """A catalog is a JSON array: brackets, entries, and a comma between."""
    entry = F.octet_length(F.concat(F.lit('{"id":"literal_'), (F.size(acc["out"]) + 1).cast("string"), F.lit('","value":'), literal_json(value), F.lit("}"))) + 1
    fits = (acc["bytes"] + entry <= C.MAX_CATALOG_BYTES) & (F.size(acc["out"]) < C.MAX_LITERALS)
    return F.struct(F.when(fits, acc["bytes"] + entry).otherwise(acc["bytes"]).cast("int").alias("bytes"), F.when(fits, F.concat(acc["out"], F.array(value))).otherwise(acc["out"]).alias("out"))


def catalog_prompt(literals: DataFrame) -> DataFrame:
    """request_id, window_ix, catalog: the text that tells a scorer of the literals."""
    lines = F.array_sort(F.collect_list(F.struct(F.substring("source_id", 9, 9).cast("int").alias("n"), F.concat("source_id", F.lit(": "), literal_json(F.col("value")), F.lit("\n")).alias("line"))))
    return literals.groupBy("request_id", "window_ix").agg(F.concat(F.lit(C.CATALOG_HEAD), F.concat_ws("", lines["line"]), F.lit(C.CATALOG_TAIL)).alias("catalog"))


def resolve_sources(candidates: DataFrame, literals: DataFrame) -> DataFrame:
    """Parsed candidates (request_id, window_ix, source_id, value, .., error) with values for named literals.

    An unknown name, or a value beside it that is another, is an error of the window's whole answer.
    """
    known = literals.select("request_id", "window_ix", "source_id", F.col("value").alias("literal"))
    x = candidates.join(known, ["request_id", "window_ix", "source_id"], "left")
    named = F.col("source_id").isNotNull()
    bad = F.coalesce(F.col("error") | (named & (F.col("literal").isNull() | ((F.coalesce("value", F.lit("")) != "") & (F.col("value") != F.col("literal"))))), F.lit(False))
    x = x.withColumn("error", F.max(bad).over(Window.partitionBy("request_id", "window_ix")))
    x = x.withColumn("value", F.when(named, F.col("literal")).otherwise(F.col("value"))).drop("literal")
    return x.where(F.col("error") | (F.trim("value") != ""))


def skipped(requests: DataFrame, findings: DataFrame, added: DataFrame, require_findings: bool = False, max_added_lines: int = 0, sample_rate: float = 1.0) -> DataFrame:
    """request_id, why: null for the requests whose diff is read. The sample is drawn by a hash of the id, so a repeated request fares alike."""
    x = requests.select("request_id").join(findings.groupBy("request_id").agg(F.count("*").alias("found")), "request_id", "left").join(added, "request_id", "left")
    draw = F.pmod(F.xxhash64("request_id"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    why = F.when(F.lit(require_findings) & F.col("found").isNull(), "require_findings")
    why = why.when(F.lit(max_added_lines > 0) & (F.coalesce("added_lines", F.lit(0)) > max_added_lines), "max_added_lines")
    return x.select("request_id", why.when(F.lit(0 < sample_rate < 1) & (draw >= sample_rate), "sample_rate").alias("why"))


def kept(rows: DataFrame) -> DataFrame:
    """``rows`` computed once: in the session's checkpoint folder, which outlives executors, or in memory where there is none (local runs)."""
    has_folder = rows.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined()
    return rows.checkpoint() if has_folder else rows.persist()


def deep_scan(
    requests: DataFrame, findings: DataFrame, scorer: adjudicate.Scorer, window_tokens: int = 4000, max_windows: int = C.MAX_WINDOWS, max_candidates: int = 0, literals: bool = True, **limits
) -> tuple[DataFrame, DataFrame]:
    """(trace, status) of requests (request_id, diff).

    trace: every candidate with its outcome (see ``grounding``). status, one row per request: status (complete, failed
    or skipped), reason, windows, calls, candidates, discovered, ungrounded, collisions, truncated. A window whose answer
    stays malformed, or has a value that its source does not, fails its request; what its other windows found stays.
    ``limits``: see ``skipped``.
    """
    lines = diff.diff_lines(requests)
    why = skipped(requests, findings, diff.added_line_count(lines), **limits)
    read = lines.join(why.where("why IS NULL").select("request_id"), "request_id", "left_semi")
    windows = kept(packing.deep_windows(diff.added_blocks(read), window_tokens, max_windows))
    catalog = kept(source_literals(windows if literals else windows.limit(0)))
    prompts = windows.join(catalog_prompt(catalog), ["request_id", "window_ix"], "left").select("request_id", F.col("window_ix").alias("batch_id"), F.concat("window", F.coalesce("catalog", F.lit(""))).alias("prompt"))
    answers = kept(adjudicate.call(prompts, scorer, "candidates"))  # a call is made once, whatever reads its answer
    parsed = resolve_sources(adjudicate.parse_candidates(answers).withColumnRenamed("batch_id", "window_ix"), catalog)
    parsed = parsed.join(windows.select("request_id", "window_ix", "window"), ["request_id", "window_ix"])
    has_catalog = catalog.select("request_id", "window_ix", F.lit(True).alias("listed")).distinct()
    parsed = parsed.join(has_catalog, ["request_id", "window_ix"], "left")
    absent = F.col("listed").isNotNull() & ~F.col("kind").isin("private_key", "test_data") & ~F.contains("window", F.col("value"))
    w = Window.partitionBy("request_id", "window_ix")
    parsed = parsed.withColumn("error", F.max(F.coalesce(F.col("error") | absent, F.col("error"))).over(w)).withColumn("nth", F.row_number().over(w.orderBy("ord")))
    parsed = kept(parsed)
    good = parsed.where(~F.col("error") & (F.lit(max_candidates <= 0) | (F.col("nth") <= max_candidates)))
    order = Window.partitionBy("request_id").orderBy("window_ix", "ord")
    candidates = good.select("request_id", (F.row_number().over(order) - 1).alias("cand_ix"), "value", "kind", "confidence", "reason")
    trace = kept(grounding.ground(candidates, diff.added_lines(read).select("request_id", "ord", "path", "line", "text"), findings))
    asked = answers.groupBy("request_id").agg(F.count("*").alias("windows"), F.sum("attempts").alias("calls"))
    failed = parsed.where("error").select("request_id").distinct().withColumn("failed", F.lit(True))
    cut = windows.groupBy("request_id").agg(F.bool_or("truncated").alias("truncated"))
    x = why.join(asked, "request_id", "left").join(failed, "request_id", "left").join(cut, "request_id", "left").join(grounding.ground_stats(trace), "request_id", "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("windows", "calls", "candidates", "discovered", "ungrounded", "collisions")]
    status = F.when(F.col("why").isNotNull(), "skipped").when(F.col("failed"), "failed").otherwise("complete")
    return trace, x.select("request_id", status.alias("status"), F.coalesce("why", F.lit("")).alias("reason"), *counts, F.coalesce("truncated", F.lit(False)).alias("truncated"))


def as_findings(discoveries: DataFrame) -> DataFrame:
    """Discoveries as findings of the detector that review knows them by, to be adjudicated like any other."""
    trail = F.array(F.struct(F.lit(C.REVIEW_DETECTOR).alias("detector_type"), F.lit(C.REVIEW_DETECTOR).alias("detector_name"), F.col("kind").alias("rule"), F.lit(False).alias("verified")))
    return discoveries.select("request_id", "path", "line", "match", trail.alias("detections"), F.lit(False).alias("any_verified"), "id")


def reviewed(discoveries: DataFrame, image: DataFrame, scorer: adjudicate.Scorer, **budgets) -> DataFrame:
    """Discoveries put through adjudication with context, with ``outcome``: only confirmed ones are to be reported."""
    from .locate import with_context

    verdicts = adjudicate.adjudicate(with_context(as_findings(discoveries), image), scorer, **budgets)
    told = verdicts.select("request_id", F.col("id").alias("finding_id"), "verdict", "confidence", "reason", F.lit(1).alias("ord"))
    return adjudicate.review(discoveries, told)
