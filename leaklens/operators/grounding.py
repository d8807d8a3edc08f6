"""Grounding: every scored claim is traced to an added line, or has a reason why not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import constants as C
from ..functions.predicates import any_of, assignment_key, assignment_value, is_formatting_text, is_placeholder, is_reference, is_secret_key, pem_header, sentinel_reason
from ..functions.text import finding_id, trim_space
from .locate import locate_with_fallback


def _literal_pattern(v: Column) -> Column:
    return F.concat(F.lit(r"\Q"), F.replace(v, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def only_in_reference(value: Column, line: Column) -> Column:
    """Whether value is in line, and each occurrence, overlapping ones too, stands behind ``$`` or ``${``."""
    elsewhere = F.rlike(line, F.concat(F.lit(r"(?<!\$)(?<!\$\{)"), _literal_pattern(value)))
    return (value != "") & F.contains(line, value) & ~elsewhere


def quoted_whole(value: Column, line: Column) -> Column:
    """Whether a call-shaped value is a whole quoted literal of the line, or the password ``:value@`` in one.

    The literal is the one that the value's first occurrence lies in: what comes before it, without closed literals,
    begins with the quote that is open there. Neither value nor literal may interpolate or escape anything.
    """
    plain = lambda x: ~x.rlike(r"[$\\{}]")
    upto = lambda x, part: F.call_function("substring_index", x, part, F.lit(1))
    before = upto(line, value)
    opened = F.regexp_replace(before, r"""(?s)\A(?:[^"']++|"(?:[^"\\]|\\.)*+"|'(?:[^'\\]|\\.)*+')*+""", "")
    quote, head = F.substring(opened, 1, 1), F.substring(opened, 2, 1 << 30)
    after = F.substring(line, F.length(before) + F.length(value) + 1, F.length(line))
    tail = upto(after, quote)
    literal = F.concat(head, value, tail)
    whole = (literal == value) | (F.instr(literal, F.concat(F.lit(":"), value, F.lit("@"))) > 1)
    call = value.rlike(C.CALL_SHAPE) & F.endswith(value, F.lit(")")) & ~any_of(F.startswith(value, F.lit(p)) for p in C.REFERENCE_PREFIXES)
    return call & plain(value) & F.contains(line, value) & (opened != "") & ~F.contains(value, quote) & F.contains(after, quote) & plain(literal) & whole


def ground(candidates: DataFrame, lines: DataFrame, findings: DataFrame) -> DataFrame:
    """The trace: each candidate (request_id, cand_ix, value, kind, confidence, reason) with outcome, path, line, match, id.

    Outcomes, the first that applies: test_data, invalid_or_reference, non_secret_assignment, placeholder,
    formatting_text, not_found, sentinel, reference, duplicate, detector_overlap, discovered.
    lines: added lines with ord; findings: deduplicated detector findings.
    """
    key = F.col("kind") == "private_key"
    header = pem_header(F.col("value"))
    public = ~key & (header == "") & (F.contains("value", F.lit("-----BEGIN ")) | F.contains("value", F.lit("-----END ")))
    x = candidates.withColumn("public", public).withColumn("needle", F.when(key, header).otherwise(trim_space(F.col("value")))).withColumn("needle_id", F.col("cand_ix"))
    x = x.withColumn("akey", assignment_key(F.col("needle"))).withColumn("aval", assignment_value(F.col("needle")))
    found = locate_with_fallback(x.select("request_id", "needle_id", "needle"), lines).select("request_id", "needle_id", F.col("path").alias("p1"), F.col("line").alias("l1"), F.col("found").alias("f1"))
    by_value = locate_with_fallback(x.where("aval IS NOT NULL").select("request_id", "needle_id", F.col("aval").alias("needle")), lines).select("request_id", "needle_id", F.col("path").alias("p2"), F.col("line").alias("l2"), F.col("found").alias("f2"))
    x = x.join(found, ["request_id", "needle_id"]).join(by_value, ["request_id", "needle_id"], "left")
    full = F.col("p1") != ""
    x = x.withColumns(
        {
            "path": F.when(full, F.col("p1")).otherwise(F.coalesce("p2", F.lit(""))),
            "line": F.when(full, F.col("l1")).otherwise(F.coalesce("l2", F.lit(0))),
            "match": F.when(F.col("aval").isNotNull(), F.col("aval")).when(full, F.col("f1")).otherwise(F.lit("")),
        }
    )
    text = lines.groupBy("request_id", "path", "line").agg(F.min_by("text", "ord").alias("line_text"))
    x = x.join(text, ["request_id", "path", "line"], "left").withColumn("line_text", F.coalesce("line_text", F.lit("")))
    n, assigned = F.col("needle"), F.col("aval").isNotNull()
    rescued = full & (F.col("f1") == n) & quoted_whole(n, F.col("line_text"))
    early = (
        F.when(F.col("kind") == "test_data", "test_data")
        .when(F.col("public") | (F.octet_length(n) < C.MIN_GROUNDED_BYTES), "invalid_or_reference")
        .when(is_reference(n) & ~rescued, "invalid_or_reference")
        .when(assigned & (~is_secret_key(F.col("akey"), F.col("aval")) | is_placeholder(F.col("aval")) | (F.octet_length("aval") < C.MIN_GROUNDED_BYTES)), "non_secret_assignment")
        .when(~assigned & is_placeholder(n), "placeholder")
        .when(~assigned & ~key & is_formatting_text(n), "formatting_text")
        .when(F.col("path") == "", "not_found")
        .when(sentinel_reason(F.col("match")).isNotNull(), "sentinel")
        .when(only_in_reference(F.col("match"), F.col("line_text")), "reference")
    )
    x = x.withColumn("early", early).withColumn("id", F.when(F.col("path") != "", finding_id(F.col("path"), F.col("line"), F.col("match"))))
    c, f = x.alias("c"), findings.alias("f")
    same = (F.col("c.request_id") == F.col("f.request_id")) & (F.col("c.path") == F.col("f.path")) & (F.col("c.line") == F.col("f.line"))
    covered = c.where("early IS NULL").join(f, same & (F.contains(F.col("c.match"), F.col("f.match")) | F.contains(F.col("f.match"), F.col("c.match"))), "left_semi").select("request_id", "cand_ix", F.lit(True).alias("covered"))
    x = x.join(covered, ["request_id", "cand_ix"], "left").withColumn("covered", F.coalesce("covered", F.lit(False)))
    # a colliding candidate is never recorded, so it makes no later one a duplicate
    x = x.withColumn("nth", F.when(F.col("early").isNull(), F.row_number().over(Window.partitionBy("request_id", "id", F.col("early").isNull()).orderBy("covered", "cand_ix"))))
    outcome = F.coalesce(F.col("early"), F.when(F.col("covered"), "detector_overlap").when(F.col("nth") > 1, "duplicate").otherwise("discovered"))
    return x.select("request_id", "cand_ix", F.when(key, "private_key").otherwise("credential").alias("kind"), "confidence", "reason", outcome.alias("outcome"), "path", "line", "match", "id")


def discoveries(trace: DataFrame) -> DataFrame:
    return trace.where("outcome = 'discovered'").drop("outcome")


def ground_stats(trace: DataFrame) -> DataFrame:
    o = F.col("outcome")
    return trace.groupBy("request_id").agg(
        F.count("*").alias("candidates"), F.count_if(o == "discovered").alias("discovered"), F.count_if(o.isin("invalid_or_reference", "not_found")).alias("ungrounded"), F.count_if(o == "detector_overlap").alias("collisions")
    )
