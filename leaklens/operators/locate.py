"""Joins of findings and candidates with lines: first location, context windows, collisions, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import constants as C
from ..functions.predicates import normalized


def locate(needles: DataFrame, lines: DataFrame, needle: str = "needle") -> DataFrame:
    """Needles with the path and line of the first added line that holds them, '' and 0 if none does.

    needles: request_id, needle_id and the needle. lines: request_id, ord, path, line, text. The equality on request_id
    makes it a hash or merge join with the containment as its residual.
    """
    n, x = needles.alias("n"), lines.alias("x")
    hit = n.join(x, (F.col("n.request_id") == F.col("x.request_id")) & (F.col(f"n.{needle}") != "") & F.contains(F.col("x.text"), F.col(f"n.{needle}")))
    first = hit.groupBy(F.col("n.request_id").alias("request_id"), F.col("n.needle_id").alias("needle_id")).agg(F.min(F.struct(F.col("x.ord").alias("ord"), F.col("x.path").alias("path"), F.col("x.line").alias("line"))).alias("at"))
    return needles.join(first, ["request_id", "needle_id"], "left").select(*needles.columns, F.coalesce("at.path", F.lit("")).alias("path"), F.coalesce("at.line", F.lit(0)).alias("line"))


def locate_with_fallback(needles: DataFrame, lines: DataFrame) -> DataFrame:
    """As ``locate``; where the needle is nowhere, its normalised form if that is another of six bytes or more. ``found``: the form that was."""
    other = normalized(F.col("needle"))
    two = needles.withColumn("second", F.when((other != F.col("needle")) & (F.octet_length(other) >= C.MIN_GROUNDED_BYTES), other).otherwise(F.lit("")))
    a = locate(two, lines)
    b = locate(two.select("request_id", "needle_id", "second"), lines, "second").select("request_id", "needle_id", F.col("path").alias("path2"), F.col("line").alias("line2"))
    first, second = F.col("path") != "", F.col("path2") != ""
    return a.join(b, ["request_id", "needle_id"]).select(
        *needles.columns,
        F.when(first, F.col("path")).otherwise(F.col("path2")).alias("path"),
        F.when(first, F.col("line")).otherwise(F.col("line2")).alias("line"),
        F.when(first, F.col("needle")).when(second, F.col("second")).otherwise(F.lit("")).alias("found"),
    )


def context_line(hit: Column, number: Column, width: Column, text: Column) -> Column:
    digits = number.cast("string")
    return F.concat(F.when(hit, F.lit(">")).otherwise(F.lit(" ")), F.lit(" "), F.lpad(digits, F.greatest(width, F.length(digits)), " "), F.lit(": "), text)


def with_context(findings: DataFrame, image: DataFrame, n: int = 3) -> DataFrame:
    """Findings with ``context``: the lines n above to n below in the post-image, '' if it knows none."""
    f, x = findings.alias("f"), image.alias("x")
    near = f.join(x, (F.col("f.request_id") == F.col("x.request_id")) & (F.col("f.path") == F.col("x.path")) & F.col("x.line").between(F.col("f.line") - n, F.col("f.line") + n))
    row = F.struct(F.col("x.line").alias("line"), context_line(F.col("x.line") == F.col("f.line"), F.col("x.line"), F.length((F.col("f.line") + n).cast("string")), F.col("x.text")).alias("shown"))
    got = near.groupBy(F.col("f.request_id").alias("request_id"), F.col("f.id").alias("id")).agg(F.concat_ws("\n", F.array_sort(F.collect_set(row))["shown"]).alias("context"))
    return findings.join(got, ["request_id", "id"], "left").withColumn("context", F.coalesce("context", F.lit("")))


def without_collisions(candidates: DataFrame, findings: DataFrame) -> DataFrame:
    """Candidates that no finding on the same line covers: neither value contains the other."""
    c, f = candidates.alias("c"), findings.alias("f")
    same = (F.col("c.request_id") == F.col("f.request_id")) & (F.col("c.path") == F.col("f.path")) & (F.col("c.line") == F.col("f.line"))
    return c.join(f, same & (F.contains(F.col("c.match"), F.col("f.match")) | F.contains(F.col("f.match"), F.col("c.match"))), "left_anti")


def last_verdicts(verdicts: DataFrame) -> DataFrame:
    """One row per (request_id, finding_id): the last in ``ord``."""
    return verdicts.groupBy("request_id", "finding_id").agg(F.max_by(F.struct("verdict", "confidence", "reason"), "ord").alias("v")).select("request_id", "finding_id", "v.*")


def fill_gaps(findings: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Findings with their last model verdict; a missing or unknown one is unreviewed with confidence 0."""
    v = last_verdicts(verdicts).select("request_id", F.col("finding_id").alias("id"), F.col("verdict").alias("mv"), F.col("confidence").alias("mc"), F.col("reason").alias("mr"))
    good = F.coalesce(F.col("mv").isin("confirmed", "dismissed"), F.lit(False))
    out = findings.join(v, ["request_id", "id"], "left")
    return out.select(*findings.columns, F.when(good, F.col("mv")).otherwise("unreviewed").alias("verdict"), F.when(good, F.col("mc")).otherwise(F.lit(0.0)).alias("confidence"), F.when(good, F.col("mr")).otherwise(F.lit(C.GAP_REASON)).alias("reason"))


def merge_response(findings: DataFrame, decided: DataFrame, on_truncate: str = "compat_confirmed") -> DataFrame:
    """Every finding with its decided verdict. One that was cut before the decision is confirmed with confidence 0, or unreviewed."""
    missing = "confirmed" if on_truncate == "compat_confirmed" else "unreviewed"
    d = decided.select("request_id", "id", F.col("verdict").alias("dv"), F.col("confidence").alias("dc"), F.col("reason").alias("dr"))
    keep = [c for c in findings.columns if c not in ("verdict", "confidence", "reason")]
    return findings.join(d, ["request_id", "id"], "left").select(*keep, F.coalesce("dv", F.lit(missing)).alias("verdict"), F.coalesce("dc", F.lit(0.0)).alias("confidence"), F.coalesce("dr", F.when(F.col("dv").isNull(), F.lit(C.UNSEEN_REASON)).otherwise(F.lit(""))).alias("reason"))
