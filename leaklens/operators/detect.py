"""Detectors and findings: rule matches over lines, external findings, dedup, fixed-rule decisions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import constants as C
from ..functions.predicates import any_of, sentinel_reason
from ..functions.text import finding_id, trim_space

FINDING = ["request_id", "detector_type", "detector_name", "rule", "path", "line", "match", "verified"]


@dataclass(frozen=True)
class Rule:
    """A rule is data: a pattern that does not cross lines, the group it reports, keywords and allowlists."""

    id: str
    pattern: str
    group: int = 0
    keywords: list[str] = field(default_factory=list)
    allow_match: list[str] = field(default_factory=list)


GENERIC = Rule(C.ASSIGNMENT_RULE_ID, C.ASSIGNMENT_RULE, C.ASSIGNMENT_GROUP, C.ASSIGNMENT_KEYWORDS, [C.KEY_SHAPE_ALLOWLIST])


def has_keyword(text: Column, rule: Rule) -> Column:
    """The rule's gate: a line without a keyword is not matched, whatever the pattern would find there (``access-key:`` has none)."""
    low = F.lower(text)
    return any_of(F.contains(low, F.lit(k)) for k in rule.keywords) if rule.keywords else F.lit(True)


def allowed(whole: Column, rule: Rule) -> Column:
    return any_of(whole.rlike(p) for p in rule.allow_match) if rule.allow_match else F.lit(False)


def raw_matches(lines: DataFrame, rule: Rule, prefilter: bool = True, allowlist: bool = True) -> DataFrame:
    """lines with ``whole`` and ``match`` of every non-overlapping match of the rule, one row each."""
    hit = lines.where(has_keyword(F.col("text"), rule)) if prefilter else lines
    hit = hit.where(F.col("text").rlike(rule.pattern))
    both = F.arrays_zip(F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(0)).alias("w"), F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(rule.group)).alias("m"))
    out = hit.withColumn("pair", F.explode(both)).withColumn("whole", F.col("pair.w")).withColumn("match", F.col("pair.m")).drop("pair")
    return out.where(~allowed(F.col("whole"), rule)) if allowlist else out


def yaml_scalar(capture: Column) -> Column:
    """The value of a captured ``key: value`` pair of one line, without one pair of quotes; else the capture as it is."""
    cut = F.regexp_extract(capture, r"(?s)\A[^:]*:(.*)\z", 1)
    value = trim_space(cut)
    bare = F.regexp_replace(value, r"""(?s)\A(["'])(.*)\1\z""", "$2")
    return F.when(F.contains(capture, F.lit(":")) & ~cut.rlike(r"[\r\n]") & (bare != ""), bare).otherwise(capture)


def block_findings(blocks: DataFrame, rules: list[Rule], detector: str = "rules") -> DataFrame:
    """Findings of rules whose patterns may cross lines, over added blocks (request_id, path, start_line, content).

    A finding's line is that of its capture, not of the match around it. The block is cut at each whole match, so what
    stands before the n-th is the pieces and matches before it.
    """
    out = None
    for rule in rules:
        at = lambda group: F.regexp_extract_all("content", F.lit(rule.pattern), F.lit(group))  # noqa: B023, E731
        hit = blocks.where(has_keyword(F.col("content"), rule) & F.col("content").rlike(rule.pattern))
        hit = hit.select("request_id", "path", "start_line", "content", F.posexplode(F.arrays_zip(at(0).alias("w"), at(rule.group).alias("m"))).alias("nth", "pair"), F.split("content", rule.pattern, -1).alias("between"), at(0).alias("all"))
        newlines = lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))
        whole, match = F.col("pair.w"), F.col("pair.m")
        before = F.concat_ws("", F.slice("between", F.lit(1), F.col("nth") + 1), F.slice("all", F.lit(1), F.col("nth")))
        inside = F.when(F.contains(whole, match), F.call_function("substring_index", whole, match, F.lit(1))).otherwise(F.lit(""))
        found = hit.where(~allowed(whole, rule)).select(
            "request_id", F.lit("in_process").alias("detector_type"), F.lit(detector).alias("detector_name"), F.lit(rule.id).alias("rule"), "path",
            (F.col("start_line") + newlines(before) + newlines(inside)).cast("int").alias("line"), (yaml_scalar(match) if rule.id == C.KUBERNETES_RULE_ID else match).alias("match"), F.lit(False).alias("verified"),
        )
        out = found if out is None else out.unionByName(found)
    return out


def rule_findings(lines: DataFrame, rules: list[Rule] | None = None, detector: str = "rules") -> DataFrame:
    """Findings of all rules over lines (request_id, path, line, text)."""
    out = None
    for rule in rules or [GENERIC]:
        f = raw_matches(lines, rule).select("request_id", F.lit("in_process").alias("detector_type"), F.lit(detector).alias("detector_name"), F.lit(rule.id).alias("rule"), "path", "line", "match", F.lit(False).alias("verified"))
        out = f if out is None else out.unionByName(f)
    return out


def union_findings(*parts: DataFrame) -> DataFrame:
    out = parts[0].select(*FINDING)
    for p in parts[1:]:
        out = out.unionByName(p.select(*FINDING))
    return out


def subtract_baseline(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """Findings that a baseline (path, line, rule, match) does not know; another secret on a known line is new."""
    same = ["path", "line", "rule", "match"]
    return findings.join(baseline.select(*same).distinct(), same, "left_anti")


def dedup(findings: DataFrame) -> DataFrame:
    """One row per (path, line, match) of a request, with all detections in order, repeats included."""
    trail = F.array_sort(F.collect_list(F.struct("detector_type", "detector_name", "rule", "verified")))
    out = findings.groupBy("request_id", "path", "line", "match").agg(trail.alias("detections"), F.bool_or("verified").alias("any_verified"))
    return out.withColumn("id", finding_id(F.col("path"), F.col("line"), F.col("match")))


def short_circuit(findings: DataFrame) -> DataFrame:
    """verdict, confidence and reason where a fixed rule decides; null verdicts go to the scorer."""
    sample = sentinel_reason(F.col("match"))
    return findings.withColumns(
        {
            "verdict": F.when(F.col("any_verified"), "confirmed").when(sample.isNotNull(), "dismissed"),
            "confidence": F.when(F.col("any_verified") | sample.isNotNull(), F.lit(1.0)),
            "reason": F.when(F.col("any_verified"), F.lit(C.VERIFIED_REASON)).otherwise(sample),
        }
    )


def truncated(findings: DataFrame, most: int = C.MAX_FINDINGS) -> DataFrame:
    """With ``rank`` in (path, line, match) order and ``cut`` for those beyond ``most`` of a request."""
    from pyspark.sql import Window

    w = Window.partitionBy("request_id").orderBy("path", "line", "match")
    return findings.withColumn("rank", F.row_number().over(w)).withColumn("cut", F.col("rank") > most)
