"""Sources: diffs, scanner output, rules, evaluation corpora. All give DataFrames; only rule and config files are read on the driver."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import trim_space
from ..operators.detect import Rule

TRUFFLEHOG = "DetectorName string, DetectorDescription string, Verified boolean, Raw string, RawV2 string"
KINGFISHER = "rule string, rule_name string, match string, secret string, path string, line int, verified boolean"
EXPECTATION = "description string, tags array<string>, pair string, deep boolean, min_after_dedup int, expectations array<struct<match:string,verdict:string>>, expect_secrets array<struct<file:string,line:int,kind:string,value:string>>, expect_discoveries array<struct<match:string,kind:string,file:string,line:int>>, max_alerts int, max_unreviewed int, max_confirmed int, max_discoveries int"
EXPECTATION_KEYS = ["description", "tags", "pair", "deep", "min_after_dedup", "expectations", "expect_secrets", "expect_discoveries", "max_alerts", "max_unreviewed", "max_confirmed", "max_discoveries"]


@dataclass
class Config:
    max_body_bytes: int = 5 << 20
    input_tokens: int = 24_000
    output_tokens: int = 4096
    context_lines: int = 3
    max_findings: int = 200
    window_tokens: int = 4000
    max_windows: int = 48
    detectors: list[str] = field(default_factory=lambda: ["rules"])

    def __post_init__(self):
        if self.input_tokens < 0 or self.output_tokens < 0 or self.max_findings < 1:
            raise ValueError("budgets must not be negative, and max_findings at least 1")
        unknown = set(self.detectors) - {"rules", "trufflehog", "kingfisher"}
        if unknown:
            raise ValueError(f"unknown detectors: {sorted(unknown)}")


def read_diffs(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """One row per file: request_id (its name), diff."""
    reader = spark.readStream if stream else spark.read
    return reader.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[^./]*)?$", 1).alias("request_id"), F.col("value").alias("diff"), F.lit(False).alias("deep"))


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("request_id string, diff string, deep boolean").json(path)


def request_id(given):
    """A caller's id, trimmed, of up to 128 bytes of ``[A-Za-z0-9._:-]``; else null."""
    t = trim_space(given)
    return F.when(t.rlike(r"\A[A-Za-z0-9_.:-]{1,128}\z"), t)


TEXT_TYPES = ["", "text/x-diff", "text/plain", "application/x-patch"]


def decode(raw: DataFrame, max_body_bytes: int = 5 << 20) -> tuple[DataFrame, DataFrame]:
    """(requests, errors) of raw requests (given_id, content_type, query, body as text).

    A JSON body holds diff and deep, the text types are the diff; ``deep=1`` or ``true`` in the query counts for both.
    A request without a well-shaped id gets one made of its content and place, so that a repeated read gives the same.
    """
    kind = F.lower(trim_space(F.substring_index(F.coalesce("content_type", F.lit("")), ";", 1)))
    j = F.from_json("body", "struct<diff:string,deep:boolean>", {"mode": "PERMISSIVE"})
    asked = F.coalesce(F.regexp_extract(F.coalesce("query", F.lit("")), r"(?:^|[?&])deep=([^&]*)", 1).isin("1", "true"), F.lit(False))
    made = F.substring(F.sha2(F.concat_ws("\u0001", "content_type", "query", "body", F.monotonically_increasing_id().cast("string")), 256), 1, 26)
    x = raw.withColumns({"kind": kind, "j": j, "asked": asked, "request_id": F.coalesce(request_id(F.col("given_id")), made)})
    is_json, is_text = F.col("kind") == "application/json", F.col("kind").isin(TEXT_TYPES)
    body = F.coalesce("body", F.lit(""))
    why = (
        F.when(F.octet_length(body) > max_body_bytes, "body too large").when(~is_json & ~is_text, F.concat(F.lit("unsupported content-type: "), "kind"))
        .when(is_text & (body == ""), "empty body").when(is_json & F.isnull(F.try_parse_json(body)), "invalid JSON body").when(is_json & (F.coalesce("j.diff", F.lit("")) == ""), "missing diff field")
    )
    x = x.withColumn("error", why)
    good = x.where("error IS NULL").select("request_id", F.when(is_json, F.col("j.diff")).otherwise(F.col("body")).alias("diff"), (F.col("asked") | (is_json & F.coalesce("j.deep", F.lit(False)))).alias("deep"))
    return good, x.where("error IS NOT NULL").select("request_id", F.lit(400).alias("status"), "error")


def accept(requests: DataFrame, config: Config) -> tuple[DataFrame, DataFrame]:
    """(accepted, errors): empty and over-long bodies are error rows with status 400, not exceptions."""
    why = F.when(F.coalesce(F.length("diff"), F.lit(0)) == 0, "empty diff").when(F.octet_length("diff") > config.max_body_bytes, "body too large")
    judged = requests.withColumn("error", why)
    return judged.where("error IS NULL").drop("error"), judged.where("error IS NOT NULL").select("request_id", F.lit(400).alias("status"), "error")


def _json_lines(lines: DataFrame, schema: str) -> DataFrame:
    t = trim_space(F.col("value"))
    return lines.where(F.startswith(t, F.lit("{"))).withColumn("j", F.from_json(t, schema)).where("j IS NOT NULL")


def trufflehog_findings(lines: DataFrame) -> DataFrame:
    """Output lines (request_id, value) as findings to locate: request_id, needle_id, needle, detector columns."""
    m = F.coalesce(F.nullif(F.col("j.Raw"), F.lit("")), F.nullif(F.col("j.RawV2"), F.lit("")))
    x = _json_lines(lines, TRUFFLEHOG).withColumn("needle", m).where("needle IS NOT NULL")
    return x.select("request_id", F.xxhash64("request_id", "value").alias("needle_id"), "needle", F.lit("subprocess").alias("detector_type"), F.lit("trufflehog").alias("detector_name"), F.coalesce("j.DetectorName", F.lit("")).alias("rule"), F.coalesce("j.Verified", F.lit(False)).alias("verified"))


def kingfisher_findings(lines: DataFrame) -> DataFrame:
    """As above; its own path and line are kept where both are there (given_path, given_line)."""
    m = F.coalesce(F.nullif(F.col("j.secret"), F.lit("")), F.nullif(F.col("j.match"), F.lit("")))
    x = _json_lines(lines, KINGFISHER).withColumn("needle", m).where("needle IS NOT NULL")
    both = (F.coalesce("j.path", F.lit("")) != "") & (F.coalesce("j.line", F.lit(0)) > 0)
    return x.select(
        "request_id", F.xxhash64("request_id", "value").alias("needle_id"), "needle", F.lit("subprocess").alias("detector_type"), F.lit("kingfisher").alias("detector_name"),
        F.coalesce(F.nullif(F.col("j.rule_name"), F.lit("")), F.col("j.rule"), F.lit("")).alias("rule"), F.coalesce("j.verified", F.lit(False)).alias("verified"),
        F.when(both, F.col("j.path")).alias("given_path"), F.when(both, F.col("j.line")).alias("given_line"),
    )


def read_rules(path: str) -> list[Rule]:
    """Rules of a TOML file: id, regex, secretGroup, keywords, allowlists. Patterns fold case as RE2 does and use its white space."""
    with open(path, "rb") as f:
        doc = tomllib.load(f)
    java = lambda p: p.replace("(?i)", "(?iu)").replace(r"[^\s", r"[^\t\n\f\r ")
    return [
        Rule(r["id"], java(r["regex"]), int(r.get("secretGroup", 0)), list(r.get("keywords", [])), [java(x) for a in r.get("allowlists", []) if a.get("regexTarget") == "match" for x in a.get("regexes", [])])
        for r in doc.get("rules", [])
    ]


def read_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs <name>.diff and <name>.expect.json: name, diff, expectation, strict (no unknown keys)."""
    name = F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.expect)?\.[^./]*$", 1).alias("name")
    diffs = spark.read.text(f"{folder}/*.diff", wholetext=True).select(name, F.col("value").alias("diff"))
    wants = spark.read.text(f"{folder}/*.expect.json", wholetext=True).select(name, F.from_json("value", EXPECTATION).alias("expectation"), F.json_object_keys("value").alias("keys"))
    return diffs.join(wants, "name").select("name", "diff", "expectation", (F.size(F.array_except("keys", F.array(*[F.lit(k) for k in EXPECTATION_KEYS]))) == 0).alias("strict"))
