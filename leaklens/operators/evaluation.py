"""Evaluation runs: diagnostic records, their summary, totals by stage, and request-by-request comparison of two runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import constants as C
from . import stats

USAGE = ["prompt_tokens", "completion_tokens", "total_tokens"]
_CHOICE = "struct<finish_reason:string,message:struct<reasoning:string,reasoning_content:string>>"
RECORD = (
    "name string, run int, set string, thinking boolean, latency_ms double, diff_sha256 string, expectation_sha256 string, model string, prompt string, prompt_deep string, http_status int, "
    f"response struct<stats:struct<deep_scan:struct<error:string>>>, calls array<struct<stage:string,latency_ms:double,error:string,request:string,response:struct<choices:array<{_CHOICE}>,usage:struct<prompt_tokens:long,completion_tokens:long,total_tokens:long>>>>"
)
IDENTITY = ["diff_sha256", "expectation_sha256", "model", "prompt", "prompt_deep"]


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Diagnostic records, one JSON line each; a call's request stays JSON text."""
    return spark.read.text(path).where("trim(value) <> ''").select(F.from_json("value", RECORD).alias("r")).select("r.*")


def calls_of(records: DataFrame) -> DataFrame:
    """One row per model call, with its record's name and run, its ordinal, and whether it is a retry."""
    x = records.select("name", "run", *IDENTITY, F.posexplode("calls").alias("at", "c")).select("name", "run", *IDENTITY, "at", "c.*")
    return x.withColumn("recovery", F.coalesce(F.contains("request", F.lit(C.RECOVERY_PREFIX)), F.lit(False)))


def _latency(rows: DataFrame, by: str) -> DataFrame:
    low, high = stats.middles()
    r = stats.ranked(rows, "latency_ms", by, {"low": low, "high": high, "p95": stats.nearest(0.95), "longest": F.col("n") - 1})
    return r.select(by, "n", ((F.col("low") + F.col("high")) / 2).alias("median"), "p95", "longest")


def totals_by_stage(records: DataFrame) -> DataFrame:
    """stage, calls, median, p95, longest, the usage totals, transport_errors, finish_reasons (a map of counts)."""
    c = calls_of(records)
    usage = [F.sum(F.coalesce(F.col(f"response.usage.{u}"), F.lit(0))).alias(u) for u in USAGE]
    sums = c.groupBy("stage").agg(*usage, F.count_if(F.coalesce("error", F.lit("")) != "").alias("transport_errors"))
    ends = c.select("stage", F.explode("response.choices").alias("x")).groupBy("stage", F.coalesce("x.finish_reason", F.lit("")).alias("why")).agg(F.count("*").alias("k"))
    ends = ends.groupBy("stage").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("why", "k")))).alias("finish_reasons"))
    return _latency(c, "stage").withColumnRenamed("n", "calls").join(sums, "stage").join(ends, "stage", "left")


def summary(records: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One row over all records: cases, calls, latencies, usage, errors, and the sorted distinct settings.

    outcomes: name, passed, hits, total; a case of which not all agreed did not pass. An outcome without records, or the
    reverse, raises an error in the ``cases`` column, as an incomplete run must not look like a good one.
    """
    c = calls_of(records)
    reasoned = F.exists(F.col("response.choices"), lambda x: (F.coalesce(x["message"]["reasoning"], F.lit("")) != "") | (F.coalesce(x["message"]["reasoning_content"], F.lit("")) != ""))
    names = records.select("name").distinct().withColumn("has", F.lit(True)).join(outcomes, "name", "full_outer")
    passed = F.col("passed") & (F.coalesce("hits", F.lit(0)) == F.coalesce("total", F.lit(0)))
    odd = F.count_if(F.col("has").isNull() | F.col("passed").isNull())
    cases = names.agg(F.when(odd > 0, F.raise_error(F.lit("records and outcomes disagree; a run may be incomplete"))).otherwise(F.count("*")).cast("long").alias("cases"), F.count_if(passed).alias("cases_passed"), F.sort_array(F.collect_list(F.when(~passed, F.col("name")))).alias("failed_cases"))
    distinct = [F.sort_array(F.collect_set(k)).alias(k) for k in ("model", "thinking", "prompt", "prompt_deep")]
    whole = records.agg(F.count("*").alias("requests"), F.count_if(F.coalesce("http_status", F.lit(200)) != 200).alias("http_errors"), F.count_if(F.coalesce("response.stats.deep_scan.error", F.lit("")) != "").alias("deep_errors"), *distinct)
    called = c.agg(F.count("*").alias("model_calls"), F.count_if(F.coalesce(reasoned, F.lit(False))).alias("calls_with_reasoning"), F.count_if("recovery").alias("recovery_calls"), *[F.coalesce(F.sum(F.col(f"response.usage.{u}")), F.lit(0)).alias(u) for u in USAGE])
    named = lambda rows, prefix: _latency(rows.withColumn("k", F.lit(1)), "k").select("k", *[F.col(x).alias(f"{prefix}_{x}") for x in ("median", "p95", "longest")])
    one = lambda df: df.withColumn("k", F.lit(1))  # noqa: E731  rows of one, side by side
    out = one(cases).join(one(whole), "k").join(one(called), "k").join(named(records.select("latency_ms"), "request"), "k", "left").join(named(c.select("latency_ms"), "call"), "k", "left")
    return out.drop("k")


def primary_request(request: Column) -> Column:
    """A call's request without the field that two runs may differ in, as a canonical text: top-level fields by name."""
    m = F.from_json(request, "map<string,string>")
    kwargs = F.map_filter(F.from_json(F.element_at(m, "chat_template_kwargs"), "map<string,string>"), lambda k, v: k != "enable_thinking")
    text = lambda x: F.to_json(F.map_from_entries(F.array_sort(F.map_entries(x))))
    rest = F.map_filter(m, lambda k, v: k != "chat_template_kwargs")
    return F.concat(text(rest), F.when(F.size(kwargs) > 0, text(kwargs)).otherwise(F.lit("")))


def compare_runs(left: DataFrame, right: DataFrame) -> DataFrame:
    """name, run, call, issue: where first attempts of two runs differ, aligned by ordinal; retries do not count.

    issue: only_left or only_right (a record), metadata, call_count, request.
    """
    keys = ["name", "run"]
    a, b = (x.select(*keys, F.struct(*IDENTITY).alias(side)) for x, side in ((left, "l"), (right, "r")))
    both = a.join(b, keys, "full_outer")
    issue = F.when(F.col("r").isNull(), "only_left").when(F.col("l").isNull(), "only_right").when(~F.col("l").eqNullSafe(F.col("r")), "metadata")
    records = both.select(*keys, F.lit(None).cast("long").alias("call"), issue.alias("issue")).where("issue IS NOT NULL")

    def primary(x: DataFrame, name: str) -> DataFrame:
        from pyspark.sql import Window

        c = calls_of(x).where("NOT recovery")
        return c.withColumn("call", F.row_number().over(Window.partitionBy(*keys).orderBy("at")).cast("long")).select(*keys, "call", F.struct("stage", primary_request(F.col("request")).alias("request")).alias(name))

    paired = primary(left, "x").join(primary(right, "y"), [*keys, "call"], "full_outer").join(both.where("l IS NOT NULL AND r IS NOT NULL").select(*keys), keys, "left_semi")
    uneven = paired.groupBy(*keys).agg(F.count("x").alias("nx"), F.count("y").alias("ny")).where("nx <> ny").select(*keys, F.lit(None).cast("long").alias("call"), F.lit("call_count").alias("issue"))
    differ = paired.join(uneven.select(*keys), keys, "left_anti").where(~F.col("x").eqNullSafe(F.col("y"))).select(*keys, "call", F.lit("request").alias("issue"))
    return records.unionByName(uneven).unionByName(differ)
