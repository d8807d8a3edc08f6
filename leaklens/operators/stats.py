"""Aggregates over verdicts, errors, latencies and evaluations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def verdict_counts(verdicts: DataFrame, *by: str) -> DataFrame:
    v = F.col("verdict")
    return verdicts.groupBy(*by).agg(F.count_if(v == "confirmed").alias("confirmed"), F.count_if(v == "dismissed").alias("dismissed"), F.count_if(v == "unreviewed").alias("unreviewed"))


def request_stats(requests: DataFrame, raw: DataFrame, findings: DataFrame, verdicts: DataFrame, calls: DataFrame | None = None, most: int = 200) -> DataFrame:
    """One row per request: raw findings, findings after dedup, verdicts by outcome, calls, whether findings were cut."""
    count = lambda df, name: df.groupBy("request_id").agg(F.count("*").alias(name))
    out = requests.select("request_id").join(count(raw, "raw_findings"), "request_id", "left").join(count(findings, "after_dedup"), "request_id", "left").join(verdict_counts(verdicts, "request_id"), "request_id", "left")
    if calls is not None:
        out = out.join(count(calls, "llm_calls"), "request_id", "left")
    return out.na.fill(0).withColumn("truncated", F.col("after_dedup") > most)


def error_list(errors: DataFrame) -> DataFrame:
    """request_id, errors (by name; null if none), summary."""
    listed = F.array_sort(F.collect_list(F.struct("detector", "error")))
    return errors.groupBy("request_id").agg(listed.alias("errors")).select(
        "request_id", F.when(F.size("errors") > 0, F.col("errors")).alias("errors"), F.concat_ws("; ", F.transform("errors", lambda e: F.concat(e["detector"], F.lit(": "), e["error"]))).alias("summary")
    )


def histogram(df: DataFrame, value: str, bounds: list[float], *by: str) -> DataFrame:
    """Cumulative buckets: by.., le, n; with the last one unbounded. One pass: the bounds are columns, then rows."""
    counts = [F.count_if(F.col(value) <= b).alias(f"le_{k}") for k, b in enumerate(bounds)] + [F.count(value).alias(f"le_{len(bounds)}")]
    wide = df.groupBy(*by).agg(*counts, F.coalesce(F.sum(value), F.lit(0)).alias("sum"))
    names = [*[f"{b:g}" for b in bounds], "+Inf"]
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("le"), F.col(f"le_{k}").alias("n")) for k, n in enumerate(names)]))
    return wide.select(*by, "sum", rows.alias("b")).select(*by, "b.le", "b.n", "sum")


def ranked(df: DataFrame, value: str, by: str, picks: dict[str, Column]) -> DataFrame:
    """by, n and the values at some ranks (from 0, expressions of n). Equal values are counted first and running sums sort the rest, so no group is held in memory."""
    counted = df.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(by)
    x = counted.withColumn("n", F.sum("c").over(w)).withColumn("upto", F.sum("c").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)))
    at = lambda rank: F.max(F.when((rank < F.col("upto")) & (rank >= F.col("upto") - F.col("c")), F.col(value)))
    return x.groupBy(by).agg(F.max("n").alias("n"), *[at(rank).alias(name) for name, rank in picks.items()])


def nearest(fraction: float) -> Column:
    """The rank of a nearest-rank quantile."""
    return F.greatest(F.lit(0), F.ceil(F.col("n") * F.lit(fraction)) - 1)


def middles() -> tuple[Column, Column]:
    half = (F.col("n") - 1) / 2
    return F.floor(half), F.ceil(half)


def bench_median() -> Column:
    """The upper middle one."""
    return F.floor(F.col("n") / 2)


def bench_p95() -> Column:
    return F.least(F.col("n") - 1, F.floor(F.col("n") * 0.95))


def agreement(results: DataFrame) -> DataFrame:
    """results (fixture, tags, hits, total) by tag, with one row '*' over all fixtures; a fixture counts in each of its tags."""
    by_tag = results.select("hits", "total", F.explode(F.concat(F.array(F.lit("*")), "tags")).alias("tag")).groupBy("tag").agg(F.sum("hits").alias("hits"), F.sum("total").alias("total"))
    return by_tag.withColumn("agreement", F.when(F.col("total") > 0, F.col("hits") / F.col("total")).otherwise(F.lit(1.0)))


def pair_completeness(fixtures: DataFrame) -> DataFrame:
    """pair, positives, negatives, complete: exactly one of each."""
    g = fixtures.groupBy("pair").agg(F.count_if(F.col("polarity") == "positive").alias("positives"), F.count_if(F.col("polarity") == "negative").alias("negatives"))
    return g.withColumn("complete", (F.col("positives") == 1) & (F.col("negatives") == 1))


def secret_recall(expected: DataFrame, verdicts: DataFrame, found: DataFrame) -> DataFrame:
    """Expected secrets (request_id, path, line, kind) that a confirmed verdict or a discovery meets."""
    places = verdicts.where("verdict = 'confirmed'").select("request_id", "path", "line", F.lit(None).cast("string").alias("k")).unionByName(found.select("request_id", "path", "line", F.col("kind").alias("k")))
    e, p = expected.alias("e"), places.alias("p")
    same = (F.col("e.request_id") == F.col("p.request_id")) & (F.col("e.path") == F.col("p.path")) & (F.col("e.line") == F.col("p.line"))
    return e.join(p, same & (F.col("p.k").isNull() | (F.col("p.k") == F.col("e.kind"))), "left_semi")


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of one side only, with ``side``."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def run_comparison(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys on one side only, or whose values differ: keys.., status."""
    x = a.select(*keys, F.col(value).alias("va"), F.lit(True).alias("in_a")).join(b.select(*keys, F.col(value).alias("vb"), F.lit(True).alias("in_b")), keys, "full_outer")
    status = F.when(F.col("in_a").isNull(), "only_right").when(F.col("in_b").isNull(), "only_left").when(~F.col("va").eqNullSafe(F.col("vb")), "differs").otherwise("equal")
    return x.select(*keys, status.alias("status"))


def rates_by_window(events: DataFrame, ts: str, ok: Column, minutes: int = 5, watermark: str | None = None) -> DataFrame:
    """window_start, n, good, rate per tumbling window; with a watermark it also runs on a stream."""
    x = events.withColumn(ts, F.col(ts).cast("timestamp"))  # a watermark needs a timestamp with a zone
    x = x.withWatermark(ts, watermark) if watermark else x
    g = x.groupBy(F.window(ts, f"{minutes} minutes")).agg(F.count("*").alias("n"), F.count_if(ok).alias("good"))
    return g.select(F.col("window.start").alias("window_start"), "n", "good", (F.col("good") / F.col("n")).alias("rate"))
