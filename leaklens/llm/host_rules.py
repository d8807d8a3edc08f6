"""Operator 2: host-level quality rules. DataFrame functions only.

Per document, counts over its whole text, and rules on them: ``base`` (the contract's), ``symbols`` (over one symbol to
five words), ``dup_lines`` (over six tenths of the lines with a word repeat an earlier one) and ``word_length`` (words
of under 2 or over 15 characters on average). Each rule's failures are aggregated by host (``source``), the host's
failure rate is shrunk towards the corpus by a beta prior fitted by moments to the hosts' own rates, and the verdict on
the host is joined back to its documents.

The prior of a rule: with k_h failures of n_h documents, m = sum k / sum n, and v the n-weighted variance of k_h / n_h
less what binomial noise alone gives it, m (1 - m) H / N for H hosts of N documents; the strength is
s = m (1 - m) / v - 1, kept within 1 .. ``MAX_STRENGTH``. A host's posterior rate is (k_h + s m) / (n_h + s). Against
the corpus' rate m it says what a failure means there:

* over max(``BAD_RATE``, ``FAR`` m) in any rule, the host is rejected with all its documents;
* under m / ``FAR``, a document's failure of a rule other than base is an odd page of a clean host and is excused;
* otherwise a document that fails the rule goes.

A document that fails the base rules is never kept.

Edge cases: a null text has no words and fails; a null host is a host of its own (the unnamed one); a text without words
fails no rule but base; with no documents there are no rows; equal rates at all hosts give the largest strength;
repeated rows count as often as they occur; texts of any length are counted whole. One row per input row; other columns
are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import SPACES, let, write_cut

GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
MAX_STRENGTH = 10_000.0
BAD_RATE, FAR = 0.3, 4.0


def repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the text, each word once.

    The windows' hashes, where some repeat, sort next to their equals; the starts of repeated ones, in order, cover
    3 words each less what the next one covers too.
    """

    def starts_of(hs: Column) -> Column:
        placed = F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("at")))
        return let(F.sort_array(placed), lambda s: F.sort_array(F.filter(F.transform(s, lambda x, j: F.when((F.get(s, j - 1)["h"] == x["h"]) | (F.get(s, j + 1)["h"] == x["h"]), x["at"])), lambda x: x.isNotNull())))

    def covered(at: Column) -> Column:
        return F.aggregate(F.transform(at, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(at, j + 1) - p, F.lit(3)))), F.lit(0).cast("long"), lambda acc, x: acc + x)

    none = F.lit(0).cast("long")
    hashes = lambda ws: F.transform(F.sequence(F.lit(2), F.size(ws) - 1), lambda i: F.xxhash64(F.get(ws, i - 2), F.get(ws, i - 1), F.get(ws, i)))
    return let(words, lambda ws: F.when(F.size(ws) >= 3, let(hashes(ws), lambda hs: F.when(F.size(F.array_distinct(hs)) == F.size(hs), none).otherwise(let(starts_of(hs), covered)))).otherwise(none))


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, host and the contract's counts, one row per input row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    ws = F.filter(F.split(text, GAP, -1), lambda w: w != "")
    squeezed = F.length(F.translate(text, SPACES, ""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.translate(x, SPACES, "") != "")
    return docs.select(
        "doc_id",
        F.col("source").alias("host"),
        F.transform(F.array(ws), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeat_words(w).alias("n_repeat_words")))[0].alias("w"),
        squeezed.cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("l"),
    ).select("doc_id", "host", "w.n_words", "word_chars", "n_symbols", F.col("l.n").alias("n_lines"), F.col("l.dup").alias("n_dup_lines"), "w.n_repeat_words").withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


#: The rules, as tests on a document's measures.
RULES = {
    "base": "base_failed",
    "symbols": "5 * n_symbols > n_words AND n_words > 0",
    "dup_lines": "10 * n_dup_lines > 6 * n_lines",
    "word_length": "word_chars < 2 * n_words OR word_chars > 15 * n_words",
}


def host_verdicts(measured: DataFrame, max_strength: float = MAX_STRENGTH) -> DataFrame:
    """host, n_docs, and for each rule rate_<rule> (posterior), excused_<rule>; host_kept: one row per host."""
    hosts = measured.groupBy("host").agg(F.count("*").alias("n"), *[F.count_if(F.expr(test)).alias(f"k_{r}") for r, test in RULES.items()])
    # One row of sums over all hosts, whatever their number.
    sums = hosts.agg(F.count("*").alias("hosts"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), *[x for r in RULES for x in (F.sum(f"k_{r}").alias(f"k_{r}"), F.sum(F.col(f"k_{r}") * F.col(f"k_{r}") / F.col("n")).alias(f"q_{r}"))]).first()
    columns, kept = [], F.lit(True)
    for r in RULES:
        m, s = beta_prior(sums["hosts"], sums["n"], sums[f"k_{r}"], sums[f"q_{r}"], max_strength)
        rate = (F.col(f"k_{r}") + F.lit(s * m)) / (F.col("n") + F.lit(s))
        columns += [rate.alias(f"rate_{r}"), (rate < m / FAR).alias(f"excused_{r}")]
        kept &= rate <= max(BAD_RATE, FAR * m)
    return hosts.select("host", F.col("n").alias("n_docs"), *columns, kept.alias("host_kept"))


def beta_prior(hosts: int, n: int, k: int | None, q: float | None, max_strength: float) -> tuple[float, float]:
    """(mean, strength) from the number of hosts and of documents, the failures, and the sum of k_h * k_h / n_h."""
    m = k / n if n else 0.0
    v = q / n - m * m - m * (1 - m) * hosts / n if n else 0.0
    return m, max_strength if v <= 1e-12 else max(1.0, min(max_strength, m * (1 - m) / v - 1))


def assess(docs: DataFrame) -> DataFrame:
    """The contract's columns, and host_kept. Hosts may be many, so the verdicts are joined by an ordinary join that AQE plans by size."""
    measured = write_cut(measures(docs), "host-rules")
    verdicts = host_verdicts(measured).withColumnRenamed("host", "verdict_host")
    out = measured.join(verdicts, F.col("host").eqNullSafe(F.col("verdict_host")), "left")
    failed = [F.expr(test) & ~F.col(f"excused_{r}") for r, test in RULES.items() if r != "base"]
    kept = ~F.col("base_failed") & F.col("host_kept")
    for f in failed:
        kept &= ~f
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "host_kept")
