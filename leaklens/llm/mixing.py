"""Operator 3: mixing sources to target weights by soft membership. DataFrame functions only.

1. A classifier is a table: how often each bucket of word endings occurs in each domain, learned from the documents of
   the labelled table (a bounded sample of at most ``LABELLED_ROWS`` of them, in hash order). A word's ending gives a
   posterior over the domains, a document's posterior is the mean over its words, so a text of two languages is
   partly in both.
2. Targets are token totals by domain. Nonnegative document rates minimise the squared distance between the expected
   domain totals, sum over documents of rate * tokens * posterior, and the targets, by projected gradient: each step is
   one distributed sum of as many numbers as there are domains, and a document's rate is an expression of its posterior
   and the residuals so far, so nothing but those few residuals is kept between steps.
3. ``copies`` is the rate rounded at random by a hash of the row, so that its expectation is the rate.

The native form keeps all work in whole rows: no shuffle but the sums.

Edge cases: a null, empty or wordless text has no tokens, a uniform posterior and the rate 1; a null domain teaches
nothing; an unseen ending is uniform; without labelled rows all posteriors are uniform; repeated rows count as often as
they occur, and equal ones have equal copies; a text of any length is read whole; of domains of equal posterior the first
by name is the likeliest; more than ``MAX_DOMAINS`` domains raise a ValueError; without documents there are no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .common import let, write_cut

BUCKETS = 4096
LABELLED_ROWS = 4000
MAX_DOMAINS = 64
TAIL = 3
ROOM = 1.1
GAP = r"[\x20\x09-\x0D]+"


def _buckets(text: Column) -> Column:
    """The bucket of each word's last characters, lower-cased, without ASCII punctuation."""
    clean = F.translate(F.lower(F.coalesce(text, F.lit(""))), ".,;:!?\"'()[]{}", "")
    return F.transform(F.filter(F.split(clean, GAP, -1), lambda w: w != ""), lambda w: F.pmod(F.xxhash64(F.right(w, F.lit(TAIL))), F.lit(BUCKETS)).cast("int"))


class Classifier:
    def __init__(self, docs: DataFrame, labels: DataFrame, domain: str):
        # At most LABELLED_ROWS ids: a proven bound for the broadcast.
        picked = labels.select("doc_id").where(F.col("doc_id").isNotNull()).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED_ROWS)
        known = docs.select("doc_id", "text", F.col(domain).cast("string").alias("domain")).where(F.col(domain).isNotNull()).join(F.broadcast(picked), "doc_id")
        counts = known.select("domain", F.explode(_buckets(F.col("text"))).alias("b")).groupBy("domain", "b").count().collect()  # BUCKETS * domains at most
        self.domains = sorted({r["domain"] for r in counts})
        if len(self.domains) > MAX_DOMAINS:
            raise ValueError(f"{len(self.domains)} domains; at most {MAX_DOMAINS} can be mixed")
        if not self.domains:
            self.domains = ["all"]
        d = len(self.domains)
        seen = np.zeros((BUCKETS, d))
        for r in counts:
            seen[r["b"], self.domains.index(r["domain"])] += r["count"]
        like = (seen + 0.1) / (seen.sum(axis=0) + 0.1 * BUCKETS)
        self.table = like / like.sum(axis=1, keepdims=True)
        self.table[seen.sum(axis=1) == 0] = 1 / d

    def membership(self, text: Column) -> Column:
        """struct<n_tokens long, p array<double>>: the mean posterior of the text's words."""
        d = len(self.domains)
        # One constant array a domain, folded by the optimizer; a word adds one entry of each.
        tables = [F.split(F.lit(",".join(f"{x:.6g}" for x in self.table[:, k])), ",").cast("array<double>") for k in range(d)]
        zero = F.struct(*[F.lit(0.0).alias(f"s{k}") for k in range(d)])

        def mean(bs: Column) -> Column:
            total = F.aggregate(bs, zero, lambda acc, b: F.struct(*[(acc[f"s{k}"] + F.get(tables[k], b)).alias(f"s{k}") for k in range(d)]))
            return let(total, lambda t: F.struct(F.size(bs).cast("long").alias("n_tokens"), F.when(F.size(bs) > 0, F.array(*[t[f"s{k}"] / F.size(bs) for k in range(d)])).otherwise(F.array(*[F.lit(1.0 / d)] * d)).alias("p")))

        return let(_buckets(text), mean)


def tempered(available: np.ndarray, power: float = 0.5) -> np.ndarray:
    """Shares that lie between the domains' own and equal ones."""
    share = np.maximum(available, 0) ** power
    return share / share.sum()


def _rate(p: Column, steps: list[np.ndarray], least: float) -> Column:
    """Gradient steps from rate 1, each projected onto rates of ``least`` or more. The steps are data, so that all rounds run the same code."""
    if not steps:
        return F.lit(1.0)
    moved = lambda rate, s: F.greatest(F.lit(float(least)), rate - sum((F.get(p, F.lit(k)) * F.get(s, F.lit(k)) for k in range(len(steps[0]))), F.lit(0.0)))
    listed = F.split(F.lit(";".join(",".join(repr(float(x)) for x in s) for s in steps)), ";")
    return F.aggregate(F.transform(listed, lambda s: F.split(s, ",").cast("array<double>")), F.lit(1.0), moved)


class Mixture:
    """Fitted rates, none under ``least``. members: a table with n_tokens and p."""

    def __init__(self, members: DataFrame, domains: list[str], targets: dict[str, float] | None = None, budget: float | None = None, steps: int = 24, tolerance: float = 1e-4, least: float = 0.0):
        d = len(domains)
        p = [F.get("p", F.lit(k)) for k in range(d)]
        row = members.agg(*[F.coalesce(F.sum(F.col("n_tokens") * p[k]), F.lit(0.0)) for k in range(d)], *[F.coalesce(F.sum(F.col("n_tokens") * p[i] * p[j]), F.lit(0.0)) for i in range(d) for j in range(d)]).first()
        self.domains, self.available, self.steps, self.least = domains, np.array(row[:d]), [], least
        gram, tokens = np.array(row[d:]).reshape(d, d), max(1.0, sum(row[:d]))
        share = np.array([max(0.0, targets.get(k, 0.0)) for k in domains]) if targets else tempered(self.available + 1e-9)
        share = share / share.sum()
        if budget is None:  # so many tokens that the most plentiful domain, against its target, is used once
            with np.errstate(divide="ignore", invalid="ignore"):
                budget = float(np.nanmax(np.where(share > 0, self.available / share, 0.0)))
            if least > 0:  # room for what repeated rows add to the domains that they are only partly in
                budget *= least * ROOM
        self.targets = share * budget
        # The distance to the targets is measured in the metric that makes all directions alike steep for the rows that
        # can still move, so that a step of 1 is right and few are needed; if it was too long, the metric of all rows is safe.
        whole, last = np.linalg.inv(gram / tokens + 1e-6 * np.eye(d)), np.inf
        for _ in range(steps):
            state = members.select("p", "n_tokens", _rate(F.col("p"), self.steps, least).alias("rate"))
            free = F.when(F.col("rate") > least, F.col("n_tokens")).otherwise(0)
            sums = [F.col("rate") * F.col("n_tokens") * p[k] for k in range(d)] + [free * p[i] * p[j] for i in range(d) for j in range(d)]
            row = np.array(state.agg(*[F.coalesce(F.sum(x), F.lit(0.0)) for x in sums]).first())
            residual = (row[:d] - self.targets) / tokens
            far = np.abs(residual).max()
            if far <= tolerance * max(1e-12, self.targets.sum() / tokens):
                break
            active = row[d:].reshape(d, d)
            fine = far < last and np.trace(active) > 0.05 * np.trace(gram)
            self.steps.append((np.linalg.inv(active / tokens + 1e-6 * np.eye(d)) if fine and self.steps else whole) @ residual)
            last = far
    def rate(self, n_tokens: Column, p: Column) -> Column:
        return F.when(n_tokens > 0, _rate(p, self.steps, self.least)).otherwise(F.lit(1.0))


def copies(rate: Column, *row: Column) -> Column:
    draw = F.pmod(F.xxhash64(*row, F.lit(3)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def fit(docs: DataFrame, labels: DataFrame, domain: str = "lang", targets: dict[str, float] | None = None, budget: float | None = None, least: float = 0.0):
    classifier = Classifier(docs, labels, domain)
    members = write_cut(docs.select("doc_id", F.xxhash64("text").alias("text_key"), classifier.membership(F.col("text")).alias("m")).select("doc_id", "text_key", "m.*"), "members")
    return classifier, members, Mixture(members, classifier.domains, targets, budget, least=least)


def rates(docs: DataFrame, labels: DataFrame, domain: str = "lang", targets: dict[str, float] | None = None, budget: float | None = None) -> DataFrame:
    """doc_id, n_tokens, domain (the likeliest), posterior, rate, copies: one row per row of ``docs``."""
    classifier, members, mixture = fit(docs, labels, domain, targets, budget)
    rate = mixture.rate(F.col("n_tokens"), F.col("p"))
    best = F.get(F.array(*[F.lit(x) for x in classifier.domains]), F.array_position("p", F.array_max("p")).cast("int") - 1)
    return members.select("doc_id", "n_tokens", best.alias("domain"), F.col("p").alias("posterior"), rate.alias("rate"), "text_key").withColumn("copies", copies(F.col("rate"), F.col("doc_id"), F.col("text_key"))).drop("text_key")


def mix(docs: DataFrame, labels: DataFrame, domain: str = "lang", targets: dict[str, float] | None = None, budget: float | None = None, least: int = 1) -> DataFrame:
    """``docs`` with each row as often as its copies say. The rates are fitted under the bound that each row stays ``least`` times, so the expected totals are the targets."""
    classifier, _, mixture = fit(docs, labels, domain, targets, budget, least)
    hold = "_"
    while any(c.startswith(hold) for c in docs.columns):
        hold += "_"
    m = hold + "m"
    wide = docs.withColumn(m, classifier.membership(F.col("text")))
    n = copies(mixture.rate(F.col(m)["n_tokens"], F.col(m)["p"]), F.col("doc_id"), F.xxhash64("text"))
    return wide.withColumn(hold + "i", F.explode(F.array_repeat(F.lit(1), n))).select(*docs.columns)
