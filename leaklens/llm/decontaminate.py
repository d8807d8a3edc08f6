"""Operator 10: benchmark decontamination with a broadcast hash set of normalised test n-grams. DataFrame functions only.

Benchmark items become windows of ``window`` consecutive normalised words (an item with fewer words is one window of
its own length). Document words are hashed window by window; hash hits are verified word for word; verified hits give
the covered words and the items. The windows are counted first. Up to ``MAX_BITMAP_WINDOWS`` they go with the plan as a
bitmap of their hashes. Above that, the documents' window hashes and places, without their words, are joined with the
set, which is broadcast up to ``MAX_BROADCAST_WINDOWS`` (16 bytes each) and meets them by a shuffle beyond; what meets
one is verified in the text. All ways give the same result.

Edge cases: a null or empty text, and one without words, has no words and no hits; a null or wordless item has no
windows; an item repeated under several ids counts once per id; repeated document rows each get their own row back;
an empty benchmark leaves everything clean; a text of any length is read whole, and overlapping windows count a word once.
Further columns of the documents pass through ``decontaminate`` and are
never looked at, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import ascii_lower, let, sent_if_few, write_cut

WORD_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
MAX_BITMAP_WINDOWS = 100_000
MAX_BROADCAST_WINDOWS = 4_000_000


def _hash(*ws: Column) -> Column:
    """A hash of the words in their order. ``slice`` would copy the whole array at each window, so words come one by one."""
    return F.xxhash64(*ws)


def hash_set(hashes: list[int]):
    """A test for membership in a set of hashes, as a bitmap of 16 bits or more a member that goes to every executor with
    the plan. It never misses a member; what else it lets through (under 7 %) falls at the verification.
    """
    bits = 1 << max(12, (16 * len(hashes)).bit_length())
    cells = [0] * (bits // 64)
    for h in hashes:
        at = h & (bits - 1)
        cells[at >> 6] |= 1 << (at & 63)
    signed = ",".join(str(c - (1 << 64) if c >> 63 else c) for c in cells)
    powers = F.split(F.lit(",".join(str(1 << k if k < 63 else -(1 << 63)) for k in range(64))), ",").cast("array<bigint>")
    bitmap = F.split(F.lit(signed), ",").cast("array<bigint>")  # a constant, folded once

    def test(h: Column) -> Column:
        at = h.bitwiseAND(F.lit(bits - 1).cast("long"))
        return F.get(bitmap, F.shiftright(at, 6).cast("int")).bitwiseAND(F.get(powers, at.bitwiseAND(F.lit(63).cast("long")).cast("int"))) != 0

    return test


def words(text: Column) -> Column:
    """Normalised words: A-Z lower-cased, maximal runs of ASCII letters, digits and non-ASCII characters."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), WORD_GAP, -1), lambda w: w != "")


NEAR = "array<struct<h:bigint,at:int,n:int,own:array<string>>>"


def _windows(ws: Column, sizes: list[int], begins, wanted, with_words: bool) -> Column:
    """Array of (h, at, n, own): the windows of each size whose first two words ``begin`` one and whose hash is ``wanted``, with their words or without."""
    own = lambda at, n: F.slice(ws, at, n) if with_words else F.lit(None).cast("array<string>")

    def of(n: int) -> Column:
        at = F.filter(F.sequence(F.lit(1), F.size(ws) - (n - 1)), lambda i: begins(_hash(*[F.get(ws, i + (k - 1)) for k in range(min(2, n))])))
        near = F.filter(F.transform(at, lambda i: F.struct(_hash(*[F.get(ws, i + (k - 1)) for k in range(n)]).alias("h"), i.alias("at"))), lambda x: wanted(x["h"]))
        return F.when(F.size(ws) >= n, F.transform(near, lambda x: F.struct(x["h"].alias("h"), x["at"].alias("at"), F.lit(n).alias("n"), own(x["at"], n).alias("own"))))

    return F.concat(*[F.coalesce(of(n), F.array().cast(NEAR)) for n in sizes])


def benchmark_windows(benchmark: DataFrame, window: int = 10) -> DataFrame:
    """(h, n, words, items): the distinct windows of the benchmark and the ids of the items they come from."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("ws")).where(F.size("ws") > 0)
    n = F.least(F.size("ws"), F.lit(window))
    cut = items.select("item", F.explode(F.transform(F.sequence(F.lit(1), F.size("ws") - n + 1), lambda i: F.slice("ws", i, n))).alias("words"))
    return cut.groupBy("words").agg(F.sort_array(F.collect_set("item")).alias("items")).select(
        F.coalesce(*[F.when(F.size("words") == k, _hash(*[F.get("words", F.lit(j)) for j in range(k)])) for k in range(1, window + 1)]).alias("h"), F.size("words").alias("n"), "words", "items",
        F.when(F.size("words") == 1, _hash(F.get("words", F.lit(0)))).otherwise(_hash(F.get("words", F.lit(0)), F.get("words", F.lit(1)))).alias("begin"),
    )


def hits(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """Per row of ``docs`` (columns doc_id, text): doc_id, text_key, text_len, n_words, n_hit, items (sorted ids)."""
    grams = write_cut(benchmark_windows(benchmark, window), "benchmark-windows")
    # Two bounded facts about the benchmark: the window lengths that occur (at most ``window``) and the set's size.
    sizes = {r["n"]: r["count"] for r in grams.groupBy("n").count().collect()}
    total = sum(sizes.values())
    small = total <= MAX_BITMAP_WINDOWS
    if small:
        known = grams.select("h", "begin").collect()
        begins, wanted = hash_set([r["begin"] for r in known]), hash_set([r["h"] for r in known])
    else:
        begins = wanted = lambda h: F.lit(True)
    key = ["doc_id", "text_key", "text_len"]
    whole = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.length("text").alias("text_len"), "text")
    windows = lambda ws: (_windows(ws, sorted(sizes), begins, wanted, small) if sizes else F.array().cast(NEAR)).alias("near")
    counted = F.size(words(F.col("text"))).cast("long").alias("n_words")
    if small:
        scanned = write_cut(whole.select(*key, let(words(F.col("text")), lambda ws: F.struct(F.size(ws).cast("long").alias("n_words"), windows(ws))).alias("r")).select(*key, "r.*"), "windows")
        met = scanned.select(*key, F.explode("near").alias("w")).select(*key, "w.*").join(grams.select("h", "n", "words", "items"), ["h", "n"]).where(F.col("own") == F.col("words"))
    else:
        scanned = write_cut(whole.select(*key, counted), "words")
        places = whole.select(*key, F.explode(let(words(F.col("text")), windows)).alias("w")).select(*key, "w.h", "w.at", "w.n")
        set_ = grams.select("h", "n").distinct()
        near = places.join(F.broadcast(set_) if total <= MAX_BROADCAST_WINDOWS else set_, ["h", "n"], "left_semi")
        met = _verified(near.join(grams.select("h", "n", "words", "items"), ["h", "n"]), docs, key)
    found = met.groupBy(*key).agg(F.sort_array(F.collect_set(F.struct("at", "n"))).alias("at"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    covered = F.aggregate(
        "at",
        F.struct(F.lit(0).cast("long").alias("hit"), F.lit(1).alias("free")),
        lambda acc, x: F.struct((acc["hit"] + F.greatest(F.lit(0), x["at"] + x["n"] - F.greatest(acc["free"], x["at"]))).alias("hit"), F.greatest(acc["free"], x["at"] + x["n"]).alias("free")),
        lambda acc: acc["hit"],
    )
    found = found.select(*[F.col(k).alias(f"hit_{k}") for k in key], covered.alias("n_hit"), "items")
    same = [F.col(k).eqNullSafe(F.col(f"hit_{k}")) for k in key]
    return scanned.join(found, same[0] & same[1] & same[2], "left").select(*key, "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def _verified(met: DataFrame, docs: DataFrame, key: list[str]) -> DataFrame:
    """Those of the met windows (key, at, n, words, items) that the texts have word for word. A document's are gathered first: they are bounded by its length."""
    by_doc = met.groupBy(*key).agg(F.collect_set(F.struct("at", "n", "words", "items")).alias("met"))
    texts = docs.select(F.col("doc_id").alias("own_id"), F.xxhash64("text").alias("own_key"), F.length("text").alias("own_len"), "text")
    same = F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("text_key") == F.col("own_key")) & F.col("text_len").eqNullSafe(F.col("own_len"))
    kept = let(words(F.col("text")), lambda ws: F.filter("met", lambda x: F.slice(ws, x["at"], x["n"]) == x["words"]))
    return by_doc.join(texts.dropDuplicates(["own_id", "own_key", "own_len"]), same).select(*key, F.explode(kept).alias("w")).select(*key, "w.*")


def report(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The contract's columns, one row per row of ``docs``."""
    return hits(docs, benchmark, window).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """``docs`` without the documents that hold a benchmark window, with all their columns."""
    bad = hits(docs, benchmark, window).where("n_hit > 0").select(F.col("doc_id").alias("bad_id"), F.col("text_key").alias("bad_key"), F.col("text_len").alias("bad_len")).distinct()
    return docs.join(sent_if_few(write_cut(bad, "bad")), F.col("doc_id").eqNullSafe(F.col("bad_id")) & (F.xxhash64("text") == F.col("bad_key")) & F.length("text").eqNullSafe(F.col("bad_len")), "left_anti")
