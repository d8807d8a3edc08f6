"""Operator 5: sharding by sampled splitters. Law ``bytes``: the shards' sizes are near equal.

Records are ordered by (crc32 of the text, doc_id, row number), so equal texts stand together. A Poisson sample whose
chance grows with a record's size is sorted on the driver (about ``SAMPLES_PER_RANGE`` keys a range); its weighted
quantiles are the splitters of ``n_ranges`` ranges. A range that still holds over ``OVERFULL`` times its share of rows
is subdivided by splitters sampled inside it. Within a range a window gives running rows and bytes; with the ranges' own
totals (a few hundred to ``MAX_RANGES`` numbers) each record knows the bytes before it in the whole order, and its shard
is that number's place among ``shards`` equal parts. So a shard differs from its share by less than one record,
whatever the sample was; the sample only decides how evenly the tasks are filled.

Edge cases: a null text has size 16 and crc32 0; repeated rows are separate records; a null doc_id sorts first; no
rows give no rows; fewer bytes than shards leave shards empty. Further columns pass through ``shard`` untouched, even
if they are called like those added (the added ones then come under a name with underscores).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.functions import arrow_udf

from .common import write_cut

SAMPLES_PER_RANGE = 16
MIN_RANGES, MAX_RANGES, ROWS_PER_RANGE = 320, 65_536, 250_000
OVERFULL = 4


def text_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long")


def text_crc(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")))


def _packed(crc, doc_id, copy) -> np.ndarray:
    """Keys as byte strings that sort like (crc, null first doc_id, copy)."""
    n = len(crc)
    out = np.zeros((n, 21), np.uint8)
    out[:, 0:4] = np.asarray(crc, np.uint64).astype(">u4").view(np.uint8).reshape(n, 4)
    known = np.array([x is not None for x in doc_id]) if not isinstance(doc_id, pa.Array) else np.asarray(doc_id.is_valid())
    ids = np.asarray(doc_id.fill_null(0) if isinstance(doc_id, pa.Array) else [x or 0 for x in doc_id], np.int64)
    out[:, 4] = known
    out[:, 5:13] = (ids.view(np.uint64) ^ np.uint64(1 << 63)).astype(">u8").view(np.uint8).reshape(n, 8)
    out[:, 13:21] = np.asarray(copy, np.int64).astype(np.uint64).astype(">u8").view(np.uint8).reshape(n, 8)
    return np.ascontiguousarray(out).view("S21").ravel()


def _range_of(splitters: np.ndarray, crc: Column, doc_id: Column, copy: Column) -> Column:
    @arrow_udf("int")
    def place(c: pa.Array, d: pa.Array, k: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(splitters, _packed(c.to_numpy(zero_copy_only=False), d, k.to_numpy(zero_copy_only=False)), "right").astype(np.int32))

    return place(crc, doc_id, copy)


def _sample(keyed: DataFrame, total: int, most: int) -> list:
    """Keys drawn with chance most * size / total, at most 1, by a hash of the key; with the weight each stands for."""
    chance = F.least(F.lit(1.0), F.lit(float(most)) * F.col("size") / F.lit(float(total)))
    draw = F.pmod(F.xxhash64("crc", "doc_id", "copy", F.lit(5)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return keyed.where(draw < chance).select("crc", "doc_id", "copy", (F.col("size") / chance).alias("weight")).collect()


def _quantiles(rows: list, n: int) -> np.ndarray:
    if not rows:
        return np.zeros(0, "S21")
    keys = _packed([r["crc"] for r in rows], [r["doc_id"] for r in rows], [r["copy"] for r in rows])
    order = np.argsort(keys)
    upto = np.cumsum(np.array([r["weight"] for r in rows])[order])
    at = np.searchsorted(upto, upto[-1] * np.arange(1, n) / n)
    return np.unique(keys[order][np.minimum(at, len(keys) - 1)])


class Plan:
    """Splitters, the totals before each range, and the first row of each shard."""

    def __init__(self, keyed: DataFrame, shards: int):
        """keyed: doc_id long, size, crc, copy, from a table that reads the same each time."""
        self.shards = shards
        rows, self.total = keyed.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
        n = min(MAX_RANGES, max(MIN_RANGES, rows // ROWS_PER_RANGE))
        self.splitters = _quantiles(_sample(keyed, self.total, n * SAMPLES_PER_RANGE), n) if rows else np.zeros(0, "S21")
        while True:  # keys are distinct, so each round splits what is overfull
            parts = self._parts(keyed)
            over = [r for r in parts if r["rows"] > max(1000, OVERFULL * rows / n)]
            if not over:
                break
            inside = keyed.withColumn("range", _range_of(self.splitters, F.col("crc"), F.col("doc_id"), F.col("copy"))).where(F.col("range").isin([r["range"] for r in over]))
            # rows count alike in here, else a range of many small records would stay as it is
            drawn = _sample(inside.withColumn("size", F.lit(1).cast("long")), sum(r["rows"] for r in over), len(over) * OVERFULL * SAMPLES_PER_RANGE)
            known = len(self.splitters)
            self.splitters = np.unique(np.concatenate([self.splitters, _quantiles(drawn, len(over) * OVERFULL)]))
            if len(self.splitters) == known:
                break
        parts = self._parts(keyed)
        self.before: dict[int, tuple[int, int]] = {}
        r0 = b0 = 0
        for p in sorted(parts, key=lambda r: r["range"]):
            self.before[p["range"]] = (r0, b0)
            r0, b0 = r0 + p["rows"], b0 + p["bytes"]
        first = self._placed(keyed).groupBy("shard").agg(F.min("at").alias("first")).collect()
        self.first = {r["shard"]: r["first"] for r in first}

    def _parts(self, keyed: DataFrame) -> list:
        return keyed.withColumn("range", _range_of(self.splitters, F.col("crc"), F.col("doc_id"), F.col("copy"))).groupBy("range").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes")).collect()

    def _placed(self, keyed: DataFrame, hold: str = "") -> DataFrame:
        """keyed with ``at`` (its place in the whole order) and ``shard``; column names carry the prefix ``hold``."""
        c = lambda name: F.col(hold + name)
        spark = keyed.sparkSession
        ranged = keyed.withColumn(hold + "range", _range_of(self.splitters, c("crc"), F.col("doc_id"), c("copy")))
        # at most MAX_RANGES * OVERFULL rows
        starts = F.broadcast(spark.createDataFrame([(k, r, b) for k, (r, b) in self.before.items()], f"{hold}range int, {hold}rows0 long, {hold}bytes0 long"))
        w = Window.partitionBy(hold + "range").orderBy(c("crc"), F.col("doc_id").asc_nulls_first(), c("copy"))
        run = ranged.withColumn(hold + "row", F.row_number().over(w)).withColumn(hold + "upto", F.sum(c("size")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        run = run.join(starts, hold + "range")
        part = F.floor((c("bytes0") + c("upto") - c("size")).cast("decimal(38,0)") * self.shards / F.lit(max(1, self.total)))
        return run.withColumn(hold + "at", c("rows0") + c("row") - 1).withColumn(hold + "shard", part.cast("int"))

    def apply(self, keyed: DataFrame, hold: str = "") -> DataFrame:
        placed = self._placed(keyed, hold)
        first = F.create_map(*[F.lit(x) for kv in self.first.items() for x in kv]) if self.first else F.create_map().cast("map<int,bigint>")
        return placed.withColumn(hold + "slot", F.col(hold + "at") - F.element_at(first, F.col(hold + "shard")))


def keys_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_size(F.col("text")).alias("size"), text_crc(F.col("text")).alias("crc"), F.monotonically_increasing_id().alias("copy"))


def assign(docs: DataFrame, shards: int = 40) -> DataFrame:
    """The contract's columns, one row per row of ``docs``."""
    keyed = write_cut(keys_of(docs), "shard-keys")
    return Plan(keyed, shards).apply(keyed).select("doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def shard(docs: DataFrame, shards: int = 40) -> DataFrame:
    """``docs`` (read from a table) with columns shard and slot, whole records brought into their ranges and order."""
    hold = "_"
    while any(c.startswith(hold) for c in docs.columns):
        hold += "_"
    wide = docs.withColumns({hold + "size": text_size(F.col("text")), hold + "crc": text_crc(F.col("text")), hold + "copy": F.monotonically_increasing_id()})
    keyed = write_cut(wide.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(hold + c).alias(c) for c in ("size", "crc", "copy")]), "shard-keys")
    out = Plan(keyed, shards).apply(wide, hold)
    names = [n if n not in docs.columns else hold + n for n in ("shard", "slot")]
    return out.select(*docs.columns, F.col(hold + "shard").alias(names[0]), F.col(hold + "slot").alias(names[1]))
