"""Shared plumbing of the training-data operators: table access, durable cuts of lineage, scratch names."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: The separator bytes between words in every contract that says ``[^\x20\x09-\x0D]+``.
SPACES = " \t\n\x0b\x0c\r"

LOWER_FROM, LOWER_TO = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


#: So many bytes of a table in fewer files than there are cores may be dealt out by a shuffle.
SMALL = 256 << 20
#: Bytes of texts that go to a Python worker at a time, unless the session says less.
ARROW_BYTES = 8 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small input of fewer files than the session has cores is dealt out once; larger ones stay as they are."""
    spark = df.sparkSession
    if _bytes_of(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", "64m")) > ARROW_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size <= SMALL and len(df.inputFiles()) < min(cores, 64) else df


def _bytes_of(setting: str) -> int:
    number = setting.strip().lower().removesuffix("b")
    return int(number[:-1]) << {"k": 10, "m": 20, "g": 30}[number[-1]] if number[-1:] in ("k", "m", "g") else int(number)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; one of our own only where it is unset (local runs)."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = "/tmp/leaklens-checkpoints"
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def write_cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage ends here and no executor's loss undoes it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/leaklens-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: So many rows of a few numbers, 64 bytes each at most, may be sent to every executor. They are counted first.
FEW = 1_000_000


def sent_if_few(rows: DataFrame, most: int | None = None) -> DataFrame:
    """A written table of rows of a few numbers, marked for broadcast if it has at most ``most`` rows; otherwise the join shuffles."""
    return F.broadcast(rows) if rows.count() <= (FEW if most is None else most) else rows


def ascii_lower(column):
    return F.translate(column, LOWER_FROM, LOWER_TO)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once: a lambda body otherwise evaluates what it captures for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)
