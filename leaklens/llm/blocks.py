"""Blocks of texts that ask questions by ranges of hashes and get the answers back.

A corpus is written once as blocks of compressed rows. A block sends its distinct keys, packed by ranges of their
hashes; the task of a range sees what all blocks have there and answers each of them. A key that a third of the corpus
holds so comes once from each block, and no text travels: the table of blocks is bucketed by block, so answers are
brought to the blocks and not the blocks to the answers.

The blocks of one writing task have numbers that fall into one bucket, so a task writes one file. Blocks grow with the
corpus (``block_bytes``), so that a packed message holds many keys at any size.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import shared_dir
from .textops import slices

MAX_BUCKETS = 100_000  # what Spark allows by default
BUCKET = 8 << 20
MAX_TASKS = 100_000

MESSAGE = "block long, task long, bucket int, h binary, x binary, y binary, z binary"
ANSWER = "block long, bucket int, n long, x binary, y binary"
_MESSAGE = pa.schema([("block", pa.int64()), ("task", pa.int64()), ("bucket", pa.int32()), ("h", pa.binary()), ("x", pa.binary()), ("y", pa.binary()), ("z", pa.binary())])
_ANSWER = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("n", pa.int64()), ("x", pa.binary()), ("y", pa.binary())])


def block_bytes(size: int) -> int:
    """Bytes of text in a block of a corpus of ``size`` bytes."""
    return min(256 << 20, max(6 << 20, size // 125_000))


def range_bits(size: int, of: int) -> int:
    """So many leading bits of a hash that a range holds about ``of`` bytes' keys."""
    return max(1, (size // of).bit_length())


def _spark_hash(x: np.ndarray) -> np.ndarray:
    """The hash of a long by which Spark deals rows to buckets (Murmur3, seed 42)."""
    u = np.uint32
    turn = lambda v, r: (v << u(r)) | (v >> u(32 - r))
    x = x.astype(np.uint64)
    with np.errstate(over="ignore"):
        h = np.full(len(x), 42, u)
        for half in ((x & np.uint64(0xFFFFFFFF)).astype(u), (x >> np.uint64(32)).astype(u)):
            h = turn(h ^ turn(half * u(0xCC9E2D51), 15) * u(0x1B873593), 13) * u(5) + u(0xE6546B64)
        h ^= u(8)
        h = (h ^ (h >> u(16))) * u(0x85EBCA6B)
        h = (h ^ (h >> u(13))) * u(0xC2B2AE35)
        return (h ^ (h >> u(16))).view(np.int32)


def _numbers(task: int, buckets: int) -> Iterator[int]:
    """Block numbers of one task: all in the bucket task mod buckets."""
    at = task << 32
    while True:
        tried = np.arange(at, at + 4096)
        yield from tried[np.mod(_spark_hash(tried).astype(np.int64), buckets) == task % buckets].tolist()
        at += 4096


def _packed(text: int, most: int, buckets: int):
    """Rows as compressed blocks of about ``most`` bytes of column ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = _numbers(TaskContext.get().partitionId(), buckets)
        held, size = [], 0

        def flush():
            rows = pa.Table.from_batches(held).combine_chunks()
            sizes = pa.compute.fill_null(pa.compute.binary_length(rows.column(text)), 0).to_numpy().astype(np.int64)
            for i, j in slices(np.concatenate([[0], np.cumsum(sizes)]), most):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_table(rows.slice(i, j - i))
                yield pa.RecordBatch.from_arrays([pa.array([next(numbers)], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "x"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.column(text).nbytes
            if size >= most:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    return run


def write_blocks(rows: DataFrame, text: str, size: int) -> DataFrame:
    """(block, x): ``rows`` in a table of its own in the shared folder, bucketed by block. size: bytes of text."""
    spark = rows.sparkSession
    buckets = min(MAX_BUCKETS, max(2 * spark.sparkContext.defaultParallelism, size // BUCKET))
    name = f"leaklens_blocks_{uuid.uuid4().hex}"
    packed = rows.mapInArrow(_packed(rows.columns.index(text), block_bytes(size), buckets), "block long, x binary")
    packed.write.format("parquet").option("compression", "none").option("path", f"{shared_dir(spark)}/{name}").bucketBy(buckets, "block").saveAsTable(name)
    return spark.table(name)


def read_block(payload: bytes) -> pa.Table:
    with pa.ipc.open_stream(payload) as stream:
        return stream.read_all().combine_chunks()


# --- packing ----------------------------------------------------------------------------------------------------------


def squeezed(values: np.ndarray) -> bytes:
    """Compressed byte by byte of the values: the high bytes of small numbers are all alike."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize).T
    return pa.compress(np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True)


def unsqueezed(raw: bytes, kind, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, kind)
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(raw, decompressed_size=n * size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(kind).ravel()


def _pack(h: np.ndarray, base: int) -> bytes:
    """Sorted hashes of a range as steps of as few bytes as the longest needs."""
    steps = np.diff(h, prepend=np.array([base], np.uint64))
    width = max(1, (int(steps.max()).bit_length() + 7) // 8)
    return bytes([width]) + steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpack(raw: bytes, base: int) -> np.ndarray:
    body = np.frombuffer(raw, np.uint8, offset=1).reshape(-1, raw[0])
    steps = np.zeros((len(body), 8), np.uint8)
    steps[:, : raw[0]] = body
    return np.cumsum(steps.view("<u8").ravel().astype(np.uint64), dtype=np.uint64) + np.uint64(base)


def _base(bucket: int, bits: int) -> int:
    return (bucket & ((1 << bits) - 1)) << (64 - bits)


#: What a block asks: the kind of key, its sorted hashes, and up to three columns: values, or a function of a slice of places that gives bytes.
Part = tuple[int, np.ndarray, list]


def messages(block: int, bits: int, parts: list[Part]) -> pa.Table:
    """A row for each kind and range of hashes (``bucket``)."""
    out: dict[str, list] = {name: [] for name in _MESSAGE.names}
    dealt = _dealt_to(range_tasks(bits))
    for kind, h, columns in parts:
        which = (h >> np.uint64(64 - bits)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(which, prepend=-1))
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(h)]):
            bucket = kind << bits | int(which[a])
            out["block"].append(block)
            out["task"].append(int(dealt[which[a] % len(dealt)]))
            out["bucket"].append(bucket)
            out["h"].append(_pack(h[a:b], _base(bucket, bits)))
            for name, column in zip("xyz", [*columns, None, None, None]):
                out[name].append(None if column is None else squeezed(column(a, b) if callable(column) else column[a:b]))
    return pa.table(out, _MESSAGE)


class Range:
    """What all blocks ask in one range: the kind, the hashes end to end, and where each block's part begins."""

    def __init__(self, rows: pa.Table, bits: int):
        self.rows, self.bucket = rows, rows["bucket"][0].as_py()
        self.kind = self.bucket >> bits
        base = _base(self.bucket, bits)
        parts = [_unpack(h.as_py(), base) for h in rows["h"]]
        self.lengths = [len(p) for p in parts]
        self.cuts = np.cumsum([0, *self.lengths])
        self.h = np.concatenate(parts)

    def values(self, name: str, kind) -> np.ndarray:
        return np.concatenate([unsqueezed(x.as_py(), kind, n) for x, n in zip(self.rows[name], self.lengths)])

    def raw(self, name: str, sizes: np.ndarray) -> np.ndarray:
        """Bytes end to end of keys that have so many each."""
        upto = np.concatenate([[0], np.cumsum(sizes)])
        return np.concatenate([unsqueezed(x.as_py(), np.uint8, int(upto[b] - upto[a])) for x, a, b in zip(self.rows[name], self.cuts[:-1], self.cuts[1:])])

    def answers(self, x: np.ndarray, y: Callable[[int, int], np.ndarray] | None = None, summary: tuple[int, int] | None = None) -> pa.Table:
        """x: a value for each key; y: further ones for the keys of a slice, n of them. A summary is a row without a block: its numbers are in n and bucket -1 and -2."""
        cuts = list(zip(self.cuts[:-1].tolist(), self.cuts[1:].tolist()))
        more = [None if y is None else y(a, b) for a, b in cuts]
        out = {
            "block": self.rows["block"].to_pylist(),
            "bucket": [self.bucket] * len(cuts),
            "n": [None if m is None else len(m) for m in more],
            "x": [squeezed(x[a:b]) for a, b in cuts],
            "y": [None if m is None else squeezed(m) for m in more],
        }
        for k, n in enumerate(summary or (), 1):
            for name, value in (("block", None), ("bucket", -k), ("n", n), ("x", None), ("y", None)):
                out[name].append(value)
        return pa.table(out, _ANSWER)


def answered(answers: pa.Table, kind: int, bits: int) -> list[tuple[int, bytes, int | None, bytes | None]]:
    """(range, x, n, y) of a block's answers to keys of one kind, in order of the ranges."""
    got = zip(answers["bucket"].to_pylist(), answers["x"], answers["n"], answers["y"])
    return sorted((b & ((1 << bits) - 1), x.as_py(), n.as_py(), y.as_py()) for b, x, n, y in got if b >> bits == kind)


def told(answers: pa.Table, kind: int, bits: int, h: np.ndarray, dtype) -> np.ndarray:
    """The answers' values for a block's sorted hashes of one kind."""
    buckets, sizes = np.unique((h >> np.uint64(64 - bits)).astype(np.int64), return_counts=True)
    raw = {b: x for b, x, _, _ in answered(answers, kind, bits)}
    return np.concatenate([np.zeros(0, dtype), *[unsqueezed(raw[b], dtype, k) for b, k in zip(buckets.tolist(), sizes.tolist())]])


# --- rounds -----------------------------------------------------------------------------------------------------------


def asked(blocks: DataFrame, ask: Callable[[int, bytes], pa.Table]) -> DataFrame:
    """Messages of blocks that know nothing yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
                yield from ask(number, payload.as_py()).to_batches()

    return blocks.mapInArrow(run, MESSAGE)


def range_tasks(bits: int) -> int:
    return min(MAX_TASKS, 1 << bits)


_dealt: dict[int, np.ndarray] = {}


def _dealt_to(tasks: int) -> np.ndarray:
    """A number for each task that Spark deals to just this task."""
    if tasks not in _dealt:
        out, at = np.full(tasks, -1, np.int64), 0
        while (out < 0).any():
            tried = np.arange(at, at + (1 << 16))
            place = np.mod(_spark_hash(tried).astype(np.int64), tasks)
            new = out[place] < 0
            out[place[new]] = tried[new]
            at += len(tried)
        _dealt[tasks] = out
    return _dealt[tasks]


def answers_of(questions: DataFrame, answer: Callable[[pa.Table], pa.Table], bits: int) -> DataFrame:
    """The answers of the ranges' tasks, which have a range each. Its keys are in one group, which is bounded: hashes spread and each block asks once."""
    return questions.repartition(range_tasks(bits), "task").groupBy("task", "bucket").applyInArrow(answer, ANSWER)


def with_answers(blocks: DataFrame, answers: DataFrame, run: Callable[[int, bytes, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``run`` over each block and its answers, which are brought to the buckets of the blocks."""

    def each(left: pa.Table, right: pa.Table) -> pa.Table:
        return run(left["block"][0].as_py(), left["x"][0].as_py(), right)

    return blocks.groupBy("block").cogroup(answers.where("block IS NOT NULL").groupBy("block")).applyInArrow(each, schema)
