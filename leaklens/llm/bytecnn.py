"""Operator 6: a byte-level convolutional network in numpy that scores document quality.

A text is its UTF-8 bytes; each byte is one of 512 symbols, its value and whether its word equals the word before.
Learned filters run over every position, are rectified and max-pooled over overlapping chunks that cover the whole
document (``CHUNK`` bytes, one starting every half chunk); the mean and the maximum over the chunks are combined into
one probability. Training is plain backpropagation with Adam, on the driver, on a bounded sample of labelled rows:
at most ``SAMPLE_ROWS`` of each class, each of at most ``SAMPLE_BYTES`` bytes (longer ones are not sampled, and are
scored whole like all others). The sample has both classes alike; the score is corrected to their share among all
labelled training rows. Scoring is an Arrow UDF over texts, so memory is bounded by one slice of 64 kB
or the longest text.

Edge cases: a null or empty text is one padded position and gets a score like any other; labels other than 0 and 1
are ignored; with no usable label all scores are 0.5, with one class only they are its Laplace-smoothed share.
Repeated rows each get their score. Other columns are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from .textops import Words, slices, text_bytes

CHUNK = 256
HALF = CHUNK // 2
WIDTH, FILTERS, DEPTH = 5, 8, 6
SYMBOLS = 512
SAMPLE_ROWS, SAMPLE_BYTES = 1500, 32_768
KEEP_AT = 0.7


def symbols(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of texts end to end, each followed by WIDTH pads (symbol 0); where each begins; its positions (bytes + 1)."""
    offsets = offsets - offsets[0]
    lengths = np.diff(offsets)
    starts = offsets[:-1] + WIDTH * np.arange(len(lengths))
    out = np.zeros(len(raw) + WIDTH * len(lengths), np.int64)
    place = np.arange(len(raw)) + np.repeat(WIDTH * np.arange(len(lengths)), lengths)
    values = raw.astype(np.int64)
    words = Words(raw, offsets)
    if len(words.starts) > 1:
        h = words.hashes()
        again = np.zeros(len(h), bool)
        again[1:] = h[1:] == h[:-1]
        again[words.bounds[:-1][words.bounds[:-1] < len(h)]] = False
        mark = np.zeros(len(raw) + 1, np.int64)
        mark[words.starts[again]] += 1
        mark[words.ends[again]] -= 1
        values += 256 * np.cumsum(mark[:-1])
    out[place] = values
    return out, starts, lengths + 1


def blocks(starts: np.ndarray, positions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each half chunk begins, and its row."""
    per = (positions + HALF - 1) // HALF
    row = np.repeat(np.arange(len(starts)), per)
    first = np.cumsum(per) - per
    return np.repeat(starts, per) + HALF * (np.arange(len(row)) - first[row]), row


class Model:
    """Filters, embedding and the final combination; ``constant`` overrides them where there was nothing to learn from."""

    def __init__(self, seed: int = 11):
        r = np.random.default_rng(seed)
        self.embed = r.normal(0, 0.5, (SYMBOLS, DEPTH)).astype(np.float32)
        self.filters = r.normal(0, 0.3, (WIDTH, DEPTH, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.out = r.normal(0, 0.1, 2 * FILTERS).astype(np.float32)
        self.offset = np.zeros(1, np.float32)
        self.shift = 0.0
        self.constant: float | None = None

    def tables(self) -> np.ndarray:
        """What each symbol adds to each filter at each place under it."""
        return np.einsum("se,wef->wsf", self.embed, self.filters).astype(np.float32)

    def convolve(self, table: np.ndarray, syms: np.ndarray, starts: np.ndarray, positions: np.ndarray) -> np.ndarray:
        """Rectified responses at each position; 0 at the pads that would look into the next text."""
        n = len(syms)
        out = np.broadcast_to(self.bias, (n, FILTERS)).copy()
        hold = np.empty_like(out)
        for w in range(WIDTH):
            m = n - w
            np.take(table[w], syms[w:], axis=0, out=hold[:m])
            out[:m] += hold[:m]
        np.maximum(out, 0, out=out)
        ends = starts + positions
        for k in range(WIDTH - 1):
            out[ends + k] = 0
        return out

    def probabilities(self, raw: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> np.ndarray:
        syms, starts, positions = symbols(raw, offsets)
        response = self.convolve(table, syms, starts, positions)
        at, row = blocks(starts, positions)
        half = np.maximum.reduceat(response, at, axis=0)
        pooled, _ = pool(half, row, len(starts))
        z = pooled @ self.out + self.offset[0] + self.shift
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -40, 40)))


def pool(half: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, tuple]:
    """(n, 2 FILTERS): mean and maximum over the chunks, each the larger of two neighbouring halves (a last one stands alone)."""
    chunk = half.copy()
    joined = row[:-1] == row[1:]
    chunk[:-1][joined] = np.maximum(half[:-1][joined], half[1:][joined])
    first = np.searchsorted(row, np.arange(n))
    counts = np.bincount(row, minlength=n).astype(np.float32)
    mean = np.add.reduceat(chunk, first, axis=0) / counts[:, None]
    top = np.maximum.reduceat(chunk, first, axis=0)
    return np.concatenate([mean, top], axis=1), (chunk, joined, first, counts, top)


def train(texts: list[bytes], labels: np.ndarray, epochs: int = 8, batch: int = 32, rate: float = 0.01, seed: int = 11) -> Model:
    model = Model(seed)
    names = ("embed", "filters", "bias", "out", "offset")
    moments = {k: [np.zeros_like(getattr(model, k)), np.zeros_like(getattr(model, k))] for k in names}
    random, step = np.random.default_rng(seed), 0
    for epoch in range(epochs):
        order = random.permutation(len(texts))
        for b in range(0, len(order), batch):
            pick = order[b : b + batch]
            offsets = np.concatenate([[0], np.cumsum([len(texts[i]) for i in pick])])
            grads = gradient(model, np.frombuffer(b"".join(texts[i] for i in pick), np.uint8), offsets, labels[pick])
            step += 1
            speed = rate * (0.5 if epoch >= epochs // 2 else 1) * (0.3 if epoch >= epochs - 2 else 1)
            for k in names:
                g, (m, v) = grads[k], moments[k]
                m *= 0.9
                m += 0.1 * g
                v *= 0.999
                v += 0.001 * g * g
                p = getattr(model, k)
                p -= speed * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return model


def gradient(model: Model, raw: np.ndarray, offsets: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
    syms, starts, positions = symbols(raw, offsets)
    response = model.convolve(model.tables(), syms, starts, positions)
    at, row = blocks(starts, positions)
    stops = np.minimum(at + HALF, (starts + positions)[row])
    grid = np.minimum(at[:, None] + np.arange(HALF), stops[:, None] - 1)
    inside = response[grid]  # (blocks, HALF, FILTERS)
    where = inside.argmax(axis=1)
    half = np.take_along_axis(inside, where[:, None, :], axis=1)[:, 0]
    where = np.take_along_axis(grid, where, axis=1)
    n = len(starts)
    pooled, (chunk, joined, first, counts, top) = pool(half, row, n)
    z = pooled @ model.out + model.offset[0]
    err = ((1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels) / n).astype(np.float32)
    grads = {"out": pooled.T @ err + 1e-4 * model.out, "offset": err.sum(keepdims=True)}
    to_mean, to_top = err[:, None] * model.out[:FILTERS], err[:, None] * model.out[FILTERS:]
    to_chunk = (to_mean / counts[:, None])[row]
    is_top = chunk == top[row]
    is_top &= np.add.accumulate(is_top, axis=0) - (np.add.accumulate(is_top, axis=0) - is_top)[first][row] == 1  # the first only
    to_chunk = to_chunk + is_top * to_top[row]
    source = where.copy()  # the position each chunk's maximum came from
    right = np.zeros(half.shape, bool)
    right[:-1] = joined[:, None] & (half[1:] > half[:-1])
    source[:-1] = np.where(right[:-1], where[1:], where[:-1])
    to_chunk = np.where(chunk > 0, to_chunk, 0)
    grads["bias"] = to_chunk.sum(axis=0)
    seen = syms[np.minimum(source[None] + np.arange(WIDTH)[:, None, None], len(syms) - 1)]  # (WIDTH, chunks, FILTERS)
    hold = model.embed[seen]
    grads["filters"] = np.einsum("wcfe,cf->wef", hold, to_chunk)
    back = np.einsum("cf,wef->wcfe", to_chunk, model.filters)
    flat, ids = back.reshape(-1, DEPTH), seen.ravel()
    grads["embed"] = np.stack([np.bincount(ids, flat[:, e], SYMBOLS) for e in range(DEPTH)], axis=1).astype(np.float32)
    return grads


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Train on a bounded sample of the labelled rows whose crc32(doc_id as text) mod 4 is not 2."""
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where(F.col("quality").isin(0, 1) & (F.crc32(F.col("doc_id").cast("string")) % 4 != 2))
    totals = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    model = Model()
    if len(totals) < 2:
        n1, n = totals.get(1, 0), sum(totals.values())
        model.constant = (n1 + 1) / (n + 2)
        return model
    of_class = lambda rows, q, n: rows.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    # Twice as many ids as are wanted, for those whose texts are too long: a proven bound for the broadcast, and for what comes to the driver.
    pick = of_class(known, 0, 2 * SAMPLE_ROWS).unionByName(of_class(known, 1, 2 * SAMPLE_ROWS))
    short = docs.select("doc_id", "text").where(F.octet_length("text") <= SAMPLE_BYTES).join(F.broadcast(pick), "doc_id")
    rows = of_class(short, 0, SAMPLE_ROWS).unionByName(of_class(short, 1, SAMPLE_ROWS)).orderBy("doc_id", "quality", F.xxhash64("text")).collect()
    y = np.array([r["quality"] for r in rows], np.float32)
    if len(rows) == 0 or y.min() == y.max():
        model.constant = (totals[1] + 1) / (totals[0] + totals[1] + 2)
        return model
    model = train([r["text"].encode() for r in rows], y)
    model.shift = float(np.log(totals[1] / totals[0]) - np.log(y.sum() / (len(y) - y.sum())))
    return model


def score_column(model: Model, text: Column) -> Column:
    if model.constant is not None:
        return F.lit(float(model.constant))
    table = model.tables()

    @arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        raw, offsets = text_bytes(texts)
        parts = [model.probabilities(raw[offsets[i] : offsets[j]], offsets[i : j + 1], table) for i, j in slices(offsets, 1 << 16)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return score(text)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns, one row per row of ``docs``."""
    model = fit(docs, labels)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return docs.select("doc_id", held_out.alias("held_out"), score_column(model, F.col("text")).alias("score")).withColumn("predicted", (F.col("score") >= KEEP_AT).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the documents the classifier rejects, with all their columns."""
    return docs.where(score_column(fit(docs, labels), F.col("text")) >= KEEP_AT)
