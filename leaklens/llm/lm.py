"""Operator 8: language-model scoring with a weighted backoff automaton.

Counts cover the whole training part of the corpus, for every order: each token counts, and each bigram and trigram seen
``LEAST`` times or more is an arc, whatever the corpus' size.

The automaton: a state is a history; an arc (state, token) has the discounted probability (count - DISCOUNT) / count of
the history, and leads to the longest history that is a state; a failure arc leads to the next shorter history with the
weight that makes the state's probabilities sum to one. At the root a token has the base estimate
(c + 1) / (N + V + 1), seen or not. Each text starts in the state of the token ``end``; its score is the sum of the log10
probabilities along its traversal.

Up to ``WHOLE`` tokens the automaton is sent to the workers, which walk it from left to right. In a larger corpus nothing
that grows is sent (``_looked_up``). The state before a token is the longest suffix of its history that has arcs, so
the walk's arcs and failures at a token are those of its trigram, bigram and unigram and of its two histories. The texts
are written once as blocks, which ask and are told (see ``blocks``): for the counts of their distinct unigrams and
bigrams, then of the trigrams whose bigrams both are arcs, since no other can be one. The first block that has an arc
adds it to its history's sums, and the histories' failure weights come back the same way. Then each block is scored.

Words are 64-bit hashes of their bytes, which for a vocabulary of a billion words collide with odds of about 3 %; bigrams
and trigrams are 64-bit hashes too, each order for itself.

Edge cases: a null, empty or wordless text is the token end alone; without training rows N = V = 0 and every token has
probability 1; a null doc_id is a training row and not held out; repeated rows count and are scored as often as they
occur; other columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .blocks import MESSAGE, Part, Range, answers_of, asked, messages, range_bits, read_block, told, with_answers, write_blocks
from .common import write_cut
from .textops import each_slice, mix

ORDER = 3
LEAST = 2
WHOLE = 1_000_000
DISCOUNT = 0.5
BITS = 20
FLUSH = 1 << 22
RANGE = 16 << 20
STEP = np.uint64(0xD6E8FEB86659FD93)
END = np.uint64(0x5BF03635DC2F96E1)
SUMS = np.dtype([("x", "<i8"), ("y", "<i8")])
WEIGHT = 4  # the kind of key that asks for a failure weight, less its order


def token_rows(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(rows so far, tokens, bounds) of slices: each row is its words and one END."""
    for i, _, words in each_slice(texts):
        h = words.hashes()
        n = np.diff(words.bounds)
        bounds = np.concatenate([[0], np.cumsum(n + 1)])
        tokens = np.empty(bounds[-1], np.uint64)
        at = np.ones(len(tokens), bool)
        at[bounds[1:] - 1] = False
        tokens[at], tokens[~at] = h, END
        yield i, tokens, bounds


def _counted(chunks: list[np.ndarray]) -> pa.RecordBatch:
    keys, counts = np.unique(np.concatenate(chunks), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts.astype(np.int64))], names=["h", "c"])


def _unigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for batch in batches:
        for _, tokens, _ in token_rows(batch.column(0)):
            held.append(tokens)
            size += len(tokens)
            if size >= FLUSH:
                yield _counted(held)
                held, size = [], 0
    if held:
        yield _counted(held)


class Frequent:
    """The n-grams that are arcs, by order. words: sorted token hashes, a token's id is its place; keys[n]: sorted packed ids."""

    def __init__(self, words: np.ndarray, counts: np.ndarray):
        self.words, self.keys, self.counts = words, {1: np.arange(len(words), dtype=np.int64)}, {1: counts}
        self.name = uuid.uuid4().hex

    def ids(self, tokens: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.full(len(tokens), -1, np.int64)
        at = np.minimum(np.searchsorted(self.words, tokens), len(self.words) - 1)
        return np.where(self.words[at] == tokens, at, -1)

    def has(self, n: int, keys: np.ndarray) -> np.ndarray:
        if n == 1:
            return keys >= 0
        known = self.keys[n]
        if not len(known):
            return np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        return known[at] == keys


def _with_starts(ids: np.ndarray, bounds: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """ids with the token end put before each row, and the row of each."""
    n = np.diff(bounds)
    out = np.full(len(ids) + len(n), end, np.int64)
    row = np.repeat(np.arange(len(n)), n + 1)
    start = bounds[:-1] + np.arange(len(n))
    keep = np.ones(len(out), bool)
    keep[start] = False
    out[keep] = ids
    return out, row


def _ngrams(frequent: Frequent, n: int):
    """Counts of the n-grams whose two parts of n - 1 tokens are frequent."""
    end = int(frequent.ids(np.array([END]))[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for _, tokens, bounds in token_rows(batch.column(0)):
                ids, row = _with_starts(frequent.ids(tokens), bounds, end)
                keys, fine = ids.copy(), ids >= 0
                for k in range(2, n + 1):  # keys[i]: the k-gram that starts at i
                    m = len(ids) - k + 1
                    if m <= 0:
                        fine = fine[:0]
                        break
                    fine = fine[:m] & fine[1 : m + 1] & (row[:m] == row[k - 1 : k - 1 + m])
                    keys = (keys[:m] << BITS) | ids[k - 1 : k - 1 + m]
                    if k < n:
                        fine &= frequent.has(k, keys)
                got = keys[: len(fine)][fine]
                if len(got):
                    held.append(got)
                    size += len(got)
                if size >= FLUSH:
                    yield _counted([h.view(np.uint64) for h in held])
                    held, size = [], 0
        if held:
            yield _counted([h.view(np.uint64) for h in held])

    return run


class Automaton:
    def __init__(self, frequent: Frequent, total: int, vocabulary: int):
        self.frequent, self.total, self.vocabulary = frequent, total, vocabulary
        self.scale = float(np.log10(total + vocabulary + 1))
        self.root = np.log10(frequent.counts[1] + 1.0) - self.scale
        end = frequent.ids(np.array([END]))[0]
        self.end = int(end)
        mask = (1 << BITS) - 1
        # histories that have arcs; state 0 is the empty one
        states: dict[tuple[int, int], int] = {}
        for n in range(2, ORDER + 1):
            for h in np.unique(frequent.keys[n] >> BITS).tolist():
                states[n - 1, h] = len(states) + 1
        self.arcs: dict[int, int] = {}
        self.weight: list[float] = []
        self.next: list[int] = []
        self.back, self.fail, self.to_root = [0.0] * (len(states) + 1), [0] * (len(states) + 1), [0.0] * (len(states) + 1)
        prob = {1: 10.0**self.root}
        for n in range(2, ORDER + 1):
            keys, counts = frequent.keys[n], frequent.counts[n]
            history, word = keys >> BITS, keys & mask
            of_history = frequent.counts[n - 1][np.searchsorted(frequent.keys[n - 1], history)] if len(keys) else counts
            prob[n] = (counts - DISCOUNT) / np.maximum(of_history, counts)
            shorter = keys & ((1 << BITS * (n - 1)) - 1)
            lower = prob[n - 1][np.searchsorted(frequent.keys[n - 1], shorter)] if len(keys) else prob[n]
            firsts, where = np.unique(history, return_inverse=True)
            left = np.maximum(1e-9, 1 - np.bincount(where, prob[n], len(firsts)))
            below = np.maximum(1e-9, 1 - np.bincount(where, lower, len(firsts)))
            for h, a in zip(firsts.tolist(), np.log10(left / below).tolist()):
                s = states[n - 1, h]
                self.back[s] = a
                self.fail[s] = states.get((n - 2, h & ((1 << BITS * (n - 2)) - 1)), 0) if n > 2 else 0
                self.to_root[s] = a + self.to_root[self.fail[s]]
            for key, h, w, p in zip(keys.tolist(), history.tolist(), word.tolist(), np.log10(prob[n]).tolist()):
                self.arcs[states[n - 1, h] << BITS | w] = len(self.weight)
                self.weight.append(p)
                self.next.append(self._longest(states, key, n))
        self.of_word = [states.get((1, w), 0) for w in range(len(frequent.words))]

    @staticmethod
    def _longest(states: dict, key: int, n: int) -> int:
        """The state of the longest suffix of an n-gram that is a history with arcs."""
        for k in range(min(n, ORDER - 1), 0, -1):
            s = states.get((k, key & ((1 << BITS * k) - 1)))
            if s:
                return s
        return 0

    def traverse(self, ids: list[int]) -> float:
        """The text's log10 probability without what its tokens outside the root add."""
        arcs, weight, nxt, back, fail, root, of_word = self.arcs, self.weight, self.next, self.back, self.fail, self.root_list, self.of_word
        s = of_word[self.end] if self.end >= 0 else 0
        total = 0.0
        for w in ids:
            if w < 0:
                total += self.to_root[s]
                s = 0
                continue
            while s:
                k = arcs.get(s << BITS | w)
                if k is not None:
                    total += weight[k]
                    s = nxt[k]
                    break
                total += back[s]
                s = fail[s]
            else:
                total += root[w]
                s = of_word[w]
        return total

    @property
    def root_list(self) -> list[float]:
        if not hasattr(self, "_root_list"):
            self._root_list = self.root.tolist()
        return self._root_list


_built: dict[str, Automaton] = {}


def _score(shared, total: int, vocabulary: int):
    """shared: the broadcast Frequent. Each worker process builds the automaton once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = shared.value
        if frequent.name not in _built:
            _built.clear()
            _built[frequent.name] = Automaton(frequent, total, vocabulary)
        auto = _built[frequent.name]
        for batch in batches:
            n, known, base, score, tail = [], [], [], [], []
            for _, tokens, bounds in token_rows(batch.column(2)):
                ids = frequent.ids(tokens)
                hit = ids >= 0
                log = np.where(hit, auto.root[np.maximum(ids, 0)] if len(auto.root) else 0.0, 0.0)
                listed = ids.tolist()
                for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                    n.append(b - a)
                    known.append(int(hit[a:b].sum()))
                    base.append(float(log[a:b].sum()))
                    score.append(auto.traverse(listed[a:b]))
                    tail.append(tokens[a:b][~hit[a:b]].view(np.int64))
            lengths = np.cumsum([0, *map(len, tail)]).astype(np.int32)
            tails = pa.ListArray.from_arrays(pa.array(lengths), pa.array(np.concatenate(tail) if tail else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64()), tails],
                names=["doc_id", "held_out", "n_tokens", "n_head", "base", "walk", "tail"],
            )

    return run


def fit(texts: DataFrame) -> tuple[DataFrame, Frequent, int, int]:
    """texts: the training texts, of ``WHOLE`` tokens at most. The table of all counts (h, c), the n-grams, N and V."""
    unigrams = write_cut(texts.mapInArrow(_unigrams, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")), "unigrams")
    total, vocabulary = unigrams.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    rows = unigrams.toPandas()
    h, c = rows["h"].to_numpy(np.int64).view(np.uint64), rows["c"].to_numpy(np.int64)
    order = np.argsort(h)
    frequent = Frequent(h[order], c[order])
    for n in range(2, ORDER + 1):
        grams = texts.mapInArrow(_ngrams(frequent, n), "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))
        rows = grams.where(F.col("c") >= LEAST).toPandas()
        order = np.argsort(rows["h"].to_numpy(np.int64))
        frequent.keys[n], frequent.counts[n] = rows["h"].to_numpy(np.int64)[order], rows["c"].to_numpy(np.int64)[order]
    return unigrams, frequent, int(total), int(vocabulary)


def _walked(rows: DataFrame) -> DataFrame:
    """Scores of a small corpus by the automaton, sent whole. rows: doc_id, held_out, text."""
    _, frequent, total, vocabulary = fit(rows.where(~F.col("held_out")).select("text"))
    shared = rows.sparkSession.sparkContext.broadcast(frequent)
    walked = rows.mapInArrow(_score(shared, total, vocabulary), "doc_id long, held_out boolean, n_tokens long, n_head long, base double, walk double, tail array<long>")
    tail = F.size("tail") * F.lit(float(np.log10(total + vocabulary + 1)))  # tokens of held-out texts that no training text has
    return walked.select("doc_id", "held_out", "n_tokens", F.col("n_head").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), (F.col("base") - tail).alias("base_score"), (F.col("walk") - tail).alias("score"))


# --- any size: counts and failure weights are looked up ---------------------------------------------------------------

class Block:
    """The n-grams of a block. of[n]: its sorted distinct n-gram hashes; at[n]: the place there of the n-gram that ends at a position, or -1; first[n]: a position where each ends."""

    def __init__(self, payload: bytes):
        self.rows = read_block(payload)
        tokens, lengths = [], []
        for _, got, bounds in token_rows(self.rows["text"]):
            tokens.append(got)
            lengths.append(np.diff(bounds))
        self.n_tokens = np.concatenate(lengths)
        flat = np.concatenate(tokens)
        bounds = np.concatenate([[0], np.cumsum(self.n_tokens)])
        self.start = bounds[:-1] + np.arange(len(self.n_tokens))  # the token end put before each row
        size = len(flat) + len(self.n_tokens)
        self.token = np.ones(size, bool)
        self.token[self.start] = False
        self.words = np.full(size, END, np.uint64)
        self.words[self.token] = flat
        self.row = np.repeat(np.arange(len(self.n_tokens)), self.n_tokens + 1)
        self.ends, self.of, self.at, self.first, self.c, self.own = {}, {}, {}, {}, {}, {}
        with np.errstate(over="ignore"):
            self.pairs = mix(np.concatenate([self.words[:1], self.words[:-1]]) * STEP + self.words + np.uint64(2))
        self._placed(1, self.words, np.ones(size, bool))
        self._placed(2, self.pairs, self.token)

    def _placed(self, n: int, keys: np.ndarray, ends: np.ndarray) -> None:
        places = np.flatnonzero(ends)
        keys = keys[places]
        order = np.argsort(keys)
        ranked = keys[order]
        new = np.ones(len(order), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        self.ends[n], self.of[n], self.first[n] = ends, ranked[new], places[order[new]]
        self.at[n] = np.full(len(ends), -1, np.int64)
        self.at[n][places[order]] = np.cumsum(new) - 1

    def _trigrams(self) -> None:
        """Those that may occur LEAST times: both their bigrams do."""
        arc = np.zeros(len(self.token), bool)
        arc[self.token] = self.c[2][self.at[2][self.token]] >= LEAST
        both = arc.copy()
        both[1:] &= arc[:-1]
        both[self.start] = False
        both[self.start + 1] = False  # the first token of a row ends no trigram
        with np.errstate(over="ignore"):
            self._placed(3, mix(np.concatenate([self.pairs[:1], self.pairs[:-1]]) * STEP + self.words + np.uint64(3)), both)

    def _counts(self, n: int) -> Part:
        train = ~self.rows["held_out"].to_numpy(zero_copy_only=False)[self.row] & self.token & self.ends[n]
        return n, self.of[n], [np.bincount(self.at[n][train], minlength=len(self.of[n])).astype(np.uint32)]

    def told(self, answers: pa.Table, bits: int, upto: int) -> "Block":
        """Takes the counts: c[n], and own[n] for the n-grams that this block adds to their histories' sums."""
        for n in range(1, upto + 1):
            if n == 3:
                self._trigrams()
            got = told(answers, n, bits, self.of[n], np.int64)
            self.c[n], self.own[n] = got >> 1, (got & 1).astype(bool)
        return self

    def ask(self, number: int, bits: int) -> pa.Table:
        return messages(number, bits, [self._counts(1), self._counts(2)])

    def ask_trigrams(self, number: int, bits: int) -> pa.Table:
        self._trigrams()
        return messages(number, bits, [self._counts(3), self._weights(1)])

    def ask_weights(self, number: int, bits: int) -> pa.Table:
        return messages(number, bits, [self._weights(2)])

    def _weights(self, n: int) -> Part:
        at, x, y = self.histories(n)
        return WEIGHT + n, self.of[n][at], [x, y]

    def histories(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the n-grams whose failure weight is asked or added to: places in of[n], and sums over the arcs that are this block's to add.

        In an arc's count c, x adds 2 c - 1: the arcs' probabilities are x / 2 by the history's count. y adds what gives
        the shorter histories' probabilities in the same way: 2 c - 1 of the shorter n-gram, or c + 1 at the root.
        """
        arc = self.own[n + 1] & (self.c[n + 1] >= LEAST)
        p = self.first[n + 1][arc]  # where such an arc ends
        history, size = self.at[n][p - 1], len(self.of[n])
        shorter = self.c[n][self.at[n][p]]
        x, y = np.zeros(size, np.int64), np.zeros(size, np.int64)
        np.add.at(x, history, 2 * self.c[n + 1][arc] - 1)
        np.add.at(y, history, shorter + 1 if n == 1 else 2 * shorter - 1)
        last = np.flatnonzero(self._can_end(n + 1))
        at = self.at[n + 1][last]
        missed = last[(at < 0) | (self.c[n + 1][np.maximum(at, 0)] < LEAST) if len(self.of[n + 1]) else np.ones(len(last), bool)] - 1
        wanted = np.zeros(size, bool)
        wanted[self.at[n][missed]] = True
        wanted &= self.c[n] >= LEAST
        wanted[history] = True
        at = np.flatnonzero(wanted)
        return at, x[at], y[at]

    def _can_end(self, n: int) -> np.ndarray:
        out = self.token.copy()
        if n == 3:
            out[self.start + 1] = False
        return out

    def backs(self, n: int, answers: pa.Table, bits: int, scale: float) -> np.ndarray:
        """log10 of the failure weights of of[n]; 0 for those without arcs."""
        at, *_ = self.histories(n)
        got = told(answers, WEIGHT + n, bits, self.of[n][at], SUMS)
        x, y = got["x"].astype(float), got["y"].astype(float)
        if n == 1:
            lower = y / scale
        else:
            lower = y / 2 / np.maximum(1, self.c[1][self.at[1][self.first[2][at]]])
        out = np.zeros(len(self.of[n]))
        with np.errstate(divide="ignore", invalid="ignore"):
            out[at] = np.where(x > 0, np.log10(np.maximum(1e-9, 1 - x / 2 / np.maximum(1, self.c[n][at])) / np.maximum(1e-9, 1 - lower)), 0.0)
        return out

    def scored(self, answers: pa.Table, bits: int, total: int, vocabulary: int) -> pa.Table:
        scale = float(total + vocabulary + 1)
        back = {n: self.backs(n, answers, bits, scale) for n in (1, 2)}
        p = np.flatnonzero(self.token)
        c1, c2, before = self.c[1][self.at[1][p]], self.c[2][self.at[2][p]], self.c[1][self.at[1][p - 1]]
        base = np.log10(c1 + 1.0) - np.log10(scale)
        with np.errstate(divide="ignore", invalid="ignore"):
            score = np.where(c2 >= LEAST, np.log10((c2 - DISCOUNT) / np.maximum(before, c2)), back[1][self.at[1][p - 1]] + base)
            third = self._can_end(3)[p]
            q = p[third]
            at, pair = self.at[3][q], self.at[2][q - 1]
            c3 = np.where(at >= 0, self.c[3][np.maximum(at, 0)], 0) if len(self.c[3]) else np.zeros(len(q), np.int64)
            score[third] = np.where(c3 >= LEAST, np.log10((c3 - DISCOUNT) / np.maximum(self.c[2][pair], c3)), back[2][pair] + score[third])
        row, n = self.row[p], len(self.n_tokens)
        add = lambda x: np.bincount(row, x, n)
        return pa.table(
            [self.rows["doc_id"], self.rows["held_out"], pa.array(self.n_tokens, pa.int64()), pa.array(add(c1 > 0).astype(np.int64)), pa.array(np.full(n, total, np.int64)), pa.array(add(base)), pa.array(add(score))],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )


def _answer(bits: int):
    """What a range's task answers. To n-grams: count * 2, and 1 more at the first block that trains on it; one under LEAST is no arc and told as 0. To histories: the sums of all blocks."""

    def run(rows: pa.Table) -> pa.Table:
        asked_ = Range(rows, bits)
        distinct, inverse = np.unique(asked_.h, return_inverse=True)
        if asked_.kind > WEIGHT:
            out = np.zeros(len(inverse), SUMS)
            for name in "xy":
                added = np.zeros(len(distinct), np.int64)
                np.add.at(added, inverse, asked_.values(name, np.int64))
                out[name] = added[inverse]
            return asked_.answers(out)
        own = asked_.values("x", np.uint32).astype(np.int64)
        count = np.bincount(inverse, own, len(distinct)).astype(np.int64)
        trains = np.flatnonzero(own)
        first = np.full(len(distinct), -1, np.int64)
        first[inverse[trains[::-1]]] = trains[::-1]
        summary = (int(count.sum()), int((count > 0).sum())) if asked_.kind == 1 else None
        if asked_.kind > 1:
            count[count < LEAST] = 0
        answer = count[inverse] * 2
        answer[first[first >= 0]] |= 1
        return asked_.answers(answer, summary=summary)

    return run


def _looked_up(rows: DataFrame, size: int) -> DataFrame:
    """Scores of a corpus of any size; rows: doc_id, held_out, text; size: bytes of text."""
    bits = range_bits(size, RANGE)
    blocks = write_blocks(rows, "text", size)
    rounds = lambda asked_, label: write_cut(answers_of(asked_, _answer(bits), bits), label)
    counts = rounds(asked(blocks, lambda number, payload: Block(payload).ask(number, bits)), "counts")
    sums = counts.where("block IS NULL").groupBy("bucket").agg(F.sum("n")).collect()  # of N and of V
    total, vocabulary = (int(dict(sums).get(-k, 0)) for k in (1, 2))
    second = rounds(with_answers(blocks, counts, lambda number, payload, answers: Block(payload).told(answers, bits, 2).ask_trigrams(number, bits), MESSAGE), "trigrams")
    known = counts.unionByName(second)
    third = rounds(with_answers(blocks, known, lambda number, payload, answers: Block(payload).told(answers, bits, 3).ask_weights(number, bits), MESSAGE), "weights")
    return with_answers(
        blocks,
        known.unionByName(third),
        lambda _, payload, answers: Block(payload).told(answers, bits, 3).scored(answers, bits, total, vocabulary),
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )


def score(docs: DataFrame) -> DataFrame:
    """The contract's columns, one row per row of ``docs``."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "text")
    size, n = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    most = (size + n) // 2 + n  # words are a byte and a space at least, and each row has the token end
    out = _walked(rows) if most <= WHOLE else _looked_up(rows, size)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
