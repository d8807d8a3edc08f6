"""Operator 7: removal of repeated passages with a logarithmic family of suffix indexes.

A byte goes if a 50-byte string over it also starts in a document with a smaller doc_id. Suffixes are dealt by content:
of the GRAM-byte strings in every 50-byte window, the one with the smallest hash is its anchor, so equal windows have
equal anchors at equal places. An anchor's context is the up to 80 bytes of all windows in which it is the smallest.

The texts are written once as blocks, which ask and are told (see ``blocks``):

1. A block sends the hashes of its distinct anchors and texts, and is told which anchors two or more documents have and
   the smallest document of each text. A later copy of a text goes whole and takes no further part.
2. It sends the distinct contexts of its shared anchors, each once, with the smallest document in the block that has it.
   Each task holds the index family of its range of anchors: of equal contexts all but the smallest document's are hits
   as a whole; of anchors with several contexts, batches in order of doc_id get a suffix array (their windows, sorted by
   their bytes, with the smallest document of each), are merge-scanned against the levels so far, and become a level;
   levels of like size merge, so there are logarithmically many.
3. Each block is told what of each of its contexts smaller documents have, and cuts its texts.

So a passage that a third of all documents hold is one context from each block. An anchor of over ``HOT`` documents, as
at the edges of such a passage, where each document has another context, has these cut into their windows, which are
dealt by the windows' own hashes.

Edge cases: a null or empty text, and one under 50 bytes, loses nothing; rows with a null doc_id neither lose bytes nor
take any from others; equal texts lose everything but the smallest doc_id's; rows under one doc_id are one document and
take nothing from each other; a text of any length is handled whole, in one block; other columns are not read. Offsets
are bytes; a removal may cut a character.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .blocks import MESSAGE, Range, answered, answers_of, asked, messages, range_bits, read_block, told, unsqueezed, with_answers, write_blocks
from .common import write_cut
from .textops import _BYTE_CODE, _powers_to, mix, slices, text_bytes

LENGTH, GRAM = 50, 20
REACH = LENGTH - GRAM
HOT = 4096
RANGE = 16 << 20
BATCH = 12_500
SLICE = 1 << 19
TEXT, ANCHOR, CONTEXT = 0, 1, 2
LONE, SHARED, CROWDED = 0, 1, 2
NONE, WHOLE, PARTS = 0, 1, 2
_PART = np.dtype([("key", "<u4"), ("a", "u1"), ("b", "u1")])


class Rolling:
    """64-bit hashes of any strings of bytes within ``raw``."""

    def __init__(self, raw: np.ndarray):
        n = len(raw)
        up, self.down = _powers_to(n + 1)
        self.total = np.zeros(n + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(_BYTE_CODE[raw] * up[:n], out=self.total[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.total[stop] - self.total[start]) * self.down[start])

    def grams(self) -> np.ndarray:
        """The hash of the GRAM bytes from each position on."""
        n = len(self.total) - GRAM
        if n <= 0:
            return np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            return mix((self.total[GRAM:] - self.total[:-GRAM]) * self.down[:n])


def _sliding(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over each ``width`` neighbours, by doubling."""
    w = 1
    while w * 2 <= width:
        x, w = op(x[:-w], x[w:]), w * 2
    return op(x[: len(x) - (width - w)], x[width - w :]) if w < width else x


def anchors(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Positions of the anchors of rows end to end: the smallest gram of every LENGTH-byte window inside a row (all, if several are)."""
    width = REACH + 1
    if len(h) < width:
        return np.zeros(0, np.int64)
    least = _sliding(h, width, np.minimum)  # of the window that starts here
    room = np.repeat(offsets[1:], np.diff(offsets))[: len(least)] - np.arange(len(least))
    pad = np.zeros(width - 1, np.uint64)
    # a gram is an anchor if a window over it has it as the smallest, so if the largest of their smallest ones is the gram
    inside = np.concatenate([pad, np.where(room >= LENGTH, least, np.uint64(0)), pad])
    return np.flatnonzero(_sliding(inside, width, np.maximum)[: len(h)] == h)


def _reach(h: np.ndarray, at: np.ndarray, least: np.ndarray, room: np.ndarray, way: int) -> np.ndarray:
    """How many grams in a row next to each anchor, REACH and ``room`` at most, are not smaller than it."""
    out, going = np.zeros(len(at), np.int64), np.ones(len(at), bool)
    for k in range(1, REACH + 1):
        going &= (k <= room) & (h[np.clip(at + way * k, 0, len(h) - 1)] >= least)
        out += going
    return out


def _gathered(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of many pieces end to end."""
    if not len(start):
        return np.zeros(0, np.uint8)
    upto = np.cumsum(size)
    return raw[np.arange(upto[-1]) + np.repeat(start - (upto - size), size)]


class Block:
    """The texts of a block, end to end, and what is known of them."""

    def __init__(self, payload: bytes):
        rows = read_block(payload)
        self.ids = rows["doc_id"].combine_chunks()
        self.raw, self.offsets = text_bytes(rows["text"])
        self.doc = self.ids.fill_null(0).to_numpy(zero_copy_only=False)
        self.able = np.asarray(self.ids.is_valid()) & (np.diff(self.offsets) >= LENGTH)
        # distinct texts: (hi, lo) of their digests, sorted; each able row's place among them
        rows_able = np.flatnonzero(self.able)
        whole = self.raw.tobytes() if len(rows_able) else b""
        digests = [hashlib.blake2b(whole[self.offsets[r] : self.offsets[r + 1]], digest_size=16).digest() for r in rows_able.tolist()]
        pairs = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)
        order = np.lexsort((self.doc[rows_able], pairs[:, 1], pairs[:, 0]))
        pairs = pairs[order]
        new = np.ones(len(order), bool)
        new[1:] = (pairs[1:] != pairs[:-1]).any(axis=1)
        self.texts, self.first_doc = pairs[new], self.doc[rows_able][order][new]
        self.text_of = np.full(len(self.doc), -1, np.int64)
        self.text_of[rows_able[order]] = np.cumsum(new) - 1

    def _slices(self) -> Iterator[tuple[int, int, np.ndarray, Rolling, np.ndarray, np.ndarray]]:
        """(i, j, hashes of grams, rolling, positions of anchors, their rows) of rows i to j; positions count from row i."""
        for i, j in slices(self.offsets, SLICE):
            if not self.able[i:j].any():
                continue
            rolling = Rolling(self.raw[self.offsets[i] : self.offsets[j]])
            h = rolling.grams()
            local = self.offsets[i : j + 1] - self.offsets[i]
            at = anchors(h, local)
            row = np.searchsorted(local, at, "right") - 1 + i
            fine = self.able[row]
            yield i, j, h, rolling, at[fine], row[fine]

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct hashes (mixed again, as the smallest of many would all be in the first ranges), and how many documents have each."""
        hs, docs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for _, _, h, _, at, row in self._slices():
            hs.append(mix(h[at]))
            docs.append(self.doc[row])
        h, doc = np.concatenate(hs), np.concatenate(docs)
        order = np.lexsort((doc, h))
        h, doc = h[order], doc[order]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        another = new.copy()
        another[1:] |= doc[1:] != doc[:-1]
        first = np.flatnonzero(new)
        return h[first], np.add.reduceat(another.astype(np.int64), first) if len(first) else np.zeros(0, np.int64)

    def ask(self, number: int, bits: int) -> pa.Table:
        h, docs = self.anchors()
        return messages(number, bits, [(TEXT, self.texts[:, 0], [self.texts[:, 1], self.first_doc]), (ANCHOR, h, [np.minimum(docs, 65_535).astype(np.uint16)])])

    def contexts(self, answers: pa.Table, bits: int) -> None:
        """Takes the answers: copies goes by rows; the shared anchors' contexts by key, and each context's place among the distinct ones."""
        least = told(answers, TEXT, bits, self.texts[:, 0], np.int64)
        self.copy = self.able.copy()
        self.copy[self.able] = self.doc[self.able] > least[self.text_of[self.able]]
        h_all = self.anchors()[0]
        state = told(answers, ANCHOR, bits, h_all, np.uint8)
        found = []
        for i, _, h, rolling, at, row in self._slices():
            key = mix(h[at])
            state_at = state[np.searchsorted(h_all, key)]
            fine = (state_at != LONE) & ~self.copy[row]
            at, row, key, state_at = at[fine], row[fine], key[fine], state_at[fine]
            if not len(at):
                continue
            least_h = h[at]
            begin, end = self.offsets[row] - self.offsets[i], self.offsets[row + 1] - self.offsets[i]
            start = at - _reach(h, at, least_h, at - begin, -1)
            stop = at + _reach(h, at, least_h, end - GRAM - at, 1) + GRAM
            wide = stop - start >= LENGTH
            key, start, stop, row, hot = key[wide], start[wide], stop[wide], row[wide], state_at[wide] == CROWDED
            if hot.any():  # each window over the anchor on its own, under its own hash
                n = (stop - start - LENGTH + 1)[hot]
                first = np.repeat(start[hot] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                windows = rolling.of(first, first + LENGTH) ^ np.uint64(0x9E3779B97F4A7C15)
                key, row = np.concatenate([key[~hot], windows]), np.concatenate([row[~hot], np.repeat(row[hot], n)])
                start, stop = np.concatenate([start[~hot], first]), np.concatenate([stop[~hot], first + LENGTH])
            found.append((key, rolling.of(start, stop), start + self.offsets[i], stop - start, row))
        if found:
            key, digest, start, size, row = (np.concatenate(x) for x in zip(*found))
        else:
            key, digest = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
            start, size, row = (np.zeros(0, np.int64) for _ in range(3))
        order = np.lexsort((self.doc[row], digest, size, key))
        key, digest, self.start, self.size, self.row = (x[order] for x in (key, digest, start, size, row))
        new = np.ones(len(order), bool)
        new[1:] = (key[1:] != key[:-1]) | (self.size[1:] != self.size[:-1]) | (digest[1:] != digest[:-1])
        self.first = np.flatnonzero(new)  # of each distinct context, with its smallest document
        self.place = np.cumsum(new) - 1
        self.key = key[self.first]

    def ask_contexts(self, number: int, bits: int) -> pa.Table:
        size, doc = self.size[self.first], self.doc[self.row[self.first]]
        pieces = lambda a, b: _gathered(self.raw, self.start[self.first[a:b]], size[a:b])
        return messages(number, bits, [(CONTEXT, self.key, [size.astype(np.uint8), doc, pieces])])

    def cut(self, answers: pa.Table, bits: int) -> pa.Table:
        """The contract's columns."""
        state = told(answers, CONTEXT, bits, self.key, np.uint8)
        later = self.doc[self.row] > self.doc[self.row[self.first]][self.place]
        whole = later | (state[self.place] == WHOLE)
        starts, stops = [self.start[whole], self.offsets[:-1][self.copy]], [(self.start + self.size)[whole], self.offsets[1:][self.copy]]
        # parts: of distinct contexts, for all places of their smallest documents
        parts, at = [], 0
        buckets, sizes = np.unique((self.key >> np.uint64(64 - bits)).astype(np.int64), return_counts=True)
        for (_, _, n, y), k in zip(answered(answers, CONTEXT, bits), sizes.tolist()):
            got = unsqueezed(y, _PART, n)
            parts.append(np.stack([got["key"].astype(np.int64) + at, got["a"].astype(np.int64), got["b"].astype(np.int64)], axis=1))
            at += k
        if parts and len(parts := np.concatenate(parts)):
            own = np.flatnonzero(~later & (state[self.place] == PARTS))
            lo = np.searchsorted(parts[:, 0], self.place[own], "left")
            n = np.searchsorted(parts[:, 0], self.place[own], "right") - lo
            which = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
            from_ = np.repeat(self.start[own], n)
            starts.append(from_ + parts[which, 1])
            stops.append(from_ + parts[which, 2])
        n = len(self.raw)
        edge = np.bincount(np.concatenate(starts), minlength=n + 1) - np.bincount(np.concatenate(stops), minlength=n + 1)
        gone = np.cumsum(edge)[:n] > 0
        opens = gone.copy()
        opens[1:] &= ~gone[:-1]
        rows = len(self.doc)
        filled = np.flatnonzero(np.diff(self.offsets))
        opens[self.offsets[filled]] = gone[self.offsets[filled]]
        n_gone, n_spans = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
        if len(filled):
            n_gone[filled] = np.add.reduceat(gone.astype(np.int64), self.offsets[filled])
            n_spans[filled] = np.add.reduceat(opens.astype(np.int64), self.offsets[filled])
        left = self.raw[~gone].tobytes()
        sizes = np.diff(self.offsets) - n_gone
        ends = np.cumsum(sizes)
        digests = [hashlib.sha256(left[b - k : b]).hexdigest() for b, k in zip(ends.tolist(), sizes.tolist())]
        return pa.table([self.ids, pa.array(np.diff(self.offsets)), pa.array(n_gone), pa.array(n_spans), pa.array(digests, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


# --- what the ranges' tasks answer ------------------------------------------------------------------------------------


def _shared(bits: int):
    """Texts: their smallest document. Anchors: whether one, several or many documents have them."""

    def run(rows: pa.Table) -> pa.Table:
        asked_ = Range(rows, bits)
        if asked_.kind == TEXT:
            lo, doc = asked_.values("x", np.uint64), asked_.values("y", np.int64)
            order = np.lexsort((doc, lo, asked_.h))
            h, lo = asked_.h[order], lo[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (lo[1:] != lo[:-1])
            least = np.empty(len(h), np.int64)
            least[order] = doc[order][new][np.cumsum(new) - 1]
            return asked_.answers(least)
        docs = asked_.values("x", np.uint16)
        distinct, inverse = np.unique(asked_.h, return_inverse=True)
        total = np.bincount(inverse, docs, len(distinct))[inverse]
        return asked_.answers(np.where(total > HOT, CROWDED, np.where(total > 1, SHARED, LONE)).astype(np.uint8))

    return run


class SuffixIndexFamily:
    """Sorted distinct windows with the smallest document of each, in levels whose sizes at least double."""

    def __init__(self):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []

    def scan(self, windows: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """The smallest document of each of the (sorted distinct) windows, by merging them with every level."""
        out = docs
        for level in self.levels:
            out = np.minimum(out, merged(level, (windows, docs))[2])
        return out

    def add(self, windows: np.ndarray, docs: np.ndarray) -> None:
        """A new level; levels of like size merge."""
        if len(windows):
            self.levels.append((windows, docs))
        while len(self.levels) > 1 and len(self.levels[-2][0]) < 2 * len(self.levels[-1][0]):
            b, a = self.levels.pop(), self.levels.pop()
            self.levels.append(merged(a, b)[:2])


def merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The merge of two sorted levels: their distinct windows, the smallest document of each, and that of each window of b."""
    keys, docs = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
    order = np.argsort(keys, kind="stable")  # two runs, which the sort merges in one pass
    keys, docs = keys[order], docs[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    first = np.flatnonzero(new)
    least = np.minimum.reduceat(docs, first) if len(first) else docs
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    return keys[first], least, least[place[len(a[0]) :]]


def _suffix_array(windows: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct windows, the smallest document of each, and each given window's place among them. docs ascend."""
    order = np.argsort(windows, kind="stable")
    ranked = windows[order]
    first = np.ones(len(ranked), bool)
    first[1:] = ranked[1:] != ranked[:-1]
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(first) - 1
    return ranked[first], docs[order][first], place


def _alike(raw: np.ndarray, offsets: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Whether pairs of pieces of one length have the same bytes."""
    out = np.ones(len(left), bool)
    size = offsets[left + 1] - offsets[left]
    for i, j in slices(np.concatenate([[0], np.cumsum(size)]), 1 << 21):
        same = _gathered(raw, offsets[left[i:j]], size[i:j]) == _gathered(raw, offsets[right[i:j]], size[i:j])
        out[i:j] = np.logical_and.reduceat(same, np.cumsum(size[i:j]) - size[i:j])
    return out


def _found(bits: int):
    """What smaller documents have of the contexts in a range: nothing, all, or parts (key within the block's part, from, to)."""

    def run(rows: pa.Table) -> pa.Table:
        asked_ = Range(rows, bits)
        size, doc = asked_.values("x", np.uint8).astype(np.int64), asked_.values("y", np.int64)
        raw, offsets = asked_.raw("z", size), np.concatenate([[0], np.cumsum(size)])
        state = np.full(len(doc), NONE, np.uint8)
        # equal contexts: neighbours in the order of key, size and digest, whose bytes are compared
        digest = np.concatenate([np.zeros(0, np.uint64), *[Rolling(raw[offsets[i] : offsets[j]]).of(offsets[i:j] - offsets[i], offsets[i + 1 : j + 1] - offsets[i]) for i, j in slices(offsets, 1 << 20)]])
        order = np.lexsort((doc, digest, size, asked_.h))
        h, d = asked_.h[order], digest[order]
        same = np.zeros(len(order), bool)
        same[1:] = (h[1:] == h[:-1]) & (d[1:] == d[:-1]) & (size[order][1:] == size[order][:-1])
        pairs = np.flatnonzero(same)
        same[pairs] = _alike(raw, offsets, order[pairs - 1], order[pairs])
        group = np.cumsum(~same) - 1
        least = doc[order][~same][group]
        state[order[doc[order] > least]] = WHOLE
        # windows, of anchors with several contexts; equal contexts of the smallest document all take part
        firsts = h[~same]
        several = np.zeros(len(firsts), bool)
        several[1:] = firsts[1:] == firsts[:-1]
        several[:-1] |= firsts[:-1] == firsts[1:]
        rest = order[(doc[order] == least) & several[group]]
        rest = rest[np.argsort(doc[rest], kind="stable")]
        family, parts = SuffixIndexFamily(), [np.zeros((0, 3), np.int64)]
        strings = np.lib.stride_tricks.sliding_window_view(raw, LENGTH) if len(raw) >= LENGTH else None
        a = 0
        while a < len(rest):
            b = min(len(rest), a + BATCH)
            while b < len(rest) and doc[rest[b]] == doc[rest[b - 1]]:  # a document is in one batch
                b += 1
            k = rest[a:b]
            n = size[k] - LENGTH + 1
            who = np.repeat(np.arange(len(k)), n)
            at = np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)
            windows = np.ascontiguousarray(strings[offsets[k][who] + at]).view(f"S{LENGTH}").ravel()
            docs = doc[k][who]
            keys, least_doc, place = _suffix_array(windows, docs)
            hit = family.scan(keys, least_doc)[place] < docs
            family.add(keys, least_doc)
            who, at = who[hit], at[hit]
            if len(who):
                opens = np.ones(len(who), bool)
                opens[1:] = (who[1:] != who[:-1]) | (at[1:] != at[:-1] + 1)
                first = np.flatnonzero(opens)
                last = np.append(first[1:], len(who)) - 1
                parts.append(np.stack([k[who[first]], at[first], at[last] + LENGTH], axis=1))
            a = b
        parts = np.concatenate(parts)
        parts = parts[np.lexsort((parts[:, 1], parts[:, 0]))]
        state[parts[:, 0]] = PARTS

        def of(a: int, b: int) -> np.ndarray:
            lo, hi = np.searchsorted(parts[:, 0], [a, b])
            out = np.zeros(hi - lo, _PART)
            out["key"], out["a"], out["b"] = parts[lo:hi, 0] - a, parts[lo:hi, 1], parts[lo:hi, 2]
            return out

        return asked_.answers(state, of)

    return run


# --- the rounds -------------------------------------------------------------------------------------------------------


def remove_repeats(docs: DataFrame) -> DataFrame:
    """The contract's columns, one row per row of ``docs``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = range_bits(size, RANGE)
    blocks = write_blocks(rows, "text", size)

    def told_block(payload: bytes, answers: pa.Table) -> Block:
        block = Block(payload)
        block.contexts(answers, bits)
        return block

    first = write_cut(answers_of(asked(blocks, lambda number, payload: Block(payload).ask(number, bits)), _shared(bits), bits), "anchors")
    contexts = with_answers(blocks, first, lambda number, payload, answers: told_block(payload, answers).ask_contexts(number, bits), MESSAGE)
    second = write_cut(answers_of(contexts, _found(bits), bits), "contexts")
    return with_answers(blocks, first.unionByName(second), lambda number, payload, answers: told_block(payload, answers).cut(answers, bits), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
