"""Operator 1: MinHash near-dedup by a multi-index Hamming join.

A text's distinct word shingles give SYMBOLS minhashes of 16 bits, its signature. Signatures are split into CHUNKS
chunks; two that differ in at most ``DISTANCE`` symbols have, by pigeonhole, a chunk in which at most ALLOWED symbols
differ, and all choices of the symbols kept in a chunk are enumerated as index keys. So every pair within that distance
shares a key; at a similarity of 0.8 a symbol agrees with probability 0.8, and more than DISTANCE of SYMBOLS disagree
with a probability of about 2e-5. Pairs are then confirmed on the full shingle sets.

Nothing emits all pairs of a group:

1. Texts with equal shingle sets are one class, found by a pre-aggregated group-by; its smallest doc_id stands for it.
2. In every bucket (rows of one key) each class is paired with the bucket's smallest one only. These stars, filtered by
   signature distance, are confirmed and give components.
3. Only classes that are in one bucket but in different components can still add a link that matters. Their signatures
   are compared in blocks of at most ``BLOCK`` rows, and what is within the distance gives a forest over the
   components, not pairs. A larger bucket is dealt over pairs of blocks, but its largest component's rows meet only
   those of the others, so that a million near copies cost as many rows as there are strangers among them. The
   components that the forest connects are a family; in a family's blocks, dealt alike, the full shingle sets are
   compared through an inverted index, and only links that join two components come out. So no group's pairs are ever
   rows, and no link between two components is lost.

A key of over ``HOT`` rows is dealt over salts wherever it is joined.

Components are labelled by their smallest doc_id: by min-label propagation with pointer jumping over written tables, or
in one task while the edges are few enough, which is counted.

Edge cases: a null, empty or wordless text has no shingles and is linked with nothing; a text of fewer words is one
shingle; a null doc_id is never linked, has a null component and is kept; repeated rows are copies of each other; two
texts under one doc_id are two nodes of that name, and rows get the component of their own text's class. Other columns
are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from .common import sent_if_few, write_cut
from .textops import each_slice, mix, shingle_sets

CHUNKS, CHUNK, ALLOWED = 10, 4, 1
SYMBOLS = CHUNKS * CHUNK
DISTANCE = CHUNKS * (ALLOWED + 1) - 1
BLOCK = 1024
FAN = 256
KEYS = CHUNKS * CHUNK  # of a signature, as one symbol of a chunk is left out
FINISH_EDGES = 2_000_000
HOT, MOST_HOT = 1000, 2000
_MULTIPLIERS = np.random.default_rng(77).integers(0, 1 << 63, (SYMBOLS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_OFFSETS = np.random.default_rng(78).integers(0, 1 << 63, (SYMBOLS, 1), dtype=np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """SYMBOLS minhashes, 16 bits each. Long sets go in pieces, so that memory stays small."""
    least = np.full(SYMBOLS, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(0, len(shingles), 4096):
            np.minimum(least, ((shingles[None, k : k + 4096] ^ _OFFSETS) * _MULTIPLIERS).min(axis=1), out=least)
        return (mix(least) >> np.uint64(48)).astype(np.uint16)


def _sketches(size: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("fp", pa.binary()), ("sig", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, fps, sigs = [], [], []
            for _, _, words in each_slice(batch.column(1)):
                for s in shingle_sets(words, size):
                    n.append(len(s))
                    fps.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    sigs.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(fps, pa.binary()), pa.array(sigs, pa.binary())], schema=schema)

    return run


def _index_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept = list(combinations(range(CHUNK), CHUNK - ALLOWED))
    for batch in batches:
        if batch.num_rows == 0:
            continue
        symbols = _matrix(batch.column(1)).astype(np.uint64).reshape(-1, CHUNKS, CHUNK)
        keys = []
        for c in range(CHUNKS):
            for k, keep in enumerate(kept):
                packed = np.full(len(symbols), 1 + k + c * len(kept), np.uint64)
                for j in keep:
                    packed = (packed << np.uint64(16)) | symbols[:, c, j]
                keys.append(mix(packed))
        nodes = np.tile(batch.column(0).to_numpy(zero_copy_only=False), len(keys))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(nodes)], names=["key", "node"])


def _matrix(signatures: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(signatures.to_pylist()), np.uint16).reshape(len(signatures), -1)


def hamming(left: str, right: str):
    @arrow_udf("int")
    def distance(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array((_matrix(a) != _matrix(b)).sum(axis=1).astype(np.int32) if len(a) else np.zeros(0, np.int32))

    return distance(F.col(left), F.col(right))


def _grouped(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
    """Runs of equal values in the first ``width`` columns of sorted rows, each as the pieces it came in."""
    held, name = [], None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(width)]
        cut = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        for a, b in zip([0, *cut], [*cut, batch.num_rows]):
            now = tuple(int(c[a]) for c in cols)
            if now != name:
                if held:
                    yield name, held
                held, name = [], now
            held.append(batch.slice(a, b - a))
    if held:
        yield name, held


def _confirm(size: int, percent: int):
    """Rows (a, salt, side, node, text) sorted by the first three: a's own text first, then at most about FAN others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, own = None, []
        for batch in batches:
            a, salt, side, node = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            left, right, row = [], [], 0
            for _, _, words in each_slice(batch.column(4)):
                for s in shingle_sets(words, size):
                    if (a[row], salt[row]) != name:
                        name, own = (a[row], salt[row]), []
                    if side[row] == 0:
                        own.append(s)
                    elif any(_linked(s, o, percent) for o in own):
                        left.append(a[row])
                        right.append(node[row])
                    row += 1
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return run


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if not len(x) or not len(y) or 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


class _Union:
    """Joined labels, within one task."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
        return x != y


def _near_in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, i, j, block, node, comp, first, n, sig) sorted by the first three: a forest over the components that have signatures within the distance."""
    for (_, i, j), pieces in _grouped(batches, 3):
        t = pa.Table.from_batches(pieces).combine_chunks().to_batches()[0]
        block, node, comp, first, n = (t.column(k).to_numpy(zero_copy_only=False) for k in range(3, 8))
        sig = _matrix(t.column(8))
        rows = np.flatnonzero(block == i)
        others = np.flatnonzero(block == j)
        left, right, union = [], [], _Union()
        for x in rows:
            if node[x] == first[x]:
                continue  # its pairs were all confirmed or not
            ys = others[others > x] if i == j else others
            ys = ys[(comp[ys] != comp[x]) & (first[ys] != node[ys])]
            ys = ys[(5 * n[ys] >= 4 * n[x]) & (5 * n[x] >= 4 * n[ys])]
            if len(ys):
                for c in np.unique(comp[ys[(sig[ys] != sig[x]).sum(axis=1) <= DISTANCE]]).tolist():
                    if union.join(int(comp[x]), c):
                        left.append(int(comp[x]))
                        right.append(c)
        if left:
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])


def _family_links(size: int, percent: int):
    """Rows (family, i, j, block, node, comp, text) sorted by the first three: links between different components, a spanning set of them.

    The shingles of block j are an inverted index, which gives a text's intersections with all of them at once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j), pieces in _grouped(batches, 3):
            block, node, comp = (np.concatenate([p.column(k).to_numpy(zero_copy_only=False) for p in pieces]) for k in (3, 4, 5))
            sets = [s for p in pieces for _, _, words in each_slice(p.column(6)) for s in shingle_sets(words, size)]
            rows, others = np.flatnonzero(block == i), np.flatnonzero(block == j)
            if not len(rows) or not len(others):
                continue
            lengths = np.array([len(sets[y]) for y in others])
            shingles, owners = np.concatenate([sets[y] for y in others]), np.repeat(np.arange(len(others)), lengths)
            order = np.argsort(shingles, kind="stable")
            shingles, owners = shingles[order], owners[order]
            left, right, union = [], [], _Union()
            for x in rows:
                s = sets[x]
                able = (comp[others] != comp[x]) & (100 * np.minimum(lengths, len(s)) >= percent * np.maximum(lengths, len(s)))
                if not able.any():
                    continue
                lo = np.searchsorted(shingles, s, "left")
                n = np.searchsorted(shingles, s, "right") - lo
                at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
                both = np.bincount(owners[at], minlength=len(others))
                for y in others[able & (both > 0) & (100 * both >= percent * (lengths + len(s) - both))]:
                    if union.join(int(comp[x]), int(comp[y])):
                        left.append(min(node[x], node[y]))
                        right.append(max(node[x], node[y]))
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return run


def _in_block_pairs(rows: DataFrame, group: str, block: int) -> DataFrame:
    """rows (group, node, comp, ..) of the groups that hold several components, with block, i, j.

    A group of up to ``block`` rows is one block. In a larger one the largest component and the others have blocks of
    their own: each block of the others meets all blocks, those of the largest component do not meet each other.
    """
    by_comp = rows.groupBy(group, "comp").agg(F.count("*").alias("n"))
    by_group = by_comp.groupBy(group).agg(F.sum("n").alias("size"), F.max(F.struct("n", "comp")).alias("top"), F.count("*").alias("comps")).where("comps > 1")
    half = F.lit(block // 2)
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(n / half)).cast("int")
    plan = by_group.select(group, (F.col("size") <= block).alias("small"), F.col("top.comp").alias("top"), blocks(F.col("size") - F.col("top.n")).alias("rest"), blocks(F.col("top.n")).alias("tops"))
    x = rows.join(sent_if_few(write_cut(plan, "block-plan")), group)
    in_top = F.col("comp") == F.col("top")
    own = F.pmod(F.xxhash64("node"), F.when(in_top, F.col("tops")).otherwise(F.col("rest"))).cast("int")
    x = x.withColumn("block", F.when(F.col("small"), 0).when(in_top, F.col("rest") + own).otherwise(own))
    last = F.when(F.col("small"), 0).when(in_top, F.col("rest") - 1).otherwise(F.col("rest") + F.col("tops") - 1)
    x = x.withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    return x.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, comp) of all edges, in one task."""
    union = _Union()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            union.up.setdefault(a, a)
            union.up.setdefault(b, b)
            union.join(a, b)
    nodes = list(union.up)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([union.find(x) for x in nodes], pa.int64())], names=["node", "comp"])


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for the nodes of ``edges`` (a, b), a written table: the smallest node reachable.

    Up to ``FINISH_EDGES`` edges, counted first, are a bounded job for one task. More go in rounds of min-labels and
    pointer jumps over written tables until nothing changes.
    """
    if edges.count() <= FINISH_EDGES:
        return write_cut(edges.select("a", "b").coalesce(1).mapInArrow(_finish, "node long, comp long"), "labels")
    both = write_cut(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "links")
    label = write_cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("comp")), "labels")
    while True:
        near = both.join(label.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        step = label.join(near, "node").select("node", "comp", F.least("comp", "near").alias("next"))
        up = label.select(F.col("node").alias("next"), F.col("comp").alias("up"))
        step = write_cut(step.join(up, "next", "left").select("node", F.col("comp").alias("was"), F.least("next", F.coalesce("up", "next")).alias("comp")), "labels")
        label = step.select("node", "comp")
        if step.where("comp <> was").limit(1).count() == 0:
            return label


def _of_nodes(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text) of the listed nodes (node, distinct, a written table). Few, counted first, are sent to the texts; else the texts are shuffled."""
    return docs.select(F.col("doc_id").alias("node"), "text").join(sent_if_few(nodes), "node", "left_semi")


class NearDuplicates:
    """shingle: words in a shingle; percent: links have 100 * intersection >= percent * union (80 or more)."""

    def __init__(self, docs: DataFrame, shingle: int = 5, percent: int = 80):
        if percent < 80:
            raise ValueError("the signature distance is set for similarities of 0.8 and more")
        self.shingle, self.percent = shingle, percent
        docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        self.sketch = write_cut(docs.mapInArrow(_sketches(shingle), "doc_id long, n_shingles long, fp binary, sig binary"), "sketch")
        ranked = self.sketch.where("fp IS NOT NULL AND doc_id IS NOT NULL")
        self.classes = write_cut(ranked.groupBy("fp").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig")), "classes")
        nodes = self.classes.select("node", "n", "sig")
        keys = nodes.select("node", "sig").mapInArrow(_index_keys, "key long, node long")
        buckets = keys.groupBy("key").agg(F.count("*").alias("size"), F.min("node").alias("first")).where("size > 1")
        members = write_cut(self._members(keys, write_cut(buckets, "buckets"), self.classes.count() * KEYS), "members")

        star = members.where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
        side = lambda k: nodes.select(F.col("node").alias(k), F.col("n").alias(f"n_{k}"), F.col("sig").alias(f"sig_{k}"))
        near = star.join(side("a"), "a").join(side("b"), "b").where("5 * least(n_a, n_b) >= 4 * greatest(n_a, n_b)").where(hamming("sig_a", "sig_b") <= DISTANCE)
        near = write_cut(near.select("a", "b"), "stars")
        links = self._confirmed(docs, near)
        comps = components(links)

        placed = members.where("size > 2").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        dealt = _in_block_pairs(placed.select("key", "node", "comp", "first"), "key", BLOCK).join(nodes, "node")
        dealt = dealt.select("key", "i", "j", "block", "node", "comp", "first", "n", "sig")
        forest = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_near_in_blocks, "a long, b long").distinct()
        forest = write_cut(forest, "forest")
        if forest.limit(1).count():
            links = write_cut(links.union(self._within_families(docs, forest, comps)), "all-links")
            comps = components(links)
        self.links, self.components = links, comps

    @staticmethod
    def _members(keys: DataFrame, buckets: DataFrame, total: int) -> DataFrame:
        """key, node, size, first of the keys that several classes have. Hot keys, of which there are at most ``MOST_HOT``, are dealt over salts on both sides."""
        hot = buckets.where(F.col("size") > max(HOT, total // MOST_HOT)).select("key", F.ceil(F.col("size") / F.lit(HOT)).cast("int").alias("salts"))
        salts = F.coalesce("salts", F.lit(1))
        rows = keys.join(F.broadcast(hot), "key", "left").withColumn("salt", F.pmod(F.xxhash64("node"), salts).cast("int")).drop("salts")
        dealt = buckets.join(F.broadcast(hot), "key", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
        return rows.join(dealt, ["key", "salt"]).drop("salt")

    def _confirmed(self, docs: DataFrame, pairs: DataFrame) -> DataFrame:
        """Those of ``pairs`` (a, b) whose full shingle sets are alike enough. A node with many partners is dealt over salts of about FAN."""
        fan = pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(FAN)).alias("fan"))
        salted = pairs.join(fan, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("fan")).cast("int"))
        wanted = write_cut(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "pair-nodes")
        texts = write_cut(_of_nodes(docs, wanted), "pair-texts")
        others = salted.select("a", "salt", F.lit(1).alias("side"), F.col("b").alias("node")).join(texts, "node")
        owns = salted.select("a", "salt").distinct().select("a", "salt", F.lit(0).alias("side"), F.col("a").alias("node")).join(texts, "node")
        cols = ["a", "salt", "side", "node", "text"]
        rows = owns.select(*cols).union(others.select(*cols)).repartition("a", "salt").sortWithinPartitions("a", "salt", "side")
        return write_cut(rows.mapInArrow(_confirm(self.shingle, self.percent), "a long, b long").distinct(), "confirmed")

    def _within_families(self, docs: DataFrame, forest: DataFrame, comps: DataFrame) -> DataFrame:
        """Links between different components of a family: those that the forest connects."""
        families = components(forest).select(F.col("node").alias("comp"), F.col("comp").alias("family"))
        alone = families.select(F.col("comp").alias("node"), "comp", "family").join(comps.select("node"), "node", "left_anti")
        members = write_cut(comps.join(families, "comp").select("node", "comp", "family").union(alone), "families")
        texts = write_cut(_of_nodes(docs, write_cut(members.select("node").distinct(), "family-nodes")), "family-texts")
        rows = _in_block_pairs(members, "family", BLOCK).join(texts, "node").select("family", "i", "j", "block", "node", "comp", "text")
        rows = rows.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j")
        return write_cut(rows.mapInArrow(_family_links(self.shingle, self.percent), "a long, b long").distinct(), "family-links")

    def report(self) -> DataFrame:
        """doc_id, n_shingles, component_id, kept: one row per row of the documents."""
        named = self.classes.select("fp", "node").join(self.components, "node", "left").select("fp", F.coalesce("comp", "node").alias("comp"))
        out = self.sketch.select("doc_id", "n_shingles", "fp").join(named, "fp", "left")
        component = F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id"))
        return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def deduplicate(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the documents that are not the first of their component, with all their columns."""
    gone = write_cut(NearDuplicates(docs, shingle, percent).report().where("NOT kept").select(F.col("doc_id").alias("gone_id")).distinct(), "gone")
    return docs.join(sent_if_few(gone), docs["doc_id"] == gone["gone_id"], "left_anti")
