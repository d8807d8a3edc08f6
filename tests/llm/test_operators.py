import hashlib
import importlib.util
import math
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from leaklens.llm import blocks, bytecnn, decontaminate, host_rules, lm, minhash, mixing, pii, secrets, sharding, substrings, textops  # noqa: E402


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


# 1


def test_near_duplicates(spark, docs, texts):
    got = minhash.NearDuplicates(docs, shingle=4).report()
    rows = by_id(got)
    want = brute.components(texts)
    assert {i: (rows[i].n_shingles, rows[i].component_id) for i in texts} == want
    assert all(rows[i].kept == (want[i][1] == i) for i in texts)
    assert rows[None].kept and rows[None].component_id is None and got.count() == len(texts) + 2


def test_components_in_rounds_are_those_of_one_task(spark, monkeypatch):
    r = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in r.integers(0, 400, (250, 2))] + [(k, k + 1) for k in range(1000, 1060)]
    df = spark.createDataFrame(edges, "a long, b long")
    one = {r.node: r.comp for r in minhash.components(df).collect()}
    monkeypatch.setattr(minhash, "FINISH_EDGES", 0)
    rounds = {r.node: r.comp for r in minhash.components(df).collect()}
    assert all(one[n] == c for n, c in rounds.items()) and all(one[n] == n for n in set(one) - set(rounds)) and one[1060] == 1000


def test_pairs_within_the_distance_share_a_key():
    r = np.random.default_rng(1)
    for _ in range(200):
        a = r.integers(0, 65536, minhash.SYMBOLS).astype(np.uint16)
        b = a.copy()
        b[r.permutation(minhash.SYMBOLS)[: minhash.DISTANCE]] ^= 1
        batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([a.tobytes(), b.tobytes()])], names=["node", "sig"])
        out = next(minhash._index_keys(iter([batch])))
        keys = [{k for k, n in zip(out.column(0).to_pylist(), out.column(1).to_pylist()) if n == x} for x in (1, 2)]
        assert keys[0] & keys[1]


def test_pairs_at_the_threshold_are_within_the_distance():
    """Sets of a similarity from 0.80 to 0.85: none of them may be beyond the signature distance, or the join would miss it."""
    r = np.random.default_rng(12)
    missed = 0
    for _ in range(3000):
        n = int(r.integers(20, 300))
        similarity = r.uniform(0.80, 0.85)
        both = math.ceil(similarity * 2 * n / (1 + similarity))
        pool = r.integers(0, 1 << 63, 2 * n - both, dtype=np.uint64)
        a, b = minhash.signature(pool[:n]), minhash.signature(pool[n - both :])
        missed += int((a != b).sum()) > minhash.DISTANCE
    assert missed <= 1


def test_a_hot_bucket_of_several_components(spark, monkeypatch):
    """A template's near copies, one component, among strangers that only share its words: blocks, salts and families all take part."""
    for name, value in (("BLOCK", 16), ("HOT", 5), ("FAN", 3), ("MOST_HOT", 10**9)):
        monkeypatch.setattr(minhash, name, value)
    r = np.random.default_rng(5)
    base = [f"w{k}" for k in range(100)]
    listed = {}
    for k in range(120):
        words = list(base)
        for at in r.integers(0, 100, int(r.integers(0, 4))):
            words[at] = f"e{k}_{at}"
        listed[k] = " ".join(words)
    for k in range(60):
        words = list(base)
        for at in range(k % 7, 100, 7):
            words[at] = f"s{k % 20}_{at}"
        listed[500 + k] = " ".join(words)
    df = spark.createDataFrame([*listed.items()], "doc_id long, text string").repartition(4)
    got = {x.doc_id: x.component_id for x in minhash.NearDuplicates(df, shingle=4).report().collect()}
    assert got == {i: c for i, (_, c) in brute.components(listed).items()}


def test_a_family_that_only_chains_is_one_component(spark):
    """Texts that are alike to their neighbours only, in blocks smaller than the family."""
    base = [f"w{k}" for k in range(200)]
    chain = {k: " ".join(base[k * 3 : k * 3 + 60]) for k in range(40)}
    chain |= {100 + k: " ".join(f"z{k}_{j}" for j in range(50)) for k in range(10)}
    want = brute.components(chain, 5)
    df = spark.createDataFrame(list(chain.items()), "doc_id long, text string")
    for block in (4, 1024):
        minhash.BLOCK, keep = block, minhash.BLOCK
        try:
            rows = by_id(minhash.NearDuplicates(df, 5).report())
        finally:
            minhash.BLOCK = keep
        assert {i: rows[i].component_id for i in chain} == {i: c for i, (_, c) in want.items()}


# 2


def test_host_rules(docs, texts):
    rows = by_id(host_rules.assess(docs))
    for i, t in texts.items():
        r, w = rows[i], brute.measures(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == w
        assert r.base_failed == (w[0] < 50 or 100 * w[4] > 50 * w[0]) and not (r.base_failed and r.kept)


def test_hosts_decide_what_a_failure_means(spark, nothing):
    good = " ".join(f"word{k}" for k in range(80))
    junk = " ".join(f"w{k} ##" for k in range(80))
    rows = [(k, good, "fine") for k in range(600)] + [(1000 + k, "short", "bad") for k in range(59)] + [(1100, good, "bad"), (1200, good, None)]
    rows += [(2000 + k, good, "mixed") for k in range(300)] + [(2400 + k, junk, "mixed") for k in range(30)]
    rows += [(3000, junk, "fine")] + [(4000 + k, junk, "spam") for k in range(80)] + [(4100, good, "spam")]
    got = by_id(host_rules.assess(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)))
    assert got[0].kept and got[1200].kept and got[2000].kept
    assert not got[1100].base_failed and not got[1100].kept and not got[1100].host_kept  # a host of short texts
    assert not got[4100].kept and not got[4100].host_kept  # a host of symbols
    assert not got[2400].kept and got[2400].host_kept  # junk of a middling host
    assert got[3000].kept  # one odd page of a clean host
    assert host_rules.assess(nothing).count() == 0


def test_priors_do_not_take_noise_for_spread():
    r = np.random.default_rng(2)
    alike = [(1000, int(k)) for k in r.binomial(1000, 0.1, 200)]
    apart = [(1000, int(k)) for k in r.binomial(1000, r.beta(2, 18, 200))]
    of = lambda hosts: host_rules.beta_prior(len(hosts), sum(n for n, _ in hosts), sum(k for _, k in hosts), sum(k * k / n for n, k in hosts), 10_000.0)
    assert of(alike)[1] > 500 and 10 < of(apart)[1] < 40 and abs(of(apart)[0] - 0.1) < 0.02


# 3


def test_mixing_meets_its_targets(spark):
    words = {"en": "the of and with house tree", "de": "der und mit nicht haus baum"}
    rows = [(k, " ".join(words["en" if k % 4 else "de"].split()[j % 6] for j in range(k % 30 + 5)), "en" if k % 4 else "de") for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = df.selectExpr("doc_id", "1 AS quality").where("doc_id % 3 = 0")
    out = mixing.rates(df, labels, targets={"en": 0.5, "de": 0.5}, budget=8000.0).collect()
    en = sum(r.rate * r.n_tokens * r.posterior[1] for r in out)
    de = sum(r.rate * r.n_tokens * r.posterior[0] for r in out)
    assert abs(en - 4000) < 40 and abs(de - 4000) < 40 and min(r.rate for r in out) >= 0
    assert all(math.floor(r.rate) <= r.copies <= math.ceil(r.rate) for r in out)
    assert sum(r.domain == ("en" if r.doc_id % 4 else "de") for r in out) == 400


def test_mixed_rows_meet_the_targets_though_none_goes(spark):
    words = {"en": "the of and with house tree", "de": "der und mit nicht haus baum"}
    rows = [(k, " ".join(words["en" if k % 5 else "de"].split()[j % 6] for j in range(k % 30 + 5)), "en" if k % 5 else "de") for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = df.selectExpr("doc_id", "1 AS quality").where("doc_id % 3 = 0")
    out = mixing.mix(df, labels, targets={"en": 0.5, "de": 0.5}).collect()
    total = {lang: sum(len(r.text.split()) for r in out if r.lang == lang) for lang in words}
    have = mixing.ROOM * sum(len(t.split()) for _, t, lang in rows if lang == "en")
    assert len({r.doc_id for r in out}) == 3000
    assert abs(total["en"] / have - 1) < 0.03 and abs(total["de"] / have - 1) < 0.03


def test_mixed_rows_keep_their_columns(docs, labels, nothing):
    out = mixing.mix(docs, labels)
    assert out.columns == docs.columns and out.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    assert mixing.rates(nothing, labels).count() == 0 == mixing.mix(nothing, labels).count()


# 4


def test_personal_data(spark):
    texts = {
        1: "mail to ab.c@x-y.example.com, or call +1 (649) 555-6111 now. From 10.0.0.255 and 999.1.1.1",
        2: "card 4009066533180588 and 4009066533180589; phone (212) 555-0101 or ssn 123-45-6789",
        3: None, 4: "", 5: "a@b no host, 1.2.3, +12", 6: "ü@ ä+1 234 567 8901 x@y.z@q.r",
    }
    rows = by_id(pii.find(spark.createDataFrame(list(texts.items()), "doc_id long, text string")))
    assert (rows[1].n_email, rows[1].n_ip, rows[1].n_card, rows[1].n_phone) == (1, 1, 0, 1)
    assert (rows[2].n_card, rows[2].n_phone) == (1, 0) and rows[3].spans == rows[4].spans == "" == rows[5].spans
    assert rows[3].base_sha256 == hashlib.sha256(b"").hexdigest()
    for i, t in texts.items():
        base = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in pii.base_spans(t or ""))
        assert hashlib.sha256(base.encode()).hexdigest() == rows[i].base_sha256 and set(base.split(",")) - {""} <= set(rows[i].spans.split(","))


def plain_spans(text):
    """The contract's patterns as they stand."""
    import re

    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0

    digits = lambda m: re.sub("[^0-9]", "", m)
    kinds = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    )
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, pattern, good in kinds for m in re.finditer(pattern, text or "") if good(m[0]))


def test_base_spans_equal_the_plain_patterns():
    import random

    r = random.Random(6)
    parts = ["a", "Z", "b.c", "@", "@", ".", "-", "+", "1", "23", "255", "256", "4009066533180588", "0", " ", "(", ")", "_", "%", "ü", "\n", "1.2.3.4", "x@y.z", "+1 234 567 8901"]
    for _ in range(20_000):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 14)))
        assert ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in pii.base_spans(t)) == plain_spans(t), t


def test_planted_data_beyond_the_patterns_is_found(spark, nothing):
    r = np.random.default_rng(3)
    word = lambda: "".join(chr(x) for x in r.integers(97, 123, int(r.integers(2, 9))))
    num = lambda n: "".join(str(x) for x in r.integers(0, 10, n))
    filler = lambda: " ".join(word() for _ in range(12))

    def account():
        body = "37040044" + num(10)
        check = 98 - int(body + "131400") % 97
        whole = f"DE{check:02d}{body}"
        return " ".join(whole[k : k + 4] for k in range(0, len(whole), 4))

    good = {
        "email": lambda: f"email {word()} (at) {word()} (dot) com",
        "ip": lambda: "server " + ":".join(f"{x:x}" for x in r.integers(0x2a00, 0xffff, 8)),
        "phone": lambda: f"call 0{num(3)} {num(3)} {num(3)}",
        "ssn": lambda: f"ssn {r.integers(100, 665)}-{r.integers(10, 99)}-{r.integers(1000, 9999)}",
        "iban": lambda: f"account {account()}",
        "card": lambda: "card 4009.0665.3318.0588",
    }
    bad = {
        "email": lambda: f"we met {word()} at {word()}.{word()} then", "ip": lambda: f"time 12:{r.integers(10, 59)}:{r.integers(10, 59)}", "ssn": lambda: f"order {r.integers(900, 999)}-{r.integers(10, 99)}-0000",
        "iban": lambda: f"part DE{num(2)} {num(4)} {num(4)} {num(4)} {num(4)} {num(2)}", "card": lambda: "number 4009.0665.3318.0589", "phone": lambda: f"version 10.{num(2)}.{num(2)}",
    }
    rows, want, wrong = [], {}, {}
    for k in range(400):
        kind = list(good)[k % 6]
        lead, item = filler() + " ", good[kind]()
        cue = item.index(" ") + 1
        text = f"{lead}{item} {filler()}"
        want[k] = f"{kind}:{len(lead) + cue}:{len(lead) + len(item)}"
        rows.append((k, text))
        rows.append((1000 + k, f"{filler()} {bad[kind]()} {filler()}"))
    df = spark.createDataFrame(rows + rows[:1] + [(None, None)], "doc_id long, text string").withColumn("spans", F.lit("clash")).withColumn("base", F.lit(1))
    got = pii.find(df).collect()
    assert len(got) == len(rows) + 2 and pii.find(nothing).count() == 0
    found = {r_.doc_id: r_.spans for r_ in got}
    caught = sum(w in found[k].split(",") for k, w in want.items())
    clean = sum(found[1000 + k] == "" for k in range(400))
    assert caught >= 390 and clean >= 390, (caught, clean)


def test_reliabilities_find_the_good_labeler():
    r = np.random.default_rng(0)
    truth = r.random(4000) < 0.5
    votes = np.stack([np.where(r.random(4000) < p, truth, ~truth) * 2 - 1 for p in (0.95, 0.9, 0.55)], axis=1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    post, table, prior = pii.reliabilities(patterns, counts.astype(float))
    assert table[1, 0, 2] > 0.9 > 0.7 > table[1, 2, 2] and 0.45 < prior < 0.55


# 5


def test_shards_are_near_equal_and_whole(docs, texts, nothing):
    out = sharding.assign(docs, 7).collect()
    assert len(out) == docs.count()
    sizes = Counter()
    for r in out:
        sizes[r.shard] += r.size
        assert r.law == "bytes" and r.grown_shard is None
        if r.doc_id is not None:
            assert r.size == len((texts[r.doc_id] or "").encode()) + 16
    biggest = max(r.size for r in out)
    assert all(abs(sizes[s] - sum(sizes.values()) / 7) <= biggest for s in range(7))
    for s in range(7):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    order = sorted((r.text_crc32, r.doc_id is not None, r.doc_id or 0, r.shard) for r in out)
    assert [x[3] for x in order] == sorted(x[3] for x in order)
    assert sharding.assign(nothing, 7).count() == 0


def test_shards_equal_prefix_sums_of_the_sorted_rows(docs):
    import zlib

    rows = [(zlib.crc32((r.text or "").encode()), r.doc_id is not None, r.doc_id or 0, len((r.text or "").encode()) + 16) for r in docs.collect()]
    total, before, want, slots = sum(r[3] for r in rows), 0, [], Counter()
    for crc, known, doc_id, size in sorted(rows):
        part = before * 7 // total
        want.append((doc_id if known else None, size, crc, part, slots[part]))
        slots[part] += 1
        before += size
    got = [(r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in sharding.assign(docs, 7).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_sharded_records_keep_clashing_columns(docs):
    out = sharding.shard(docs, 5)
    assert out.columns[: len(docs.columns)] == docs.columns and len(set(out.columns)) == len(docs.columns) + 2 and out.count() == docs.count()


def test_one_hot_text_is_spread(spark):
    df = spark.createDataFrame([(k, "same text" if k % 3 else f"text {k}") for k in range(3000)], "doc_id long, text string")
    n = Counter(r.shard for r in sharding.assign(df, 10).collect())
    assert max(n.values()) - min(n.values()) < 150 and len(n) == 10


# 6


def test_network_learns_and_scores_whole_texts(spark):
    r = np.random.default_rng(2)
    word = lambda: "".join(r.choice(list("abcdefgh"), 5))
    rows = []
    for k in range(400):
        good = k % 2
        w = [word() for _ in range(60)]
        rows.append((k, " ".join(w) if good else " ".join(x + "###" for x in w), good))
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    out = by_id(bytecnn.classify(df.select("doc_id", "text"), df.select("doc_id", "quality")))
    held = [k for k, _, _ in rows if brute.crc(k, 4) == 2]
    assert all(out[k].held_out == (brute.crc(k, 4) == 2) for k in out)
    assert sum(out[k].predicted == k % 2 for k in held) / len(held) >= 0.9
    assert all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.7) for x in out.values())


def test_scores_do_not_depend_on_neighbours(texts):
    model = bytecnn.Model()
    table = model.tables()
    raw = [(t or "").encode() for t in texts.values()]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    together = model.probabilities(np.frombuffer(b"".join(raw), np.uint8), offsets, table)
    alone = np.array([model.probabilities(np.frombuffer(x, np.uint8), np.array([0, len(x)]), table)[0] for x in raw])
    assert np.allclose(together, alone, atol=1e-6)


def test_scores_equal_a_plain_network(texts):
    """Position by position, chunk by chunk."""
    import re

    model = bytecnn.Model(3)
    table = model.tables()
    for t in list(texts.values())[::5] + ["go go GO stop", "a" * 700, "é " * 300]:
        raw = (t or "").encode()
        symbols, last = list(raw), None
        for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw):
            if m[0].lower() == last:
                symbols[m.start() : m.end()] = [256 + b for b in m[0]]
            last = m[0].lower()
        padded = symbols + [0] * bytecnn.WIDTH
        response = np.array([np.maximum(0, model.bias + sum(model.embed[padded[p + w]] @ model.filters[w] for w in range(bytecnn.WIDTH) if p + w < len(padded))) for p in range(len(raw) + 1)])
        chunks = np.array([response[k : k + bytecnn.CHUNK].max(axis=0) for k in range(0, len(response), bytecnn.HALF)])
        z = np.concatenate([chunks.mean(axis=0), chunks.max(axis=0)]) @ model.out + model.offset[0]
        got = model.probabilities(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), table)[0]
        assert abs(got - 1 / (1 + np.exp(-z))) < 1e-4


def test_gradient_agrees_with_differences():
    model = bytecnn.Model(3)
    raw = bytes(np.random.default_rng(4).choice(list(b"etaoin shrdlu##"), 700).astype(np.uint8))
    offsets, y = np.array([0, 300, len(raw)]), np.array([1.0, 0.0], np.float32)
    g = bytecnn.gradient(model, np.frombuffer(raw, np.uint8), offsets, y)

    def loss():
        p = np.clip(model.probabilities(np.frombuffer(raw, np.uint8), offsets, model.tables()), 1e-9, 1 - 1e-9)
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)) + 0.5e-4 * float(model.out @ model.out)

    for name, at in (("out", (3,)), ("bias", (2,)), ("filters", (1, 2, 3)), ("embed", (ord("e"), 1))):
        p, e = getattr(model, name), 2e-3
        p[at] += e
        up = loss()
        p[at] -= 2 * e
        down = loss()
        p[at] += e
        assert abs((up - down) / (2 * e) - g[name][at]) < 1e-3 + 0.05 * abs(g[name][at]), name


def test_classifier_without_labels(docs, labels, nothing):
    none = bytecnn.classify(docs, labels.limit(0))
    assert {r.score for r in none.collect()} == {0.5} and bytecnn.classify(nothing, labels).count() == 0
    assert bytecnn.keep_good(docs, labels).columns == docs.columns


# 7


def test_repeats(docs, texts, nothing):
    rows = by_id(substrings.remove_repeats(docs))
    want = brute.repeats({i: t for i, t in texts.items()})
    assert {i: (rows[i].n_bytes, rows[i].n_removed, rows[i].n_spans, rows[i].kept_sha256) for i in texts} == want
    assert rows[None].n_removed == 0 and substrings.remove_repeats(nothing).count() == 0


def test_repeats_with_hot_anchors(spark, docs, texts, monkeypatch):
    monkeypatch.setattr(substrings, "HOT", 3)
    monkeypatch.setattr(blocks, "block_bytes", lambda size: 2000)
    monkeypatch.setattr(substrings, "RANGE", 5000)
    rows = by_id(substrings.remove_repeats(docs))
    want = brute.repeats(texts)
    assert {i: (rows[i].n_removed, rows[i].kept_sha256) for i in texts} == {i: (w[1], w[3]) for i, w in want.items()}


def test_index_family_keeps_few_levels():
    family, r = substrings.SuffixIndexFamily(), np.random.default_rng(0)
    seen, first = set(), {}
    for k in range(64):
        keys = np.unique(r.integers(0, 99999, 100).astype("S50"))
        family.add(keys, np.full(len(keys), k))
        seen |= set(keys.tolist())
        first = {x: k for x in keys.tolist()} | first
        assert family.scan(keys, np.full(len(keys), k)).tolist() == [first[x] for x in keys.tolist()]
    assert set(np.concatenate([a for a, _ in family.levels]).tolist()) == seen
    assert len(family.levels) <= 8 and all(len(a[0]) >= 2 * len(b[0]) for a, b in zip(family.levels, family.levels[1:]))


def test_one_passage_in_most_documents(spark, monkeypatch):
    """Its edges differ in each document, so that its outer anchors are crowded; equal and near copies besides."""
    monkeypatch.setattr(substrings, "HOT", 20)
    monkeypatch.setattr(blocks, "block_bytes", lambda size: 3000)
    r = np.random.default_rng(4)
    make = lambda n: "".join(chr(x) for x in r.integers(97, 123, n))
    passage = make(130)
    listed = {k: make(r.integers(0, 60)) + passage + make(r.integers(0, 60)) for k in range(120)}
    listed |= {500 + k: listed[7] for k in range(30)}
    listed |= {600 + k: listed[8][:40] + make(1) + listed[8][41:] for k in range(30)}
    rows = by_id(substrings.remove_repeats(spark.createDataFrame([*listed.items()], "doc_id long, text string").repartition(5)))
    want = brute.repeats(listed)
    assert {i: (x.n_removed, x.n_spans, x.kept_sha256) for i, x in rows.items()} == {i: w[1:] for i, w in want.items()}


def test_block_numbers_fall_into_the_bucket_of_their_task(spark):
    from itertools import islice

    for task, buckets in ((0, 16), (7, 5), (123_456, 1000)):
        numbers = list(islice(blocks._numbers(task, buckets), 3))
        got = spark.createDataFrame([(n,) for n in numbers], "n long").selectExpr(f"pmod(hash(n), {buckets}) AS b").distinct().collect()
        assert [r.b for r in got] == [task % buckets]


# 8


def test_language_model(docs, texts):
    rows = by_id(lm.score(docs))
    train = Counter()
    listed = [*texts.items(), (10, texts[10]), (None, "a text without an id that is long enough to hold more than fifty bytes")]
    for i, t in listed:
        if brute.crc(i, 7) != 2:
            train.update([*brute.words(brute.lower(t)), None])
    n, v = sum(train.values()), len(train)
    for i, t in listed:
        w = [*brute.words(brute.lower(t)), None]
        r = rows[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(w), sum(train[x] > 0 for x in w), n, brute.crc(i, 7) == 2)
        assert math.isclose(r.base_score, sum(math.log10((train[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
        assert r.score <= 1e-9


def test_automaton_probabilities_sum_to_one(spark):
    text = " ".join(["a b c", "a b d", "b c a", "a b c d"] * 30)
    df = spark.createDataFrame([(k, text) for k in range(5)], "doc_id long, text string")
    _, frequent, n, v = lm.fit(df.select("text"))
    auto = lm.Automaton(frequent, n, v)
    for s in range(len(auto.back)):
        total = 1 / (n + v + 1)  # the unknown word at the root
        weight, state, seen = 0.0, s, set()
        mass = 0.0
        while True:
            if state == 0:
                mass += sum(10 ** (weight + p) for w, p in enumerate(auto.root) if w not in seen) + 10**weight * total
                break
            for key, k in auto.arcs.items():
                if key >> lm.BITS == state and key & ((1 << lm.BITS) - 1) not in seen:
                    seen.add(key & ((1 << lm.BITS) - 1))
                    mass += 10 ** (weight + auto.weight[k])
            weight += auto.back[state]
            state = auto.fail[state]
        assert abs(mass - 1) < 1e-6


def test_rare_ngrams_count_in_large_corpora(spark):
    filler = " ".join(["x y z x x"] * 40_000)
    rare = "words that come twice"
    rows = [(k, filler) for k in range(14)] + [(100 + k, f"{rare} pair{k // 2} of{k // 2} x y{k // 2} only{k} here") for k in range(12)] + [(200, None), (201, "x"), (None, rare)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    train, seqs = [Counter(), Counter(), Counter()], []
    for i, t in rows:
        w = [None, *brute.words(t or ""), None]
        seqs.append((i, w))
        if brute.crc(i, 7) != 2:
            for n in (1, 2, 3):
                train[n - 1].update(zip(*[w[(1 if n == 1 else 0) + k :] for k in range(n)]))
    c1, c2, c3 = train
    assert sum(c1.values()) > 2_000_000
    n_v = sum(c1.values()) + len(c1) + 1
    p1 = lambda w: (c1[w,] + 1) / n_v
    arcs2, arcs3 = {g: c for g, c in c2.items() if c >= 2}, {g: c for g, c in c3.items() if c >= 2}
    p2 = lambda v, w: (arcs2[v, w] - 0.5) / max(c1[v,], arcs2[v, w])
    left, below = Counter(), Counter()
    for (v, w), c in arcs2.items():
        left[v,] += p2(v, w)
        below[v,] += p1(w)
    for (u, v, w), c in arcs3.items():
        left[u, v] += (c - 0.5) / c2[u, v]
        below[u, v] += p2(v, w)
    back = lambda h: math.log10(max(1e-9, 1 - left[h]) / max(1e-9, 1 - below[h])) if h in left else 0.0

    def one(w, k):
        a, b, c = (w[k - 2] if k > 1 else 0), w[k - 1], w[k]
        if k > 1 and (a, b, c) in arcs3:
            return math.log10((arcs3[a, b, c] - 0.5) / c2[a, b])
        low = math.log10(p2(b, c)) if (b, c) in arcs2 else back((b,)) + math.log10(p1(c))
        return (back((a, b)) if k > 1 else 0.0) + low

    want = sorted((str(i), round(sum(one(w, k) for k in range(1, len(w))), 3)) for i, w in seqs if len(w) < 100)
    got = sorted((str(r.doc_id), round(r.score, 3)) for r in lm.score(df).collect() if r.n_tokens < 100)
    assert got == want


def test_looked_up_scores_are_those_of_the_automaton(spark, docs, nothing, monkeypatch):
    monkeypatch.setattr(blocks, "block_bytes", lambda size: 2000)
    walked = sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in lm.score(docs).collect())
    monkeypatch.setattr(lm, "WHOLE", -1)
    looked = sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in lm.score(docs).collect())
    assert looked == walked and lm.score(nothing).count() == 0


# 9


def test_nested_secrets(spark):
    import base64
    import gzip
    import urllib.parse

    secret = 'token = "0123456789abcdef0123456789abcdef01234567"'
    layers = {
        1: secret, 2: urllib.parse.quote(secret, safe=""), 3: base64.b64encode(secret.encode()).decode(), 4: base64.b64encode(gzip.compress(gzip.compress(secret.encode()))).decode(),
        5: urllib.parse.quote(base64.b64encode(urllib.parse.quote(secret).encode()).decode(), safe=""), 6: "".join(f"\\u{ord(c):04x}" for c in secret), 7: None, 8: "100% of AKIA" + "A" * 14 + " %zz", 9: "plain text",
    }
    rows = by_id(secrets.find(spark.createDataFrame([(k, f"before {t} after" if t else t) for k, t in layers.items()], "doc_id long, text string")))
    for k in range(1, 7):
        spans = [(x.split(":")[0], int(x.split(":")[1]), int(x.split(":")[2])) for x in rows[k].spans.split(",")]
        assert any(kind == "assign" and a == 7 for kind, a, _ in spans), k
        assert all(7 <= a < b <= 7 + len(layers[k]) for _, a, b in spans)
    assert rows[1].n_assign == 1 and rows[3].n_assign == 0 and rows[7].spans == "" == rows[9].spans and rows[8].n_access == 1


def test_cycles_end_and_bombs_stay():
    import base64
    import zlib

    bomb = base64.b64encode(zlib.compress(b"a" * (secrets.MAX_INFLATED + 10))).decode()
    assert secrets.find_secrets(bomb)[1] == [] and secrets.find_secrets("%2525252541" * 50) is not None


def test_encoded_values_after_marks_and_over_lines():
    import base64
    import gzip

    secret = 'password: "hunter2hunter2hunter2"'
    plain = base64.b64encode(secret.encode()).decode()
    noise = " ".join(hashlib.sha256(str(k).encode()).hexdigest()[:9].upper() for k in range(40))
    packed = base64.encodebytes(gzip.compress(f"{noise} {secret} {noise}".encode(), mtime=0)).decode()
    lines = base64.encodebytes(f"{noise[:40]} {secret} {noise}".encode()).decode()
    for text, at in ((f"data={plain}", 5), (f"/x?state={plain}", 9), (f"/v1/{plain}", 4), (f"id-{plain} end", 3), (f"see\n{packed}end", 4), (f"see\n{lines}end", 4), ("see\n" + lines.replace("\n", "\r\n") + "end", 4)):
        spans = [x for x in secrets.find_secrets(text)[1] if x[1] == 0]
        assert spans and all(at <= a < b <= len(text) for a, _, b in spans), text


def test_layers_with_odd_characters_and_long_contents():
    import base64
    import gzip
    import urllib.parse
    import zlib

    secret = 'password: "hunter2hunter2hunter2"'
    quoted = urllib.parse.quote(secret, safe="")
    b64 = lambda raw: base64.b64encode(raw).decode()
    texts = [b64(f"{odd} some words {secret} {odd}".encode()) for odd in ("\u00a0", "\u3000", "\u00ad", "\u200d", "\f", "\x1b", "\0")]
    texts += [b64(b"\xff some words " + secret.encode()), f"%ff{quoted}%80", "".join(f"\\u{ord(c):04x}" for c in f"\u00a0{secret}")]
    filler = b"nothing to see here. " * (secrets.MAX_INFLATED // 20)
    texts += [b64(zlib.compress(filler + secret.encode() + filler)), b64(gzip.compress(zlib.compress(filler + quoted.encode())))]
    deep = secret.encode()
    for _ in range(20):
        deep = zlib.compress(deep)
    texts.append(b64(deep))
    for k, text in enumerate(texts):
        spans = [x for x in secrets.find_secrets(f"see {text} end")[1] if x[1] == 0]
        assert spans and all(4 <= a < b <= 4 + len(text) for a, _, b in spans), k



def test_more_codecs_and_deep_layers():
    import base64
    import bz2
    import zlib

    secret = "token=abcdefghijklmnop1234"
    b64 = lambda raw: base64.b64encode(raw).decode()

    def found(text):
        base, whole = secrets.find_secrets(text)
        return set(whole) - set(base)

    raw = zlib.compressobj(wbits=-15)
    deflated = raw.compress(secret.encode() + b" and some words more") + raw.flush()
    deep = secret.encode()
    for _ in range(40):
        deep = zlib.compress(deep)
    for text in (
        "".join(f"%u{ord(c):04x}" for c in secret), "".join(f"\\u{{{ord(c):x}}}" for c in secret), b64(deflated), b64(bz2.compress(secret.encode())), b64(deep),
        "x=" + b64(secret.encode()), "/v1/" + b64(secret.encode()), b64(b"token") + "=abcdefghijklmnop", "%00%ff%74%6f%6b%65%6e=abcdefghijklmnop",
    ):
        assert found(f"before {text} after"), text
    assert not found("Ordinary sentences with McDonald and iPhone15Pro, LaTeX or JavaScript")


def test_spans_do_not_depend_on_where_a_layer_is_held(monkeypatch):
    """Layers in memory or in files, handled in parts of any size: base64 over lines, escapes, nested, cut and corrupt contents."""
    import base64
    import bz2
    import gzip
    import urllib.parse
    import zlib

    b64 = lambda raw: base64.b64encode(raw).decode()
    secret = 'é 😀 password: "hunter2hunter2hunter2" AKIA' + "B" * 16 + " 0123456789abcdef0123"
    raw = secret.encode()
    words = " ".join(hashlib.sha256(str(k).encode()).hexdigest()[:9].upper() for k in range(400)).encode()
    cut, bad = zlib.compress(raw + b" " + words)[:-40], gzip.compress(raw, mtime=0)[:-8] + b"\0" * 8
    layers = [raw, bz2.compress(words + raw), zlib.compress(b"\0\1\2\3" * 200 + raw), cut, bad, zlib.compress(b64(gzip.compress(raw + words)).encode()), zlib.compress(urllib.parse.quote(secret, safe="").encode())]
    layers.append(zlib.compress("".join(f"\\u{int.from_bytes(u, 'big'):04x}" for u in (secret.encode("utf-16-be")[k : k + 2] for k in range(0, len(secret.encode("utf-16-be")), 2))).encode()))
    texts = [f"pré token={x} end" for layer in layers for x in (b64(layer), base64.encodebytes(layer).decode(), urllib.parse.quote(b64(layer)))]
    want = [secrets.find_secrets(t) for t in texts]
    assert all(any(k == kind for _, k, _ in set(whole) - set(base)) for base, whole in want for kind in (1, 2))
    for held, part in ((1 << 10, 1200), (100, 24), (1, 12)):
        monkeypatch.setattr(secrets, "MAX_INFLATED", held)
        monkeypatch.setattr(secrets, "CHUNK", part)
        assert [secrets.find_secrets(t) for t in texts] == want


@pytest.mark.parametrize("n", [100, secrets.MAX_INFLATED + 10])
def test_long_and_short_contents_give_the_same_spans(n):
    """Values and encoded runs of over 65,536 characters, contents that are no text, and padding."""
    import base64
    import random
    import zlib

    noise = random.Random(5).randbytes(60_000)
    filler = (b"nothing to see here. " * (n // 21 + 1))[:n]
    long_value, long_run = b"password=" + b"Z" * 120_000, base64.b64encode(noise[:100] + b" " * 90_000 + b" token=abcdefghijklmnop " + b" " * 90_000)
    for inside, kinds in ((long_value, {0}), (noise.hex().encode(), {2}), (long_run, {0}), (b"\0\1" * n + b" AKIA" + b"C" * 16 + b" ", {1}), (b"a" * n, set())):
        run = base64.b64encode(zlib.compress(filler + inside + filler)).decode()
        assert {(a, k, b) for a, k, b in secrets.find_secrets(f"see {run} end")[1]} == {(4, k, 4 + len(run)) for k in kinds}, (inside[:20], kinds)


def test_covers_equal_a_search_of_all():
    r = np.random.default_rng(9)
    for _ in range(300):
        cover, kept = secrets.Cover(), []
        for a, n in zip(r.integers(0, 30, 25).tolist(), r.integers(1, 12, 25).tolist()):
            new = not any(s <= a and a + n <= e for s, e in kept)
            assert cover.add(a, a + n) == new
            if new:
                kept.append((a, a + n))


def test_base_secrets_equal_the_plain_patterns(spark, nothing):
    import random
    import re

    kinds = (("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 12), ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18), ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 16))
    r = random.Random(7)
    parts = ["password", "Token", "api_key", "APIKEY", "secret", "AKIA", "ABCDEFGH1234", "0123456789abcdef", "deadbeef", ":", "=", " ", '"', "'", "\n", "abcdefghijkl", "é", "Z", "%41", "ſ", "K"]
    rows = [(k, "".join(r.choice(parts) for _ in range(r.randint(0, 12)))) for k in range(6000)]
    rows += [(7000, None), (7001, ""), (7002, "x " * 100_000 + "token=abcdefghijklmnop"), (None, "AKIA" + "A" * 14)] + rows[:1]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit("clash")).withColumn("base_sha256", F.lit(1))
    got = secrets.find(df).collect()
    assert len(got) == len(rows) and secrets.find(nothing).count() == 0
    told = {r_.doc_id: r_ for r_ in got}
    for k, t in rows:
        spans = sorted((m.start(), at, f"{name}:{m.start()}:{m.end()}") for at, (name, pattern, good) in enumerate(kinds) for m in re.finditer(pattern, t or "", re.ASCII) if good(m))
        want = ",".join(s for *_, s in spans)
        assert told[k].base_sha256 == hashlib.sha256(want.encode()).hexdigest(), t
        assert (told[k].n_assign, told[k].n_access, told[k].n_hex) == tuple(want.count(f"{n}:") for n, *_ in kinds)
        assert set(want.split(",")) - {""} <= set(told[k].spans.split(","))


# 10


@pytest.mark.parametrize("bitmap, most", [(100_000, 0), (0, 100_000), (0, 0)])
def test_decontamination(spark, docs, texts, nothing, monkeypatch, bitmap, most):
    monkeypatch.setattr(decontaminate, "MAX_BITMAP_WINDOWS", bitmap)
    monkeypatch.setattr(decontaminate, "MAX_BROADCAST_WINDOWS", most)
    items = [(1, texts[60].split("\n")[1]), (2, "two words"), (3, " ".join(texts[110].split()[5:30])), (4, None), (5, "!!"), (6, "TWO, words!"), (7, texts[208][500:900])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = by_id(decontaminate.report(docs, bench))
    for i, t in texts.items():
        r = rows[i]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == brute.contamination(t, items)
    clean = decontaminate.decontaminate(docs, bench)
    assert clean.columns == docs.columns and clean.count() == sum(not r.contaminated for r in decontaminate.report(docs, bench).collect())
    assert decontaminate.report(nothing, bench).count() == 0 and not decontaminate.report(docs, bench.limit(0)).where("contaminated").count()


# words, SQL, pipeline


def test_word_bounds(texts):
    col = pa.array(list(texts.values()), pa.string())
    for i, j, w in textops.each_slice(col):
        for k in range(i, j):
            a, b = w.bounds[k - i], w.bounds[k - i + 1]
            got = [bytes(w.raw[s:e]).decode() for s, e in zip(w.starts[a:b], w.ends[a:b])]
            assert got == brute.words(brute.lower(list(texts.values())[k]))


def test_queries_equal_sql(spark):
    from oracle import assert_same

    from leaklens.llm import oracles, queries

    for name, sql in oracles.oracle_sql().items():
        assert_same(spark, queries.queries()[name], sql, "/root/testdata/sf0.001")


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="the pipeline was taken away")
def test_pipeline_on_a_small_corpus(spark, texts, docs, labels, tmp_path):
    import corpus_pipeline

    whole = docs.select("doc_id", "text", "lang", "source", "n_chars")
    whole.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, " ".join(texts[110].split()[5:30]))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = at
        stage(spark, before, str(tmp_path)).write.parquet(str(tmp_path / f"stage{k}"))
        at = spark.read.parquet(str(tmp_path / f"stage{k}"))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert at.columns == whole.columns
        kept = {r.doc_id for r in at.collect()}
        given = {r.doc_id: r.text for r in before.collect()}
        if name == "near_duplicates":
            want = brute.components({i: t for i, t in given.items() if i is not None}, 5)
            assert kept - {None} == {i for i, (_, c) in want.items() if c == i}
        elif name == "benchmark_passages":
            assert kept == set(given) - {110}
        elif name in ("mixture", "shards"):
            assert kept == set(given)
    rows = at.collect()
    assert {r.shard for r in rows} <= set(range(40)) and at.columns[-2:] == ["shard", "slot"]
