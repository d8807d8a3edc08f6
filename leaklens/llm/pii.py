"""Operator 4: personal data by weak supervision.

Base spans are the contract's four patterns. Around them, a broader generator proposes candidate spans of six kinds:
email (also spelled out, ``jo (at) host dot org``), ip (also of version 6), card (also between dots), phone (also
national forms), ssn and iban. Labelers of three sorts vote on each: patterns and checksums, gazetteers (top-level
domains, card issuer prefixes, calling codes, reserved networks, countries of accounts) and context (cue words before
the span, and what stands at its edges). Each vote is for, against or abstaining. The candidates of all documents are
counted by what was seen of them (votes, length, edges, a bucket of the word before); expectation-maximisation on the
counts of votes estimates each labeler's reliability without labels, and its posteriors train the final span classifier,
a logistic regression that reads the context word too, again on counts. Candidates that it accepts and that overlap no
base span of their kind are added; base spans stay.

One pass over the texts; what is kept of a text is its spans and candidates. Python's ``re`` runs only where a cheap
test finds the characters a pattern needs, and each pattern is written so that its time is linear in the text.

Edge cases: a null or empty text has no spans; without candidates there is nothing to learn and base spans remain;
repeated rows each get theirs, and count as often as they occur; of overlapping accepted candidates of a kind the first
is taken; a text of any length is scanned whole; other columns are not read; offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import write_cut

KINDS = ("email", "ip", "card", "phone", "ssn", "iban")
LABELERS = ("pattern", "checksum", "gazetteer", "context", "edges")
ACCEPT = 0.5
WORDS = 32

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOOSE_PHONE = re.compile(r"(?<![0-9.+-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])")
_NATIONAL = re.compile(r"(?<![0-9.+/-])\(?0[0-9]{1,4}\)?(?:[ ./-][0-9]{2,4}){2,4}(?![0-9-])")
_DOTTED_CARD = re.compile(r"(?<![0-9.])[0-9]{4}(?:\.[0-9]{4}){3}(?![0-9.])")
_IP6 = re.compile(r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![0-9A-Za-z:])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_IBAN = re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])")
_AT = re.compile(r" ?(?:\(at\)|\[at\]) ?| at ", re.IGNORECASE)
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_SPELLED_HOST = re.compile(r"[A-Za-z0-9-]+(?:(?: ?(?:\(dot\)|\[dot\]) ?| dot |\.)[A-Za-z0-9-]+){1,4}", re.IGNORECASE)

# Gazetteers and cue words.
_TOP_LEVEL = frozenset("com org net edu gov mil int info biz io dev app co us uk de fr es it nl eu ch at be se no dk fi pl pt ie ca mx br ar au nz jp kr cn in ru za".split())
_ISSUERS = ("4", "51", "52", "53", "54", "55", "2221", "2720", "34", "37", "6011", "65", "35", "36", "30")
_CALLING = ("1", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "7", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98")
_FOR = {
    "email": frozenset("email mail contact write reply to from".split()),
    "ip": frozenset("ip host server address addr client login".split()),
    "card": frozenset("card visa mastercard amex credit debit payment".split()),
    "phone": frozenset("phone tel telephone call mobile cell fax contact".split()),
    "ssn": frozenset("ssn social security".split()),
    "iban": frozenset("iban account bank konto cuenta transfer".split()),
}
_ACCOUNT_SIZES = {"AT": 20, "BE": 16, "CH": 21, "CZ": 24, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "IE": 22, "IT": 27, "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "SE": 24}
_AGAINST = frozenset("version v release build isbn issn doi order ref reference invoice id no nr number serial hash section figure".split())


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches of the contract's pattern, found from each @: local parts are maximal runs."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        host = _HOST.match(text, at + 1) if start < at else None
        if host:
            yield start, host.end()
            done = host.end()
        at = text.find("@", max(at + 1, done))


def spelled(text: str) -> Iterator[tuple[int, int]]:
    """Addresses with a spelled-out at sign; after a bare ``at`` a dot must be spelled too, else any place would do."""
    if " at " not in text and "at)" not in (low := text.lower()) and "at]" not in low:
        return
    for m in _AT.finditer(text):
        local = _LOCAL_END.search(text, max(0, m.start() - 64), m.start())
        host = _SPELLED_HOST.match(text, m.end()) if local else None
        if host and (m[0] != " at " or "dot" in host[0].lower()):
            yield local.start(), host.end()


def valid_iban(account: str) -> bool:
    plain = account.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def valid_ip6(text: str) -> bool:
    try:
        return bool(ipaddress.IPv6Address(text))
    except ValueError:
        return False


def small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end), in the order of kinds, then starts."""
    out = []
    if "@" in text:
        out += [(0, a, b) for a, b in emails(text)]
    if _DIGIT.search(text):
        out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(map(small, m[0].split(".")))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
        if "+" in text:
            out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return out


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(kind, start, end, code): base spans and broader ones, coded by votes (base 3), length, and edges."""
    spans = set(base)
    if _DIGIT.search(text):
        spans |= {(1, m.start(), m.end()) for m in _IP.finditer(text)}
        spans |= {(2, m.start(), m.end()) for m in _CARD.finditer(text) if 13 <= sum("0" <= c <= "9" for c in m[0]) <= 19}
        spans |= {(3, m.start(), m.end()) for m in _LOOSE_PHONE.finditer(text)}
        spans |= {(3, m.start(), m.end()) for m in _NATIONAL.finditer(text)}
        spans |= {(2, m.start(), m.end()) for m in _DOTTED_CARD.finditer(text)}
        spans |= {(4, m.start(), m.end()) for m in _SSN.finditer(text)}
        spans |= {(5, m.start(), m.end()) for m in _IBAN.finditer(text)}
        if "+" in text:
            spans |= {(3, m.start(), m.end()) for m in _PHONE.finditer(text)}
    if ":" in text:
        spans |= {(1, m.start(), m.end()) for m in _IP6.finditer(text) if any(c in "0123456789abcdefABCDEF" for c in m[0])}
    spans |= {(0, a, b) for a, b in spelled(text)}
    fixed = set(base)
    return [(k, a, b, code(text, k, a, b, (k, a, b) in fixed)) for k, a, b in sorted(spans)]


def code(text: str, kind: int, a: int, b: int, is_base: bool) -> int:
    span, name = text[a:b], KINDS[kind]
    digits = "".join(c for c in span if "0" <= c <= "9")
    pattern = 1 if is_base else 0
    if kind == 0:
        checksum = 1 if len(span) <= 254 and ".." not in span else -1
        gazetteer = 1 if re.split(r"\.|dot[)\]]? ?", span.lower())[-1].strip() in _TOP_LEVEL else 0 if is_base else -1
    elif kind == 1 and ":" in span:
        checksum = 1 if valid_ip6(span) else -1
        gazetteer = -1 if checksum < 0 or span in ("::", "::1") or span.lower().startswith(("2001:db8:", "fe80:")) else 1
    elif kind == 1:
        checksum = 1 if all(map(small, span.split("."))) else -1
        first = span.partition(".")[0].lstrip("0")
        gazetteer = -1 if first in ("", "127", "255") or len(first) > 3 else 1
    elif kind == 2:
        checksum = 1 if luhn(digits) else -1
        gazetteer = 1 if digits.startswith(_ISSUERS) else -1
    elif kind == 3:
        checksum = 1 if 9 <= len(digits) <= 15 else -1
        gazetteer = (1 if digits.startswith(_CALLING) else -1) if span[0] == "+" else 0
    elif kind == 5:
        checksum = 1 if valid_iban(span) else -1
        gazetteer = 1 if _ACCOUNT_SIZES.get(span[:2]) == len(span.replace(" ", "")) else -1
    else:
        checksum = 1 if digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000" else -1
        gazetteer = 0
    near = re.findall(r"[a-z]+", text[max(0, a - 32) : a].lower())[-3:]
    cues = set(near)
    context = 1 if cues & _FOR[name] else -1 if cues & _AGAINST else 0
    before, after = text[a - 1 : a], text[b : b + 1]
    edges = -1 if before.isalnum() or after.isalnum() else 1
    out = 0
    for v in (pattern, checksum, gazetteer, context, edges):
        out = out * 3 + v + 1
    size = min(3, (b - a) // 8)
    word = zlib.crc32(near[-1].encode()) % (WORDS - 1) + 1 if near else 0
    return (((out * 4 + size) * 3 + _edge(before)) * 3 + _edge(after)) * WORDS + word


def _edge(c: str) -> int:
    return 0 if not c or c.isspace() else 1 if c.isalnum() else 2


def votes_of(codes: np.ndarray) -> np.ndarray:
    v = codes // (36 * WORDS)
    return np.stack([v // 3 ** (len(LABELERS) - 1 - k) % 3 - 1 for k in range(len(LABELERS))], axis=1)


def reliabilities(votes: np.ndarray, counts: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, float]:
    """Posteriors of each vote pattern, P(vote | truth) as (truth, labeler, vote), and the prior, by expectation-maximisation.

    It starts from the majority of votes, which fixes which of the two classes is the personal one.
    """
    post = 1 / (1 + np.exp(-votes.sum(axis=1).astype(float)))
    table, prior = np.full((2, votes.shape[1], 3), 1 / 3), 0.5
    for _ in range(rounds):
        prior = float(np.clip((post @ counts + 1) / (counts.sum() + 2), 1e-3, 1 - 1e-3))
        for y, w in ((0, (1 - post) * counts), (1, post * counts)):
            for v in range(3):
                table[y, :, v] = ((votes == v - 1) * w[:, None]).sum(axis=0) + 1.0 + (2.0 if (v == 2) == (y == 1) and v != 1 else 0.0)
            table[y] /= table[y].sum(axis=1, keepdims=True)
        logs = [np.log(table[y][np.arange(votes.shape[1]), votes + 1]).sum(axis=1) for y in (0, 1)]
        post = 1 / (1 + np.exp(np.clip(logs[0] + np.log(1 - prior) - logs[1] - np.log(prior), -50, 50)))
    return post, table, prior


def features(codes: np.ndarray) -> np.ndarray:
    v = votes_of(codes)
    rest, word = codes // WORDS % 36, codes % WORDS
    cols = [np.ones(len(codes))] + [v[:, k] == s for k in range(v.shape[1]) for s in (-1, 1)] + [rest // 9 == s for s in range(1, 4)] + [rest // 3 % 3 == s for s in (1, 2)] + [rest % 3 == s for s in (1, 2)] + [word == s for s in range(1, WORDS)]
    return np.stack(cols, axis=1).astype(float)


def logistic(x: np.ndarray, target: np.ndarray, counts: np.ndarray, rounds: int = 30, ridge: float = 1.0) -> np.ndarray:
    """Newton's method on soft targets, weighted by counts."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (counts * (p - target)) + ridge * w
        hess = (x * (counts * p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        w -= np.linalg.solve(hess, grad)
    return w


class SpanClassifier:
    """accepted[kind]: the codes of the candidates that are personal data."""

    def __init__(self, counts: list[tuple[int, int, int]]):
        """counts: (kind, code, how many), over all documents."""
        self.accepted: dict[int, set[int]] = {}
        self.reliability: dict[str, dict[str, float]] = {}
        for kind in range(len(KINDS)):
            mine = [(c, n) for k, c, n in counts if k == kind]
            if not mine:
                continue
            codes, n = np.array([c for c, _ in mine]), np.array([n for _, n in mine], float)
            votes, place = np.unique(votes_of(codes), axis=0, return_inverse=True)
            post, table, prior = reliabilities(votes, np.bincount(place.ravel(), n, len(votes)))
            post = post[place.ravel()]
            w = logistic(features(codes), post, n)
            good = 1 / (1 + np.exp(-np.clip(features(codes) @ w, -30, 30))) >= ACCEPT
            self.accepted[kind] = set(codes[good].tolist())
            self.reliability[KINDS[kind]] = {name: float(prior * table[1, k, 2] + (1 - prior) * table[0, k, 0]) for k, name in enumerate(LABELERS)}


_SCAN = "doc_id long, base string, found string"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        base, found = [], []
        for text in batch.column(1):
            text = text.as_py() or ""
            spans = base_spans(text)
            base.append(",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans))
            found.append(",".join(f"{k}:{a}:{b}:{c}" for k, a, b, c in candidates(text, spans)))
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(base, pa.string()), pa.array(found, pa.string())], names=["doc_id", "base", "found"])


def _decide(accepted: dict[int, set[int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, spans = [], [], []
            for base, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                fixed = [(KINDS.index(k), int(a), int(b)) for k, a, b in (x.split(":") for x in base.split(",") if x)]
                whole = list(fixed)
                for k, a, b, c in (map(int, x.split(":")) for x in found.split(",") if x):
                    if c in accepted.get(k, ()) and all(k != k2 or b <= a2 or b2 <= a for k2, a2, b2 in whole):
                        whole.append((k, a, b))
                counts.append([sum(k == kind for k, _, _ in fixed) for kind in range(4)])
                digests.append(hashlib.sha256(base.encode()).hexdigest())
                spans.append(",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(whole)))
            columns = [pa.array([c[k] for c in counts], pa.int64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(digests, pa.string()), pa.array(spans, pa.string())], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return run


def find(docs: DataFrame) -> DataFrame:
    """The contract's columns, one row per row of ``docs``."""
    scanned = write_cut(docs.select("doc_id", "text").mapInArrow(_scan, _SCAN), "pii")
    parts = scanned.where("found <> ''").select(F.explode(F.split("found", ",")).alias("c")).select(F.split("c", ":").alias("c"))
    # Bounded by the kinds and codes there can be, whatever the corpus.
    counts = parts.groupBy(F.col("c")[0].cast("int").alias("k"), F.col("c")[3].cast("int").alias("code")).count().collect()
    classifier = SpanClassifier([(r["k"], r["code"], r["count"]) for r in sorted(counts)])
    return scanned.mapInArrow(_decide(classifier.accepted), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(text: str, spans: list[tuple[int, int, int]], mask: str = "[{}]") -> str:
    """``text`` with each span replaced by its kind."""
    out, at = [], 0
    for k, a, b in sorted(spans, key=lambda s: s[1:]):
        if a >= at:
            out += [text[at:a], mask.format(KINDS[k].upper())]
            at = b
    return "".join([*out, text[at:]])
