"""Tests on candidate values, as Spark expressions: sentinels, references, placeholders, keys, formatting text, key headers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from . import constants as C
from .text import trim_space


def any_of(tests) -> Column:
    return reduce(lambda a, b: a | b, tests)


def sentinel_reason(match: Column) -> Column:
    """Why a match is a known sample value; null if it is none. Exact values come before prefixes."""
    out = None
    for value, reason in C.SENTINELS.items():
        out = F.when(match == value, F.lit(reason)) if out is None else out.when(match == value, F.lit(reason))
    for p in C.SENTINEL_PREFIXES:
        out = out.when(F.startswith(match, F.lit(p)), F.lit(C.SENTINEL_PREFIX_REASON + p))
    return out


def normalized(v: Column) -> Column:
    """Trimmed, without trailing commas and semicolons and one pair of equal quotes."""
    t = F.regexp_replace(trim_space(v), r"[,;]+\z", "")
    return trim_space(F.regexp_replace(t, r"""(?s)\A(["'`])(.*)\1\z""", "$2"))


def is_reference(v: Column) -> Column:
    """Whether a value only names a secret: variables, substitutions, calls, environment lookups."""
    return (
        normalized(v).rlike(C.BASIC_AUTH_REFERENCE)
        | F.startswith(v, F.lit("$"))
        | F.contains(v, F.lit("${"))
        | v.rlike(C.COMMAND_SUBSTITUTION)
        | (v.rlike(C.CALL_SHAPE) & F.endswith(trim_space(v), F.lit(")")))
        | any_of(F.startswith(v, F.lit(p)) for p in C.REFERENCE_PREFIXES)
    )


def _after_scheme(v: Column) -> Column:
    return F.regexp_extract(v, r"(?s)\A.*?://(.*)\z", 1)


def url_with_credentials(v: Column) -> Column:
    """scheme://user:password@host, by text alone: a colon before the first @ after the first ://."""
    rest = _after_scheme(v)
    return F.contains(v, F.lit("://")) & F.contains(rest, F.lit("@")) & F.contains(F.substring_index(rest, "@", 1), F.lit(":"))


def url_password(v: Column) -> Column:
    info = F.substring_index(_after_scheme(v), "@", 1)
    return F.when(url_with_credentials(v), F.regexp_extract(info, r"(?s)\A[^:]*:(.*)\z", 1)).otherwise(F.lit(""))


def assignment_key(v: Column) -> Column:
    """The key of an assignment-shaped candidate, or null."""
    return F.when(v.rlike(C.ASSIGNMENT_SHAPE) & (_assigned(v) != ""), F.regexp_extract(v, C.ASSIGNMENT_SHAPE, 1))


def _assigned(v: Column) -> Column:
    return normalized(F.regexp_extract(v, C.ASSIGNMENT_SHAPE, 2))


def assignment_value(v: Column) -> Column:
    return F.when(v.rlike(C.ASSIGNMENT_SHAPE) & (_assigned(v) != ""), _assigned(v))


def is_secret_key(key: Column, value: Column) -> Column:
    """Whether an assignment to this key can be a secret: not for identities and places, always for URLs with passwords."""
    k = F.upper(F.replace(F.replace(key, F.lit("-"), F.lit("_")), F.lit("."), F.lit("_")))
    listed = F.exists(F.array(*[F.lit(s) for s in C.NON_SECRET_SUFFIXES]), lambda s: (k == s) | F.endswith(k, F.concat(F.lit("_"), s)))
    return url_with_credentials(value) | ~listed


def _placeholder(v: Column) -> Column:
    low = F.lower(v)
    return (
        (v == "")
        | low.isin(C.PLACEHOLDER_WORDS)
        | (F.startswith(v, F.lit("<")) & F.endswith(v, F.lit(">")))
        | (F.startswith(v, F.lit("{{")) & F.endswith(v, F.lit("}}")))
        | (F.startswith(v, F.lit("%")) & F.endswith(v, F.lit("%")) & (F.octet_length(v) > 2))
        | any_of(F.startswith(low, F.lit(p)) for p in C.PLACEHOLDER_PREFIXES)
        | any_of(F.contains(low, F.lit(p)) for p in C.PLACEHOLDER_PARTS)
        | v.rlike(r"(?s)\A(.)\1{3,}\z")
    )


def is_placeholder(v: Column) -> Column:
    """Filler: stock words, template marks, prefixes, one repeated character. A URL's password stands for the URL."""
    t = trim_space(v)
    return F.when(url_with_credentials(t), _placeholder(trim_space(url_password(t)))).otherwise(_placeholder(t))


def is_formatting_text(v: Column) -> Column:
    """Display text: white-space escapes in source spelling, or markup. URLs with passwords and PEM text are exempt."""
    marks = any_of(F.contains(v, F.lit(x)) for x in ("\\n", "\\r", "\\t"))
    return ~(url_with_credentials(v) | F.contains(v, F.lit("-----BEGIN"))) & (marks | v.rlike(C.HTML_ELEMENT))


def pem_header(v: Column) -> Column:
    """The first line that is a private-key header, trimmed; '' if none is."""
    lines = F.transform(F.split(v, "\n", -1), trim_space)
    return F.coalesce(F.get(F.filter(lines, lambda x: x.isin(C.PRIVATE_KEY_HEADERS)), F.lit(0)), F.lit(""))
