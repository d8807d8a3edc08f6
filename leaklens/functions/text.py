"""Scalar text functions as Spark expressions: bytes, trimming, ids, budgets, redaction."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .constants import MASK, MYSQL_DSN, TOKEN_BYTES, TRUNCATION_MARK

URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)@([^@/?#]+)([^?#]*)(\?[^#]*)?"


def trim_space(x: Column) -> Column:
    """Strip all Unicode white space at both ends, not only blanks."""
    return F.regexp_replace(x, r"^\p{IsWhite_Space}+|\p{IsWhite_Space}+\z", "")


def finding_id(file: Column, line: Column, match: Column) -> Column:
    """First 12 hex digits of sha256(file:line:match)."""
    return F.substring(F.sha2(F.concat(file, F.lit(":"), line.cast("string"), F.lit(":"), match), 256), 1, 12)


def token_estimate(x: Column) -> Column:
    """Bytes over three, rounded up."""
    return F.floor((F.octet_length(x) + (TOKEN_BYTES - 1)) / TOKEN_BYTES).cast("long")


def bytes_slice(x: Column, start, length) -> Column:
    """Bytes start .. (from 1), as text; a cut character becomes U+FFFD."""
    b = x.cast("binary")
    return F.make_valid_utf8(F.substring(b, start if isinstance(start, Column) else F.lit(start), length if isinstance(length, Column) else F.lit(length)).cast("string"))


def clamp(x: Column, most: int) -> Column:
    """At most ``most`` bytes: the head and a marker."""
    mark = len(TRUNCATION_MARK.encode())
    if most <= 0:
        return F.lit("")
    cut = bytes_slice(x, 1, most) if most <= mark else F.concat(bytes_slice(x, 1, most - mark), F.lit(TRUNCATION_MARK))
    return F.when(F.octet_length(x) <= most, x).otherwise(cut)


def clamp_middle(x: Column, most: Column | int) -> Column:
    """At most ``most`` bytes: head, marker and tail."""
    most = most if isinstance(most, Column) else F.lit(most)
    mark = len(TRUNCATION_MARK.encode())
    half = F.floor((most - mark) / 2).cast("int")
    n = F.octet_length(x)
    return (
        F.when(most <= 0, F.lit(""))
        .when(n <= most, x)
        .when(most <= mark + 2, bytes_slice(x, 1, most.cast("int")))
        .otherwise(F.concat(bytes_slice(x, 1, half), F.lit(TRUNCATION_MARK), bytes_slice(x, n - half + 1, half)))
    )


def preview(x: Column) -> Column:
    """What may be shown of a secret: URL and DSN credentials masked, else four bytes at each end, or nothing if short."""
    host = F.concat(F.regexp_extract(x, URL, 3), F.regexp_extract(x, URL, 4), F.regexp_extract(x, URL, 5))
    return (
        F.when(x == "", F.lit(""))
        .when(x.rlike(URL), F.concat(F.regexp_extract(x, URL, 1), F.lit(f"://{MASK}:{MASK}@"), host))
        .when(x.rlike(MYSQL_DSN), F.concat(F.lit(f"{MASK}:{MASK}@"), F.regexp_extract(x, MYSQL_DSN, 3)))
        .when(F.octet_length(x) <= 8, F.lit(MASK))
        .otherwise(F.concat(bytes_slice(x, 1, 4), F.lit(MASK), bytes_slice(x, F.octet_length(x) - 3, 4)))
    )


def scrub(text: Column, secret: Column) -> Column:
    """``text`` with the secret replaced by its preview and then its user and password, the longer first, by a mask."""
    url = secret.rlike(URL)
    userinfo = F.when(url, F.regexp_extract(secret, URL, 2)).when(secret.rlike(MYSQL_DSN), F.concat(F.regexp_extract(secret, MYSQL_DSN, 1), F.lit(":"), F.regexp_extract(secret, MYSQL_DSN, 2))).otherwise(F.lit(""))
    user = F.substring_index(userinfo, ":", 1)
    password = F.when(F.contains(userinfo, F.lit(":")), F.regexp_extract(userinfo, r"(?s)^[^:]*:(.*)\z", 1)).otherwise(F.lit(""))
    first = F.when(F.octet_length(password) > F.octet_length(user), password).otherwise(user)
    second = F.when(F.octet_length(password) > F.octet_length(user), user).otherwise(password)
    swap = lambda t, part: F.when(part == "", t).otherwise(F.replace(t, part, F.lit(MASK)))
    whole = F.replace(text, secret, preview(secret))
    return F.when(secret == "", text).otherwise(swap(swap(whole, first), second))
