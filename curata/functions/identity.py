"""Identity primitives: canonical JSON, digests, token and shingle expressions (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words (letters, digits, underscore) or single other visible characters.
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}\x{1c}-\x{1f}\x{85}]"
NUMBER = r"\b\d+(?:\s*\.\s*\d+)?\b"


def let(value: Column, f) -> Column:
    """``f(value)`` with the value computed once, however often ``f`` or a lambda inside it reads it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def fold(c: Column) -> Column:
    """Case folding as far as Latin texts need it: lower case, with sharp s as ss."""
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(fold(c), F.lit(TOKEN), F.lit(0))


def canon(c: Column) -> Column:
    """Tokens joined by single spaces: the form in which prompts compare."""
    return F.array_join(tokens(c), " ")


def digest(c: Column) -> Column:
    return F.sha2(c, 256)


def template(c: Column) -> Column:
    """Canonical form with every number replaced by NUM."""
    return F.regexp_replace(canon(c), NUMBER, "NUM")


def shingles(c: Column, n: int = 5) -> Column:
    """Distinct 16-digit digests of ``n`` tokens in succession; empty for shorter texts."""

    def of(t):
        at = F.when(F.size(t) >= n, F.sequence(F.lit(1), F.size(t) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.array_distinct(F.transform(at, lambda i: F.substring(F.sha2(F.array_join(F.slice(t, i, F.lit(n)), "\x1f"), 256), 1, 16)))

    return let(tokens(c), of)


def shingle_hashes(t: Column, n: int = 5) -> Column:
    """Distinct 64-bit hashes of ``n`` of the tokens ``t`` in succession: for counting what texts share; no digest of each is made."""
    at = F.when(F.size(t) >= n, F.sequence(F.lit(1), F.size(t) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(at, lambda i: F.xxhash64(F.slice(t, i, F.lit(n)))))


def messages_json(msgs: Column) -> Column:
    """Canonical JSON of ``array<struct<content, role>>``: keys in order, no spaces, no escapes beyond JSON's."""
    return F.to_json(F.transform(msgs, lambda m: F.struct(m["content"].alias("content"), m["role"].alias("role"))))


def record_hash(msgs: Column) -> Column:
    return digest(messages_json(msgs))


def record_id(msgs: Column) -> Column:
    return F.concat(F.lit("repo-"), F.substring(record_hash(msgs), 1, 24))


def family_id(root: Column) -> Column:
    return F.concat(F.lit("family-"), F.substring(F.sha2(root, 256), 1, 24))


def blank(c: Column) -> Column:
    """Whether a text is null or has no visible character (Unicode spaces included)."""
    return F.coalesce(~c.rlike(r"[^\s\p{Z}\x{1c}-\x{1f}\x{85}]"), F.lit(True))


def lines(c: Column) -> Column:
    return F.split(c, "\n")
