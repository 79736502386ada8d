"""Text normalisation shared by the operators that must look at whole texts in Python (Arrow batches)."""

from __future__ import annotations

import json
import re
import unicodedata
from hashlib import blake2b

_NOT_ALNUM = re.compile(r"[\W_]+")
_WORD = re.compile(r"[^\W_]+")


def fold(s: str) -> str:
    """Compatibility form, case folded. ASCII texts skip the normaliser."""
    return s.lower() if s.isascii() else unicodedata.normalize("NFKC", s).casefold()


def letters(s: str) -> str:
    """Letters and digits only, folded: what is left when case, spacing and punctuation don't count."""
    return _NOT_ALNUM.sub("", fold(s))


def words(s: str) -> list[str]:
    """Runs of letters and digits, folded."""
    return _WORD.findall(fold(s))


def digest(*parts: bytes) -> bytes:
    h = blake2b(digest_size=16)
    for p in parts:
        h.update(len(p).to_bytes(4, "little"))
        h.update(p)
    return h.digest()


def merkle(v: object) -> bytes:
    """Digest of a JSON value from its leaves up.

    Children of objects are unordered (sorted by digest), of arrays ordered.
    Strings and keys compare by :func:`letters`; numbers by value.
    """
    if isinstance(v, dict):
        return digest(b"o", *sorted(digest(b"f", letters(k).encode(), merkle(x)) for k, x in v.items()))
    if isinstance(v, list):
        return digest(b"a", *[merkle(x) for x in v])
    if isinstance(v, str):
        return digest(b"s", letters(v).encode())
    return digest(b"n", json.dumps(v).encode())


def structure(v: object) -> str:
    """The canonical form that :func:`merkle` digests, in full, for comparison."""
    if isinstance(v, dict):
        return "{" + ",".join(sorted(letters(k) + ":" + structure(x) for k, x in v.items())) + "}"
    if isinstance(v, list):
        return "[" + ",".join(structure(x) for x in v) + "]"
    return '"' + letters(v) if isinstance(v, str) else json.dumps(v)


def json_object(s: str) -> dict | None:
    """The object that ``s`` is in JSON, else None."""
    t = s.strip()
    if t[:1] != "{" or t[-1:] != "}":
        return None
    try:
        v = json.loads(t)
    except (ValueError, RecursionError):
        return None
    return v if isinstance(v, dict) else None


def content_digest(s: str | None) -> bytes:
    s = s or ""
    v = json_object(s)
    return digest(b"t", letters(s).encode()) if v is None else merkle(v)


def content_structure(s: str | None) -> str:
    s = s or ""
    v = json_object(s)
    return letters(s) if v is None else structure(v)
