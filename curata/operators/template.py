"""Conversations in a chat template under a public tokenizer, with the answers as targets; the tokenizer's contract."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

# The marks of the template, and what no content may hold.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
CONTROLS = ("<|", "<think>", "</think>")
IGNORE = -100
ENCODED = StructType([StructField("input_ids", ArrayType(IntegerType())), StructField("labels", ArrayType(IntegerType())), StructField("render_sha256", StringType()), StructField("code", StringType())])

_LOADED: dict[str, object] = {}


def structure_code(msgs: Column) -> Column:
    """First reason, turn by turn, why a conversation can't be rendered; null if it can. A leading system turn is allowed."""
    start = F.when(F.coalesce(F.element_at(msgs, 1)["role"] == "system", F.lit(False)), 1).otherwise(0)

    def code(m, i):
        want = F.when(i < start, "system").when((i - start) % 2 == 0, "user").otherwise("assistant")
        held = F.lit(False)
        for c in CONTROLS:
            held = held | F.contains(m["content"], F.lit(c))
        blank = ~F.coalesce(m["content"].rlike(r"[^\s\p{Z}\x{1c}-\x{1f}\x{85}]"), F.lit(False))
        return F.when(blank, "INVALID_MESSAGE").when(~F.coalesce(m["role"] == want, F.lit(False)), "INVALID_TURN_ORDER").when(held, "EMBEDDED_CONTROL")

    last = F.when(F.element_at(msgs, -1)["role"] != "assistant", "MISSING_ANSWER")
    return F.when(F.coalesce(F.size(msgs), F.lit(0)) < 1, "INVALID_MESSAGE").otherwise(F.coalesce(F.get(F.array_compact(F.transform(msgs, code)), F.lit(0)), last))


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The text of a conversation, and where its answers stand, their closing marks included."""
    text, spans = "", []
    for role, content in turns:
        text += f"{OPEN}{role}\n"
        begin = len(text)
        text += content + CLOSE
        if role == "assistant":
            spans.append((begin, len(text)))
        text += "\n"
    return text, spans


def _tokenizer(path: str):
    if path not in _LOADED:
        from tokenizers import AddedToken, Tokenizer

        t = Tokenizer.from_file(path)
        t.add_special_tokens([AddedToken(OPEN), AddedToken(CLOSE)])  # two more ids behind the vocabulary; nothing is trained
        _LOADED[path] = t
    return _LOADED[path]


def targets(offsets: list[tuple[int, int]], ids: list[int], spans: list[tuple[int, int]], end: int) -> tuple[list[int], str | None]:
    """Labels by offset: a token inside an answer is its own label, any other is ``IGNORE``.

    Refused are a token that an answer's edge cuts through, an answer without a
    target and one whose last token is not the closing mark.
    """
    labels, closing = [], {}
    k = 0
    for i, (a, b) in enumerate(offsets):
        while k < len(spans) and spans[k][1] <= a:
            k += 1
        inside = k < len(spans) and a < spans[k][1] and b > spans[k][0]
        if inside and (a < spans[k][0] or b > spans[k][1]):
            return [], "TOKEN_CROSSES_BOUNDARY"
        labels.append(ids[i] if inside else IGNORE)
        if inside and b > a:
            closing[k] = ids[i]
    if not closing:
        return [], "EMPTY_TARGET"
    if any(closing.get(j) != end for j in range(len(spans))):
        return [], "END_NOT_SUPERVISED"
    return labels, None


def chat_template(msgs: Column, path: str) -> Column:
    """``struct(input_ids, labels, render_sha256, code)`` of ``array<struct<role, content>>``; only ``code`` where it is refused."""

    def encode(roles: pd.Series, contents: pd.Series, code: pd.Series) -> pd.DataFrame:
        t = _tokenizer(path)
        end = t.token_to_id(CLOSE)
        out = [(None, None, None, c) for c in code]
        todo = [i for i, c in enumerate(code) if c is None]
        drawn = [render(list(zip(roles.iloc[i], contents.iloc[i]))) for i in todo]
        for i, (text, spans), e in zip(todo, drawn, t.encode_batch([x for x, _ in drawn], add_special_tokens=False)):
            labels, refused = targets(e.offsets, e.ids, spans, end)
            out[i] = (None, None, None, refused) if refused else (e.ids, labels, hashlib.sha256(text.encode()).hexdigest(), None)
        return pd.DataFrame(out, columns=["input_ids", "labels", "render_sha256", "code"])

    return F.pandas_udf(encode, ENCODED)(F.transform(msgs, lambda m: m["role"]), F.transform(msgs, lambda m: m["content"]), structure_code(msgs))


def tokenizer_contract(path: str, special: dict[str, int] | None = None, size: int | None = None, fingerprint: str | None = None) -> str:
    """Checks a tokenizer file before it is used and returns its fingerprint (digest of its canonical JSON).

    Special tokens must have the ids given, the vocabulary its size, the file the
    fingerprint on record; raises otherwise. The file is read where the driver is.
    """
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        held = json.load(f)
    have = hashlib.sha256(json.dumps(held, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()
    t = Tokenizer.from_str(json.dumps(held))
    if size is not None and t.get_vocab_size() != size:
        raise ValueError("the vocabulary has another size")
    for token, at in (special or {}).items():
        if t.token_to_id(token) != at:
            raise ValueError(f"special token {token} has another id")
    if fingerprint is not None and have != fingerprint:
        raise ValueError("the tokenizer has another fingerprint")
    return have
