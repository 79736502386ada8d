"""Conversations: assembly, canonical form, error codes, protocol and record validators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curata.functions.identity import blank, messages_json
from curata.functions.quality import normalize_newlines

MESSAGE_KEYS = ["role", "content", "name", "tool_call_id", "tool_calls"]
# Keys of each kind of record besides id and document_family, and the parts that are its content.
RECORD_KEYS = {"pretrain": ["text"], "sft": ["messages", "constraint_labels", "si_dimensions", "domain_label", "verifier_label"], "verifier": ["messages", "constraint_labels", "si_dimensions", "domain_label", "verifier_label"], "preference": ["prompt", "chosen", "rejected"], "rl": ["prompt", "task"]}
CONTENT_KEYS = {"pretrain": ["text"], "sft": ["messages"], "verifier": ["messages"], "preference": ["prompt", "chosen", "rejected"], "rl": ["prompt"]}


def assemble(turns: DataFrame) -> DataFrame:
    """``(id, msgs)``: the turns of each record in order; repeated rows count once."""
    m = F.struct("turn", F.lower(F.trim("role")).alias("role"), "content", "name", "tool_call_id", "tool_calls")
    return turns.filter("id is not null").groupBy(F.lower(F.trim("id")).alias("id")).agg(F.array_sort(F.collect_set(m)).alias("msgs"))


def plain(msgs: Column) -> Column:
    """Role and normalised content of each message."""
    return F.transform(msgs, lambda m: F.struct(normalize_newlines(m["content"]).alias("content"), m["role"].alias("role")))


def status(msgs: Column) -> Column:
    """OK or the first reason, left to right, why messages are no training conversation."""
    start = F.when(F.coalesce(F.element_at(msgs, 1)["role"] == "system", F.lit(False)), 1).otherwise(0)

    def error(m, i):
        expected = F.when((i - start) % 2 == 0, "user").otherwise("assistant")
        return (
            F.when(m["name"].isNotNull() | m["tool_call_id"].isNotNull() | m["tool_calls"].isNotNull(), "UNSUPPORTED_MESSAGE_FIELDS")
            .when(blank(m["content"]), "EMPTY_OR_NON_TEXT_CONTENT")
            .when((i >= start) & ~F.coalesce(m["role"] == expected, F.lit(False)), "INVALID_ROLE_ORDER")
        )

    first = F.get(F.array_compact(F.transform(msgs, error)), F.lit(0))
    last = F.when(~F.coalesce(F.element_at(msgs, -1)["role"] == "assistant", F.lit(False)), "MISSING_FINAL_ASSISTANT")
    return F.when(F.size(msgs) < 2, "INCOMPLETE_MESSAGES").otherwise(F.coalesce(first, last, F.lit("OK")))


def canonical_row(raw: Column) -> Column:
    """``struct(messages, error)`` of a legacy JSON row: messages, prompt and completion, or instruction, input and output."""
    v = F.try_parse_json(raw)
    text = lambda k: F.try_variant_get(v, f"$.{k}", "string")
    kind = lambda k: F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant"))
    isstr = lambda k: F.coalesce(kind(k) == "STRING", F.lit(False))
    pair = lambda q, a: F.array(F.struct(F.lit("user").alias("role"), q.alias("content")), F.struct(F.lit("assistant").alias("role"), a.alias("content")))
    given = F.from_json(F.to_json(F.try_variant_get(v, "$.messages", "variant")), "array<struct<role string, content string>>")
    extra = F.coalesce(text("input"), F.lit(""))
    asked = F.concat(text("instruction"), F.when(extra != "", F.concat(F.lit("\n\n"), extra)).otherwise(""))
    keys = F.json_object_keys(raw)
    has = lambda k: F.coalesce(F.array_contains(keys, k), F.lit(False))
    msgs = F.when(has("messages"), given).when(isstr("prompt") & isstr("completion"), pair(text("prompt"), text("completion"))).when(isstr("instruction") & isstr("output"), pair(asked, text("output")))
    error = (
        F.when(v.isNull(), "INVALID_JSON")
        .when(~F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)), "ROW_NOT_OBJECT")
        .when(~has("messages") & ~(isstr("prompt") & isstr("completion")) & isstr("instruction") & isstr("output") & has("input") & ~isstr("input"), "INPUT_NOT_TEXT")
        .when(msgs.isNull() & ~has("messages"), "UNSUPPORTED_ROW_SCHEMA")
        .when(msgs.isNull() | (F.size(msgs) < 2), "INCOMPLETE_MESSAGES")
    )
    return F.struct(msgs.alias("messages"), error.alias("error"))


def labelled_messages(text: Column) -> Column:
    """Messages of a text whose lines begin with System:, User: or Assistant:; null if it has no such line."""
    parts = F.split(F.concat(F.lit("\n"), normalize_newlines(text)), r"\n(?=(?:System|User|Assistant):)")
    said = F.transform(F.slice(parts, 2, 1_000_000), lambda p: F.struct(F.lower(F.regexp_extract(p, r"^(\w+):", 1)).alias("role"), F.trim(F.regexp_replace(p, r"^\w+:\s*", "")).alias("content")))
    return F.when(F.size(said) > 0, said)


def protocol_error(msgs: Column, require_answer: bool = False) -> Column:
    """First violation of the message protocol, null if there is none: a fold over the turns.

    The state holds the pending and the known tool calls; a call must be answered
    before any other turn. Messages are ``struct<role, content, name,
    tool_call_id, tool_calls>`` with ``tool_calls`` as JSON.
    """
    none = F.array().cast("array<string>")
    null = F.lit(None).cast("string")
    zero = F.struct(null.alias("err"), F.lit(0).alias("i"), F.lit(False).alias("user"), none.alias("pending"), none.alias("known"))

    def step(s, m):
        calls = F.coalesce(F.from_json(m["tool_calls"], "array<struct<id string, name string, arguments string>>"), F.array().cast("array<struct<id string, name string, arguments string>>"))
        ids = F.transform(calls, lambda c: c["id"])
        role = m["role"]
        err = (
            F.when(~F.coalesce(role.isin("system", "user", "assistant", "tool"), F.lit(False)), "UNSUPPORTED_ROLE")
            .when((role == "system") & (s["i"] > 0), "LATE_SYSTEM")
            .when(role.isin("assistant", "tool") & ~s["user"], "NO_PRECEDING_USER")
            .when(m["content"].isNull(), "CONTENT_NOT_TEXT")
            .when((F.size(calls) > 0) & (role != "assistant"), "TOOL_CALLS_NOT_ON_ASSISTANT")
            .when(blank(m["content"]) & (F.size(calls) == 0), "EMPTY_CONTENT")
            .when((F.size(s["pending"]) > 0) & (role != "tool"), "UNANSWERED_TOOL_CALL")
            .when(F.exists(calls, lambda c: blank(c["id"]) | blank(c["name"]) | ~F.coalesce(c["arguments"].startswith("{"), F.lit(False))), "BAD_TOOL_CALL")
            .when(F.arrays_overlap(s["known"], ids) | (F.size(F.array_distinct(ids)) < F.size(ids)), "DUPLICATE_TOOL_CALL")
            .when((role == "tool") & ~F.coalesce(F.array_contains(s["pending"], m["tool_call_id"]), F.lit(False)), "UNKNOWN_TOOL_CALL")
            .when((role != "tool") & m["tool_call_id"].isNotNull(), "TOOL_CALL_ID_NOT_ON_TOOL")
            .when(m["name"].isNotNull() & blank(m["name"]), "BLANK_NAME")
        )
        pending = F.when(role == "tool", F.array_remove(s["pending"], m["tool_call_id"])).otherwise(F.concat(s["pending"], ids))
        return F.struct(F.coalesce(s["err"], err).alias("err"), (s["i"] + 1).alias("i"), (s["user"] | F.coalesce(role == "user", F.lit(False))).alias("user"), F.coalesce(pending, s["pending"]).alias("pending"), F.concat(s["known"], ids).alias("known"))

    def finish(s):
        end = F.when(F.size(s["pending"]) > 0, "UNANSWERED_TOOL_CALL").when(~s["user"], "NO_USER")
        if require_answer:
            end = end.when(F.element_at(msgs, -1)["role"] != "assistant", "NO_FINAL_ANSWER")
        return F.coalesce(s["err"], end)

    return F.when(F.coalesce(F.size(msgs), F.lit(0)) < 1, "NO_MESSAGES").otherwise(F.aggregate(msgs, zero, step, finish))


def record_violations(records: DataFrame) -> DataFrame:
    """``(rule, entity, detail)`` of rows ``(id, kind, line)`` whose JSON breaks the closed schema of their kind."""
    keys = F.json_object_keys("line")
    allowed = F.create_map(*[x for k, v in RECORD_KEYS.items() for x in (F.lit(k), F.array(*[F.lit(c) for c in ["id", "document_family", *v]]))])
    accepted = F.try_element_at(allowed, F.col("kind"))
    get = lambda k: F.get_json_object("line", f"$.{k}")
    rules = [
        ("NOT_OBJECT", keys.isNull(), F.lit("")),
        ("UNKNOWN_KIND", accepted.isNull(), F.col("kind")),
        ("UNKNOWN_FIELDS", F.size(F.array_except(keys, accepted)) > 0, F.array_join(F.array_sort(F.array_except(keys, accepted)), ",")),
        ("BLANK_ID", blank(get("id")), F.lit("")),
        ("BLANK_TEXT", (F.col("kind") == "pretrain") & blank(get("text")), F.lit("")),
        ("SAME_ANSWERS", (F.col("kind") == "preference") & F.coalesce(get("chosen") == get("rejected"), F.lit(False)), F.lit("")),
        ("BLANK_ANSWER", (F.col("kind") == "preference") & (blank(get("chosen")) | blank(get("rejected"))), F.lit("")),
        ("BAD_TASK", (F.col("kind") == "rl") & (blank(get("task.task_id")) | blank(get("task.category")) | ~F.coalesce(get("task.expected_action").isin("answer", "abstain", "out_of_domain"), F.lit(False))), F.lit("")),
    ]
    hits = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(r).alias("rule"), d.alias("detail"))) for r, c, d in rules]))
    return records.select(F.col("id").alias("entity"), F.explode(hits).alias("v")).select("v.rule", "entity", "v.detail")


def auxiliary_errors(df: DataFrame) -> DataFrame:
    """``df`` with ``codes``: label columns of wrong length or value (constraints of 4, dimensions of 7, domain, verifier)."""
    finite = lambda v: v.isNull() | (~F.isnan(v) & (F.abs(v) < float("inf")))
    c = F.array_compact(
        F.array(
            F.when(F.col("constraint_labels").isNotNull() & ((F.size("constraint_labels") != 4) | ~F.forall("constraint_labels", lambda v: v.isNull() | v.isin(-1.0, 0.0, 1.0))), "CONSTRAINT_LABELS"),
            F.when(F.col("si_dimensions").isNotNull() & ((F.size("si_dimensions") != 7) | ~F.forall("si_dimensions", finite)), "SI_DIMENSIONS"),
            F.when(F.col("domain_label").isNotNull() & ~F.col("domain_label").isin(-1, 0, 1, 2), "DOMAIN_LABEL"),
            F.when(F.col("verifier_label").isNotNull() & ~F.col("verifier_label").isin(-1.0, 0.0, 1.0), "VERIFIER_LABEL"),
        )
    )
    return df.withColumn("codes", c)


def training_texts(records: DataFrame) -> DataFrame:
    """``(id, at, text)`` of the train split: text or the contents, tool calls and answers of each record.

    ``records`` has ``split``, ``id`` and any of ``text``, ``msgs``, ``chosen``, ``rejected``.
    """
    r = records.filter(F.col("split") == "train")
    parts = []
    if "text" in records.columns:
        parts.append(r.filter("text is not null").select("id", F.lit(0).alias("at"), "text"))
    if "msgs" in records.columns:
        m = r.select("id", F.posexplode("msgs").alias("at", "m"))
        calls = F.when(F.col("m.tool_calls").isNotNull(), F.concat(F.lit('{"tool_calls":'), F.col("m.tool_calls"), F.lit("}")))
        parts.append(m.select("id", (F.col("at") * 2).alias("at"), F.col("m.content").alias("text")).filter("text is not null"))
        parts.append(m.select("id", (F.col("at") * 2 + 1).alias("at"), calls.alias("text")).filter("text is not null"))
    for k, c in enumerate(("chosen", "rejected")):
        if c in records.columns:
            parts.append(r.filter(F.col(c).isNotNull()).select("id", F.lit(1_000_000 + k).alias("at"), F.col(c).alias("text")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def content_digest(kind: str) -> Column:
    """Digest of the parts of a record that are its content."""
    cols = [messages_json(F.col(c)) if c in ("messages", "prompt") else F.col(c) for c in CONTENT_KEYS[kind]]
    return F.sha2(F.to_json(F.struct(*[c.alias(n) for c, n in zip(cols, CONTENT_KEYS[kind])])), 256)
