"""Queries over texts: identity, quality, duplicates, conversations, packing, sampling, retrieval."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from curata.functions import identity as I  # noqa: E741
from curata.functions import quality as Q
from curata.operators import dedup, families, guards, messages, packing, reports, retrieval, sampling
from curata.plans.registry import Registry
from curata.runtime import Stage, lookup, table

QUERIES = query = Registry()


def docs(spark, d):
    return table(spark, d, "documents")


def convs(spark, d):
    return messages.assemble(table(spark, d, "messages"))


def quote(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


# ---- identity ---------------------------------------------------------------------------------------------------

TOKENS_SQL = r"regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\pL\pN_]+|[^\pL\pN_\s\pZ\x1c-\x1f\x85]')"


@query("i01_text_digest", "SELECT doc_id, sha256(text) AS digest FROM documents")
def i01(spark, d):
    return docs(spark, d).select("doc_id", I.digest(F.col("text")).alias("digest"))


@query("i02_canonical_digest", f"SELECT doc_id, sha256(array_to_string({TOKENS_SQL}, ' ')) AS digest, len({TOKENS_SQL}) AS n_tokens FROM documents")
def i02(spark, d):
    return docs(spark, d).select("doc_id", I.digest(I.canon(F.col("text"))).alias("digest"), F.size(I.tokens(F.col("text"))).cast("long").alias("n_tokens"))


@query("i03_numeric_template", rf"SELECT sha256(regexp_replace(array_to_string({TOKENS_SQL}, ' '), '\b\d+(?:\s*\.\s*\d+)?\b', 'NUM', 'g')) AS template, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1")
def i03(spark, d):
    return docs(spark, d).groupBy(I.digest(I.template(F.col("text"))).alias("template")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"))


@query(
    "i04_shingle_counts",
    f"WITH t AS (SELECT doc_id, {TOKENS_SQL} AS t FROM documents), s AS (SELECT DISTINCT doc_id, substr(sha256(array_to_string(t[i:i+4], chr(31))), 1, 16) AS s FROM t, range(1, greatest(len(t) - 3, 1)) r(i)) "
    "SELECT doc_id, count(*) AS n_shingles, min(s) AS first_shingle FROM s GROUP BY 1",
)
def i04(spark, d):
    s = docs(spark, d).select("doc_id", I.shingles(F.col("text")).alias("s")).filter(F.size("s") > 0)
    return s.select("doc_id", F.size("s").cast("long").alias("n_shingles"), F.array_min("s").alias("first_shingle"))


MSG_SQL = "SELECT DISTINCT lower(trim(id)) AS id, turn, lower(trim(role)) AS role, content, name, tool_call_id, tool_calls FROM messages WHERE id IS NOT NULL"


@query(
    "i05_record_hash",
    f"WITH m AS ({MSG_SQL}) SELECT id, sha256(CAST(to_json(list({{'content': replace(replace(content, chr(13) || chr(10), chr(10)), chr(13), chr(10)), 'role': role}} ORDER BY turn)) AS VARCHAR)) AS hash FROM m WHERE id IN (SELECT id FROM m GROUP BY id HAVING count(content) = count(*)) GROUP BY id",
)
def i05(spark, d):
    c = convs(spark, d).filter(F.forall("msgs", lambda m: m["content"].isNotNull()))
    return c.select("id", I.record_hash(messages.plain(F.col("msgs"))).alias("hash"))


@query(
    "a07_prompt_groups",
    f"WITH m AS ({MSG_SQL}), g AS (SELECT id, sha256(coalesce(string_agg(content, chr(30) ORDER BY turn) FILTER (WHERE role = 'user'), '')) AS prompt_group FROM m GROUP BY id) SELECT prompt_group, count(*) AS n, count(*) > 1 AS collides, min(id) AS first_id FROM g GROUP BY 1",
)
def a07(spark, d):
    users = F.transform(F.filter("msgs", lambda m: m["role"] == "user"), lambda m: m["content"])
    c = convs(spark, d).select("id", F.sha2(F.array_join(users, "\x1e"), 256).alias("prompt_group"))
    return c.groupBy("prompt_group").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id")).withColumn("collides", F.col("n") > 1)


# ---- duplicates -------------------------------------------------------------------------------------------------


@query("a01_exact_dedup", "SELECT sha256(text) AS digest, min(doc_id) AS doc_id, count(*) AS n_copies FROM documents GROUP BY 1")
def a01(spark, d):
    return dedup.exact_dedup(docs(spark, d), F.sha2("text", 256), ["doc_id"], ["doc_id"])


@query("a01_origins", "SELECT sha256(text) AS digest, min(doc_id) OVER (PARTITION BY sha256(text)) AS keep, doc_id AS origin FROM documents")
def a01_origins(spark, d):
    return dedup.origins(docs(spark, d), F.sha2("text", 256), "doc_id")


@query("a02_duplicate_sources", "SELECT lower(trim(sha256)) AS sha256, count(*) AS n FROM rights_dispositions WHERE sha256 IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def a02(spark, d):
    r = table(spark, d, "rights_dispositions").filter("sha256 is not null")
    return dedup.duplicates(r, F.lower(F.trim("sha256")), "sha256")


@query("a03_duplicate_ids", "SELECT lower(trim(id)) AS id, count(*) AS n FROM candidates GROUP BY 1 HAVING count(*) > 1")
def a03(spark, d):
    return dedup.duplicates(table(spark, d, "candidates"), F.lower(F.trim("id")), "id")


@query("a04_duplicate_content", "SELECT sha256(content) AS digest, count(*) AS n FROM messages WHERE content IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def a04(spark, d):
    return dedup.duplicates(table(spark, d, "messages").filter("content is not null"), F.sha2("content", 256), "digest")


@query("a05_family_leaks", "SELECT lower(trim(family)) AS family, count(DISTINCT lower(trim(split))) AS n_splits, count(*) AS n FROM families WHERE family IS NOT NULL AND trim(split) <> '' GROUP BY 1 HAVING count(DISTINCT lower(trim(split))) > 1")
def a05(spark, d):
    f = table(spark, d, "families").filter("family is not null and trim(split) <> ''")
    return dedup.leaks(f, F.lower(F.trim("family")), F.lower(F.trim("split")), "family")


@query("a06_text_leaks", "SELECT sha256(text) AS digest, count(DISTINCT lower(trim(source))) AS n_splits, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1 HAVING count(DISTINCT lower(trim(source))) > 1")
def a06(spark, d):
    return dedup.leaks(docs(spark, d).filter("source is not null"), F.sha2("text", 256), F.lower(F.trim("source")), "digest")


@query("a08_near_twins")
def a08(spark, d):
    return dedup.near_twins(docs(spark, d), "text", "doc_id")


@query("s01_union_dedup", "WITH u AS (SELECT 0 AS part, sha256(text) AS digest, doc_id AS item, doc_id::VARCHAR AS name FROM documents UNION ALL SELECT 1, sha256(prompt), 0, task_id FROM eval_tasks) SELECT digest, arg_min(name, (part, name)) AS name, count(*) AS n_origins FROM u GROUP BY 1")
def s01(spark, d):
    a = docs(spark, d).select(F.sha2("text", 256).alias("digest"), F.col("doc_id").cast("string").alias("name"))
    b = table(spark, d, "eval_tasks").select(F.sha2("prompt", 256).alias("digest"), F.col("task_id").alias("name"))
    return dedup.union_dedup([a, b], "digest", "name")


# ---- quality ----------------------------------------------------------------------------------------------------



def _sql_count(p: str) -> str:
    return f"len(regexp_extract_all(text, {quote(p)}))"


def _issue_sql() -> str:
    ls = "string_split(text, chr(10))"
    math = f"list_filter({ls}, lambda x: regexp_matches(x, {quote(Q.MATH_LINE)}))"
    hit = lambda src, p: f"len(list_filter({src}, lambda x: regexp_matches(x, {quote(p)})))"
    parts = [("EMPTY_TEXT", r"(NOT regexp_matches(text, '[^\s\pZ\x1c-\x1f\x85]'))::INT")]
    parts += [(c, _sql_count(p.replace("\\x{ad}", "\\x{AD}"))) for c, _, _, p in Q.PATTERNS]
    parts += [(c, hit(math if m else ls, p)) for c, _, _, p, m in Q.LINE_PATTERNS]
    full = f"list_filter(list_transform({ls}, lambda x: length(trim(x))), lambda n: n > 0)"
    short = f"len(list_filter({full}, lambda n: n <= 3))"
    parts.append(("FRAGMENTED_LINES", f"CASE WHEN len({full}) >= 8 AND {short} * 1.0 / len({full}) > 0.45 THEN {short} ELSE 0 END"))
    nums = f"list_transform(list_filter({ls}, lambda x: regexp_matches(x, {quote(Q.QUESTION_NUMBER)})), lambda x: regexp_extract(x, {quote(Q.QUESTION_NUMBER)}, 1)::INT)"
    parts.append(("READING_ORDER_HINT", f"CASE WHEN len({nums}) > 1 THEN len(list_filter(list_zip({nums}, {nums}[2:]), lambda p: p[2] < p[1])) ELSE 0 END"))
    money = r"replace(text, '\$', '')"
    single = f"replace({money}, '$$', '')"
    parts.append(("UNBALANCED_MATH_DELIMITERS", rf"(len(regexp_extract_all({money}, '\$\$')) % 2 = 1 OR (len(regexp_extract_all({single}, '\$')) % 2 = 1 AND NOT regexp_matches({single}, {quote(Q.MONETARY)})))::INT"))
    parts.append(("TRUNCATED_SENTENCE_HINT", f"regexp_matches(rtrim(text), {quote(Q.TRUNCATED_HINT)})::INT"))
    parts.append(("EMPTY_EDUCATIONAL_SECTION", rf"regexp_matches(string_split(regexp_replace(text, '\s+$', ''), chr(10))[-1], {quote(Q.HEADING_ONLY)})::INT"))
    u = " UNION ALL ".join(f"SELECT doc_id, '{c}' AS code, {e} AS n FROM documents" for c, e in parts)
    return f"SELECT code, count(*) FILTER (WHERE n > 0) AS n_documents, coalesce(sum(n), 0)::BIGINT AS n_hits FROM ({u}) GROUP BY code"


def _long(df, found):
    one = F.array(*[F.struct(F.lit(c).alias("code"), n.cast("long").alias("n")) for c, _, _, n in found])
    x = df.select(F.explode(one).alias("x")).select("x.code", "x.n")
    return x.groupBy("code").agg(F.sum((F.col("n") > 0).cast("long")).alias("n_documents"), F.sum("n").alias("n_hits"))


@query("q01_issue_counts", _issue_sql())
def q01(spark, d):
    """Hits of each detector that SQL can state; every code has a row."""
    found = [x for x in Q.issue_counts(F.col("text"), looking=False)]
    # of the two checks of math delimiters the SQL states the one of dollars
    seen, keep = set(), []
    for x in found:
        if x[0] not in seen:
            keep.append(x)
        seen.add(x[0])
    return _long(docs(spark, d), keep)


@query("q09_looking_counts")
def q09(spark, d):
    """Hits of the detectors with look-around, back references or delimiter folds, which the oracle's engine lacks."""
    plain = {x[0] for x in Q.issue_counts(F.col("text"), looking=False)} - {"UNBALANCED_MATH_DELIMITERS"}
    return _long(docs(spark, d), [x for x in Q.issue_counts(F.col("text")) if x[0] not in plain])


@query("q16_exact_checks")
def q16(spark, d):
    """Documents by code with the checks that need stacks and exact arithmetic."""
    t = Q.inspect(docs(spark, d), exact=True)
    return reports.code_counts(t.select(F.transform("checks", lambda x: x["code"]).alias("codes")), "codes")


def _evidence_sql() -> str:
    one = lambda code, p, m: f"SELECT doc_id, '{code}' AS code, i FROM l WHERE regexp_matches(x, {quote(p)})" + (f" AND regexp_matches(x, {quote(Q.MATH_LINE)})" if m else "")
    parts = [one(c, p, m) for c, _, _, p, m in Q.LINE_PATTERNS] + [one(c, p, False) for c, _, _, p in Q.PATTERNS if c != "AMBIGUOUS_HYPHENATION"]
    return "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents), h AS (" + " UNION ALL ".join(parts) + ") SELECT doc_id, code, count(*) AS count, array_to_string(list(i ORDER BY i)[1:30], ',') AS line_numbers FROM h GROUP BY 1, 2"


@query("t04_evidence", _evidence_sql())
def t04(spark, d):
    """Line numbers of the findings of all detectors that SQL can state; the rest needs look-around."""
    looking = [c for c, *_ in Q.LOOKING_PATTERNS]
    e = Q.evidence(docs(spark, d), "doc_id").filter(~F.col("code").isin(looking))
    return e.select("doc_id", "code", "count", F.array_join(F.transform("line_numbers", lambda i: i.cast("string")), ",").alias("line_numbers"))


@query("q28_statuses")
def q28(spark, d):
    t = Q.statuses(Q.inspect(docs(spark, d)))
    return t.groupBy(Q.FIDELITY, Q.TECHNICAL, Q.SUITABILITY).agg(F.count(F.lit(1)).alias("n"))


@query("q29_metrics", rf"SELECT doc_id, length(text) AS characters, length(regexp_replace(text, '\s', '', 'g')) AS visible, len(string_split(text, chr(10))) AS lines, len(regexp_extract_all(text, '\S+')) AS words, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, {quote(Q.MATH_LINE)}))) AS math_lines FROM documents")
def q29(spark, d):
    return docs(spark, d).select("doc_id", *Q.metrics(F.col("text")))


def _sensitive_tests() -> dict[str, str]:
    any_ = {c: "(" + " OR ".join(f"regexp_matches(text, {quote(p)})" for p in ps) + ")" for c, ps in Q.SENSITIVE.items()}
    any_["EMAIL_AND_PASSWORD"] = f"({any_['LOGIN_CREDENTIALS']} AND regexp_matches(text, {quote(Q.EMAIL)}))"
    any_["PERSONAL_MEDICAL_RECORD"] = f"(regexp_matches(text, {quote(Q.PATIENT)}) AND regexp_matches(text, {quote(Q.CLINICAL)}))"
    return any_


def _sensitive_sql() -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS code, count(*) FILTER (WHERE {e}) AS n FROM documents" for c, e in _sensitive_tests().items())


@query("p_sensitive_counts", _sensitive_sql())
def p_sensitive(spark, d):
    """Documents by sensitive code, zeros included."""
    s = docs(spark, d).select(Q.sensitive_codes(F.col("text")).alias("c"))
    one = F.array(*[F.struct(F.lit(c).alias("code"), F.array_contains("c", c).cast("long").alias("n")) for c in Q.SENSITIVE_CODES])
    return s.select(F.explode(one).alias("x")).groupBy("x.code").agg(F.sum("x.n").alias("n"))


@query("p_excluded_sources", "SELECT lower(trim(source)) AS source, bool_or(" + " OR ".join(_sensitive_tests().values()) + f" OR regexp_matches(text, {quote(Q.EMAIL)})) AS excluded FROM documents GROUP BY 1")
def p_excluded(spark, d):
    """Sources by whether any of their texts has sensitive content of some code, or an e-mail address: one hit excludes the whole source."""
    t = F.coalesce("text", F.lit(""))
    bad = (F.size(Q.sensitive_codes(t)) > 0) | t.rlike(Q.EMAIL)
    return docs(spark, d).groupBy(F.lower(F.trim("source")).alias("source")).agg(F.bool_or(bad).alias("excluded"))


@query("prj23_normalized", "SELECT doc_id, sha256(nfc_normalize(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)))) AS digest FROM documents")
def prj23(spark, d):
    return Q.normalized(docs(spark, d)).select("doc_id", F.sha2("text", 256).alias("digest"))


@query("prj24_record_flags", " UNION ALL ".join(f"SELECT '{c}' AS code, count(*) FILTER (WHERE regexp_matches(content, {quote(p)})) AS n FROM messages" for c, p in Q.RECORD_FLAGS.items()))
def prj24(spark, d):
    m = table(spark, d, "messages")
    one = F.array(*[F.struct(F.lit(c).alias("code"), F.coalesce(F.col("content").rlike(p), F.lit(False)).cast("long").alias("n")) for c, p in Q.RECORD_FLAGS.items()])
    return m.select(F.explode(one).alias("x")).groupBy("x.code").agg(F.sum("x.n").alias("n"))


# ---- conversations ----------------------------------------------------------------------------------------------

STATUS_SQL = (
    f"WITH m AS ({MSG_SQL}), s AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY turn) - 1 AS i FROM m), "
    "f AS (SELECT id, max(CASE WHEN i = 0 AND role = 'system' THEN 1 ELSE 0 END) AS start, count(*) AS n, arg_max(role, i) AS last FROM s GROUP BY id), "
    r"e AS (SELECT s.id, i, CASE WHEN name IS NOT NULL OR tool_call_id IS NOT NULL OR tool_calls IS NOT NULL THEN 'UNSUPPORTED_MESSAGE_FIELDS' WHEN content IS NULL OR NOT regexp_matches(content, '[^\s\pZ\x1c-\x1f\x85]') THEN 'EMPTY_OR_NON_TEXT_CONTENT' "
    "WHEN i >= start AND role IS DISTINCT FROM CASE WHEN (i - start) % 2 = 0 THEN 'user' ELSE 'assistant' END THEN 'INVALID_ROLE_ORDER' END AS err FROM s JOIN f USING (id)), "
    "x AS (SELECT id, arg_min(err, i) FILTER (WHERE err IS NOT NULL) AS err FROM e GROUP BY id) "
    "SELECT CASE WHEN n < 2 THEN 'INCOMPLETE_MESSAGES' WHEN err IS NOT NULL THEN err WHEN last IS DISTINCT FROM 'assistant' THEN 'MISSING_FINAL_ASSISTANT' ELSE 'OK' END AS status, count(*) AS n FROM f JOIN x USING (id) GROUP BY 1"
)


@query("prj03_message_status", STATUS_SQL)
def prj03(spark, d):
    return convs(spark, d).groupBy(messages.status(F.col("msgs")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("prj05_protocol_errors")
def prj05(spark, d):
    return convs(spark, d).groupBy(F.coalesce(messages.protocol_error(F.col("msgs"), True), F.lit("OK")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("prj10_training_texts", f"WITH m AS ({MSG_SQL}), t AS (SELECT lower(trim(id)) AS id FROM families WHERE lower(trim(split)) = 'train') SELECT m.id, count(*) FILTER (WHERE content IS NOT NULL) + count(tool_calls) AS n_texts FROM m SEMI JOIN t USING (id) GROUP BY 1")
def prj10(spark, d):
    split = table(spark, d, "families").select(F.lower(F.trim("id")).alias("id"), F.lower(F.trim("split")).alias("split")).filter("split = 'train'").distinct()
    return messages.training_texts(convs(spark, d).join(split, "id")).groupBy("id").agg(F.count(F.lit(1)).alias("n_texts"))


# Paths made by rule, and their classes.
PATH_CASES = [("../up/a.jsonl", "excluded_path"), ("notes/api_key.txt", "excluded_path"), ("lib/__pycache__/x.pyc", "local_configuration_or_binary"), ("logs_01.jsonl", "training_log_or_evaluation_artifact"), ("set/part.jsonl", "candidate_dataset"), ("tokenizer_corpus/part", "tokenizer_corpus_not_sft"), ("README.md", "documentation_config_or_code"), ("model.bin", "unsupported_or_generated_artifact")]


@query("prj01_path_classes", f"SELECT class, count(*) AS n FROM (SELECT CASE doc_id % {len(PATH_CASES)} " + " ".join(f"WHEN {i} THEN '{c}'" for i, (_, c) in enumerate(PATH_CASES)) + " END AS class FROM documents UNION ALL SELECT CASE WHEN regexp_matches(path, '(?i)password|passwd|credential|secret|private.?key|api.?key|access.?token') THEN 'excluded_path' WHEN regexp_matches(path, '^logs.*\\.jsonl$') THEN 'training_log_or_evaluation_artifact' WHEN regexp_matches(path, '\\.jsonl$') THEN 'candidate_dataset' ELSE 'unsupported_or_generated_artifact' END FROM candidates) GROUP BY 1")
def prj01(spark, d):
    """Classes of the candidates' paths, and of one made path of each class for every eighth document."""
    made = F.element_at(F.array(*[F.lit(x) for x, _ in PATH_CASES]), (F.col("doc_id") % len(PATH_CASES) + 1).cast("int"))
    p = table(spark, d, "candidates").select("path").union(docs(spark, d).select(made))
    return p.groupBy(sampling.path_class(F.col("path")).alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query("prj12_tag_counts", " UNION ALL ".join(f"SELECT '{c}' AS tag, count(*) AS n FROM documents WHERE regexp_matches(text, {quote(p)})" for c, p in sampling.TAGS.items()).join(["SELECT * FROM (", ") WHERE n > 0"]))
def prj12(spark, d):
    return reports.code_counts(docs(spark, d).select(sampling.tags(F.col("text")).alias("t")), "t", "tag")


@query("prj13_eligible", f"SELECT doc_id FROM documents WHERE n_chars >= 80 AND domain IS NOT NULL AND ({' OR '.join(f'regexp_matches(text, {quote(p)})' for p in sampling.TAGS.values())})")
def prj13(spark, d):
    return docs(spark, d).filter("n_chars >= 80 and domain is not null").filter(F.size(sampling.tags(F.col("text"))) > 0).select("doc_id")


@query("prj14_scope", "SELECT id, path FROM candidates WHERE lower(path) = 'val.jsonl'")
def prj14(spark, d):
    return table(spark, d, "candidates").filter(sampling.in_scope(F.col("path"), ["val.jsonl"], ["private"])).select("id", "path")


@query("prj25_review_page", "SELECT doc_id, domain, ordinal FROM (SELECT doc_id, domain, row_number() OVER (PARTITION BY domain ORDER BY created_at, doc_id) - 1 AS ordinal FROM documents) WHERE ordinal BETWEEN 3 AND 12 AND doc_id NOT IN (SELECT doc_id FROM documents WHERE qwen_tokens IS NOT NULL)")
def prj25(spark, d):
    done = docs(spark, d).filter("qwen_tokens is not null").select("doc_id")
    return sampling.review_page(docs(spark, d), "domain", ["created_at", "doc_id"], 3, 10, done, "doc_id").select("doc_id", "domain", "ordinal")


@query("w03_quota_sample", "SELECT lang, doc_id, rank FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY sha256('salt' || doc_id), doc_id) AS rank FROM documents) WHERE rank <= 5")
def w03(spark, d):
    return sampling.quota_sample(docs(spark, d), "lang", "doc_id", budget=5)


@query("w08_epoch_order", "SELECT doc_id, row_number() OVER (ORDER BY md5('9:' || doc_id), doc_id) - 1 AS position FROM documents")
def w08(spark, d):
    return sampling.epoch_order(docs(spark, d).select("doc_id"), "doc_id", 7, 2)


# ---- packing ----------------------------------------------------------------------------------------------------


@query("k01_byte_tokens", "SELECT doc_id, strlen(text) AS n_tokens, sha256(text) AS digest FROM documents")
def k01(spark, d):
    """Byte tokens of each text, and the digest of the text that they give back."""
    t = docs(spark, d).select("doc_id", packing.byte_tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.sha2(packing.byte_text(F.col("t")), 256).alias("digest"))


@query("k07_pack_counts", "SELECT sum(ceil((strlen(text) + 1) / 63.0))::BIGINT AS n_windows, sum(strlen(text) + 1)::BIGINT AS n_targets FROM documents")
def k07_counts(spark, d):
    w, t = packing.window_counts(F.octet_length("text"), 64)
    return docs(spark, d).agg(F.sum(w).alias("n_windows"), F.sum(t).alias("n_targets"))


@query("k07_pack", "WITH w AS (SELECT doc_id, strlen(text) + 2 AS n FROM documents) SELECT doc_id, ceil((n - 1) / 63.0)::BIGINT AS n_windows, n - 1 AS n_targets FROM w")
def k07(spark, d):
    """Windows of 64 tokens as they are packed, counted again from the arrays."""
    t = docs(spark, d).select("doc_id", packing.byte_tokens(F.col("text")).alias("t"))
    p = packing.sequence(packing.windows(t, "doc_id", "t", 64), "window", None, 64)
    return p.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_windows"), F.sum("n_targets").cast("long").alias("n_targets"))


@query("k08_pack_sft", f"WITH m AS ({MSG_SQL}), ok AS (SELECT id FROM m GROUP BY id HAVING count(*) FILTER (WHERE content IS NULL OR tool_calls IS NOT NULL OR tool_call_id IS NOT NULL OR name IS NOT NULL OR role NOT IN ('system','user','assistant')) = 0) SELECT id, (2 + sum(strlen(content) + 2))::BIGINT AS n_tokens, (1 + sum(CASE WHEN role = 'assistant' THEN strlen(content) + 1 ELSE 0 END))::BIGINT AS n_targets FROM m SEMI JOIN ok USING (id) GROUP BY id")
def k08(spark, d):
    """Tokens and targets of conversations without tools, from the packed arrays."""
    ok = lambda m: m["content"].isNotNull() & m["tool_calls"].isNull() & m["tool_call_id"].isNull() & m["name"].isNull() & m["role"].isin("system", "user", "assistant")
    c = convs(spark, d).filter(F.forall("msgs", ok))
    p = packing.pack_sft(c, "msgs", 16384)
    return p.select("id", F.aggregate("attention_mask", F.lit(0), lambda a, b: a + b).cast("long").alias("n_tokens"), F.col("n_targets").cast("long").alias("n_targets"))


@query("k11_record_index", "SELECT doc_id, coalesce(sum(ceil((strlen(text) + 1) / 63.0)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM documents")
def k11(spark, d):
    w, _ = packing.window_counts(F.octet_length("text"), 64)
    return packing.record_index(docs(spark, d).select("doc_id", w.alias("n")), "doc_id", "n").select("doc_id", F.col("start").cast("long").alias("start"))


@query("k13_preflight", "SELECT 'OVERFLOW' AS rule, count(*) AS n FROM documents WHERE strlen(text) > 2000 UNION ALL SELECT 'BAD_DIGEST', count(*) FROM documents WHERE doc_id % 9 = 0 UNION ALL SELECT 'DUPLICATE_ID', count(*) FROM (SELECT doc_id FROM documents GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'SEALED_FAMILY', count(*) FROM documents WHERE document_family = (SELECT min(document_family) FROM documents)")
def k13(spark, d):
    x = docs(spark, d).select(F.col("doc_id").alias("id"), F.col("document_family").alias("family"), F.octet_length("text").alias("n_tokens"), F.when(F.col("doc_id") % 9 == 0, F.lit("none")).otherwise(F.sha2("text", 256)).alias("sha256"))
    sealed = x.agg(F.min("family").alias("family"))
    return guards.counts(packing.preflight(x, 2000, sealed), ["OVERFLOW", "BAD_DIGEST", "DUPLICATE_ID", "SEALED_FAMILY"])


@query("k15_length_report", f"WITH n AS (SELECT strlen(text) AS v FROM documents), r AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i, count(*) OVER () AS n FROM n) SELECT max(v) AS max, max(v) FILTER (WHERE i = floor(n * 0.5)) AS p50, max(v) FILTER (WHERE i = floor(n * 0.95)) AS p95, max(v) FILTER (WHERE i = floor(n * 0.99)) AS p99, max(n) AS n FROM r")
def k15(spark, d):
    return reports.index_percentiles(docs(spark, d).select(F.octet_length("text").cast("long").alias("v")), "v")


# ---- families and contamination ---------------------------------------------------------------------------------


def _features(spark, d):
    """Features of the documents, computed once: several joins read them."""
    return Stage(families.features(docs(spark, d), "doc_id", "text"), "features").df


@query("j02_exact_prompts", f"WITH c AS (SELECT doc_id, sha256(array_to_string({TOKENS_SQL}, ' ')) AS h FROM documents) SELECT a.doc_id AS anchor, count(*) AS n_others, min(b.doc_id) AS first_other FROM c a JOIN c b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY 1")
def j02(spark, d):
    """Documents with exact partners: one row each, from the groups, not from pairs."""
    f = docs(spark, d).select("doc_id", I.digest(I.canon(F.col("text"))).alias("h"))
    g = f.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("lo"), F.min(F.struct(F.col("doc_id"))).alias("_a")).filter("n > 1")
    second = f.join(g.select("h", "lo"), "h").filter("doc_id <> lo").groupBy("h").agg(F.min("doc_id").alias("next"))
    x = f.join(g.select("h", "n", "lo"), "h").join(second, "h")
    return x.select(F.col("doc_id").alias("anchor"), (F.col("n") - 1).alias("n_others"), F.when(F.col("doc_id") == F.col("lo"), F.col("next")).otherwise(F.col("lo")).alias("first_other"))


SHINGLES_SQL = (
    f"t AS (SELECT doc_id, {TOKENS_SQL} AS t FROM documents), s AS (SELECT DISTINCT doc_id, hash(array_to_string(t[i:i+4], chr(31))) AS s FROM t, range(1, greatest(len(t) - 3, 1)) r(i)), "
    "n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1 HAVING count(*) >= 10), "
    "p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2)"
)


@query("j04_near_copies", f"WITH {SHINGLES_SQL} SELECT a AS doc_id, count(*) AS n_links, min(b) AS first_other FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c * 1.0 / (x.n + y.n - c) >= 0.85 GROUP BY 1")
def j04(spark, d):
    """Documents with near copies (Jaccard of 0.85 and more): one row each with the number of its links, from classes of equal texts."""
    reps, members = families.classes(_features(spark, d))
    o = families.overlaps(reps.df, reps.df, families.NEAR).filter(F.col("common") / (F.col("na") + F.col("nb") - F.col("common")) >= families.NEAR)
    size = reps.df.select(F.col("id").alias("other"), "copies")
    far = o.join(size, "other").groupBy(F.col("anchor").alias("cls")).agg(F.sum("copies").alias("links"), F.min("other").alias("first"))
    # inside a class: the other copies; the smallest of them is the class's name, or the next id for the name itself
    own = reps.df.filter(F.col("n") >= families.MIN_SHINGLES).select(F.col("id").alias("cls"), "copies")
    second = members.df.filter("id <> cls").groupBy("cls").agg(F.min("id").alias("second"))
    c = own.join(far, "cls", "left").join(second, "cls", "left").filter("links is not null or copies > 1")
    x = lookup(members.df.select("id", "cls"), c, "cls", "inner", rows=members.rows)
    near = F.when(F.col("id") == F.col("cls"), F.col("second")).otherwise(F.col("cls"))
    return x.select(F.col("id").alias("doc_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.least("first", near).alias("first_other"))


J05_SQL = (
    f"WITH t AS (SELECT 'a' AS side, task_id AS id, {TOKENS_SQL.replace('text', 'prompt')} AS t FROM eval_tasks UNION ALL SELECT 'b', doc_id::VARCHAR, {TOKENS_SQL} FROM documents), c AS (SELECT side, id, array_to_string(t, ' ') AS c FROM t), "
    "s AS (SELECT DISTINCT side, id, hash(array_to_string(t[i:i+4], chr(31))) AS s FROM t, range(1, greatest(len(t) - 3, 1)) r(i)), n AS (SELECT side, id, count(*) AS n FROM s GROUP BY 1, 2 HAVING count(*) >= 10), "
    "p AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.side = 'a' AND b.side = 'b' GROUP BY 1, 2), "
    "e AS (SELECT a.id AS a, b.id AS b, 0 AS r, 'EXACT_PROMPT' AS kind FROM c a JOIN c b ON a.c = b.c AND a.side = 'a' AND b.side = 'b'), "
    "o AS (SELECT p.a, p.b, p.c, x.n AS na, y.n AS nb, ca.c AS ca, cb.c AS cb FROM p JOIN n x ON x.side = 'a' AND x.id = p.a JOIN n y ON y.side = 'b' AND y.id = p.b JOIN c ca ON ca.side = 'a' AND ca.id = p.a JOIN c cb ON cb.side = 'b' AND cb.id = p.b), "
    "f AS (SELECT * FROM e UNION ALL SELECT a, b, 2, 'LEXICAL_NEAR_COPY_CONSERVATIVE_BIND' FROM o WHERE c * 1.0 / (na + nb - c) >= 0.85 UNION ALL SELECT a, b, 3, 'PROMPT_CONTAINED_IN_SOURCE' FROM o WHERE c * 1.0 / (na + nb - c) < 0.85 AND c >= 0.95 * na AND contains(cb, ca)), "
    "k AS (SELECT a, b, min_by(kind, r) AS kind FROM f GROUP BY 1, 2) SELECT kind, count(*) AS n, count(DISTINCT a) AS n_anchors FROM k GROUP BY 1"
)


@query("j05_contained_prompts", J05_SQL)
def j05(spark, d):
    """Labels of held-out prompts against documents by kind, from classes of equal documents."""
    a = Stage(families.features(table(spark, d, "eval_tasks"), "task_id", "prompt"), "features").df
    reps, _ = families.classes(_features(spark, d).withColumn("id", F.col("id").cast("string")))
    m = families.matches(a, reps.df).join(reps.df.select(F.col("id").alias("other"), "copies"), "other")
    return m.groupBy("kind").agg(F.sum("copies").alias("n"), F.countDistinct("anchor").alias("n_anchors"))


@query("j13_prompt_contamination", r"WITH x AS (SELECT doc_id, document_family AS f, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS p FROM documents), h AS (SELECT * FROM x WHERE doc_id % 10 = 0), t AS (SELECT * FROM x WHERE doc_id % 10 <> 0) SELECT rule, entity FROM (SELECT 'SHARED_P' AS rule, doc_id::VARCHAR AS entity FROM t WHERE p IN (SELECT p FROM h) UNION ALL SELECT 'SHARED_F', doc_id::VARCHAR FROM t WHERE f IN (SELECT f FROM h) UNION ALL SELECT 'SHARED_P', task_id FROM eval_tasks WHERE lower(trim(regexp_replace(prompt, '\s+', ' ', 'g'))) IN (SELECT p FROM h))")
def j13(spark, d):
    """Every tenth document as held out: others with its family or its text, and prompts that are its text."""
    norm = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    x = docs(spark, d).select(F.col("doc_id").alias("id"), F.col("document_family").alias("f"), norm(F.col("text")).alias("p"))
    held = x.filter("id % 10 = 0")
    tasks = table(spark, d, "eval_tasks").select(F.col("task_id").alias("id"), norm(F.col("prompt")).alias("p"))
    return guards.union([guards.contamination(x.filter("id % 10 <> 0"), held, ["p", "f"]), guards.contamination(tasks, held, ["p"])]).select("rule", "entity")


# ---- retrieval --------------------------------------------------------------------------------------------------


@query("src10_line_slices", "SELECT doc_id, sha256(array_to_string(string_split(text, chr(10))[2:3], chr(10))) AS slice FROM documents WHERE len(string_split(text, chr(10))) > 3")
def src10(spark, d):
    t = docs(spark, d).filter(F.size(F.split("text", "\n")) > 3)
    s = F.regexp_replace(retrieval.line_slice(F.col("text"), F.lit(2), F.lit(3)), r"\n\z", "")
    return t.select("doc_id", F.sha2(s, 256).alias("slice"))


POST_SQL = r"t AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[\pL\pN]+') AS t FROM documents), post AS (SELECT term, id, count(*) AS tf FROM (SELECT id, unnest(t) AS term FROM t) GROUP BY 1, 2), dl AS (SELECT id, len(t) AS dl FROM t)"


@query("snk10_postings", f"WITH {POST_SQL} SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM post GROUP BY 1")
def snk10(spark, d):
    p, _ = retrieval.postings(docs(spark, d), "doc_id")
    return p.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def _bm25_sql(queries: str, k: int) -> str:
    """The ``k`` best documents of each query of ``queries``, a select of ``(query_id, query)``, as ``r(query_id, id, score, rank)``."""
    return (
        f"WITH {POST_SQL}, q AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(query), '[A-Za-z_][A-Za-z_0-9]*')) AS term FROM ({queries})), g AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl), "
        "i AS (SELECT term, greatest(ln((n - count(*) + 0.5) / (count(*) + 0.5)), 1e-6) AS idf FROM post, g GROUP BY term, n), "
        "s AS (SELECT query_id, post.id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 9) AS score FROM q JOIN post USING (term) JOIN i USING (term) JOIN dl ON dl.id = post.id, g GROUP BY 1, 2), "
        f"r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= {k}) "
    )


FIRST_LINES = "SELECT doc_id AS query_id, string_split(text, chr(10))[1] AS query FROM documents WHERE doc_id % 100 = 0 AND length(string_split(text, chr(10))[1]) <= 2000"


@query("r03_bm25_search", _bm25_sql("SELECT task_id AS query_id, prompt AS query FROM eval_tasks", 3) + "SELECT query_id, id, round(score, 6) AS score, rank FROM r")
def r03(spark, d):
    q = table(spark, d, "eval_tasks").select(F.col("task_id").alias("query_id"), F.col("prompt").alias("query"))
    return retrieval.search_texts(docs(spark, d), q, 3, "doc_id").withColumn("score", F.round("score", 6))


def _leaders(spark, d):
    return docs(spark, d).select(F.col("doc_id").alias("expected"), F.get(F.split("text", "\n"), F.lit(0)).alias("query"))


@query("r05_regression", _bm25_sql(FIRST_LINES, 3) + "SELECT doc_id AS query_id, doc_id IN (SELECT id FROM r WHERE r.query_id = doc_id) AS hit FROM documents WHERE doc_id % 100 = 0")
def r05(spark, d):
    """Whether a document is among the first three for its own first line, over every hundredth document as a query."""
    q = _leaders(spark, d).filter("expected % 100 = 0").withColumn("query_id", F.col("expected"))
    return retrieval.regression(retrieval.search_texts(docs(spark, d), q.select("query_id", "query"), 3, "doc_id"), q.select("query_id", "expected"))


@query("n03_recall", _bm25_sql(FIRST_LINES, 5) + "SELECT count(*) AS n_queries, avg((coalesce(rank, 99) <= 1)::INT) AS recall_at_1, avg((coalesce(rank, 99) <= 3)::INT) AS recall_at_3, avg((coalesce(rank, 99) <= 5)::INT) AS recall_at_5 FROM documents LEFT JOIN r ON r.query_id = doc_id AND r.id = doc_id WHERE doc_id % 100 = 0")
def n03(spark, d):
    """Recall at one, three and five of the same queries."""
    q = _leaders(spark, d).filter("expected % 100 = 0").withColumn("query_id", F.col("expected"))
    return retrieval.recall(retrieval.search_texts(docs(spark, d), q.select("query_id", "query"), 5, "doc_id"), q.select("query_id", F.col("expected").alias("id")))


@query("k02_bpe_tokens")
def k02(spark, d):
    """Tokens of each document under a public vocabulary; its folder is a parameter of the environment."""
    path = os.environ.get("CURATA_TOKENIZERS", "/opt/tokenizers") + "/byte_bpe_50k.json"
    return docs(spark, d).select("doc_id", F.size(packing.bpe_tokens(F.col("text"), path)).alias("n_tokens"))


@query("prj11_first_domain", "WITH p AS (SELECT lower(trim(id)) AS id, min(path) FILTER (WHERE path IN ('D_Algebra_part.jsonl', 'D_Circuits_part.jsonl', 'D_Thermal_part.jsonl')) AS path FROM candidates GROUP BY 1) SELECT id, CASE path WHEN 'D_Algebra_part.jsonl' THEN 'algebra' WHEN 'D_Circuits_part.jsonl' THEN 'circuits' WHEN 'D_Thermal_part.jsonl' THEN 'thermal' ELSE 'generic' END AS domain FROM p")
def prj11(spark, d):
    """Domain of the alphabetically first path of a record that has one."""
    c = table(spark, d, "candidates").groupBy(F.lower(F.trim("id")).alias("id")).agg(F.collect_set("path").alias("paths"))
    known = {"D_Algebra_part.jsonl": "algebra", "D_Circuits_part.jsonl": "circuits", "D_Thermal_part.jsonl": "thermal"}
    return c.select("id", sampling.first_domain(F.col("paths"), known, "generic").alias("domain"))


def flagship(spark, d):
    t = docs(spark, d)
    keep = dedup.exact_dedup(t, F.sha2("text", 256), ["doc_id"], ["doc_id", "lang", "text"])
    x = Q.statuses(Q.inspect(keep))
    status = F.when(F.col(Q.SUITABILITY) == "exclude", "excluded").when(F.size("checks") > 0, "quarantined").otherwise("needs_review")
    return x.groupBy("lang", status.alias("status")).agg(F.count(F.lit(1)).alias("n_texts"), F.sum("n_copies").alias("n_documents"))


QUERIES["v16_flagship"] = (flagship, None)
