"""Operators of the core against small literals, brute force and hand-made goldens."""

import hashlib
import json
import math
import random
import sqlite3
import unicodedata
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from curata import sources, streaming
from curata.functions import identity as I
from curata.functions import quality as Q
from curata.functions import text as T
from curata.functions import udfs
from curata.operators import dedup, evaluation, families, graph, guards, kernels, messages, packing, reports, retrieval, sampling, stats, tools
from curata.runtime import Stage, clean_id, lookup

MSG = "array<struct<turn int, role string, content string, name string, tool_call_id string, tool_calls string>>"


def union_find(pairs):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in parent}


def graph_edges(seed):
    r = random.Random(seed)
    chain = [(i, i + 1) for i in range(40)]
    ring = [(100 + i, 100 + (i + 1) % 9) for i in range(9)]
    star = [(200, 201 + i) for i in range(30)]
    loop = [(200, 300), (300, 301), (301, 200)]
    return chain + ring + star + loop + [(r.randrange(400, 440), r.randrange(400, 440)) for _ in range(50)] + [(7, 7), (2, 1)]


@pytest.mark.parametrize("method", [graph.contract_components, graph.frontier_components, graph.star_components])
def test_components_equal_union_find(spark, method):
    e = graph_edges(3)
    got = {}
    for r in method(spark.createDataFrame(e, "a long, b long"), hot=10).collect():
        got.setdefault(r.root, set()).add(r.v)
    want = {}
    for v, root in union_find([x for x in e if x[0] != x[1]]).items():
        want.setdefault(root, set()).add(v)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    if method is not graph.frontier_components:
        assert all(root == min(vs) for root, vs in got.items())


def test_components_of_nothing(spark):
    empty = spark.createDataFrame([], "a long, b long")
    for method in (graph.contract_components, graph.star_components, graph.frontier_components):
        assert method(empty).collect() == []


def test_lookup_splits_hot_keys(spark):
    left = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(300)] + [(None, -1)], "k int, x int")
    right = spark.createDataFrame([(i, i * 10) for i in range(300)], "k int, y int")
    hot, plain = (sorted(map(tuple, lookup(left, right, "k", "left", h).select("k", "x", "y").collect()), key=str) for h in (20, 10**9))
    assert hot == plain and len(hot) == 301


def test_stage_cuts_lineage_and_keeps_the_schema(spark):
    s = Stage(spark.createDataFrame([(1, None)], "a int, b string"), "x")
    assert s.df.collect()[0].a == 1 and s.df.columns == ["a", "b"]
    s.drop()


def test_clean_id(spark):
    rows = [("  A\t",), (" b ",), ("",), ("   ",), (None,)]
    assert [r[0] for r in spark.createDataFrame(rows, "x string").select(clean_id(F.col("x"))).collect()] == ["a", "b", None, None, None]


def test_identity_equals_python(spark):
    text = 'a "quoted" \\ back\tslash \u0001   é 😀'
    df = spark.createDataFrame([([("user", text), ("assistant", "ok")],)], "m array<struct<role string, content string>>")
    want = json.dumps([{"role": "user", "content": text}, {"role": "assistant", "content": "ok"}], ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    assert df.select(I.messages_json(F.col("m"))).first()[0] == want
    assert df.select(I.record_id(F.col("m"))).first()[0] == "repo-" + hashlib.sha256(want.encode()).hexdigest()[:24]


def test_tokens_templates_shingles(spark):
    df = spark.createDataFrame([("Straße 12.5 V, café_x!",), ("",), (None,)], "t string")
    got = df.select(I.tokens(F.col("t")), I.template(F.col("t")), I.shingles(F.col("t"))).collect()
    assert got[0][0] == ["strasse", "12", ".", "5", "v", ",", "café_x", "!"]
    assert got[0][1] == "strasse NUM v , café_x !"
    assert got[0][2][0] == hashlib.sha256("\x1f".join(got[0][0][:5]).encode()).hexdigest()[:16] and len(got[0][2]) == 4
    assert got[1][2] == [] and got[2][0] is None


def test_text_folding():
    assert T.letters("Ｓtraße – 12,5 kΩ!") == "strasse125kω"
    assert T.merkle({"a": [1, "B!"], "c": None}) == T.merkle({"c": None, "A": [1, "b"]})
    assert T.merkle([1, 2]) != T.merkle([2, 1]) and T.json_object("[1]") is None and T.json_object('{"a": 1') is None


def test_quality_codes(spark):
    texts = {
        "": "EMPTY_TEXT", "[image goes here]": "SOURCE_VISUAL_PLACEHOLDER", "a�b": "REPLACEMENT_CHARACTERS", "": "PRIVATE_USE_GLYPHS", "a\u0001b": "CONTROL_CHARACTERS",
        "a​b": "INVISIBLE_FORMATTING", "hyphen-\nated": "AMBIGUOUS_HYPHENATION", "l e t t e r s": "SPACED_LETTER_FRAGMENTS", "a\nb\nc\nd\ne\nf\ng\nh": "FRAGMENTED_LINES", "!!!!!!!": "GARBLED_SYMBOL_RUN",
        "helloooooo": "GARBLED_WORDS", "Problem 3\nProblem 2": "READING_ORDER_HINT", "cost $x": "UNBALANCED_MATH_DELIMITERS", r"\(a": "UNBALANCED_MATH_DELIMITERS", r"\begin{a}": "UNBALANCED_LATEX_ENVIRONMENT",
        "x = (1": "UNBALANCED_MATH_BRACKETS", "x = 1O": "OCR_NUMERIC_CONFUSION", "y = x +": "INCOMPLETE_MATH", r"\frac{}{2}": "EMPTY_MATH_ARGUMENT", "5 m^ ": "BROKEN_UNIT_EXPONENT",
        "2 + 2 = 5": "NUMERIC_EQUALITY_MISMATCH", "we stop because": "TRUNCATED_SENTENCE_HINT", "text\nSolution:": "EMPTY_EDUCATIONAL_SECTION", "key AKIA" + "A" * 16: "POSSIBLE_SECRET", "password: abc1": "LOGIN_CREDENTIALS",
        "123-45-6789": "POSSIBLE_SSN", "MRN: A1234": "MEDICAL_RECORD_IDENTIFIER", "IBAN DE12 5001 0517 0648 4898": "BANK_ACCOUNT_NUMBER", "routing number 123456789": "BANK_ROUTING_NUMBER",
        "password=abcd a@b.org": "EMAIL_AND_PASSWORD", "Patient: Ann Lee\nDiagnosis: flu": "PERSONAL_MEDICAL_RECORD",
    }
    df = spark.createDataFrame([(k, v) for k, v in texts.items()], "text string, want string")
    for r in Q.inspect(df, exact=True).collect():
        assert r.want in [c.code for c in r.checks], (r.text, r.checks)
    clean = Q.statuses(Q.inspect(spark.createDataFrame([("A plain sentence costs $5 here.",)], "text string"), exact=True), F.lit(True), F.lit(True)).first()
    assert clean.checks == [] and clean.training_suitability == "eligible"


def test_quality_context_and_null(spark):
    ctx = {"expected_solution": F.lit(True), "solution_complete": F.lit(False), "ocr_confidence": F.lit(0.5)}
    codes = [c.code for c in Q.inspect(spark.createDataFrame([(None,)], "text string"), context=ctx).first().checks]
    assert {"EMPTY_TEXT", "SOLUTION_NOT_ESTABLISHED", "INCOMPLETE_SOLUTION", "LOW_OCR_CONFIDENCE"} <= set(codes)


def test_exact_arithmetic():
    assert udfs.exact_value("1/3 + 1/6") == Fraction(1, 2) and udfs.exact_value("2^-2") == Fraction(1, 4)
    assert udfs.exact_value("2^13") is None and udfs.exact_value("1/0") is None and udfs.exact_value("__import__") is None
    assert udfs.equality_counts(["10 / 3 = 3.33", "1 + 1 = 3", "a = 2"]) == (2, 1)


def test_strict_json():
    deep = "{\"a\":" * 70 + "1" + "}" * 70
    got = [udfs.strict_json_error(x) for x in ('{"a":1}', '{"a":1,"a":2}', '{"a":NaN}', '{"a":1e999}', "[1]", "{", deep)]
    assert got == [None, "DUPLICATE_KEY", "NON_FINITE", "NON_FINITE", "NOT_OBJECT", "INVALID_JSON", "TOO_DEEP"]


def test_distributions():
    assert abs(udfs.t_two_sided(2.228138852, 10) - 0.05) < 1e-8 and abs(udfs.f_upper(4.964602744, 1, 10) - 0.05) < 1e-8
    assert abs(udfs.t_quantile(0.95, 10) - 2.228138852) < 1e-7


def conversation(*turns):
    return [(i, *t, *[None] * (5 - len(t))) for i, t in enumerate(turns)]


def test_message_status_and_protocol(spark):
    call = '[{"id": "c1", "name": "f", "arguments": {"x": 1}}]'
    rows = [
        ("ok", conversation(("system", "s"), ("user", "q"), ("assistant", "a"))), ("order", conversation(("user", "q"), ("user", "q"))), ("empty", conversation(("user", "  "), ("assistant", "a"))),
        ("one", conversation(("user", "q"))), ("open", conversation(("user", "q"), ("assistant", "a"), ("user", "q"))), ("tool", conversation(("user", "q"), ("assistant", "", None, None, call), ("tool", "1", None, "c1"), ("assistant", "a"))),
        ("lost", conversation(("user", "q"), ("assistant", "", None, None, call), ("assistant", "a"))), ("none", []), ("null", conversation(("user", None), ("assistant", "a"))),
    ]
    got = {r.id: (r.s, r.p) for r in spark.createDataFrame(rows, f"id string, m {MSG}").select("id", messages.status(F.col("m")).alias("s"), messages.protocol_error(F.col("m"), True).alias("p")).collect()}
    assert got["ok"] == ("OK", None) and got["tool"] == ("UNSUPPORTED_MESSAGE_FIELDS", None)
    assert got["order"][0] == "INVALID_ROLE_ORDER" and got["empty"][0] == "EMPTY_OR_NON_TEXT_CONTENT" and got["one"][0] == "INCOMPLETE_MESSAGES" and got["open"][0] == "MISSING_FINAL_ASSISTANT"
    assert got["lost"][1] == "UNANSWERED_TOOL_CALL" and got["none"][1] == "NO_MESSAGES" and got["null"][1] == "CONTENT_NOT_TEXT"


def test_canonical_rows(spark):
    rows = ['{"prompt":"q","completion":"a"}', '{"instruction":"i","input":"x","output":"o"}', '{"messages":[{"role":"user","content":"q"},{"role":"assistant","content":"a"}]}', "{", "[1]", '{"a":1}', '{"instruction":"i","input":5,"output":"o"}', None]
    got = spark.createDataFrame([(r,) for r in rows], "r string").select(messages.canonical_row(F.col("r")).alias("x")).collect()
    assert [g.x.error for g in got] == [None, None, None, "INVALID_JSON", "ROW_NOT_OBJECT", "UNSUPPORTED_ROW_SCHEMA", "INPUT_NOT_TEXT", "INVALID_JSON"]
    assert got[1].x.messages[0].content == "i\n\nx" and got[2].x.messages[1].content == "a"
    lab = spark.createDataFrame([("User: hi\nthere\nAssistant: yes",), ("none",)], "t string").select(messages.labelled_messages(F.col("t")).alias("m")).collect()
    assert [(m.role, m.content) for m in lab[0].m] == [("user", "hi\nthere"), ("assistant", "yes")] and lab[1].m is None


def test_record_violations_and_auxiliary(spark):
    rows = [("a", "pretrain", '{"id":"a","text":"x","extra":1}'), ("b", "preference", '{"id":"b","prompt":[],"chosen":"x","rejected":"x"}'), ("c", "rl", '{"id":"c","prompt":[],"task":{}}'), ("d", "pretrain", '{"id":"d","text":"fine"}')]
    got = {(r.rule, r.entity) for r in messages.record_violations(spark.createDataFrame(rows, "id string, kind string, line string")).collect()}
    assert got == {("UNKNOWN_FIELDS", "a"), ("SAME_ANSWERS", "b"), ("BAD_TASK", "c")}
    aux = spark.createDataFrame([([1.0, 0.0, -1.0, None], [float("nan")] * 7, 5, 0.5)], "constraint_labels array<double>, si_dimensions array<double>, domain_label int, verifier_label double")
    assert messages.auxiliary_errors(aux).first().codes == ["SI_DIMENSIONS", "DOMAIN_LABEL", "VERIFIER_LABEL"]


def test_dedup_and_leaks(spark):
    df = spark.createDataFrame([(1, "x", "train"), (2, "x", "test"), (3, "y", "train"), (4, None, "test")], "id int, t string, split string")
    assert {(r.keep, r.origin) for r in dedup.origins(df.filter("t is not null"), F.col("t"), "id").collect()} == {(1, 1), (1, 2), (3, 3)}
    assert [r.key for r in dedup.leaks(df.filter("t is not null"), F.col("t"), F.col("split")).collect()] == ["x"]
    twins = dedup.near_twins(spark.createDataFrame([(1, "Ａ  b"), (2, "a B"), (3, "c")], "id int, t string"), "t", "id").collect()
    assert [(r["first"], r.n) for r in twins] == [(1, 2)]


def test_family_matches_against_brute_force(spark):
    r = random.Random(5)
    base = [" ".join(f"w{r.randrange(40)}" for _ in range(30)) for _ in range(12)]
    texts = {i: t for i, t in enumerate(base)}
    texts |= {100 + i: t.replace("w1 ", "w2 ") for i, t in enumerate(base)} | {200: base[0] + " tail " + base[1], 300: "", 301: None, 302: base[3]}
    f = families.features(spark.createDataFrame(list(texts.items()), "k int, t string"), "k", "t")
    sh = {k: set(x) for k, x in ((r.id, r.sh) for r in f.collect())}
    got = {(m.anchor, m.other): m.kind for m in families.matches(f, f).collect()}
    for a in texts:
        for b in texts:
            if a == b or (texts[a] or "") == (texts[b] or ""):
                continue
            if min(len(sh[a]), len(sh[b])) < 10:
                assert (a, b) not in got
                continue
            c = len(sh[a] & sh[b])
            if c / len(sh[a] | sh[b]) >= 0.85:
                assert got[a, b] == "LEXICAL_NEAR_COPY_CONSERVATIVE_BIND"
            elif c >= 0.95 * len(sh[a]) and texts[a] in texts[b]:
                assert got[a, b] == "PROMPT_CONTAINED_IN_SOURCE"
            else:
                assert (a, b) not in got
    assert got[3, 302] == "EXACT_PROMPT" and got[0, 200] == "PROMPT_CONTAINED_IN_SOURCE"


def test_numeric_template_is_uncertain(spark):
    f = families.features(spark.createDataFrame([("a", "Calculate current for voltage 12 and resistor 3."), ("b", "Calculate current for voltage 24 and resistor 6.")], "k string, t string"), "k", "t")
    m = families.matches(f, f, same_prompt=True).collect()
    assert {(x.kind, x.score) for x in m} == {("NUMERIC_TEMPLATE_UNCERTAIN", None)}


def test_taint_and_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y")], "parent string, child string")
    assert {r.id for r in families.tainted(e, spark.createDataFrame([("a",)], "id string")).collect()} == {"a", "b", "c"}
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("e", "f"), ("f", None)], "id string, duplicate_of string")
    assert {r.id for r in guards.duplicate_cycles(links).collect()} == {"a", "b", "c", "d"}


def test_guards(spark):
    v = guards.one_to_one(spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(2,), (3,)], "k int"), "k")
    assert {(r.rule, r.entity) for r in v.collect()} == {("LEFT_ONLY", "1"), ("RIGHT_ONLY", "3")}
    with pytest.raises(guards.Violations, match="LEFT_ONLY: 1"):
        guards.assert_clean(v)
    guards.assert_clean(v.limit(0))
    with pytest.raises(guards.Violations):
        guards.two_phase(v, lambda: pytest.fail("content was read"))
    s = spark.createDataFrame([("a", 0, 5, 10, None, None), ("b", 5, 5, 10, None, None), ("c", 0, 9, 10, 1, 8)], "id string, start int, stop int, length int, within_start int, within_stop int")
    assert {(r.rule, r.entity) for r in guards.span_violations(s).collect()} == {("SPAN_BOUNDS", "b"), ("SPAN_OUTSIDE_PARENT", "c")}


def test_packing_goldens(spark):
    d = spark.createDataFrame([("a", "hello"), ("b", "wörld"[:4]), ("c", "")], "k string, t string").withColumn("tok", packing.byte_tokens(F.col("t")))
    assert d.filter("k = 'a'").first().tok == [b + 32 for b in b"hello"] and d.filter("k = 'c'").first().tok == []
    w = packing.sequence(packing.windows(d.filter("k <> 'c'"), "k", "tok", 4), "window", None, 4)
    rows = w.collect()
    assert len(rows) == 4 and sum(r.n_targets for r in rows) == 12 and all(len(r.input_ids) == 4 and r.labels[0] == -100 for r in rows)
    c = spark.createDataFrame([("x", conversation(("user", "q"), ("assistant", "ok")))], f"id string, m {MSG}")
    p = packing.pack_sft(c, "m", 16).first()
    assert p.aux_position == sum(p.attention_mask) - 2 and [x for x in p.labels if x != -100][-2:] == [packing.TURN_END, packing.EOS]
    pref = packing.pack_preference(c.withColumn("m", F.slice("m", 1, 1)).withColumn("chosen", F.lit("y")).withColumn("rejected", F.lit("no")), "m", 16).first()
    assert pref.chosen_n_targets == 3 and pref.rejected_n_targets == 4
    rl = packing.pack_rl(c.withColumn("m", F.slice("m", 1, 1)), "m", 8).first()
    assert rl.input_ids[: sum(rl.attention_mask)][-1] == packing.ROLE_IDS["assistant"] and rl.code is None
    assert packing.sequence(d.filter("k = 'a'"), "tok", None, 3).first().code == "TOO_LONG"


def test_round_trip_of_bytes(spark):
    texts = ["", "plain", "é 😀  ", "\x00\x7f"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(packing.byte_text(packing.byte_tokens(F.col("t")))).collect()
    assert [r[0] for r in got] == texts


def test_index_and_epochs(spark):
    d = spark.range(25_000).withColumn("n", F.col("id") % 3)
    rows = sorted(packing.record_index(d, "id", "n").collect(), key=lambda r: r.id)
    total = 0
    for r in rows:
        assert r.start == total
        total += r.n
    a, b = ([r.id for r in sampling.epoch_order(spark.range(500), "id", 1, e).orderBy("position").collect()] for e in (0, 1))
    assert sorted(a) == list(range(500)) and a != b


def test_percentiles_by_index(spark):
    r = random.Random(1)
    v = [r.randrange(5000) for _ in range(997)]
    got = reports.index_percentiles(spark.createDataFrame([(x,) for x in v] + [(None,)], "v int"), "v").first()
    s = sorted(v)
    assert (got.max, got.p50, got.p95, got.p99, got.n) == (s[-1], s[int(997 * 0.5)], s[int(997 * 0.95)], s[int(997 * 0.99)], 997)


def test_seal_is_independent_of_partitions(spark):
    d = spark.range(200).withColumn("x", F.sha2(F.col("id").cast("string"), 256))
    seals = {tuple(reports.seal(d.repartition(n), "id", F.col("x")).first()) for n in (1, 3, 7)}
    assert len(seals) == 1 and seals != {tuple(reports.seal(d.filter("id > 0"), "id", F.col("x")).first())}


def test_bm25_against_brute_force(spark):
    docs = {i: t for i, t in enumerate(["pump motor pump", "motor valve", "valve valve leak", "unrelated words here"])}
    p, n = retrieval.postings(spark.createDataFrame(list(docs.items()), "id int, text string"))
    got = retrieval.search(p, n, spark.createDataFrame([("q", "pump valve")], "query_id string, query string"), 3).orderBy("rank").collect()
    avg = sum(len(t.split()) for t in docs.values()) / 4

    def score(t):
        ws, s = t.split(), 0.0
        for term in ("pump", "valve"):
            df = sum(term in x.split() for x in docs.values())
            tf = ws.count(term)
            s += max(math.log((4 - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ws) / avg)) if tf else 0
        return s

    want = sorted(((-round(score(t), 9), i) for i, t in docs.items() if score(t) > 0))[:3]
    assert [(-r.score, r.id) for r in got] == want


def test_units_and_calculators(spark):
    assert tools.unit_of("N/mm^2")[:2] == (1e6, 0.0) or math.isclose(tools.unit_of("N/mm^2")[0], 1e6)
    assert [tools.unit_of(u)[3] for u in ("degC*m", "m^13", "furlong", "", None)] == ["AFFINE_UNIT_IN_PRODUCT", "POWER_OUT_OF_RANGE", "UNSUPPORTED_UNIT", "NO_UNIT", "NO_UNIT"]
    rows = [(1.0, "N/mm^2", "MPa"), (0.0, "degC", "K"), (1.0, "Hz", "rad/s"), (1.0, "degC", "delta_degC"), (1.0, "N", "Pa"), (None, "m", "m")]
    got = tools.convert(spark.createDataFrame(rows, "v double, a string, b string"), "v", "a", "b").collect()
    assert math.isclose(got[0].converted, 1) and got[1].converted == 273.15
    assert [r.code for r in got] == [None, None, "CYCLES_AND_ANGLE", "POINT_AND_INTERVAL", "DIMENSIONS_DIFFER", "NO_VALUE"]
    q = spark.createDataFrame([(1.0, 1e8, 1.0), (1.0, 0.0, 1.0), (1.0, 2.0, 1.0), (0.0, 1.0, 1.0)], "a double, b double, c double").select(tools.quadratic_roots(*map(F.col, "abc")).alias("r")).collect()
    assert abs(q[0].r[0] * q[0].r[1] - 1) < 1e-12 and q[1].r == [] and q[2].r == [-1.0] and q[3].r is None
    with pytest.raises(ValueError):
        tools.route("dc_motor", {"kt": F.lit(1)})


def test_statistics_goldens(spark):
    d = spark.createDataFrame([("a", float(x)) for x in (1, 2, 3)] + [("b", float(x)) for x in (10, 12, 14, 16, 18)], "g string, v double")
    w = stats.welch(d, "g", "v", "a", "b").first()
    assert math.isclose(w.difference, -12) and math.isclose(w.df, 98 / 19) and math.isclose(w.t, -12 / math.sqrt(7 / 3)) and w.ci_low < -12 < w.ci_high and 0 < w.p_two_sided < 0.01
    a = stats.anova(spark.createDataFrame([("x", float(v)) for v in (1, 2, 3)] + [("y", float(v)) for v in (4, 5, 6)], "g string, v double"), "g", "v").first()
    assert math.isclose(a.f, 13.5) and a.df_within == 4
    rows = [(float(1 + 2 * x + 3 * z), float(x), float(z)) for x, z in ((0, 0), (1, 0), (0, 1), (2, 3), (4, 1))]
    fit = stats.regression(spark.createDataFrame(rows, "y double, a double, b double"), "y", ["a", "b"])
    assert math.isclose(fit["intercept"], 1, abs_tol=1e-9) and all(math.isclose(c, e) for c, e in zip(fit["coefficients"], (2, 3)))
    with pytest.raises(ValueError):
        stats.regression(spark.createDataFrame([(1.0, x, 2 * x) for x in (1.0, 2.0, 3.0, 4.0)], "y double, a double, b double"), "y", ["a", "b"])
    f = stats.factorial_design(spark, ["p", "q", "r"]).collect()
    assert len(f) == 8 and sum(r.p for r in f) == 0 and sum(r.p * r.q for r in f) == 0
    assert [r.v for r in stats.out_of_control(spark.createDataFrame([(9.0,), (10.0,), (11.0,), (14.0,)], "v double"), "v", 10, 1).collect()] == [14.0]


def test_kernels(spark):
    g = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0)], "g string, r double")
    adv = {r.r: r.advantage for r in kernels.advantages(g, "g", "r").collect()}
    assert math.isclose(adv[3.0], 1 / (1 + 1e-6)) and adv[5.0] is None
    dpo = kernels.dpo(spark.createDataFrame([(1.0, 0.0, 0.0, 0.0)], "a double, b double, c double, d double"), "a", "b", "c", "d").first()
    assert math.isclose(dpo.loss, math.log(1 + math.exp(-0.1))) and dpo.preference_accuracy == 1
    lr = [r.lr for r in kernels.learning_rates(spark, 10, 2, 1.0).orderBy("step").collect()]
    assert lr[0] == 0.5 and lr[1] == 1.0 and math.isclose(lr[-1], 0.1)
    b = kernels.bootstrap(spark.createDataFrame([("s", i % 20, float(i % 7)) for i in range(400)], "s string, c int, v double"), "s", "c", "v", resamples=200).first()
    assert b.low < 3 < b.high


def test_scores(spark):
    t = spark.createDataFrame([("t1", "math", 2.0, "m", (0.0, 0.01), ["x"], "answer"), ("t2", "ood", None, None, (0.0, 0.0), [], "out_of_domain"), ("t3", "math", 1.0, "m", (0.0, 0.01), [], "answer"), ("t4", "math", 1.0, "m", (0.0, 0.01), ["y"], "answer")], "task_id string, category string, reference_value double, expected_unit string, tolerance struct<absolute double, relative double>, required_assumptions array<string>, expected_action string")
    a = spark.createDataFrame([("t1", "answered", 200.0, "cm", ["x", "z"]), ("t2", "out_of_domain", None, None, None), ("t4", "answered", 1.0, "m", [])], "task_id string, status string, value double, unit string, assumptions array<string>")
    s = evaluation.score(t, a)
    assert {r.task_id: r.reason for r in s.collect()} == {"t1": "correct", "t2": "correct refusal", "t3": "format", "t4": "assumptions"}
    r = evaluation.report(s).first()
    assert r.task_count == 4 and r.coverage == round(2 / 3, 6) and r.refusal_accuracy == 1.0
    e = spark.createDataFrame([("q", "x", 1.0, "m", 1e-6, 0.0), ("r", "x", 1.0, "m", 1e-6, 0.0), ("s", "x", 1.0, "m", 0.0, 0.0)], "id string, field string, value double, unit string, rtol double, atol double")
    g = evaluation.grade_fields(e, spark.createDataFrame([("q", "x", 1.0, "m"), ("r", "x", 1.0, "cm")], "id string, field string, value double, unit string"))
    assert {r.id: r.reason for r in g.collect()} == {"q": "FIXED_ORACLE_FIELDS_AND_UNITS", "r": "ANSWER_UNITS_OR_SHAPE", "s": "ANSWER_KEYS"}


def test_sampling(spark):
    d = spark.createDataFrame([(g, i) for g in "ab" for i in range(20)], "g string, id int")
    s = sampling.quota_sample(d, "g", "id", spark.createDataFrame([("a", 3)], "g string, budget int"))
    want = sorted(range(20), key=lambda i: hashlib.sha256(f"salt{i}".encode()).hexdigest())[:3]
    assert [r.id for r in s.orderBy("rank").collect()] == want
    p = sampling.review_page(d, "g", ["id"], 5, 3, spark.createDataFrame([(6,)], "id int"))
    assert sorted(r.id for r in p.collect()) == [5, 5, 7, 7]
    assert [r[0] for r in spark.createDataFrame([("logs/a.jsonl",), ("x/y.jsonl",), ("my_password.txt",), ("a.md",), ("x.bin",), ("../a.md",)], "p string").select(sampling.path_class(F.col("p"))).collect()] == ["training_log_or_evaluation_artifact", "candidate_dataset", "excluded_path", "documentation_config_or_code", "unsupported_or_generated_artifact", "excluded_path"]


def test_sources_and_sinks(spark, tmp_path):
    f = tmp_path / "a.jsonl"
    f.write_text('{"a":1}\n\n{"a":1,"a":2}\n[1]\n')
    lines = sources.json_lines(spark, str(f))
    assert [(r.line_no, r.line) for r in lines.orderBy("line_no").collect()][:2] == [(1, '{"a":1}'), (2, "")]
    assert {(r.rule, r.entity[-1]) for r in sources.line_violations(lines).collect()} == {("BLANK_LINE", "2"), ("DUPLICATE_KEY", "3"), ("NOT_OBJECT", "4")}
    assert sources.json_lines(spark, str(f), tolerant=True).count() == 3
    d = spark.createDataFrame([(2, "b"), (1, "a")], "id int, x string")
    one, two = (sources.gzip_lines(d.repartition(n), "x", "id", str(tmp_path / f"{n}.gz")) for n in (1, 3))
    assert one == two == hashlib.sha256(b"a\nb\n").hexdigest() and (tmp_path / "1.gz").read_bytes() == (tmp_path / "3.gz").read_bytes()
    sources.publish(d, str(tmp_path / "out"), "f1")
    assert sources.prepared(spark, str(tmp_path / "out"), "f1").count() == 2
    with pytest.raises(FileExistsError):
        sources.publish(d, str(tmp_path / "out"))
    with pytest.raises(ValueError):
        sources.prepared(spark, str(tmp_path / "out"), "f2")
    (tmp_path / "link").symlink_to(f)
    with pytest.raises(ValueError):
        sources.confined(str(tmp_path), "link")
    with pytest.raises(ValueError):
        sources.confined(str(tmp_path), "../x")
    blob = spark.createDataFrame([(bytearray(b"hi"),)], "c binary").select(sources.blob_sha1(F.col("c"))).first()[0]
    assert blob == hashlib.sha1(b"blob 2\0hi").hexdigest()
    db = tmp_path / "l.db"
    with sqlite3.connect(db) as c:
        c.execute("create table t (a int)")
        c.execute("insert into t values (1), (2)")
    assert sources.ledger(spark, str(db), "select sum(a) from t", "s long").first().s == 3
    pins = spark.createDataFrame([("a.jsonl", hashlib.sha256(f.read_bytes()).hexdigest()), ("gone", "0" * 64)], "path string, sha256 string")
    (tmp_path / "pin").mkdir()
    (tmp_path / "pin" / "a.jsonl").write_bytes(f.read_bytes())
    good, bad = sources.pinned_files(spark, str(tmp_path / "pin"), pins)
    assert [r.name for r in good.collect()] == ["a.jsonl"] and [(r.rule, r.entity) for r in bad.collect()] == [("MISSING", "gone")]


def test_stream_resumes_and_keeps_dead_letters(spark, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    spark.createDataFrame([(1, "a"), (2, None)], "id int, x string").write.parquet(src)
    args = dict(schema="id int, x string", target=out, good=lambda d: d, folder=state, error=F.when(F.col("x").isNull(), "NO_TEXT"))
    for more in (None, [(3, "c")]):
        if more:
            spark.createDataFrame(more, "id int, x string").write.mode("append").parquet(src)
        sources_ = streaming.scan(spark, src, contract={"v": 1}, **args)
        sources_.awaitTermination(120)
    assert sorted(r.id for r in spark.read.parquet(f"{out}/rows").collect()) == [1, 3]
    assert [(r.id, r.reason) for r in spark.read.parquet(f"{out}/failed").filter("id is not null").collect()] == [(2, "NO_TEXT")]
    with pytest.raises(streaming.ContractChanged):
        streaming.scan(spark, src, contract={"v": 2}, **args)


def test_normalisation(spark):
    r = Q.normalized(spark.createDataFrame([("é\r\nx\ry",)], "text string")).first()
    assert r.text == unicodedata.normalize("NFC", "é\nx\ny") and (r.n_crlf, r.n_cr, r.nfc_changed) == (1, 1, True)


def test_entry_and_queries(spark):
    import __spark_entry__ as e

    rows = e.entry(spark).collect()
    assert rows and set(e.oracle_sql()) <= set(e.queries())


def test_metadata_guards(spark):
    d = spark.createDataFrame([("a", {"x": "ok"}), ("a", {"y": "ok"}), (" ", {"x": "no"})], "id string, decl map<string,string>")
    assert {(r.rule, r.entity) for r in guards.metadata_violations(d, "id", ["id", "more"]).collect()} == {("FIELDS", "decl"), ("FIELDS", "more"), ("BLANK_KEY", ""), ("DUPLICATE_KEY", "a")}
    assert {(r.rule, r.entity) for r in guards.declared_violations(d, "id", "decl", ["x"], ["ok"]).collect()} == {("DECLARATIONS_MISSING", "a"), ("DECLARATION_UNKNOWN", " ")}
    reg = spark.createDataFrame([("s", "r1", 0, 5, 9, "p", "1"), ("s", "r2", 5, 5, 9, "p", "2")], "source string, region string, start int, stop int, length int, path string, sha256 string")
    sel = spark.createDataFrame([("s", "r1"), ("s", "r3")], "source string, region string")
    assert {r.rule for r in guards.region_violations(reg, sel).collect()} == {"SPAN_BOUNDS", "DIGEST_CONFLICT", "NOT_COVERED", "NOT_SELECTED"}
    pins = spark.createDataFrame([("a", 1, "x"), ("b", 3, "y")], "id string, no int, v string").withColumn("d", F.when(F.col("id") == "a", F.sha2(F.to_json(F.struct("id", "v")), 256)).otherwise("0"))
    assert {(r.rule, r.entity) for r in guards.pin_violations(pins, "id", ["v", "id"], "d", "no").collect()} == {("PIN_CHANGED", "b"), ("NUMBERING", "2")}
    assert guards.fingerprint({"b": 1, "a": "é"}) == hashlib.sha256('{"a":"é","b":1}'.encode()).hexdigest()


def test_staging_invariants(spark):
    h = "f" * 64
    c = spark.createDataFrame([("repo-" + h[:24], h, "fine"), ("bad", h, "password: abcd")], "id string, hash string, text string")
    p = spark.createDataFrame([("repo-" + h[:24], "quarantined", []), ("other", "reviewed", [])], "id string, review_status string, issue_codes array<string>")
    got = {r.rule for r in guards.staging_violations(c, p).collect()}
    assert got == {"NO_PROVENANCE", "NO_CANDIDATE", "ID_NOT_OF_HASH", "DUPLICATE_HASH", "SENSITIVE", "ISSUES_AND_STATUS"}


def test_evidence_lines(spark):
    t = "\n".join(["x = 1 +"] * 40 + ["fine"])
    r = {x.code: x for x in Q.evidence(spark.createDataFrame([(1, t), (2, None)], "id int, text string"), "id").collect()}
    assert r["INCOMPLETE_MATH"]["count"] == 40 and r["INCOMPLETE_MATH"].line_numbers == list(range(1, 31))


def test_batches(spark):
    d = spark.createDataFrame([(1, 0, [1, 2]), (2, 0, [3]), (3, 1, [4])], "id int, b int, t array<int>")
    got = {r.batch: r.rows for r in packing.collate(packing.right_pad(d, "t", 9, "b"), F.col("b"), "t", "id").collect()}
    assert got == {0: [[1, 2], [3, 9]], 1: [[4]]}
    c = packing.completion_batch(spark.createDataFrame([([5, 6], [7])], "p array<int>, c array<int>"), "p", "c", 4).first()
    assert c.input_ids == [5, 6, 7, 0] and c.labels == [-100, -100, 7, -100]
