"""The nine training-data operators against brute force, made cases and awkward tables."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from curata.functions import text as T
from curata.llm import copies, cuts, groups, leaks, mix, near, pairs, splits, tokens

MESSAGES = "id string, turn int, role string, content string, name string, tool_call_id string, tool_calls string, repository string"
EDGES = "anchor string, other string, kind string, score double, x string, a string, b string, v long"
LONG = "alpha beta gamma delta " * 60_000


def table(spark, rows, schema, **more):
    d = spark.createDataFrame(rows, schema)
    # extra columns with names that the operators use themselves
    for c in ("v", "root", "u", "n", "base", "digest", "seed", "hit", "unit", "k", "token"):
        if c not in d.columns:
            d = d.withColumn(c, F.lit("clash"))
    return d


def turns(spark, recs):
    rows = [(i, k, r, c, None, None, tc, "r") for i, ts in recs.items() for k, (r, c, tc) in enumerate([(*t, None)[:3] for t in ts])]
    return table(spark, rows, MESSAGES)


def union_find(ps):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in ps:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in parent}


# ---- 1 ----------------------------------------------------------------------------------------------------------


def test_groups(spark):
    r = random.Random(2)
    nan, inf = float("nan"), float("inf")
    es = [(f"n{r.randrange(60)}", f"n{r.randrange(60)}", 0.9) for _ in range(45)] + [("hub", f"l{i}", 1.0) for i in range(40)] + [(f"c{i}", f"c{i + 1}", 0.85) for i in range(30)]
    odd = [("q1", "q2", None), ("q1", "q3", nan), ("q1", "q4", inf), ("q1", "q5", 0.8499), (None, "q6", 1.0), ("q7", " ", 1.0), ("Q8", "q8 ", 1.0), ("p1", "p2", 0.1), ("P2 ", "\tp1", 0.95), ("p1", "p2", 0.95)]
    rows = [(a, b, None, s, None, "clash", "clash", 1) for a, b, s in es + odd]
    got = {x.id: x.group_id for x in groups.consolidate(groups.binding_pairs(table(spark, rows, EDGES)), hot=15).collect()}
    assert got == union_find([(a, b) for a, b, _ in es if a != b] + [("p1", "p2")])


def test_groups_of_nothing(spark):
    assert groups.consolidate(groups.binding_pairs(table(spark, [], EDGES))).collect() == []


# ---- 2 ----------------------------------------------------------------------------------------------------------

Q_EN = "What should I check first when the pump in the cellar drifts from 3 V to 5 V after lunch, and how does the valve behave then?"
GOOD = "Check the valve first, because the seal wears out before the motor does. Then read the gauge again and note what it shows."


@pytest.mark.parametrize(
    ("answer", "want"),
    [
        (GOOD, None), ("", "empty"), (None, "empty"), ("<think>\n</think>\n\n", "empty"), ("```\n```", "empty"), ("n/a", "empty"), ("…", "empty"), ("{}", "empty"), ("[no answer]", "empty"), ("12.5 kN", None), ("No.", None),
        ("I'm sorry, but I cannot assist with questions of this kind. Please ask a professional.", "refusal"), ("Leider dabei kann ich nicht helfen.", "refusal"), ("Lo siento, pero debo rechazar esta petición.", "refusal"),
        ("Désolé, mais je ne peux pas vous aider à ce sujet.", "refusal"), ("Sorry, the start request for CB-1 was declined: the valve leaks. Clear it and press reset.", None), ("You cannot answer this from one reading, so take two. " + GOOD, None),
        (Q_EN, "echo"), ("Q: " + Q_EN.upper(), "echo"), ("You ask: " + Q_EN + " " + GOOD + " " + GOOD, None),
        ("Prüfen Sie zuerst das Ventil, weil die Dichtung vor dem Motor verschleißt und der Wert nicht stimmt.", "other_language"), (GOOD[:-8], "truncated"), (GOOD + "\n\n```python\nx = 1", "truncated"), (GOOD + "\n\n```python\nx = 1\n```", None),
        (GOOD + "\n\n- Check the valve\n- Note the value", None), (GOOD + "\n\nF = k x = 2 × 3 = 6 N", None), (GOOD[:60] + "...", "truncated"), ('{"status": "answered", "response": "' + GOOD, "truncated"), (json.dumps({"status": "answered", "response": GOOD}), None),
        (GOOD + " => 12 mV", None), (GOOD + " (see the", "truncated"), (LONG + "end.", None),
    ],
)
def test_defects_of_single_answers(spark, answer, want):
    batch = next(iter(pairs._judge([_batch([("x", [(0, "user", Q_EN, False), (1, "assistant", answer, False)])])])))
    row = batch.to_pylist()[0]
    assert (row["defect"] or ("truncated" if row["cut"] else None)) == want


def _batch(recs):
    import pyarrow as pa

    return pa.RecordBatch.from_pydict({"id": [r[0] for r in recs], "t": [[dict(zip(("turn", "role", "content", "calls"), t)) for t in r[1]] for r in recs]})


def test_defects(spark):
    ask = ("user", "Please answer in German. " + Q_EN)
    recs = {
        " A": [(" User", Q_EN), ("ASSISTANT", GOOD)],
        "b": [ask, ("assistant", "Prüfen Sie zuerst das Ventil, weil die Dichtung vor dem Motor verschleißt und der Wert nicht stimmt.")],
        "c": [("user", Q_EN), ("assistant", "", '[{"id": "1"}]'), ("tool", "7"), ("assistant", GOOD[:-9])],
        "d": [("assistant", ""), ("user", Q_EN)],
        "e": [("user", Q_EN), ("assistant", GOOD.replace(".", "").upper())],
        "f": [("user", None), ("assistant", GOOD[:-30])],
    }
    m = turns(spark, recs)
    got = sorted(tuple(r) for r in pairs.defects(m.union(m)).collect())
    # e has lost its marks only: the same letters end properly in another answer
    assert got == [("c", 3, "truncated"), ("f", 1, "truncated")]
    assert pairs.defects(table(spark, [], MESSAGES)).collect() == []


def test_length_limits_are_found(spark):
    r = random.Random(4)
    word = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    recs = {f"r{i}": [("user", Q_EN), ("assistant", "- " + word(98))] for i in range(40)}
    recs |= {f"s{i}": [("user", Q_EN), ("assistant", "- " + word(70 + i * 3))] for i in range(20)}
    got = {x.id for x in pairs.defects(turns(spark, recs)).collect()}
    assert {f"r{i}" for i in range(40)} <= got and not {f"s{i}" for i in range(20) if 70 + i * 3 != 98} & got


# ---- 3 ----------------------------------------------------------------------------------------------------------


def test_related_groups(spark):
    fam = "id string, family string, split string, observed_at timestamp, received_at timestamp"
    rig = "family_id string, holder string, path string, sha256 string"
    h1, h2 = "a" * 64, "B" * 64
    rows = [("r1", "F1", "train"), ("r2 ", " f1", "Test"), ("r3", "f2", None), ("r4", "f3", "train"), ("r5", None, "val"), ("r6", None, "train"), ("r7", "f4", "train"), ("r8", "f5", "training"), ("r9", "f6", "unassigned"), ("r9", "f6", "unassigned"), (None, "f1", "test"), ("r10", "f7", "validation")]
    rights = [("f1", "Ann  Lab", "p", None), ("F2 ", " ann lab", "p", h1), ("f3", "n/a", "p", h1.upper()), ("f4", "Unknown", "p", splits.EMPTY_SHA256), ("f5", "unknown", "p", splits.EMPTY_SHA256), ("f6", "-", "p", "xyz"), ("f7", "other", "same", h2), ("f9", "Other", "same", None), (None, "ann lab", "p", h2)]
    f = table(spark, [(*x, None, None) for x in rows], fam)
    g = splits.related_groups(f, table(spark, rights, rig), hot=3)
    got = {r.id: r.group_id for r in g.collect()}
    assert got == {"r1": "r1", "r2": "r1", "r3": "r1", "r4": "r1", "r5": "r5", "r6": "r6", "r7": "r7", "r8": "r8", "r9": "r9", "r10": "r10"}
    assert {tuple(r) for r in splits.split_conflicts(f, g).collect()} == {(i, "r1") for i in ("r1", "r2", "r3", "r4")}
    t = spark.createDataFrame([("train", 0.5), ("test", 0.5), (None, 1.0), ("bad", -1.0)], "split string, target_share double")
    a = splits.assign_splits(g, t).collect()
    assert len(a) == 10 and len({r.split for r in a if r.group_id == "r1"}) == 1 and {r.split for r in a} <= {"train", "test"}
    assert splits.related_groups(table(spark, [], fam), table(spark, [], rig)).collect() == []


def test_split_shares(spark):
    g = spark.range(4000).select(F.concat(F.lit("i"), "id").alias("id"), F.concat(F.lit("g"), (F.col("id") % 1500).cast("string")).alias("group_id"))
    t = spark.createDataFrame([("train", 0.8), ("validation", 0.1), ("test", 0.1)], "split string, target_share double")
    for r in splits.split_shares(splits.assign_splits(g, t), t).collect():
        assert abs(r.share - r.target_share) < 0.005


# ---- 4 ----------------------------------------------------------------------------------------------------------


def test_token_budget(spark):
    docs = [(1, "hello world", "en", "A ", "d1", None), (2, "hello world", "EN-gb", "a", "d1", 6), (3, "", None, None, None, None), (4, None, "und", "b", "D1 ", 10**9), (5, LONG, "de", "b", "d1", None)]
    d = table(spark, docs, "doc_id long, text string, lang string, source string, domain string, qwen_tokens long")
    c = [(" C1", "repo", "en", 100, 50, 1), ("c1", "repo", "en", 7, 3, 2), ("c2", "repo", "en", None, None, 1)]
    cands = table(spark, c, "id string, repository string, lang string, qwen_tokens long, assistant_tokens long, t int").withColumn("created_at", F.timestamp_seconds("t")).withColumn("received_at", F.timestamp_seconds("t"))
    m = turns(spark, {"c1": [("user", "one two three"), ("assistant", "four five six")], "c2": [("user", "one two three"), ("assistant", "four five six")]})
    rev = table(spark, [("c1", "x", 1), ("C1", " Y", 2)], "id string, domain string, t int").withColumn("reviewed_at", F.timestamp_seconds("t")).withColumn("received_at", F.timestamp_seconds("t"))
    got = {(r.origin, r.source, r.lang, r.domain): r for r in tokens.budget(d, cands, m, rev).collect()}
    a = got["documents", "a", "en", "d1"]
    # one recorded count of 6 against 2 counted tokens gives a ratio of 3 for the language
    assert (a.n_records, a.n_recorded, a.tokens) == (2, 1, 12)
    assert got["documents", "unknown", "und", "unknown"].tokens == 0 and got["documents", "b", "und", "d1"].n_recorded == 0
    assert got["documents", "b", "de", "d1"].tokens > 100_000
    assert (got["candidates", "repo", "en", "y"].tokens, got["candidates", "repo", "en", "unknown"].tokens) == (7, 7)
    assert got["candidates", "repo", "en", "unknown"].assistant_tokens == 3
    e = [x.limit(0) for x in (d, cands, m, rev)]
    assert tokens.budget(*e).collect() == []


# ---- 5 ----------------------------------------------------------------------------------------------------------


def test_copies(spark):
    js = '{"a": 1, "b": {"c": "X y", "d": [1, 2]}}'
    recs = {
        "k1": [("user", "Straße No. 5!"), ("assistant", js)], "K0 ": [(" USER ", "strasse no 5"), ("assistant", '{"b":{"d":[1,2],"c":"x-Y"},"a":1}')], "k2": [("user", "strasse no 5"), ("assistant", '{"a":1,"b":{"c":"xy","d":[2,1]}}')],
        "k3": [("user", "strasse no 5"), ("user", js)], "e1": [("user", None), ("assistant", "")], "e2": [("user", "!?"), ("assistant", " ")], "l1": [("user", LONG), ("assistant", "x")], "l2": [("user", LONG.upper()), ("assistant", "X.")],
        "o1": [("user", "a"), ("assistant", "b")], "o2": [("user", "b"), ("assistant", "a")],
    }
    m = turns(spark, recs)
    got = {tuple(r) for r in copies.copies(m.union(m), hot=3).collect()}
    assert got == {("k0", "k1"), ("e1", "e2"), ("l1", "l2")}
    assert {r.keep_id: r.n_copies for r in copies.collapse(m).collect()} == {"k0": 2, "k2": 1, "k3": 1, "e1": 2, "l1": 2, "o1": 1, "o2": 1}
    assert copies.copies(table(spark, [], MESSAGES)).collect() == []


# ---- 6 ----------------------------------------------------------------------------------------------------------


def brute_near(recs, t=0.5):
    sets = {}
    for i, ts in recs.items():
        w = T.words(" ".join(c or "" for r, c, *_ in ts if r != "system"))
        sets[i] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)}
    form = {i: [(r, T.letters(c or "")) for r, c, *_ in ts] for i, ts in recs.items()}
    out = set()
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and form[a] != form[b] and len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]):
                out.add((a, b))
    return out


def made_records(seed, n=60):
    r = random.Random(seed)
    recs = {}
    for i in range(n):
        w = [f"w{r.randrange(30)}" for _ in range(r.choice([3, 8, 30, 80, 200]))]
        recs[f"a{i:03}"] = [("system", "be kind"), ("user", " ".join(w)), ("assistant", " ".join(f"v{r.randrange(30)}" for _ in range(6)))]
        for j in range(r.randrange(3)):
            x = list(w)
            for _ in range(r.randrange(1, max(2, len(w) // 5))):
                at = r.randrange(len(x))
                x[at : at + r.randrange(2)] = [f"z{r.randrange(9)}"] * r.randrange(2)
            recs[f"b{i:03}{j}"] = [("user", " ".join(x)), recs[f"a{i:03}"][2]]
    return recs | {"s1": [("user", "one two")], "s2": [("user", "one two")], "n1": [("user", None)], "c1": [("user", LONG)], "c2": [("user", LONG + "extra end")], "d1": [("user", "One, two three")], "d2": [("user", "one two THREE!")]}


@pytest.mark.parametrize("block", [4096, 3])
def test_near_pairs_equal_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", block)  # small blocks: hot shards are divided
    monkeypatch.setattr(near, "VISITS", 50 if block == 3 else 500_000)
    recs = made_records(block)
    m = turns(spark, recs)
    got = [tuple(r) for r in near.near_pairs(m.union(m)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_near(recs) and len(got) > 20


def test_near_pairs_of_a_hot_group(spark):
    base = " ".join(f"h{i}" for i in range(40))
    recs = {f"x{i:02}": [("user", f"{base} tail{i} more{i}")] for i in range(30)} | {f"y{i:02}": [("user", base)] for i in range(30)}
    assert {tuple(r) for r in near.near_pairs(turns(spark, recs)).collect()} == brute_near(recs)
    assert near.near_pairs(table(spark, [], MESSAGES)).collect() == []


def test_near_pairs_in_passes(spark, monkeypatch):
    """The bitmaps that go to the shards at one time take no more than the share that is given to them, however many the buckets."""
    monkeypatch.setattr(near, "SLICES", 4)
    monkeypatch.setattr(near, "BUCKET", 150)
    monkeypatch.setattr(near, "ROOM", 20_000)
    monkeypatch.setattr(near, "SHARE", 0)
    spread, rows = near.spread, []

    def watched(*args):
        df = spread(*args)
        rows.append(df.selectExpr("sum(12 + length(bits) + length(extra) + length(tails)) s").first().s or 0)
        return df

    monkeypatch.setattr(near, "spread", watched)
    recs = made_records(5, 30)
    got = [tuple(r) for r in near.near_pairs(turns(spark, recs)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_near(recs) and len(got) > 20
    assert len(rows) > near.SLICES and max(rows) < 1.5 * near.ROOM < sum(rows) / 2


def test_longer_bitmaps_lose_no_pair_and_find_fewer():
    r = np.random.default_rng(3)
    n = np.array([50, 150, 161, 200, 320, 330, 400, 600])
    base = r.integers(0, 1 << 53, 700, np.uint64)
    sets = [np.unique(base[:k]) for k in n] + [np.unique(r.integers(0, 1 << 53, k, np.uint64)) for k in n]
    row, h, n = np.repeat(np.arange(16), [len(x) for x in sets]), np.concatenate(sets), np.array([len(x) for x in sets])
    w = np.ascontiguousarray(near._bitmaps(row, h, 16)).view(np.uint64)
    size, extra = near._extras(row, h, n)
    a, b = (x.ravel() for x in np.meshgrid(np.arange(16), np.arange(16)))
    keep = near._within(a, b, n, w, size, extra.view(np.uint64), 0.5)
    for bits, least in ((1024, 64), (2048, 192)):
        x = near._bitmaps(row, h, 16, bits)
        far = np.bitwise_count(x[a] ^ x[b]).sum(1, dtype=np.int64)
        mine = (np.minimum(size[a], size[b]) == least)
        assert mine.any() and (keep[mine] <= (far <= (n[a] + n[b]) / 3 + 1e-9)[mine]).all() and not keep[mine].all()
    both = np.array([len(np.intersect1d(sets[p], sets[q])) for p, q in zip(a, b)])
    assert keep[2 * both >= n[a] + n[b] - both].all()


def test_bk_forest_against_all_pairs():
    r = np.random.default_rng(1)
    rows = 120
    sets = [set(r.integers(0, 60, r.integers(4, 40)).tolist()) for _ in range(rows)]
    h = np.concatenate([np.array(sorted(s), np.uint64) for s in sets]) * np.uint64(0x9E3779B97F4A7C15)
    n = np.array([len(s) for s in sets])
    bits = near._bitmaps(np.repeat(np.arange(rows), n), (h >> np.uint64(11)), rows)
    w = np.ascontiguousarray(bits).view(np.uint64)
    g = np.arange(rows) % 3
    got = {tuple(sorted(p)) for p in near.bk_forest(g, np.arange(rows), n, w, np.arange(rows), np.arange(rows), 0.5).tolist()}
    for a in range(rows):
        for b in range(a):
            if g[a] == g[b] and len(sets[a] & sets[b]) * 2 >= len(sets[a] | sets[b]):
                assert (b, a) in got


# ---- 7 ----------------------------------------------------------------------------------------------------------

CLOSING = "State these assumption IDs in the structured answer: steady_state."


def leak_tables(spark):
    r = random.Random(6)
    prompts = {f"t{i}": " ".join(f"i{i}x{k} the" if k % 3 else f"i{i}x{k} of" for k in range(20)) + ". " + CLOSING for i in range(12)}
    filler = lambda: " ".join(f"f{r.randrange(500)}" for _ in range(40))
    p = prompts["t3"].split()
    docs = {
        1: filler() + " " + prompts["t1"] + " " + filler(), 2: filler() + " " + " ".join(p[6:18]).upper() + " " + filler(), 3: filler() + " " + CLOSING, 4: filler() + " t3 " + " ".join(p[4:9]), 5: filler(), 6: None, 7: "",
        8: "<p>" + "\n".join(f"<b>{w}</b>" if k % 5 == 0 else w for k, w in enumerate(p[2:20])) + "</p>", 9: " ".join(w for k, w in enumerate(p[0:24]) if k != 12), 10: LONG + prompts["t5"] + LONG,
    }
    t = table(spark, [(k, v) for k, v in prompts.items()] + [("t1", prompts["t1"]), ("null", None)], "task_id string, prompt string")
    return table(spark, list(docs.items()) + [(1, docs[1])], "doc_id long, text string"), t


WANT_LEAKS = {(1, "t1"), (2, "t3"), (8, "t3"), (9, "t3"), (10, "t5")}


@pytest.mark.parametrize("block", [2_000_000, 60])
def test_leaks(spark, block, monkeypatch):
    monkeypatch.setattr(leaks, "BLOCK_WORDS", block)
    got = [tuple(r) for r in leaks.leaks(*leak_tables(spark)).collect()]
    assert len(got) == len(set(got)) and set(got) == WANT_LEAKS


def test_leaks_of_nothing(spark):
    d, t = leak_tables(spark)
    assert leaks.leaks(d.limit(0), t).collect() == [] and leaks.leaks(d, t.limit(0)).collect() == []


# ---- 8 ----------------------------------------------------------------------------------------------------------


def test_mix(spark):
    r = random.Random(8)
    rows = [(i, " ".join(["word"] * r.randrange(5, 200)) + f" {i}", "big" if i < 600 else " Small" if i < 640 else "other", ) for i in range(700)] + [(900, None, "big"), (901, "", "big"), (0, "again", None)]
    d = table(spark, rows[:-1], "doc_id long, text string, source string")
    t = spark.createDataFrame([("big", 0.6, 2), ("small", 0.2, 3), ("absent", 0.2, 2), ("bad", None, 1)], "source string, target_share double, max_repeats int")
    s = mix.sized(d)
    rate = mix.rates(s, t)
    m = mix.mix(s, rate, offset=0.3)
    got = {x.source: x for x in mix.reached(m, rate).collect()}
    assert set(got) == {"big", "small"} and abs(got["small"].share - 0.25) < 0.01 and got["small"].most_copies <= 3 and got["big"].most_copies <= 2
    # with a size beyond the cap the small source gives what it can
    over = mix.rates(s, t, total_tokens=10**9)
    assert {x.source: x.rate for x in over.collect()} == {"big": 2.0, "small": 3.0}
    assert {x.copies for x in mix.mix(s, over).filter("source = 'small'").collect()} == {3}
    assert mix.mix(s.limit(0), mix.rates(s.limit(0), t)).collect() == []


def test_mix_is_systematic(spark):
    s = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"), F.lit(10).cast("long").alias("tokens"))
    rate = spark.createDataFrame([("a", 1.0, 4.0, 10000, 1.37)], "source string, target_share double, max_repeats double, available long, rate double")
    c = [x.copies for x in mix.mix(s, rate, offset=0.0).collect()]
    assert sum(c) == 1370 and set(c) == {1, 2} and len(c) == 1000


# ---- 9 ----------------------------------------------------------------------------------------------------------


def test_stop_kinds():
    whole = [
        "A sentence.", 'It printed "loading..."', "Is it?", "", "   ", None, "A.\n\n- one item\n- two items", "A.\n\n| a | b |\n|---|---|\n| 1 | 2 |", "A.\n\n```\ncode\n```", "A.\n\n-- bench group 3, sheet X", "A.\n\nKeywords: pump; valve", "A.\n\nF = k x = 2 × 3 = 6 N",
        "A. (CB-1, rev. 2)", "A.  \n", "Ende „gut“.", "# Title\n\nText.",
    ]
    cut = ["The pump is ru", "The pump and the", "It stops here...", "It stops [...]", "It stops…", "It stops (more)", "A.\n\n| a | b |\n| 1 |", "A.\n\n| a | b |\n| 1 | 2", "A.\n\n```\ncode", "see (CB-1, the", 'He said "the pump', "byte�", "culp&am", "culp&#x2", "Hydraulik\\u00", "one, two,", "A.\n\n- Isolate the", "x =", "The value is\n\n"]
    assert [(s, cuts.stop_kind(s)) for s in whole if cuts.stop_kind(s)] == []
    assert [s for s in cut if not cuts.stop_kind(s)] == []


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_shorter_copies_equal_brute_force(spark, parts):
    r = random.Random(parts)
    ts = ["".join(r.choice("ab") for _ in range(r.randrange(0, 7))) for _ in range(120)] + [None, ""]
    got = {x.base: x.more for x in cuts.shorter_copies(spark.createDataFrame([(t,) for t in ts], "base string"), parts).collect()}
    want = {t for t in ts if t and any(u and u != t and u.startswith(t) for u in ts)}
    assert set(got) == want and all(any(u == b + m for u in ts) for b, m in got.items())


def test_cut_documents(spark):
    docs = {1: "The pump is fine. It runs well.", 2: "The pump is fine. It runs", 3: "The pump is fine.", 4: "- one\n- pump sta", 5: "- one\n- pump station", 6: None, 7: "", 8: LONG, 9: LONG + "the end.", 10: "- one [...]"}
    d = table(spark, list(docs.items()) + [(2, docs[2])], "doc_id long, text string").withColumn("source", F.lit(" S"))
    got = {r.doc_id: r.kind for r in cuts.cut_documents(d).collect()}
    assert set(got) == {2, 4, 8, 10} and got[4] == "shorter copy" and got[10] == "mark"
    r = cuts.cut_rates(d, cuts.cut_documents(d)).first()
    assert (r.source, r.n_documents, r.n_cut, r.share) == ("s", 10, 4, 0.4)
    assert cuts.cut_documents(d.limit(0)).collect() == []


def test_leaks_of_identical_and_nested_items(spark):
    """Items that share their text, or stand inside another, have no passage of their own; a text that carries them whole leaks them all."""
    r = random.Random(16)
    w = [f"w{k}" for k in range(60)]
    prompts = {"same1": " ".join(w[:12]), "same2": " ".join(w[:12]).upper() + ".", "inner": " ".join(w[20:32]), "outer": " ".join(w[14:44]), "far": " ".join(f"z{k}" for k in range(14))}
    fill = lambda: " ".join(f"f{r.randrange(500)}" for _ in range(30))
    pass_ = lambda k, word="other": " ".join(word if i == k else x for i, x in enumerate(w[34:42]))
    docs = {1: fill() + " " + " ".join(w[:12]) + " " + fill(), 2: fill() + " " + " ".join(w[20:32]) + " " + fill(), 3: " ".join(w[14:44]), 4: " ".join(w[20:28]), 5: " ".join(w[34:39]) + " " + fill()}
    # eight words with one of them replaced, at each place
    docs |= {10 + k: fill() + " " + pass_(k) + " " + fill() for k in range(8)}
    t = table(spark, list(prompts.items()), "task_id string, prompt string")
    got = {tuple(x) for x in leaks.leaks(table(spark, list(docs.items()), "doc_id long, text string"), t).collect()}
    want = {(1, "same1"), (1, "same2"), (2, "inner"), (3, "inner"), (3, "outer")} | {(10 + k, "outer") for k in range(8)}
    assert got == want


@pytest.mark.parametrize("seed", range(5))
def test_prefix_of_each_window(seed):
    """Any three runs of a window of eight words include one that is looked up."""
    import itertools

    g = np.random.default_rng(seed)
    h, df = g.integers(0, 1 << 40, 30), g.integers(1, 5, 30)
    must = leaks.prefix_places(df, h)
    assert all(must[[s + i for i in three]].any() for s in range(25) for three in itertools.combinations(range(6), 3))


@pytest.mark.parametrize("text", ["That is not a subject I engage with, sorry.", "Sorry, but that is not something I am comfortable with.", "Das möchte ich lieber nicht erläutern.", "Je préfère ne pas aborder ce sujet.", "Sorry, answering would go against my guidelines."])
def test_refusals_that_no_pattern_names(text):
    """The classifier is fitted on patterns' hits and on sound answers; phrases that no pattern has are found by their words."""
    sound = [f"{GOOD} Step {i}: the gauge at TE-{i} reads {i} kPa, which is not what we want." for i in range(300)]
    declined = ["I'm sorry, but I cannot assist with questions of this kind. Please ask a professional."] * 10
    model = pairs.decline_model(sound + declined)
    batch = next(iter(pairs._judge([_batch([("x", [(0, "user", Q_EN, False), (1, "assistant", text, False)])])], model)))
    assert batch.to_pylist()[0]["defect"] == "refusal"
    assert not any(pairs.declines(s, model) for s in sound)


@pytest.mark.parametrize(
    ("text", "lang"),
    [("Controllate prima la valvola, perché la guarnizione si usura prima del motore e il valore non è stabile.", "it"), ("Controleer eerst de klep, omdat de afdichting eerder slijt dan de motor en het niet stabiel is.", "nl"), ("首先检查阀门,因为密封件比电机先磨损。", "zh"),
     ("Sprawdź najpierw zawór, ponieważ uszczelka zużywa się przed silnikiem, a wartość jest niestabilna po każdym uruchomieniu pompy.", "other"), (GOOD, "en"), ("12 kPa", None)],
)
def test_languages(text, lang):
    assert pairs.language(T.words(text)) == lang


def test_short_answers_are_compared_too(spark):
    """No length is left out of the neighbour comparison; a whole word that others begin with is no fragment."""
    recs = {"a": [("user", Q_EN), ("assistant", "Close the valv")], "b": [("user", Q_EN), ("assistant", "Close the valve now.")], "c": [("user", Q_EN), ("assistant", "No")], "d": [("user", Q_EN), ("assistant", "Nothing is wrong.")], "e": [("user", Q_EN), ("assistant", "There is no leak.")]}
    got = {tuple(r) for r in pairs.defects(turns(spark, recs)).collect()}
    assert ("a", 1, "truncated") in got and not {i for i, _, _ in got} & {"b", "d", "e"}


def test_echo_of_a_repeated_question():
    q = T.words(Q_EN)
    assert pairs.is_echo(q, q + q) and pairs.is_echo(q, q + q + q[:3]) and not pairs.is_echo(q, q + T.words(GOOD))


def test_first_sentence_with_commas_is_not_stripped():
    plain = "the tensile specimen ran after lunch and the crew then checked every second joint of the long frame before they " * 3
    cut = [
        "Check the tensile specimen for a missing pulse; the usual culprit is that no one looked at the sensor of the no",
        "Limit power loss, and then shorten the settling time of the whole axis by treating this part as a load cel",
        "On day 49, compare the value of the first probe at station two with 31.5 lux at",
        plain + "and the",
    ]
    whole = [plain + "work ended", plain + "seal leakage sets in", "Step 5: " + plain + "work ended"]
    assert [s for s in cut if not cuts.stop_kind(s)] == [] and [s for s in whole if cuts.stop_kind(s)] == []


def test_mix_draws_an_offset_for_each_source(spark):
    s = spark.createDataFrame([(x,) for x in ("a", "b", "c", "d")], "source string")
    one, two = ([r[0] for r in s.select(mix.source_offset(F.col("source"), seed)).collect()] for seed in (1, 2))
    assert all(0 <= x < 1 for x in one) and len(set(one)) == 4 and one != two


def test_mix_of_documents_of_one_size(spark):
    """A source whose documents all have one size is divided into bins; the prefix sums run on across them."""
    s = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"), F.lit(10).cast("long").alias("tokens"))
    rate = spark.createDataFrame([("a", 1.0, 4.0, 30000, 0.7)], "source string, target_share double, max_repeats double, available long, rate double")
    got = mix.mix(s, rate, rows=40 * mix.CELL).collect()
    assert abs(sum(x.copies for x in got) - 2100) <= 1 and {x.copies for x in got} == {1}


def test_near_groups_are_made_of_members(spark, tmp_path):
    from curata.llm import queries

    w = [f"w{k}" for k in range(60)]
    edit = lambda k: " ".join(x if i != k else "zz" for i, x in enumerate(w))
    recs = {"a": [("user", " ".join(w))], "b": [("user", edit(30))], "c": [("user", edit(31).upper())], "d": [("user", edit(31))], "x": [("user", " ".join(f"v{k}" for k in range(40)))]}
    turns(spark, recs).write.parquet(f"{tmp_path}/messages.parquet")
    assert {tuple(r) for r in queries.p6_members(spark, str(tmp_path)).collect()} == {("a", i) for i in "abcd"}
    assert [r.record_ids for r in queries.p6_groups(spark, str(tmp_path)).collect()] == [["a", "b", "c", "d"]]
    assert {tuple(r) for r in queries.p6_found(spark, str(tmp_path)).collect()} == {("a", "b"), ("a", "c"), ("a", "d"), ("b", "c"), ("b", "d")}


def test_copies_with_several_spellings_of_a_turn(spark):
    """A kept record that has one turn in two spellings is compared with both."""
    rows = [("k", 0, "user", "One two.", None, None, None, "r"), ("K ", 0, "user", "one TWO", None, None, None, "r"), ("m", 0, "user", "one... two", None, None, None, "r"), ("n", 0, "user", '{"a": 1, "b": "X y"}', None, None, None, "r"), ("o", 0, "user", '{"b":"x Y","a":1}', None, None, None, "r"), ("p", 0, "user", '{"b":"x Y","a":2}', None, None, None, "r")]
    assert {tuple(r) for r in copies.copies(table(spark, rows, MESSAGES)).collect()} == {("k", "m"), ("n", "o")}
