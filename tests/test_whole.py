"""Queries that must do the whole job: results that a reduced one misses."""

import hashlib

from curata.operators import kernels
from curata.plans import corpus, numbers, relations
from test_core import union_find

KINDS = ["EXACT_PROMPT", "LEXICAL_NEAR_COPY_CONSERVATIVE_BIND", "PROMPT_CONTAINED_IN_SOURCE", "NUMERIC_TEMPLATE_UNCERTAIN"]


def save(spark, at, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{at}/{name}.parquet")


def test_families_bind_edges_of_every_kind(spark, tmp_path):
    pairs = [(f"n{i:02}", f"n{i + 1:02}") for i in range(12) if i % 5 != 4]
    save(spark, tmp_path, "edges", [(f" {a.upper()}", b, KINDS[i % 4]) for i, (a, b) in enumerate(pairs)], "anchor string, other string, kind string")
    save(spark, tmp_path, "families", [(x, "test" if x == "n03" else "train") for p in pairs for x in p], "id string, split string")
    want = union_find(pairs)
    assert {r.id: r.root for r in relations.g01(spark, str(tmp_path)).collect()} == want
    sizes = {x: list(want.values()).count(x) for x in want.values()}
    named = {"family-" + hashlib.sha256(x.encode()).hexdigest()[:24]: n for x, n in sizes.items()}
    assert {r.family: r.n for r in relations.g03(spark, str(tmp_path)).collect()} == named
    assert [tuple(r) for r in relations.g06(spark, str(tmp_path)).collect()] == [("n00", 5)]


def test_bootstrap_draws_all_resamples(spark, tmp_path, monkeypatch):
    rows = [(f"s{i % 2}", i % 20, float(i % 7)) for i in range(200)]
    save(spark, tmp_path, "events", rows, "event_type string, user_id int, value double")
    full = kernels.bootstrap(spark.createDataFrame(rows, "st string, cl int, v double"), "st", "cl", "v", resamples=10_000).first()
    got = numbers.n04(spark, str(tmp_path)).first()
    assert all(abs(a - b) < 1e-9 for a, b in zip(got, full))
    monkeypatch.setattr(kernels, "BLOCK", 10_000)
    whole = numbers.n04(spark, str(tmp_path)).first()
    assert all(abs(a - b) < 1e-9 for a, b in zip(got, whole))


def test_paired_bootstrap(spark):
    t = spark.createDataFrame([("s", i % 20, float(i), float(i) + 2) for i in range(200)] + [("s", 1, None, 9.0)], "s string, c int, base double, adapter double")
    b = kernels.paired_bootstrap(t, "s", "c", "base", "adapter", resamples=300).first()
    assert all(abs(x - 2) < 1e-9 for x in b)


def test_queries_over_the_limit_are_refused(spark, tmp_path):
    rows = [(100, "valve " * 400 + "\nend."), (200, "pump station\nend."), (201, "gear box\nend.")]
    save(spark, tmp_path, "documents", rows, "doc_id long, text string")
    assert {r.query_id: r.hit for r in corpus.r05(spark, str(tmp_path)).collect()} == {100: False, 200: True}
    assert tuple(corpus.n03(spark, str(tmp_path)).first()) == (2, 0.5, 0.5, 0.5)
