"""Hot and null keys, contraction by stars, one-pass search, ordinals, seals, templates and exact arithmetic."""

import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from curata.functions import udfs
from curata.operators import families, graph, reports, retrieval, sampling, template
from curata.runtime import HotKeys, Stage, lookup

BPE = "/opt/tokenizers/byte_bpe_50k.json"


def test_null_and_hot_keys_are_spread(spark):
    """No task gets more than about its share of 90 % null keys and a key that a third of the rest have."""
    rows = 40_000
    key = F.when(F.col("id") % 10 < 9, None).when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id"))
    left = Stage(spark.range(rows).select(key.alias("k"), F.col("id").alias("x")), "left")
    right = spark.range(rows).select(F.col("id").alias("k"), (F.col("id") * 2).alias("y"))
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        j = lookup(left.df, right, "k", "left", hot=500, rows=left.rows)
        sizes = [r.n for r in j.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
        got = {tuple(r) for r in j.filter("k is not null").select("k", "x", "y").collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(sizes) == rows and max(sizes) < rows / 4 * 1.5
    assert got == {tuple(r) for r in left.df.join(right, "k").select("k", "x", "y").collect()}


def test_small_tables_are_not_counted(spark):
    assert HotKeys(spark.range(5), "id", 10, 5).heavy is None


def test_stage_measures_what_it_writes(spark):
    s = Stage(spark.range(10), "x", most=F.max("id"))
    e = Stage(spark.range(10).filter("id < 0").groupBy("id").count(), "x", most=F.max("id"))
    assert (s.rows, s.seen, e.rows, e.seen) == (10, {"most": 9}, 0, {"most": None})


@pytest.mark.parametrize("bound", [0, 1 << 20])
def test_contraction_with_either_core(spark, bound):
    r = random.Random(5)
    es = [(r.randrange(60), r.randrange(60)) for _ in range(90)] + [(100 + i, 101 + i) for i in range(50)] + [(200, 201 + i) for i in range(25)] + [(300 + i, 300 + (i + 1) % 7) for i in range(7)] + [(400, 401)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in es:
        if a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    got = {x.v: x.root for x in graph.contract_components(spark.createDataFrame(es, "a long, b long"), hot=10, bound=bound).collect()}
    assert got == {x: root(x) for x in parent}


def test_named_components(spark):
    e = spark.createDataFrame([("b", "a"), ("b", "c"), ("x", "x"), ("y", "z")], "a string, b string")
    assert {tuple(r) for r in families.components(e).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "y"), ("z", "y")}


def test_assembled_edges(spark):
    t = spark.createDataFrame([(1, "f"), (2, "f"), (3, None)], "id long, family string")
    lex = spark.createDataFrame([("2", "1"), ("1", "2"), ("3", "3"), (None, "1")], "a string, b string")
    got = {tuple(r) for r in families.assembled(("SOURCE", families.source_edges(t, "id", "family")), ("LEXICAL", lex)).collect()}
    assert got == {("1", "source f", "SOURCE"), ("2", "source f", "SOURCE"), ("1", "2", "LEXICAL")}


def test_search_of_texts_equals_search_of_postings(spark):
    r = random.Random(3)
    words = ["the", "pump", "valve", "motor", "load", "gear", "cable", "belt", "fuse", "rpm"]
    docs = spark.createDataFrame([(i, " ".join(r.choice(words) for _ in range(r.randrange(0, 30)))) for i in range(200)] + [(900, None), (901, "")], "id long, text string")
    asked = spark.createDataFrame([(i, " ".join(r.choice(words) for _ in range(3))) for i in range(20)] + [(50, "absent"), (51, None), (52, "x" * 2001)], "query_id long, query string")
    post, n = retrieval.postings(docs.filter("text is not null"), "id")
    kept = docs.filter("text is not null")
    a = {(x.query_id, x.id, round(x.score, 6), x["rank"]) for x in retrieval.search(post, n, asked, 3).collect()}
    b = {(x.query_id, x.id, round(x.score, 6), x["rank"]) for x in retrieval.search_texts(kept, asked, 3).collect()}
    assert a == b and len(a) == 60
    assert retrieval.search_texts(docs.limit(0), asked, 3).collect() == []
    assert len(retrieval.search_texts(docs, asked, 3).collect()) == 60


@pytest.mark.parametrize("parts", [1, 5])
def test_ordinals_span_partitions(spark, parts):
    d = spark.range(500).select(F.when(F.col("id") % 10 < 7, "big").when(F.col("id") % 10 < 9, "small").alias("g"), (F.col("id") * 7919 % 503).alias("o"))
    got = {(r.g, r.o): r.ordinal for r in sampling.ordinals(d, "g", ["o"], parts).collect()}
    want = {}
    for g in ("big", "small", None):
        for i, (_, o) in enumerate(sorted((k for k in got if k[0] == g), key=lambda k: k[1])):
            want[(g, o)] = i
    assert len(got) == 500 and got == want


def test_seal_is_of_the_rows_alone(spark):
    d = spark.range(300).select("id", F.concat(F.lit("t"), "id").alias("t"))
    seal = lambda x: tuple(reports.seal(x, "id", F.col("t")).first())
    assert seal(d) == seal(d.repartition(7).orderBy(F.desc("id"))) != seal(d.withColumn("t", F.when(F.col("id") == 5, "x").otherwise(F.col("t"))))
    assert seal(d) != seal(d.union(d.limit(1))) and seal(d.limit(0))[0] == 0


def conversation(*turns):
    return [{"role": r, "content": c} for r, c in turns]


def test_chat_template(spark):
    rows = [
        (1, conversation(("system", "Be short."), ("user", "Why does it hum?"), ("assistant", "The clamp is loose.")), None), (2, conversation(("user", "Hi"), ("user", "Hi")), "INVALID_TURN_ORDER"), (3, conversation(("user", "Hi"), ("assistant", " ")), "INVALID_MESSAGE"),
        (4, conversation(("user", "Hi"), ("assistant", "<|x|>")), "EMBEDDED_CONTROL"), (5, conversation(("user", "Hi")), "MISSING_ANSWER"), (6, [], "INVALID_MESSAGE"), (7, conversation(("user", "Hi"), ("system", "late"), ("assistant", "x")), "INVALID_TURN_ORDER"),
        (8, conversation(("user", "Pumpe größer?"), ("assistant", "Ja, größer."), ("user", "Sure?"), ("assistant", "日本 ok")), None),
    ]
    d = spark.createDataFrame(rows, "id int, msgs array<struct<role string, content string>>, want string")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    for r in d.select("id", "msgs", "want", template.chat_template(F.col("msgs"), BPE).alias("e")).collect():
        assert r.e.code == r.want
        if r.want is None:
            said = [x.content for x in r.msgs if x.role == "assistant"]
            size = t.get_vocab_size()
            groups, now = [], []
            for i, lab in zip(r.e.input_ids, r.e.labels):
                assert lab in (i, template.IGNORE)
                if lab == size + 1:  # the closing mark ends each answer
                    groups.append(t.decode(now))
                    now = []
                elif lab != template.IGNORE:
                    now.append(lab)
            assert groups == said and not now


def test_targets_refuse_what_the_mask_cannot_hold():
    assert template.targets([(0, 3), (3, 6)], [1, 2], [(2, 6)], 2) == ([], "TOKEN_CROSSES_BOUNDARY")
    assert template.targets([(0, 3)], [1], [], 2) == ([], "EMPTY_TARGET")
    assert template.targets([(0, 3), (3, 6)], [1, 5], [(3, 6)], 2) == ([], "END_NOT_SUPERVISED")
    assert template.targets([(0, 3), (3, 5), (5, 6)], [1, 5, 2], [(3, 6)], 2) == ([template.IGNORE, 5, 2], None)


def test_tokenizer_contract():
    print_ = template.tokenizer_contract(BPE, {"<|endoftext|>": 50256}, 50257)
    assert template.tokenizer_contract(BPE, fingerprint=print_) == print_
    for bad in ({"special": {"<|endoftext|>": 0}}, {"size": 1}, {"fingerprint": "0" * 64}):
        with pytest.raises(ValueError):
            template.tokenizer_contract(BPE, **bad)


@pytest.mark.parametrize(
    ("text", "value"),
    [("1+2*3", 7), ("-2^2", -4), ("2^-1", Fraction(1, 2)), ("2^3^2", 512), ("(1+2)*3", 9), ("1/0", None), ("2**13", None), ("01+1", None), ("1 2", None), ("2--3", 5), ("", None), ("(1", None), ("1)", None), ("1//2", None), ("()", None), ("5*(2+)", None), ("9" * 33, None), ("1+" * 60 + "1", None), ("-(3-5)", 2)],
)
def test_exact_values(text, value):
    assert udfs.exact_value(text) == value
