"""Citation slices, postings and BM25 search."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from curata.operators.guards import rule, union
from curata.runtime import Stage

K1, B, FLOOR = 1.2, 0.75, 1e-6  # defaults of the usual full-text engines
TERM = r"[\p{L}\p{N}]+"
QUERY_TERM = r"[A-Za-z_][A-Za-z_0-9]*"


def line_slice(text: Column, start: Column, stop: Column) -> Column:
    """Lines ``start`` to ``stop`` of a text, counted from one, with their ends."""
    return F.array_join(F.slice(F.split(text, r"(?<=\n)"), start, stop - start + 1), "")


def terms(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(TERM), F.lit(0))


def query_terms(c: Column) -> Column:
    """Distinct terms of a query; null for queries over 2,000 characters."""
    return F.when(F.length(c) <= 2000, F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(QUERY_TERM), F.lit(0))))


def postings(chunks: DataFrame, key: str = "id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """``(term, id, tf)`` and ``(id, dl)``; only terms and counts are shuffled."""
    t = chunks.select(F.col(key).alias("id"), F.explode(terms(F.col(text))).alias("term"))
    return t.groupBy("term", "id").agg(F.count(F.lit(1)).alias("tf")), chunks.select(F.col(key).alias("id"), F.size(terms(F.col(text))).alias("dl"))


def search(post: DataFrame, lengths: DataFrame, queries: DataFrame, k: int = 3) -> DataFrame:
    """``(query_id, id, score, rank)``: the ``k`` best chunks of each query by BM25, ties by id.

    ``queries`` has ``query_id`` and ``query``; any term is enough. Only postings
    of asked terms are joined; scores are partial sums before they are ranked.
    """
    if not 1 <= k <= 10:
        raise ValueError("k must be 1 to 10")
    q = queries.select("query_id", F.explode(query_terms(F.col("query"))).alias("term")).distinct()
    n, avg = lengths.agg(F.count(F.lit(1)), F.avg("dl")).first()
    df = post.join(q.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = df.select("term", F.greatest(F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(FLOOR)).alias("idf"))
    hit = post.join(q.join(idf, "term"), "term").join(lengths, "id")
    s = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(avg)))
    scores = hit.groupBy("query_id", "id").agg(F.round(F.sum(s), 9).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


QUERIES = 20_000  # queries that are broadcast at a time, at most 2,000 characters each
PART = 256  # queries that are scored together


def _score(block, n: int, avg: float, k: int, dtype):
    """Scores batches of texts against a block of queries and keeps the ``k`` best texts of each query of a task."""

    def run(batches):
        import regex

        find = regex.compile(TERM).findall
        names, index, weight, parts = block.value
        best: list[list] = [[] for _ in names]
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            row, col, tf, dl = [], [], [], []
            for i, t in enumerate(texts):
                ws = find((t or "").lower())
                dl.append(len(ws))
                for w, c in Counter(w for w in ws if w in index).items():
                    row.append(i)
                    col.append(index[w])
                    tf.append(c)
            if not row:
                continue
            row, col, tf = np.array(row), np.array(col), np.array(tf, float)
            x = weight[col] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * np.array(dl)[row] / avg))
            for first, terms_, has in parts:
                at = np.searchsorted(terms_, col)
                at[at == len(terms_)] = 0
                ok = terms_[at] == col
                w = np.zeros((len(ids), len(terms_)))
                w[row[ok], at[ok]] = x[ok]
                s = np.round(w @ has, 9)
                floor = np.array([q[-1][0] * -1 if len(q := best[first + j]) == k else 0.0 for j in range(has.shape[1])])
                for i, j in zip(*np.nonzero((s > 0) & (s >= floor))):
                    q = best[first + j]
                    q.append((-s[i, j], ids[i]))
                    if len(q) > 4 * k:
                        q.sort()
                        del q[k:]
                for j in range(has.shape[1]):
                    best[first + j].sort()
                    del best[first + j][k:]
        out = [(names[j], i, -s) for j, q in enumerate(best) for s, i in q]
        if out:
            a, i, s = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(a, dtype[0]), pa.array(i, dtype[1]), pa.array(s, pa.float64())], ["query_id", "id", "score"])

    return run


def search_texts(chunks: DataFrame, queries: DataFrame, k: int = 3, key: str = "id", text: str = "text") -> DataFrame:
    """``(query_id, id, score, rank)`` as :func:`search`, straight from the texts.

    A frequent term joins nearly every text with every query that has it, so no
    join is made of that: blocks of ``QUERIES`` queries are broadcast, each text
    is scored against a block in one pass, a task keeps the ``k`` best of each
    query, and only those are shuffled. Document frequencies of the asked terms
    come from a pass of their own.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    if not 1 <= k <= 10:
        raise ValueError("k must be 1 to 10")
    spark = chunks.sparkSession
    c = chunks.select(F.col(key).alias("id"), F.col(text).alias("text"))
    q = Stage(queries.select("query_id", query_terms(F.col("query")).alias("terms")).filter(F.size("terms") > 0).groupBy("query_id").agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms")), "queries")
    t = c.select(terms(F.col("text")).alias("t"))
    n, total = t.agg(F.count(F.lit(1)), F.sum(F.size("t"))).first()
    asked = q.df.select(F.explode("terms").alias("term")).distinct()
    df = Stage(t.select(F.explode(F.array_distinct("t")).alias("term")).join(asked, "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df")), "df")
    idf = df.df.select("term", F.greatest(F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(FLOOR)).alias("idf"))
    dtype = to_arrow_type(q.df.schema["query_id"].dataType), to_arrow_type(c.schema["id"].dataType)
    types = dict(q.df.dtypes)["query_id"], dict(c.dtypes)["id"]
    blocks = -(-q.rows // QUERIES) or 1
    found = None
    for i in range(blocks):
        own = q.df.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)
        # at most about QUERIES rows of 2,000 characters, and their terms
        rows = [(r.query_id, r.terms) for r in own.orderBy("query_id").collect()]
        weight = {r.term: r.idf for r in own.select(F.explode("terms").alias("term")).distinct().join(idf, "term").collect()}
        index = {w: j for j, w in enumerate(weight)}
        parts = []
        for first in range(0, len(rows), PART):
            some = [[index[w] for w in ts if w in index] for _, ts in rows[first : first + PART]]
            known = np.unique(np.array([x for ts in some for x in ts], np.int64))
            has = np.zeros((len(known), len(some)))
            for j, ts in enumerate(some):
                has[np.searchsorted(known, ts), j] = 1.0
            if len(known):
                parts.append((first, known, has))
        block = spark.sparkContext.broadcast(([r[0] for r in rows], index, np.array(list(weight.values())), parts))
        got = c.mapInArrow(_score(block, n, (total or 0) / n if n else 0.0, k, dtype), f"query_id {types[0]}, id {types[1]}, score double")
        found = got if found is None else found.union(got)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def index_violations(chunks: DataFrame, sealed_families: DataFrame) -> DataFrame:
    """Gates of an index over ``(id, family_id, text, quality_state, rights_disposition, slice_sha256)``."""
    no = lambda c: ~F.coalesce(c, F.lit(False))
    return union(
        [
            rule("DUPLICATE_ID", chunks.groupBy("id").count().filter("count > 1"), F.col("id")),
            rule("NOT_APPROVED", chunks.filter(no(F.col("quality_state") == "APPROVED")), F.col("id")),
            rule("RIGHTS_NOT_APPROVED", chunks.filter(no(F.col("rights_disposition") == "APPROVED")), F.col("id")),
            rule("SEALED_FAMILY", chunks.join(sealed_families.select("family_id").distinct(), "family_id", "left_semi"), F.col("id")),
            rule("SLICE_CHANGED", chunks.filter(no(F.sha2("text", 256) == F.col("slice_sha256"))), F.col("id")),
        ]
    )


def regression(results: DataFrame, expected: DataFrame, k: int = 3) -> DataFrame:
    """``(query_id, hit)``: whether the expected chunk is among the first ``k``; every query is kept."""
    got = results.filter(F.col("rank") <= k).select("query_id", F.col("id").alias("expected"), F.lit(True).alias("_h"))
    return expected.join(got, ["query_id", "expected"], "left").groupBy("query_id").agg(F.max(F.coalesce("_h", F.lit(False))).alias("hit"))


def recall(results: DataFrame, relevant: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """Recall at each k over queries that have relevant chunks ``(query_id, id)``."""
    j = relevant.distinct().join(results.select("query_id", "id", "rank"), ["query_id", "id"], "left")
    per = j.groupBy("query_id").agg(*[F.avg(F.coalesce((F.col("rank") <= k).cast("double"), F.lit(0.0))).alias(f"r{k}") for k in ks])
    return per.agg(F.count(F.lit(1)).alias("n_queries"), *[F.avg(f"r{k}").alias(f"recall_at_{k}") for k in ks])


def result_violations(results: DataFrame, chunks: DataFrame, pins: DataFrame, sealed_families: DataFrame) -> DataFrame:
    """Retrieved chunks verified again: known, unchanged since they were pinned, outside sealed families.

    ``results`` has ``id``, ``chunks`` is ``(id, family_id, text)``, ``pins`` is
    ``(id, slice_sha256)``; each distinct id is looked at once.
    """
    r = results.select("id").filter("id is not null").distinct()
    j = r.join(chunks.select("id", "family_id", F.sha2("text", 256).alias("_have"), F.lit(True).alias("_there")), "id", "left").join(pins.select("id", "slice_sha256"), "id", "left")
    return union(
        [
            rule("UNKNOWN_CHUNK", j.filter("_there is null"), F.col("id")),
            rule("NOT_PINNED", j.filter("_there is not null and slice_sha256 is null"), F.col("id")),
            rule("SLICE_CHANGED", j.filter("_have <> slice_sha256"), F.col("id")),
            rule("SEALED_FAMILY", j.join(sealed_families.select("family_id").distinct(), "family_id", "left_semi"), F.col("id"), F.col("family_id")),
        ]
    )


def result_rates(results: DataFrame, queries: DataFrame, content: DataFrame) -> DataFrame:
    """``(n_queries, empty_rate, duplicate_rate)``: queries without a hit, and hits whose text an earlier hit of the query has.

    ``results`` is ``(query_id, id, rank)``, ``content`` is ``(id, digest)``.
    """
    per = results.join(content, "id").groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("digest").alias("d"))
    j = queries.select("query_id").distinct().join(per, "query_id", "left")
    return j.agg(F.count(F.lit(1)).alias("n_queries"), F.round(F.avg(F.col("n").isNull().cast("double")), 6).alias("empty_rate"), F.round(F.coalesce(F.try_divide(F.sum(F.col("n") - F.col("d")).cast("double"), F.sum("n")), F.lit(0.0)), 6).alias("duplicate_rate"))
