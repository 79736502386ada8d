"""Evaluation texts leaking into training text (problem 7)."""

from __future__ import annotations

import html
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curata.functions import text as T
from curata.llm.near import _hashes, word_hashes
from curata.runtime import Stage

WINDOW = 8  # words of a passage
WORDS = 7  # of them, those that intact runs of three must cover where no word was replaced
INTACT = 3  # runs of three that are left of a window's six when one word was replaced
DRIFT = 6  # words that edits inside a passage may add or drop
SHARED = 0.25  # a sentence with a run of five words that so many items have is a shared one
BLOCK_WORDS = 2_000_000  # words of items that are broadcast at a time (about 200 MB of index)

_TAG = re.compile(r"<[^<>]{1,80}>")
_HIDDEN = re.compile("[­​-‏⁠﻿]")
_BREAK = re.compile(r"[\s‒-―|]+")
_MARKS = re.compile(r"[^\w\s]+|_+")


def passage_words(s: str) -> list[str]:
    """Words parted by white space and dashes, folded, without markup and punctuation: 3.5 and m/s are one word each."""
    s = _HIDDEN.sub("", _TAG.sub(" ", html.unescape(s) if "&" in s else s))
    return _MARKS.sub("", _BREAK.sub(" ", T.fold(s))).split()


def _texts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Row of each word and its hash, of texts that are words between single spaces."""
    raw = [s.encode() for s in texts]
    off = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
    return word_hashes(np.frombuffer(b"".join(raw), np.uint8), off)


def _fives(batches):
    for b in batches:
        out = {"task_id": [], "h": []}
        for k, s in zip(b.column("task_id").to_pylist(), b.column("sentence").to_pylist()):
            w = passage_words(s)
            got = {zlib.crc32(" ".join(w[i : i + 5]).encode()) for i in range(len(w) - 4)}
            out["task_id"] += [k] * len(got)
            out["h"] += list(got)
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("task_id", pa.string()), ("h", pa.int64())]))


def own_text(tasks: DataFrame) -> DataFrame:
    """``(task_id, sentences)``: each item's prompt without the sentences that at least a quarter of the items share.

    A sentence counts as shared if it has a run of five words that ``SHARED`` of
    all items, and more than two, have; there can be only a few such runs, as
    each takes up five words of a quarter of the items.
    """
    parts = F.split(F.col("prompt"), r"(?<=[.!?])\s+")
    s = tasks.select(F.col("task_id").cast("string").alias("task_id"), F.posexplode(parts).alias("at", "sentence")).filter("task_id is not null").distinct()
    runs = s.select("task_id", "sentence").mapInArrow(_fives, "task_id string, h long").distinct()
    n = tasks.select("task_id").distinct().count()
    shared = [r.h for r in runs.groupBy("h").count().filter(F.col("count") >= max(3, SHARED * n)).select("h").collect()]
    bad = np.array(sorted(shared), np.int64)

    def keep(batches):
        for b in batches:
            ok = []
            for x in b.column("sentence").to_pylist():
                w = passage_words(x)
                ok.append(not any(zlib.crc32(" ".join(w[i : i + 5]).encode()) in known for i in range(len(w) - 4)))
            yield b.filter(pa.array(ok, pa.bool_()))

    known = set(bad.tolist())
    kept = s.mapInArrow(keep, s.schema)
    return kept.groupBy("task_id").agg(F.sort_array(F.collect_list(F.struct("at", "sentence"))).alias("s")).select("task_id", F.concat_ws(" ", F.col("s.sentence")).alias("sentences"))


def _normal(batches):
    for b in batches:
        got = [" ".join(passage_words(s)) for s in b.column("sentences").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("task_id"), pa.array(got, pa.string())], ["task_id", "words"])


def _grams(batches):
    """Hash of each run of three to ``WINDOW`` words of each item, with its place."""
    schema = pa.schema([("item", pa.string()), ("n", pa.int32()), ("at", pa.int32()), ("h", pa.int64())])
    for b in batches:
        for k, s in zip(b.column("item").to_pylist(), b.column("words").to_pylist()):
            h = _texts([s])[1]
            g = _hashes(h) if len(h) > 2 else h[:0]
            for n in range(3, WINDOW + 1):
                if len(h) < n:
                    break
                if n > 3:
                    g = (g[: len(h) - n + 1] * np.uint64(0x9E3779B97F4A7C15)) ^ (h[n - 1 :] + (g[: len(h) - n + 1] >> np.uint64(29)))
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(g), pa.string()), pa.array(np.full(len(g), n, np.int32)), pa.array(np.arange(len(g), dtype=np.int32)), pa.array(g.view(np.int64))], schema=schema)


def prefix_places(df: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which runs of an item must be looked up: in each window the rarest n - ``INTACT`` + 1 of its n runs.

    Whatever ``INTACT`` runs of a window a text has, one of them is among these.
    """
    keep = np.zeros(len(h), bool)
    per = min(len(h), WINDOW - 2)
    if not per:
        return keep
    order = np.empty(len(h), np.int64)
    order[np.lexsort((h, df))] = np.arange(len(h))
    windows = np.lib.stride_tricks.sliding_window_view(order, per)
    first = np.argsort(windows, axis=1)[:, : max(1, per - INTACT + 1)]
    keep[(first + np.arange(len(windows))[:, None]).ravel()] = True
    return keep


def _aligned(item: list[str], doc: list[str], p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """State of each word of the item: 2 if an intact run covers it, 1 if it stands beside a replaced, added or dropped word."""
    state = np.zeros(len(item), np.int8)
    state[np.minimum((q[:, None] + np.arange(3)).ravel(), len(item) - 1)] = 2
    at = dict(zip(q.tolist(), p.tolist()))
    ends = [(j + 3, at[j] + 3, 1) for j in at if j + 1 not in at] + [(j - 1, at[j] - 1, -1) for j in at if j - 1 not in at]
    for j, i, step in ends:
        # one edit beyond the end of a stretch, then words that agree again
        for dj, di in ((1, 1), (0, 1), (1, 0)):
            x, y, n = j + dj * step, i + di * step, 0
            while 0 <= x < len(item) and 0 <= y < len(doc) and item[x] == doc[y]:
                x, y, n = x + step, y + step, n + 1
            if n:
                lo, hi = min(j, x - step), max(j, x - step)
                state[max(lo, 0) : hi + 1] = np.maximum(state[max(lo, 0) : hi + 1], 1)
                break
    return state


def _longest(mask: np.ndarray) -> int:
    """Length of the longest stretch of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return int((edge[1::2] - edge[::2]).max(initial=0))


def carried(item: list[str], own: np.ndarray, doc: list[str], p: np.ndarray, q: np.ndarray) -> bool:
    """Whether runs of ``item`` at ``q`` that are in ``doc`` at ``p`` make up the item or a passage of it.

    ``own`` is, for each place of the item, the length of the shortest run from
    there that no other item has. The runs are taken along one diagonal, in a
    window of the item's size. A passage has ``WORDS`` words covered by intact
    runs, or ``WINDOW`` in succession of which one stretch of edits may be part,
    and in it an intact run that no other item has; the whole item, word by word
    and six words or more, needs none.
    """
    for d in np.unique(p - q):
        near = np.abs((p - q) - d) <= DRIFT
        first = p[(p - q) == d][0]
        near &= np.abs(p - first) <= len(item) + DRIFT
        # of several places for a run, the one nearest to the diagonal
        o = np.lexsort((np.abs((p - q) - d)[near], q[near]))
        qn, pn = q[near][o], p[near][o]
        one = np.concatenate([[True], qn[1:] != qn[:-1]])
        qn, pn = qn[one], pn[one]
        if len(qn) < INTACT and len(qn) < len(item) - 2:
            continue
        state = _aligned(item, doc, pn, qn)
        intact = state == 2
        if len(item) >= 6 and intact.all():
            return True
        if intact.sum() < WORDS and _longest(state > 0) < WINDOW:
            continue
        # length of the intact stretch, in item and text alike, that begins at each place
        together = np.zeros(len(item) + 1, np.int64)
        go = dict(zip(qn.tolist(), pn.tolist()))
        for j in sorted(go, reverse=True):
            together[j] = together[j + 1] + 1 if go.get(j + 1) == go[j] + 1 else 3
        if (together[: len(own)] >= own).any():
            return True
    return False


def _find(index):
    def run(batches):
        runs, item, place, start, words, own, names = index.value
        for b in batches:
            ids, texts = b.column("doc_id"), [" ".join(passage_words(s)) for s in b.column("text").to_pylist()]
            row, w = _texts(texts)
            if len(w) < 3 or not len(runs):
                continue
            h = _hashes(w).view(np.int64)
            at = np.minimum(np.searchsorted(runs, h), len(runs) - 1)
            hit = np.flatnonzero((row[:-2] == row[2:]) & (runs[at] == h))
            # every place of the item index that each run of a text has
            lo, hi = start[at[hit]], start[at[hit] + 1]
            n = hi - lo
            p = np.repeat(hit, n)
            k = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            pair = row[p].astype(np.int64) * len(names) + item[k]
            # prefix join: a pair needs a run of some window's prefix, and INTACT runs in all (or a short item)
            keys, code = np.unique(pair, return_inverse=True)
            enough = (np.bincount(code) >= np.minimum(INTACT, np.array([len(words[x % len(names)]) - 2 for x in keys]))) if len(keys) else np.zeros(0, bool)
            enough &= np.bincount(code, weights=place[k] < 0, minlength=len(keys)) > 0
            base = np.searchsorted(row, np.arange(len(texts)))
            o = np.argsort(code, kind="stable")
            ends = np.searchsorted(code[o], np.arange(len(keys) + 1))
            out_d, out_t, split = [], [], {}
            for c in np.flatnonzero(enough):
                r, it = divmod(int(keys[c]), len(names))
                sel = o[ends[c] : ends[c + 1]]
                if r not in split:
                    split = {r: texts[r].split()}
                q = np.where(place[k[sel]] < 0, ~place[k[sel]], place[k[sel]])
                if carried(words[it], own[it], split[r], p[sel] - base[r], q):
                    out_d.append(r)
                    out_t.append(names[it])
            if out_d:
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(out_d)), pa.array(out_t, pa.string())], ["doc_id", "item"])

    return run


def _index(pdf, grams):
    """The arrays of one block of items: runs in order with their places (complemented where they are of a prefix), words, own lengths."""
    names = pdf["item"].tolist()
    words = [s.split() for s in pdf["words"]]
    code = {k: i for i, k in enumerate(names)}
    who = grams["item"].map(code).to_numpy(np.int64)
    at, h, df, n = (grams[c].to_numpy(np.int64) for c in ("at", "h", "df", "n"))
    own = [np.full(max(len(w) - 2, 0), 1 << 30, np.int64) for w in words]
    single = np.flatnonzero(df == 1)
    for i in single[np.argsort(-n[single], kind="stable")]:
        own[who[i]][at[i]] = n[i]
    three = np.flatnonzero(n == 3)
    o = three[np.lexsort((at[three], who[three]))]
    who3, at3, h3, df3 = who[o], at[o].copy(), h[o], df[o]
    ends = np.searchsorted(who3, np.arange(len(names) + 1))
    for a, b in zip(ends[:-1], ends[1:]):
        must = prefix_places(df3[a:b], h3[a:b])
        at3[a:b][must] = ~at3[a:b][must]
    o = np.argsort(h3, kind="stable")
    runs, first = np.unique(h3[o], return_index=True)
    return runs, who3[o], at3[o], np.append(first, len(o)), words, own, names


def leaks(docs: DataFrame, tasks: DataFrame) -> DataFrame:
    """``(doc_id, task_id)``: the items of ``tasks`` whose prompt, or a passage of it, is in a text of ``docs``.

    A prefix-filtered set join over runs of three words. Runs are ordered by the
    number of items that have them, rarest first; of each window of ``WINDOW``
    words of an item the rarest n - ``INTACT`` + 1 runs must hold one of the
    ``INTACT`` that an edited copy still has, and those are joined first. Pairs
    with enough runs then go through the bounds on place and length and are
    compared word by word over windows of the item's size (:func:`carried`).
    Folding removes case, wrapping, spacing, markup and compatibility forms;
    sentences that many items share (the closing one) count for none. Items with
    one text are one item to the join and all come out.

    Texts are read whole and once for each block of items of about
    ``BLOCK_WORDS`` words, which bounds what is broadcast (a block that comes out
    twice as large is divided again); no row of ``docs`` is shuffled before the
    result. Null texts and prompts have no passage; repeated rows count once.
    """
    spark = docs.sparkSession
    named = Stage(own_text(tasks).mapInArrow(_normal, "task_id string, words string").filter("words <> ''").withColumn("item", F.md5("words")), "items")
    items = Stage(named.df.select("item", "words").distinct().withColumn("size", F.size(F.split("words", " "))), "items", words=F.sum(F.size(F.split("words", " "))))
    grams = Stage(items.df.select("item", "words").mapInArrow(_grams, "item string, n int, at int, h long"), "grams")
    df = grams.df.groupBy("n", "h").agg(F.count_distinct("item").alias("df"))
    # longer runs matter only where no other item has them
    full = Stage(grams.df.join(df, ["n", "h"]).filter("n = 3 or df = 1"), "runs")
    grams.drop()
    blocks = max(1, -(-(items.seen["words"] or 0) // BLOCK_WORDS))
    block = lambda n: F.pmod(F.xxhash64("item"), F.lit(n))
    while items.df.groupBy(block(blocks)).agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n")).filter((F.col("s") > 2 * BLOCK_WORDS) & (F.col("n") > 1)).head(1):
        blocks *= 2
    out = None
    for k in range(blocks):
        pdf = items.df.filter(block(blocks) == k).select("item", "words").toPandas()  # at most twice BLOCK_WORDS words
        index = spark.sparkContext.broadcast(_index(pdf, full.df.filter(block(blocks) == k).toPandas()))
        got = docs.select("doc_id", "text").filter("doc_id is not null and text is not null").mapInArrow(_find(index), "doc_id long, item string")
        out = got if out is None else out.union(got)
    items.drop()
    full.drop()
    return out.distinct().join(named.df.select("item", "task_id").distinct(), "item").select("doc_id", "task_id").distinct()
