"""Near-duplicate records with small edits (problem 6).

Two records match if at least half of the distinct runs of three words that
either has are in both (Jaccard). A prefix filter sends each distinct record to
the shards of its rarer runs, in each shard a BK-tree over parity bitmaps finds
all partners within the radius, and the pairs that are left are compared word by
word. Runs are 53-bit hashes of 64-bit hashes of words until that comparison.

Each record's shards are staged once, in ``SLICES`` columns; the records are then
sent to their shards in passes, so that the disk holds no more than a share of
the bitmaps that go along.

Why the radius loses nothing: the Hamming distance of two parity bitmaps never
exceeds the size of the symmetric difference of the sets, and Jaccard >= t
holds exactly if that size is at most (1 - t) / (1 + t) * (|A| + |B|).
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curata.functions import text as T
from curata.llm.copies import _role
from curata.runtime import FEW, Stage, clean_id, lookup

BITS = 512  # parity bitmap of a record's runs in the shards
SMALL = 160  # records of more runs carry a bitmap of twice as many bits, those of more than twice as many runs one of four times
SKETCH = 1 << 23  # counters in each of the two rows of the count-min sketch of runs: 16 MB whatever the corpus
CHUNK = 1 << 18
ROWS = 2000  # texts that are taken apart at a time; their numbers fit 11 bits
EXACT = 100  # counts up to this are kept as they are, larger ones rounded up on a scale of four steps to the double
ROW = BITS // 8 + 40  # bytes of a posting row in the shuffle besides its shards and the rest of its bitmap
SLICES = 16  # columns of the staged shards; a pass reads some of them, or part of one
SHARE = 2.5  # of the bytes of the staged words that the posting rows of one pass may take, and ROOM at least
ROOM = 1 << 26
BLOCK = 4096  # shards that may hold more records are divided
BUCKET = 1_000_000  # postings that one task of the search gets; their shards are told apart by 47 bits
VISITS = 500_000  # pairs of query and node that are looked at together

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95  # odd, so it has an inverse modulo 2^64
_BYTES = np.random.Generator(np.random.PCG64(7)).integers(1, 2**64 - 1, 256, np.uint64)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse, modulo 2^64."""
    if len(_POWERS.get("up", ())) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _POWERS[name] = np.multiply.accumulate(x)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and 64-bit hash of each word of texts that are words between single spaces.

    ``data`` holds the bytes of all texts, ``off`` where each begins. A word's
    hash is a polynomial in its bytes, read off a prefix sum, and mixed.
    """
    rows, hashes = [], []
    k = 0
    while k < len(off) - 1:
        # about half a million bytes at a time, whole texts
        stop = max(k + 1, int(np.searchsorted(off, off[k] + (1 << 19), "right")) - 1)
        x = data[off[k] : off[stop]]
        if len(x):
            space = x == 32
            edge = np.zeros(len(x) + 1, bool)  # a text begins or ends here
            edge[off[k:stop] - off[k]] = True
            edge[-1] = True
            first = ~space & (edge[:-1] | np.concatenate([[True], space[:-1]]))
            last = ~space & (edge[1:] | np.concatenate([space[1:], [True]]))
            at, end = np.flatnonzero(first), np.flatnonzero(last) + 1
            up, down = _powers(len(x))
            total = np.zeros(len(x) + 1, np.uint64)
            np.cumsum(_BYTES[x] * up, out=total[1:])
            h = (total[end] - total[at]) * down[at]
            h ^= h >> np.uint64(32)
            h *= _GOLD
            h ^= h >> np.uint64(29)
            hashes.append(h)
            rows.append(np.searchsorted(off[k : stop + 1] - off[k], at, "right") - 1 + k)
        k = stop
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(rows), np.concatenate(hashes)


def _words(batches):
    for b in batches:
        out, leaf = [], []
        for s, role in zip(b.column("content").to_pylist(), b.column("role").to_pylist()):
            t = " ".join(T.words(s or ""))
            obj = T.json_object(s) if s else None
            leaf.append(T.digest(b"t", t.replace(" ", "").encode()) if obj is None else T.merkle(obj))
            out.append("" if role == "system" else t)
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("turn"), b.column("role"), pa.array(leaf, pa.binary()), pa.array(out, pa.string())], ["id", "turn", "role", "leaf", "words"])


def _small(batches):
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            yield b.slice(at, ROWS)


def _hashes(words: np.ndarray) -> np.ndarray:
    """64-bit hash of each run of three word hashes."""
    a = words.astype(np.uint64)
    h = a[:-2] * _GOLD
    h ^= h >> np.uint64(29)
    h = (h + a[1:-1]) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    h = (h + a[2:]) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _runs(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct runs of each text of a column of at most ``ROWS`` texts, words between spaces.

    Row numbers (ascending), hashes of 53 bits (ascending in a row) and runs per
    row; row and hash are sorted as one number.
    """
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(len(column), np.int64)
    if not len(column) or column.buffers()[2] is None:
        return none
    off = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    row, words = word_hashes(np.frombuffer(column.buffers()[2], np.uint8), off)
    if len(words) < 3:
        return none
    row = row.astype(np.uint64)
    same = row[:-2] == row[2:]
    key = (row[:-2][same] << np.uint64(53)) | (_hashes(words)[same] >> np.uint64(11))
    key.sort()
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    key = key[new]
    row = (key >> np.uint64(53)).astype(np.int64)
    return row, key & np.uint64((1 << 53) - 1), np.bincount(row, minlength=len(column))


def _slots(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (h >> np.uint64(30)).astype(np.int64), ((h >> np.uint64(7)) & np.uint64(SKETCH - 1)).astype(np.int64) + SKETCH


def _count(batches):
    total = np.zeros(2 * SKETCH, np.int32)
    held: list[np.ndarray] = []

    def add():
        h = np.concatenate(held)
        for k, s in enumerate(_slots(h)):
            total[k * SKETCH : (k + 1) * SKETCH] += np.bincount(s - k * SKETCH, minlength=SKETCH).astype(np.int32)
        held.clear()

    for b in _small(batches):
        held.append(_runs(b.column("words"))[1])
        if sum(map(len, held)) > 2_000_000:
            add()
    if held:
        add()
    pack = zstandard.ZstdCompressor(1)
    for k in range(0, 2 * SKETCH, CHUNK):
        part = total[k : k + CHUNK]
        if part.any():
            # one byte for most counters; those of 255 and more follow in full
            over = np.flatnonzero(part >= 255)
            low = np.minimum(part, 255).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([pack.compress(low.tobytes() + part[over].tobytes())], pa.binary())], ["at", "part"])


def _coded(c: np.ndarray) -> np.ndarray:
    """Counts in a byte: exact up to ``EXACT``, rounded up beyond."""
    big = EXACT + np.ceil(4 * np.log2(np.maximum(c, EXACT) / EXACT))
    return np.minimum(np.where(c <= EXACT, c, big), 255).astype(np.uint8)


def _counted(code: np.ndarray) -> np.ndarray:
    """The count that a code stands for, never less than the true one."""
    x = code.astype(np.float64)
    return np.where(x <= EXACT, x, np.ceil(EXACT * 2 ** ((x - EXACT) / 4))).astype(np.int64)


def _add(key, pdf):
    import pandas as pd

    whole = np.zeros(CHUNK, np.int64)
    for x in pdf["part"]:
        raw = zstandard.decompress(x)
        one = np.frombuffer(raw, np.uint8, count=CHUNK).astype(np.int64)
        one[one == 255] = np.frombuffer(raw, np.int32, offset=CHUNK)
        whole += one
    return pd.DataFrame({"at": [key[0]], "part": [zstandard.compress(_coded(whole).tobytes(), 1)]})


def sketch(words: DataFrame) -> np.ndarray:
    """Count-min sketch of the runs of all records: two rows of ``SKETCH`` counters, never an undercount."""
    parts = words.select("words").mapInArrow(_count, "at long, part binary").groupBy("at").applyInPandas(_add, "at long, part binary")
    out = np.zeros(2 * SKETCH, np.uint8)
    for r in Stage(parts, "sketch").df.collect():  # at most 64 rows of 256 K counters, whatever the corpus
        out[r.at : r.at + CHUNK] = np.frombuffer(zstandard.decompress(bytes(r.part)), np.uint8)
    return out


def _bitmaps(row: np.ndarray, h: np.ndarray, rows: int, bits: int = BITS) -> np.ndarray:
    """Parity bitmap of each row's runs."""
    bit = (h & np.uint64(bits - 1)).astype(np.int64)
    odd = (np.bincount(row * bits + bit, minlength=rows * bits) & 1).astype(np.uint8).reshape(rows, bits)
    return np.packbits(odd, axis=1)


def _shard(h: np.ndarray, i: np.ndarray, j: np.ndarray, divided: np.ndarray) -> np.ndarray:
    """The number of a shard: the run's hash, mixed with the pair of blocks where the run is divided."""
    with np.errstate(over="ignore"):
        x = (h + (i.astype(np.uint64) << np.uint64(32)) + j.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(31)
    return np.where(divided, x, h).view(np.int64)


def _extras(row: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What the bitmaps of long records have besides their first ``BITS`` bits: bytes of each record, and all of them.

    A bitmap of ``BITS`` bits is the exclusive or of the halves of one of twice
    as many bits; so one half (and of these, one half each) tells the rest.
    """
    part = BITS // 8
    size = np.where(n > 2 * SMALL, 3 * part, np.where(n > SMALL, part, 0))
    long = np.flatnonzero(size)
    at = np.full(len(n), -1)
    at[long] = np.arange(len(long))
    mine = at[row] >= 0
    q = _bitmaps(at[row[mine]], h[mine], len(long), 4 * BITS).reshape(len(long), 4, part)
    whole = np.concatenate([q[:, 0] ^ q[:, 2], q[:, 0], q[:, 1]], axis=1)
    return size, whole[np.arange(3 * part) < size[long][:, None]]


def _binary(size: np.ndarray, data: np.ndarray) -> pa.Array:
    off = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(data).reshape(-1))])


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of each value of a binary column, and all of them."""
    off = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return np.diff(off), np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[off[0] : off[-1]]


def _tails(six: np.ndarray) -> np.ndarray:
    """The numbers of six bytes each."""
    tail = np.zeros((len(six) // 6, 8), np.uint8)
    tail[:, :6] = six.reshape(-1, 6)
    return tail.view(np.uint64)[:, 0]


def _place(tail: np.ndarray) -> np.ndarray:
    """The 31 bits of a shard's name that tell its slice, pass and bucket."""
    return (tail >> np.uint64(17)).astype(np.int64)


def postings(words: DataFrame, counts, t: float) -> DataFrame:
    """``(unit, n, bits, extra, p0, p1, ...)``: each record with its number of runs, its bitmap and its shards.

    A shard takes six bytes, 47 bits of its name and a bit that is set where the
    record is a node. Column ``p<k>`` has those whose :func:`_place` is ``k`` modulo
    ``SLICES``.

    Runs are taken rarest first by the sketch. A partner with Jaccard >= t shares
    a run that is among the first n - ceil(t n) + 1 of both and, for the smaller
    record, among the first n - ceil(2t / (1 + t) n) + 1, where it is a node.
    Runs that the sketch has counted once are in one record and go nowhere. A
    run counted more than ``BLOCK`` times is divided into blocks of records, and
    every pair of blocks is a shard.
    """
    names = [f"p{k}" for k in range(SLICES)]

    def run(batches):
        c = np.frombuffer(zstandard.decompress(counts.value), np.uint8)
        for b in _small(batches):
            row, h, n = _runs(b.column("words"))
            if not len(h):
                continue
            bits, extra = _bitmaps(row, h, b.num_rows), _extras(row, h, n)
            s1, s2 = _slots(h)
            code = np.minimum(c[s1], c[s2])
            # by row and count; runs of one row and count stay in the order of their hashes
            o = np.argsort((row << 16) | code, kind="stable")
            row, h, df = row[o], h[o], _counted(code[o])
            rank = np.arange(len(h)) - (np.cumsum(n) - n)[row]
            nr = n[row]
            go = (rank < nr - np.ceil(t * nr - 1e-9) + 1) & (df > 1)
            row, h, df, nr, rank = row[go], h[go], df[go], nr[go], rank[go]
            if not len(row):
                continue
            idx = rank < nr - np.ceil(2 * t / (1 + t) * nr - 1e-9) + 1
            unit = np.asarray(b.column("unit"))
            blocks = -(-df // BLOCK)
            if (blocks > 1).any():
                mine = (unit[row].astype(np.uint64) >> np.uint64(17)).astype(np.int64) % blocks
                rep = np.repeat(np.arange(len(row)), blocks)
                other = np.arange(len(rep)) - (np.cumsum(blocks) - blocks)[rep]
                shard = _shard(h[rep], np.minimum(mine[rep], other), np.maximum(mine[rep], other), blocks[rep] > 1).view(np.uint64)
                row, idx = row[rep], idx[rep]
            else:
                shard = h
            tail = ((shard * _GOLD & np.uint64((1 << 47) - 1)) << np.uint64(1)) | idx.astype(np.uint64)
            part = _place(tail) % SLICES
            o = np.argsort(part, kind="stable")
            six = np.ascontiguousarray(tail[o]).view(np.uint8).reshape(-1, 8)[:, :6]
            each = np.bincount(part * b.num_rows + row, minlength=SLICES * b.num_rows).reshape(SLICES, -1)
            end = np.cumsum(each.sum(1))
            parts = [_binary(6 * e, six[z - e.sum() : z]) for e, z in zip(each, end)]
            yield pa.RecordBatch.from_arrays([b.column("unit"), pa.array(n.astype(np.int32)), _binary(np.full(b.num_rows, BITS // 8), bits), _binary(*extra), *parts], ["unit", "n", "bits", "extra", *names])

    return words.select("unit", "words").mapInArrow(run, "unit long, n int, bits binary, extra binary" + "".join(f", {x} binary" for x in names))


def planned(records: int, entries: int, extra: int, size: int, cores: int) -> tuple[int, int]:
    """Passes (a power of two) and buckets of each.

    A record has a row in every bucket that has shards of it: the more buckets,
    the more often its bitmap travels, up to once for each of its shards. The
    rows of a pass may take ``SHARE`` of ``size``, the bytes of the staged words.
    """
    mean = entries / max(1, records)
    passes = 1
    while True:
        buckets = int(entries / passes // BUCKET) + 1
        if passes == 1:
            buckets = max(buckets, min(2 * cores, int(entries // (BUCKET // 16)) + 1))
        b = passes * buckets
        rows = records * min(mean, b * (1 - (1 - 1 / b) ** mean))
        if rows * (ROW + extra / max(1, records)) + 6 * entries <= passes * max(ROOM, SHARE * size):
            return passes, buckets
        passes *= 2


def spread(posted: DataFrame, k: int, passes: int, buckets: int) -> DataFrame:
    """``(bucket, unit, n, bits, extra, tails)``: the records of pass ``k``, each once in every bucket that has shards of it."""
    names = [f"p{x}" for x in range(SLICES) if x % passes == k % SLICES] if passes < SLICES else [f"p{k % SLICES}"]

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            got = [_bytes(b.column(x)) for x in names]
            row = np.concatenate([np.repeat(np.arange(b.num_rows), size // 6) for size, _ in got])
            six = np.concatenate([x for _, x in got])
            at = _place(_tails(six))
            six = six.reshape(-1, 6)
            if passes > SLICES:
                mine = at % passes == k
                row, six, at = row[mine], six[mine], at[mine]
            if not len(row):
                continue
            key = row * buckets + at // passes % buckets
            o = np.argsort(key, kind="stable")
            key = key[o]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            r = pa.array(key[first] // buckets)
            cols = [b.column(x).take(r) for x in ("unit", "n", "bits", "extra")]
            tails = _binary(6 * np.diff(np.append(first, len(key))), six[o])
            yield pa.RecordBatch.from_arrays([pa.array((key[first] % buckets).astype(np.int32)), *cols, tails], ["bucket", "unit", "n", "bits", "extra", "tails"])

    return posted.select("unit", "n", "bits", "extra", *names).mapInArrow(run, "bucket int, unit long, n int, bits binary, extra binary, tails binary")


def bk_forest(group: np.ndarray, unit: np.ndarray, n: np.ndarray, w: np.ndarray, node: np.ndarray, query: np.ndarray, t: float, rec: np.ndarray | None = None) -> np.ndarray:
    """Pairs of units within the radius, by one BK-tree per group, all trees grown and searched together.

    ``node`` and ``query`` are postings, ``group`` and ``rec`` the shard and the
    record of each posting (without ``rec``, each is a record), ``unit``, ``n`` and
    ``w`` name, number of runs and bitmap of each record. The root of a tree is its first node, and a
    node's children are keyed by their integer Hamming distance to it. A query
    of n runs looks for nodes of m <= n runs at a distance of at most
    (1 - t) / (1 + t) * (n + m); it follows an edge only if the key is within the
    largest such radius of its own distance to the node, and if the subtree has
    records of fitting size. Levels of all trees are computed at once in numpy.
    """
    f = (1 - t) / (1 + t)
    dist = lambda p, q: np.bitwise_count(w[p] ^ w[q]).sum(1, dtype=np.int64)
    tree, qtree = group[node], group[query]
    if rec is not None:
        node, query = rec[node], rec[query]
    pairs = [np.zeros((0, 2), np.int64)]
    while len(node) and len(query):
        # nodes sorted by tree; the first is the root
        o = np.argsort(tree, kind="stable")
        node, tree = node[o], tree[o]
        names, first, tree = np.unique(tree, return_index=True, return_inverse=True)
        root = node[first]
        small, large = np.minimum.reduceat(n[node], first), np.maximum.reduceat(n[node], first)
        at = np.searchsorted(names, qtree)
        at[at == len(names)] = 0
        fits = (names[at] == qtree) & (small[at] <= n[query]) & (large[at] >= t * n[query] - 1e-9)
        query, at = query[fits], at[fits]
        a, b = query, root[at]
        far = dist(a, b)
        ok = (far <= f * (n[a] + n[b]) + 1e-9) & ((n[b] < n[a]) | ((n[b] == n[a]) & (unit[b] < unit[a]))) & (n[b] >= t * n[a] - 1e-9)
        pairs.append(np.stack([unit[a[ok]], unit[b[ok]]], 1))
        rest = np.ones(len(node), bool)
        rest[first] = False
        node, tree = node[rest], tree[rest]
        if not len(node):
            break
        tree = tree * (BITS + 1) + dist(node, root[tree])
        kids = np.unique(tree)
        edge = np.arange(len(names) + 1) * (BITS + 1)
        lo = np.searchsorted(kids, edge)
        reps = np.diff(lo)[at]
        q = np.repeat(np.arange(len(query)), reps)
        child = kids[lo[at][q] + np.arange(len(q)) - (np.cumsum(reps) - reps)[q]]
        near = np.abs(far[q] - child % (BITS + 1)) <= 2 * f * n[query[q]] + 1e-9
        query, qtree = query[q[near]], child[near]
    return np.unique(np.concatenate(pairs), axis=0)


def _search(g: np.ndarray, rec: np.ndarray, unit: np.ndarray, n: np.ndarray, idx: np.ndarray, w: np.ndarray, t: float):
    """Runs :func:`bk_forest` over slices of at most ``VISITS`` possible visits, which bounds memory."""
    size, some = np.bincount(g), np.bincount(g, weights=idx).astype(np.int64)
    ends = np.cumsum(size)
    k = 0
    while k < len(size):
        stop, work = k + 1, size[k] * some[k]
        while stop < len(size) and work + size[stop] * some[stop] <= VISITS:
            work += size[stop] * some[stop]
            stop += 1
        rows = np.arange(ends[k] - size[k], ends[stop - 1])
        nodes = rows[idx[rows]]
        if len(nodes):
            step = len(rows) if work <= VISITS else max(1, VISITS // len(nodes))
            for x in range(0, len(rows), step):
                yield bk_forest(g, unit, n, w, nodes, rows[x : x + step], t, rec)
        k = stop


def _within(a: np.ndarray, b: np.ndarray, n: np.ndarray, w: np.ndarray, size: np.ndarray, extra: np.ndarray, t: float) -> np.ndarray:
    """Pairs of records whose bitmaps are within the radius, by as many bits as both have.

    ``size`` has the bytes that :func:`_extras` gives of each record, ``extra`` all of them.
    """
    keep = np.ones(len(a), bool)
    radius = (1 - t) / (1 + t) * (n[a] + n[b]) + 1e-9
    at = (np.cumsum(size) - size) // 8
    least = np.minimum(size[a], size[b])
    words, part = BITS // 64, BITS // 8
    bits = lambda *xs: sum(np.bitwise_count(x).sum(1, dtype=np.int64) for x in xs)
    for level in (part, 3 * part):
        o = np.flatnonzero(keep & (least >= level))
        p, q = a[o], b[o]
        low, one, two = (extra[at[p][:, None] + np.arange(k * words, (k + 1) * words)] ^ extra[at[q][:, None] + np.arange(k * words, (k + 1) * words)] if k * part < level else None for k in range(3))
        high = w[p] ^ w[q] ^ low
        far = bits(low, high) if level == part else bits(one, low ^ one, two, high ^ two)
        keep[o] = far <= radius[o]
    return keep


def candidates(rows: DataFrame, t: float, buckets: int) -> DataFrame:
    """Pairs of units ``(a, b)`` that a BK-tree of some shard finds within the radius.

    A bucket is one task of about ``BUCKET`` postings, sorted by shard there; a
    shard is bounded by ``BLOCK`` (a pair of blocks by twice that).
    """

    def run(batches):
        got = []
        for b in batches:
            if b.num_rows:
                (_, bits), extra, tails = (_bytes(b.column(x)) for x in ("bits", "extra", "tails"))
                got.append((np.asarray(b.column("unit")), np.asarray(b.column("n")), bits, *extra, *tails))
        if not got:
            return
        unit, n, w, size, extra, each, six = (np.concatenate(x) for x in zip(*got))
        del got
        n, w, extra = n.astype(np.int64), w.view(np.uint64).reshape(len(unit), -1), extra.view(np.uint64)
        tail, rec = _tails(six), np.repeat(np.arange(len(unit)), each // 6)
        o = np.argsort(tail, kind="stable")
        tail, rec = tail[o], rec[o]
        shard, idx = tail >> np.uint64(1), (tail & np.uint64(1)).astype(bool)
        g = np.cumsum(np.concatenate([[False], shard[1:] != shard[:-1]]))
        live = (np.bincount(g)[g] > 1) & (np.bincount(g, weights=idx)[g] > 0)
        if not live.any():
            return
        g, rec, idx = g[live], rec[live], idx[live]
        g = np.cumsum(np.concatenate([[False], g[1:] != g[:-1]]))
        pairs = lambda x: pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], ["a", "b"])
        got, rows_ = [], 0
        # each record has one row here, so its place can stand for its unit
        for x in _search(g, rec, np.arange(len(unit)), n, idx, w, t):
            x = unit[x[_within(x[:, 0], x[:, 1], n, w, size, extra, t)]]
            got.append(x)
            rows_ += len(x)
            if rows_ > 4 * VISITS:
                got = [np.unique(np.sort(np.concatenate(got), axis=1), axis=0)]
                rows_ = len(got[0])
                if rows_ > 2 * VISITS:
                    yield pairs(got[0])
                    got, rows_ = [], 0
        if got:
            yield pairs(np.unique(np.sort(np.concatenate(got), axis=1), axis=0))

    return rows.repartitionById(buckets, F.col("bucket")).mapInArrow(run, "a long, b long").distinct()


def _joined(batches):
    for b in _small(batches):
        text = b.column("words")
        row, h, n = _runs(text)
        # a unit is a set of runs together with the digest of the whole record
        two = h * np.uint64(0xD6E8FEB86659FD93)
        two ^= two >> np.uint64(32)
        sums = np.zeros((b.num_rows, 2), np.uint64)
        np.add.at(sums[:, 0], row, h)
        np.add.at(sums[:, 1], row, two)
        root = b.column("root").to_pylist()
        unit = [int.from_bytes(T.digest(r, s.tobytes())[:8], "little", signed=True) for r, s in zip(root, sums)]
        cols = [b.column("id"), b.column("root"), pa.array(unit, pa.int64()), pa.array(n.astype(np.int32)), text]
        yield pa.RecordBatch.from_arrays(cols, ["id", "root", "unit", "n", "words"]).filter(pa.array(n > 0))


def record_words(messages: DataFrame) -> DataFrame:
    """``(id, root, unit, n, words)`` of each record with at least three words outside system turns.

    ``words`` are the words of all its turns in order, between single spaces,
    ``root`` is the digest of problem 5 (equal for copies), ``unit`` a hash of
    the root and the set of runs and ``n`` the size of that set. Null ids are left out; repeated rows count once.
    """
    m = messages.select(clean_id(F.col("id")).alias("id"), F.col("turn").cast("int").alias("turn"), _role(F.col("role")).alias("role"), "content").filter("id is not null")
    w = m.mapInArrow(_words, "id string, turn int, role string, leaf binary, words string")
    turns = w.groupBy("id").agg(F.sort_array(F.collect_set(F.struct("turn", "role", "leaf", "words"))).alias("t"))
    node = F.transform("t", lambda x: F.concat_ws(":", x["role"], F.hex(x["leaf"])))
    root = F.unhex(F.md5(F.array_join(node, "|"))).alias("root")
    whole = F.array_join(F.transform("t", lambda x: x["words"]), " ").alias("words")
    return turns.select("id", root, whole).mapInArrow(_joined, "id string, root binary, unit long, n int, words string")


def _verified(t: float):
    """Pairs that reach ``t`` word by word."""

    def runs(s: str) -> set:
        w = s.split()
        return set(zip(w, w[1:], w[2:]))

    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column("wa").to_pylist(), b.column("wb").to_pylist()):
                p, q = runs(x), runs(y)
                both = len(p & q)
                keep.append(both > 0 and both >= t * (len(p) + len(q) - both) - 1e-9)
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def near_units(messages: DataFrame, t: float = 0.5) -> tuple[Stage, DataFrame]:
    """Pairs ``(a, b)`` of units with Jaccard >= ``t`` that are no copies of each other, and the members ``(unit, id)`` of the units that have a pair.

    A unit is a distinct record: copies (by :func:`record_words`' ``root``) with
    one set of runs are searched for once, however many there are.

    Words compare folded, without punctuation; system turns are left out, null
    content is empty; records of fewer than three words match nothing; an empty
    table gives an empty result. No pair is dropped: hot runs are divided, not cut.
    """
    spark = messages.sparkSession
    words = Stage(record_words(messages), "words", runs=F.sum("n"))
    names = words.df.select("unit", "id")
    more = Stage(names.join(names.groupBy("unit").agg(F.min("id").alias("id")), "id", "left_anti").select("id"), "copies")
    # the ids of up to FEW copies are broadcast: the texts need not be sorted to leave them out
    once = words.df.join(F.broadcast(more.df) if more.rows <= FEW else more.df, "id", "left_anti") if more.rows else words.df
    counts = spark.sparkContext.broadcast(zstandard.compress(sketch(once).tobytes(), 1))  # 16 MB at most, whatever the corpus
    entries = F.sum(sum(F.length(f"p{k}") for k in range(SLICES)) / 6).cast("long")
    posted = Stage(postings(once, counts, t), "postings", entries=entries, extra=F.sum(F.length("extra")), options={"parquet.enable.dictionary": "false"})
    counts.destroy()
    more.drop()
    passes, buckets = planned(posted.rows, posted.seen["entries"] or 0, posted.seen["extra"] or 0, words.bytes(), spark.sparkContext.defaultParallelism)
    # the rows of a pass are dropped before the next one begins
    found = [Stage(candidates(spread(posted.df, k, passes, buckets), t, buckets), "pairs") for k in range(passes)]
    posted.drop()
    near = Stage(reduce(DataFrame.union, [x.df for x in found]).distinct(), "near") if passes > 1 else found.pop()
    for x in found:
        x.drop()
    # only the texts of what is left are compared in full
    named = near.df.select(F.explode(F.array("a", "b")).alias("unit")).distinct()
    members = Stage(words.df.select("unit", "id", "root", "words").join(named, "unit", "left_semi"), "members")
    words.drop()
    texts = members.df.groupBy("unit").agg(F.min_by(F.struct("root", "words"), "id").alias("x"))
    pair = lookup(near.df, texts.select(F.col("unit").alias("a"), F.col("x.root").alias("ra"), F.col("x.words").alias("wa")), "a", "inner", rows=near.rows)
    pair = lookup(pair, texts.select(F.col("unit").alias("b"), F.col("x.root").alias("rb"), F.col("x.words").alias("wb")), "b", "inner", rows=near.rows)
    good = Stage(pair.filter("ra <> rb").select("a", "b", "wa", "wb").mapInArrow(_verified(t), "a long, b long"), "good")
    near.drop()
    return good, members.df.select("unit", "id")


def near_pairs(messages: DataFrame, t: float = 0.5) -> DataFrame:
    """``(id_a, id_b)``, ``id_a < id_b``: all pairs of records of :func:`near_units`."""
    good, of = near_units(messages, t)
    x = good.df.join(of.select(F.col("unit").alias("a"), F.col("id").alias("x")), "a").join(of.select(F.col("unit").alias("b"), F.col("id").alias("y")), "b")
    return x.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
