"""Periodic runs of words by the dictionary of basic factors.

Each task names, for every power of two, the stretches of so many words of its documents: equal stretches get equal
names, made by sorting pairs of names of the half length. Only names that occur again are carried on, so the arrays
shrink as the stretches grow. Per length m, the occurrences of a name are chained to their successors: neighbours at most
m / 2 apart form arithmetic progressions whose step is a period; from one progression to the next three within 2 m the
distances of each member to the first, and of last to last, are proposed. A proposal is extended to both sides by
descending through the names, kept if the stretch holds it twice, and stretches found again go.

Why that is complete: let a run have period q > m >= q / 2 (for q <= 4, m = 4 is at least q and the successor is q
itself), start s, and u = the m words at s. Between s and s + q, steps of u over m / 2 come at most three times, so
s + q lies in the progression of s or in one of the next three. In its own it would make the period a power. In a later
one it is the first, or the word pattern before it belongs to both, and then both progressions end q apart.

Documents without words have no run, a table without rows gives none. Runs never cross documents: each is followed by a
word of its own. Of the longest runs of a document the first counts, then the one of the smaller period. Null texts count
as empty; repeated rows are rows of their own, whatever their key; other columns are ignored; a task holds ``BLOCK`` bytes
of text, or one text if that is longer.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catascope.llm.common import by_value

BLOCK = 4 << 20
#: Shortest run, in words, and the first length of basic factors that proposes periods.
LEAST, FIRST = 12, 4


def names(words):
    """[array of names per power of two]; a negative name occurs once."""
    import numpy as np

    levels, n, width = [], len(words), 1
    _, name, times = np.unique(words, return_inverse=True, return_counts=True)
    now = np.where(times[name] > 1, name, -1 - np.arange(n))
    while True:
        levels.append(now)
        at = np.flatnonzero(now >= 0)
        at = at[at + width < n]
        at = at[now[at + width] >= 0]
        now = -1 - np.arange(n)
        if len(at):
            _, name, times = np.unique(levels[-1][at] * n + levels[-1][at + width], return_inverse=True, return_counts=True)
            again = times[name] > 1
            now[at[again]] = name[again]
        width *= 2
        if not (now >= 0).any():
            return levels


def proposals(name, m: int):
    """(i, q): places and periods up to 2 m that the successors of the names of length ``m`` propose."""
    import numpy as np

    at = np.flatnonzero(name >= 0)
    at = at[np.argsort(name[at], kind="stable")]
    n = len(at)
    if n < 2:
        return at[:0], at[:0]
    step = np.diff(at)
    near = (name[at[1:]] == name[at[:-1]]) & (step <= 2 * m)
    link = np.append(near & (2 * step <= m), False)  # to the next member of a progression
    reach = np.append(near, False)
    breaks = np.where(link, n, np.arange(n))
    last = np.minimum.accumulate(breaks[::-1])[::-1]  # of the progression
    first = np.flatnonzero(link & ~np.append(False, link[:-1]))
    found = [(at[first], step[first])]
    k, ok = np.arange(n), np.ones(n, bool)
    tail = last == k
    for _ in range(3):
        end = last[k]
        ok = ok & reach[end]
        k = np.where(ok, end + 1, k)
        for who, to in ((ok, k), (ok & tail, last[k])):
            q = at[to] - at
            who = who & (q > 0) & (q <= 2 * m) & ((q > m) | (m == FIRST))
            found.append((at[who], q[who]))
    return np.concatenate([i for i, _ in found]), np.concatenate([q for _, q in found])


def extend(levels, i, q):
    """(start, length) of the longest stretch around the words ``i`` and ``i + q`` that keeps the period ``q``."""
    import numpy as np

    n = len(levels[0])
    a, b = i.copy(), i.copy()
    for k in range(len(levels) - 1, -1, -1):
        name, width = levels[k], 1 << k
        for _ in range(2 if k < len(levels) - 1 else n):  # the widest as often as it holds
            can = b + q + width <= n
            can[can] = (name[b[can]] == name[b[can] + q[can]]) & (name[b[can]] >= 0)
            b[can] += width
            left = a >= width
            left[left] = (name[a[left] - width] == name[a[left] - width + q[left]]) & (name[a[left] - width] >= 0)
            a[left] -= width
            if not (can.any() or left.any()):
                break
    return a, b + q - a


def runs(words):
    """(start, length, period) of every run of an integer array, by start, then period."""
    import numpy as np

    levels = names(np.asarray(words))
    found = [proposals(levels[k], 1 << k) for k in range(2, len(levels))]
    i, q = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int),) * 2
    if not len(i):
        return i, i, i
    start, length = extend(levels, i, q)
    good = length >= np.maximum(LEAST, 2 * q)
    start, length, q = start[good], length[good], q[good]
    order = np.lexsort((q, length, start))
    start, length, q = start[order], length[order], q[order]
    new = np.ones(len(start), bool)
    new[1:] = (np.diff(start) != 0) | (np.diff(length) != 0)  # the smallest period of a stretch comes first
    start, length, q = start[new], length[new], q[new]
    order = np.lexsort((q, start))
    return start[order], length[order], q[order]


def _block(texts: list, seeds: list, repeat: bool) -> list[tuple]:
    """A result row per text: numbers of the longest run and the digests."""
    import numpy as np

    number = defaultdict(count().__next__).__getitem__  # of a word, in order of first sight
    parts, docs, total = [], [], 0
    for text, seed in zip(texts, seeds, strict=True):
        words = (text or b"").split()  # of bytes: space and tab to carriage return
        n = len(words)
        if repeat and seed is not None and seed % 10 == 0 and n:
            g = seed // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]
        docs.append((words, total))
        parts.extend(map(number, words))
        parts.append(-1 - len(docs))
        total += n + 1
    start, length, period = runs(np.array(parts, np.int64))
    bounds = np.searchsorted(start, [at for _, at in docs] + [total])
    out = []
    for k, (words, at) in enumerate(docs):
        s, n, q = (x[bounds[k] : bounds[k + 1]] for x in (start, length, period))
        s, best, kept = s - at, [None] * 4, words
        if len(s):
            top = np.lexsort((q, s, -n))[0]
            best = [int(s[top]), int(n[top]), int(q[top]), int(1000 * n[top] // q[top])]
            cover = np.zeros(len(words) + 1, int)
            np.add.at(cover, s + q, 1)
            np.add.at(cover, s + n, -1)
            kept = [words[j] for j in np.flatnonzero(np.cumsum(cover)[:-1] == 0)]
        lines = "".join(f"{x},{y},{z}\n" for x, y, z in zip(s.tolist(), n.tolist(), q.tolist(), strict=True))
        out.append((len(s), *best, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest(), len(words) - len(kept), list(zip(s.tolist(), n.tolist(), q.tolist(), strict=True)), b" ".join(kept).decode()))
    return out


FIELDS = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, n_dropped long"


def periodic_runs(docs: DataFrame, text: str = "text", key: str = "doc_id", seed: Column | None = None, details: bool = True) -> DataFrame:
    """Per document its runs: how many, the longest, digests; with ``details`` also all ``runs`` and the ``collapsed`` text.

    In the collapsed text every run keeps its first period only. ``seed`` (a long) plants repetitions for evaluation: a
    document whose seed ends in 0 repeats a stretch of its own words to its end. A null seed leaves the text as it is.
    """
    kind, planted = docs.schema[key].dataType.simpleString(), seed is not None

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            keys, texts, seeds = (batch.column(k) for k in range(3))
            first, size = 0, 0
            for k in range(batch.num_rows):
                size += len(texts[k].as_buffer() or b"") if texts[k].is_valid else 0
                if size >= BLOCK or k + 1 == batch.num_rows:
                    rows = _block(texts[first : k + 1].to_pylist(), seeds[first : k + 1].to_pylist(), planted)
                    columns = list(zip(*rows, strict=True))
                    arrays = [keys[first : k + 1]] + [pa.array(c, pa.string() if 5 <= j <= 6 else pa.int64()) for j, c in enumerate(columns[:8])]
                    fields = ["key", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "n_dropped"]
                    if details:
                        triple = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
                        arrays += [pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in x] for x in columns[8]], pa.list_(triple)), pa.array(columns[9], pa.string())]
                        fields += ["runs", "collapsed"]
                    yield pa.RecordBatch.from_arrays(arrays, names=fields)
                    first, size = k + 1, 0

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("t"), (F.lit(None) if seed is None else seed).cast("long").alias("s"))
    more = ", runs array<struct<start:long,length:long,period:long>>, collapsed string" if details else ""
    return rows.mapInArrow(run, f"key {kind}, {FIELDS}{more}").withColumnRenamed("key", key)


def run_report(docs: DataFrame) -> DataFrame:
    """The digest columns of every document; every tenth, by the checksum of its number, repeats a stretch of its words."""
    return periodic_runs(docs, seed=F.crc32(F.col("doc_id").cast("string").cast("binary")), details=False)


by_value(__name__)
