"""Repeated byte strings by difference-cover suffix arrays over content-dealt segments.

Every ``span``-byte string that also starts in a document with a smaller doc_id is removed. Each string
belongs to the anchor that winnowing picks in it (the least hash of its ``GRAM``-byte grams), so equal
strings have equal anchors. The work is done in three rounds over batches of whole documents:

1. Anchors are named: every batch sends its anchors' hashes, dealt by hash, and learns which of them occur
   in another row too. Text that no other row shares travels no further.
2. The segments around shared anchors (all strings of the anchor, at most 2 ``span`` bytes) are dealt by
   anchor. In each group equal segments are merged with the least doc_id and the rest is sorted by the
   difference-cover algorithm modulo 3: sort the triples of the sampled suffixes, recurse on their names
   until they cover ``span`` bytes or are distinct, merge the remaining suffixes by their first bytes and
   the rank after them, then compare the prefixes of neighbours.
3. Intervals of removed bytes travel back to the batches, which report and cut.

A group holds about ``group_bytes`` of segments. An anchor with more than ``crowd`` holders would outgrow it,
so its strings go one by one instead: their 128-bit hashes take the least doc_id in partial aggregates, and
the holders look it up in a salted join. Both ways give the same intervals.

Defined cases: a null text is empty; rows that repeat a doc_id are one document's texts: none is smaller
than the other, and both are judged against smaller ids; a null doc_id is smaller than none and larger
than all, so such rows lose what any other holds; texts of any length are cut into stretches for the
anchors alone, never for the result; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catascope.llm.common import by_value, partitions, stored

GRAM = 24
POSITION = 16  # bits of a position within a stretch of text; the arrays of a stretch stay in the processor's cache
LAST = (1 << 63) - 1  # stands for a null doc_id
KEY = 40  # bits of an anchor's hash that travel in round 1, beside those that deal it


def gram_hashes(part):
    """64-bit hashes of all ``GRAM``-byte grams of an array of bytes: pairs, then pairs of pairs."""
    import numpy as np

    def join(a, b, n):
        h = (a * np.uint64(0xD6E8FEB86659FD93)) ^ (b + np.uint64(n))
        return h ^ (h >> np.uint64(29))

    h = part.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)
    out, have, n = None, 0, 1
    while have < GRAM:
        if GRAM & n:
            m = len(part) - have - n + 1
            out, have = (h if out is None else join(out[:m], h[have : have + m], n + 64)), have + n
        h, n = join(h[:-n], h[n:], n), 2 * n
    out = out * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def anchors(data, ends, span: int):
    """(hash, first, last, row) of the anchors of texts that lie one after another and end at ``ends``.

    The ``span``-byte strings that start from first to last belong to the anchor; none leaves its text.
    """
    import numpy as np

    size, width, low = (1 << POSITION) - span, span - GRAM + 1, np.uint64((1 << POSITION) - 1)
    found: list[tuple] = []
    for a in range(0, len(data) - span + 1, size):
        part = data[a : a + size + span - 1]
        h = gram_hashes(part)
        # least hash of each string's grams; the position below it settles ties to the left and tells which gram it was
        least = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        n = 1
        while n < width:
            m = min(n, width - n)
            least = np.minimum(least[:-m], least[m:])
            n += m
        edge = ends[np.searchsorted(ends, a, side="right") : np.searchsorted(ends, a + len(part), side="left")] - a
        leaves = np.zeros(len(part) + 1, dtype=np.int32)
        np.add.at(leaves, np.maximum(edge - span + 1, 0), 1)
        np.add.at(leaves, edge, -1)
        inside = (np.cumsum(leaves) == 0)[: len(least)]
        same = (least[1:] == least[:-1]) & inside[1:] & inside[:-1]
        first = np.flatnonzero(inside & np.concatenate([[True], ~same]))
        last = np.flatnonzero(inside & np.concatenate([~same, [True]]))
        found.append((h[(least[first] & low).astype(np.int64)], first + a, last + a))
    if not found:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
    h, first, last = (np.concatenate([f[k] for f in found]) for k in range(3))
    return h, first, last, np.searchsorted(ends, first, side="right")


def suffix_order(s, depth: int):
    """Ranks of the suffixes of ``s`` (ints from 1), ties only beyond ``depth``."""
    import numpy as np

    n = len(s)
    x = np.concatenate([s, np.zeros(4, dtype=np.int64)])

    def pack(*parts):
        """One order-preserving int64 per row; renamed whenever the next column would not fit."""
        out, bound = parts[0], int(parts[0].max(initial=0)) + 1
        for p in parts[1:]:
            size = int(p.max(initial=0)) + 1
            if bound * size >= 1 << 62:
                out = np.unique(out, return_inverse=True)[1].astype(np.int64)
                bound = int(out.max(initial=0)) + 1
            out, bound = out * size + p, bound * size
        return out

    sample = np.concatenate([np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)])
    sample = sample[sample <= n]
    kinds, names = np.unique(pack(x[sample], x[sample + 1], x[sample + 2]), return_inverse=True)
    names = names.astype(np.int64) + 1
    ranks = suffix_order(names, -(-depth // 3)) if len(kinds) < len(sample) and depth > 3 else names
    r = np.zeros(n + 4, dtype=np.int64)
    r[sample] = ranks
    zero, one, two = np.arange(0, n, 3), np.arange(1, n, 3), np.arange(2, n, 3)
    # the rest against the samples that follow by one (compared after one byte) and by two (after two)
    with1 = pack(x[np.concatenate([zero, one])], r[np.concatenate([zero, one]) + 1])
    both = np.concatenate([zero, two])
    with2 = pack(x[both], x[both + 1], r[both + 2])
    k0, k1, k2 = with1[: len(zero)], np.sort(with1[len(zero) :]), np.sort(with2[len(zero) :])
    mixed, own = np.sort(r[np.concatenate([one, two])]), np.sort(k0)
    by2 = np.sort(with2[: len(zero)])
    out = np.zeros(n, dtype=np.int64)
    out[one] = np.searchsorted(mixed, r[one]) + np.searchsorted(own, with1[len(zero) :])
    out[two] = np.searchsorted(mixed, r[two]) + np.searchsorted(by2, with2[len(zero) :])
    out[zero] = np.searchsorted(own, k0) + np.searchsorted(k1, k0) + np.searchsorted(k2, with2[: len(zero)])
    return out + 1


def least_holders(text: bytes, starts, docs, valid, span: int):
    """Per valid start: the least doc among starts whose ``span`` bytes are equal (by neighbours in suffix order)."""
    import numpy as np

    s = np.frombuffer(text, np.uint8).astype(np.int64) + 1
    rank = suffix_order(s, span)
    order = valid[np.argsort(rank[valid], kind="stable")]
    words = np.lib.stride_tricks.sliding_window_view(np.frombuffer(text, np.uint8), 8)
    packed = np.ascontiguousarray(words).view(np.uint64).ravel()
    same = np.ones(len(order) - 1, bool)
    for at in [*range(0, span - 8, 8), span - 8]:
        w = packed[order + at]
        same &= w[1:] == w[:-1]
    begin = np.flatnonzero(np.concatenate([[True], ~same]))
    owner = docs[np.searchsorted(starts, order, side="right") - 1]
    least = np.repeat(np.minimum.reduceat(owner, begin), np.diff(np.append(begin, len(order))))
    out = np.empty(len(text), dtype=np.int64)
    out[order] = least
    return out


def _pack(*arrays, level: int = 3) -> bytes:
    import pyarrow as pa

    data = b"".join(len(b := a if isinstance(a, bytes) else a.tobytes()).to_bytes(8, "little") + b for a in arrays)
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", compression_level=level).compress(data, asbytes=True)


def _unpack(data: bytes) -> list[bytes]:
    import pyarrow as pa

    raw, out, at = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True), [], 0
    while at < len(raw):
        n = int.from_bytes(raw[at : at + 8], "little")
        out.append(raw[at + 8 : at + 8 + n])
        at += 8 + n
    return out


def _ranges(starts, sizes):
    """All ints of the ranges that begin at ``starts``, one range after another."""
    import numpy as np

    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def _opened(block: bytes):
    """(doc ids with LAST for null, is null, bytes of copies that are removed whole, ends, bytes) of a batch."""
    import numpy as np

    ids, none, gone, sizes, text = _unpack(block)
    as_long = lambda x: np.frombuffer(x, np.int64)
    return as_long(ids), np.frombuffer(none, bool), as_long(gone), np.cumsum(as_long(sizes)), np.frombuffer(text, np.uint8)


def marked_copies(docs: DataFrame, salts: int = 16) -> DataFrame:
    """(doc_id, text, copy): copy is true where a smaller doc_id has the same text.

    The texts that repeat are found by digest with partial aggregates; the join back is salted, as a third
    of all rows may share one text.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.md5(F.encode(text, "UTF-8")).alias("h"))
    keyed = keyed.withColumn("doc", F.coalesce("doc_id", F.lit(LAST)))
    least = keyed.groupBy("h").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most").drop("most")
    least = stored(least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), "repeated-texts")
    rows = keyed.withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(salts)).cast("int"))
    # no bound on the repeated texts: never broadcast
    return rows.join(least.hint("merge"), ["h", "salt"], "left").select("doc_id", "text", F.coalesce(F.col("least") < F.col("doc"), F.lit(False)).alias("copy"))


def batches_of(docs: DataFrame, batch_bytes: int, span: int) -> DataFrame:
    """(batch, block): whole documents packed together, written once and read by every round."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() << 32
        held, size = [], 0

        def flush(number: int) -> pa.RecordBatch:
            ids = np.array([LAST if k is None else k for k, _, _ in held], dtype=np.int64)
            none, gone = np.array([k is None for k, _, _ in held]), np.array([n for _, _, n in held], dtype=np.int64)
            block = _pack(ids, none, gone, np.array([len(t) for _, t, _ in held], dtype=np.int64), b"".join(t for _, t, _ in held), level=5)
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([block], pa.binary())], names=["batch", "block"])

        for batch in batches:
            for key, value, copy in zip(*(batch.column(k) for k in range(3)), strict=True):
                text = value.as_py().encode()
                whole = len(text) if copy.as_py() and len(text) >= span else 0
                held.append((key.as_py(), b"" if whole else text, whole))
                size += len(held[-1][1])
                if size >= batch_bytes or len(held) >= 50_000:
                    yield flush(at)
                    at, held, size = at + 1, [], 0
        if held:
            yield flush(at)

    return stored(marked_copies(docs).mapInArrow(run, "batch long, block binary"), "text-batches")


def shared_anchors(batches: DataFrame, groups: int, span: int, crowd: int) -> DataFrame:
    """(batch, n, block): which of a batch's anchors other rows hold too, and which of them are crowded."""

    def deal(rows: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in rows:
            for key, block in zip(batch.column(0), batch.column(1), strict=True):
                *_, ends, data = _opened(block.as_py())
                h, _, _, row = anchors(data, ends, span)
                t = ((h >> np.uint64(KEY)) % np.uint64(groups)).astype(np.int64)
                order = np.argsort(t, kind="stable")
                t, h, row = t[order], h[order] & np.uint64((1 << KEY) - 1), row[order]
                cuts = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]])).tolist() + [len(t)] if len(t) else [0]
                low, high = (h & np.uint64(0xFFFFFFFF)).astype(np.uint32), (h >> np.uint64(32)).astype(np.uint8)
                step = lambda v: np.diff(v, prepend=0).astype(np.int32)
                out = [_pack(low[a:b], high[a:b], step(row[a:b]), step(order[a:b])) for a, b in zip(cuts[:-1], cuts[1:])]
                at = pa.array(t[cuts[:-1]], pa.int64())
                yield pa.RecordBatch.from_arrays([at, pa.array([key.as_py()] * len(out), pa.int64()), pa.array(out, pa.binary())], names=["t", "batch", "block"])

    def meet(key: tuple, pdf):
        import numpy as np
        import pandas as pd

        parts = [_unpack(b) for b in pdf["block"]]
        sizes = [len(p[1]) for p in parts]
        h = np.concatenate([np.frombuffer(p[0], np.uint32).astype(np.int64) | (np.frombuffer(p[1], np.uint8).astype(np.int64) << 32) for p in parts])
        which = np.repeat(np.arange(len(parts), dtype=np.int64), sizes)
        row = (which << 32) | np.concatenate([np.cumsum(np.frombuffer(p[2], np.int32)) for p in parts])
        at = np.concatenate([np.cumsum(np.frombuffer(p[3], np.int32)) for p in parts])
        order = np.argsort(h, kind="stable")
        begin = np.flatnonzero(np.concatenate([[True], np.diff(h[order]) != 0])) if len(h) else np.zeros(0, np.int64)
        n = np.diff(np.append(begin, len(h)))
        more = np.repeat(np.minimum.reduceat(row[order], begin) < np.maximum.reduceat(row[order], begin), n) if len(h) else np.zeros(0, bool)
        mark = np.zeros(len(h), dtype=np.int8)
        mark[order] = np.where(more, 1 + (np.repeat(n, n) > crowd), 0)
        out, ends = [], np.cumsum(sizes)
        for batch, a, b in zip(pdf["batch"], (ends - sizes).tolist(), ends.tolist()):
            few, many = (at[a:b][mark[a:b] == m].astype(np.int32) for m in (1, 2))
            if len(few) or len(many):
                out.append((batch, len(few), len(many), _pack(few, many)))
        return pd.DataFrame(out, columns=["batch", "n", "crowded", "block"])

    dealt = batches.mapInArrow(deal, "t long, batch long, block binary")
    return stored(dealt.groupBy("t").applyInPandas(meet, "batch long, n long, crowded long, block binary"), "shared-anchors")


def _with(batches: DataFrame, told: DataFrame) -> DataFrame:
    """(batch, block, told): each batch with the blocks that were sent to it, which grow with the corpus (no broadcast)."""
    told = told.groupBy("batch").agg(F.collect_list("block").alias("told"))
    return batches.join(told.hint("merge"), "batch", "left")


def _chosen(block: bytes, told: list, span: int, which: int):
    """Anchors of a batch that round 1 marked: few (0) or crowded (1); with the batch's ids and bytes."""
    import numpy as np

    ids, _, _, ends, data = _opened(block)
    picks = np.sort(np.concatenate([np.frombuffer(_unpack(b)[which], np.int32) for b in told]))
    h, first, last, row = (v[picks] for v in anchors(data, ends, span))
    return h, first, last, ids[row], data


def deal_segments(asked: DataFrame, groups: int, span: int) -> DataFrame:
    """(t, batch, block): packed anchors, holders, first starts and bytes, by group of anchors."""

    def run(rows: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in rows:
            for key, block, told in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                h, first, last, doc, data = _chosen(block.as_py(), told.as_py(), span, 0)
                if not len(h):
                    continue
                t = (h % np.uint64(groups)).astype(np.int64)
                order = np.argsort(t, kind="stable")
                t, h, doc, first, size = t[order], h[order], doc[order], first[order], (last - first + span)[order]
                text, ends = data[_ranges(first, size)], np.cumsum(size)
                cuts = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]])).tolist() + [len(t)]
                out = [
                    _pack(h[a:b], np.diff(doc[a:b], prepend=0), np.diff(first[a:b], prepend=0).astype(np.int32), size[a:b].astype(np.uint8), text[ends[a] - size[a] : ends[b - 1]])
                    for a, b in zip(cuts[:-1], cuts[1:])
                ]
                at = pa.array(t[cuts[:-1]], pa.int64())
                yield pa.RecordBatch.from_arrays([at, pa.array([key.as_py()] * len(out), pa.int64()), pa.array(out, pa.binary())], names=["t", "batch", "block"])

    return asked.mapInArrow(run, "t long, batch long, block binary")


def removed_intervals(blocks: DataFrame, span: int) -> DataFrame:
    """(batch, block): bytes to remove in the batch as packed starts and stops, overlapping."""

    def run(key: tuple, pdf):
        import numpy as np
        import pandas as pd

        parts = [_unpack(b) for b in pdf["block"]]
        h, size = (np.concatenate([np.frombuffer(p[k], d) for p in parts]) for k, d in ((0, np.uint64), (3, np.uint8)))
        doc, first = (np.concatenate([np.cumsum(np.frombuffer(p[k], d)) for p in parts]) for k, d in ((1, np.int64), (2, np.int32)))
        size = size.astype(np.int64)
        raw, at = b"".join(p[4] for p in parts), np.cumsum(size) - size
        merged: dict[tuple[int, bytes], int] = {}
        segment = np.array([merged.setdefault((k, raw[a : a + n]), len(merged)) for k, a, n in zip(h.tolist(), at.tolist(), size.tolist())], dtype=np.int64)
        least = np.full(len(merged), LAST)
        np.minimum.at(least, segment, doc)
        windows = np.array([len(x) for _, x in merged], dtype=np.int64) - span + 1
        ends = np.cumsum(windows)
        holder = np.repeat(least, windows)  # per string of the distinct segments
        # an anchor with one segment is settled by the merge; the others' segments are sorted together
        _, kind = np.unique(np.array([k for k, _ in merged], dtype=np.uint64), return_inverse=True)
        open_ = np.flatnonzero((np.bincount(kind) > 1)[kind])
        if len(open_):
            texts = list(merged)
            joined = b"".join(texts[i][1] for i in open_.tolist())
            starts = np.cumsum(windows[open_] + span - 1) - (windows[open_] + span - 1)
            valid = _ranges(starts, windows[open_])
            holder[_ranges(ends[open_] - windows[open_], windows[open_])] = least_holders(joined, starts, least[open_], valid, span)[valid]
        count = windows[segment]  # back to every holder of a segment
        each = _ranges(ends[segment] - count, count)
        gone, row = holder[each] < np.repeat(doc, count), np.repeat(np.arange(len(doc)), count)
        start = _ranges(first.astype(np.int64), count)
        split = row[1:] != row[:-1]
        begins = gone & np.concatenate([[True], ~gone[:-1] | split])
        finish = gone & np.concatenate([~gone[1:] | split, [True]])
        owner = np.repeat(np.arange(len(parts)), [len(p[3]) for p in parts])[row[begins]]
        a, b = start[begins].astype(np.int32), (start[finish] + span).astype(np.int32)
        ids, cuts = np.unique(owner, return_index=True)
        cuts = [*cuts.tolist(), len(owner)]
        blocks = [_pack(a[i:j], b[i:j]) for i, j in zip(cuts[:-1], cuts[1:])]
        return pd.DataFrame({"batch": pdf["batch"].to_numpy()[ids], "block": pd.Series(blocks, dtype=object)})

    return blocks.groupBy("t").applyInPandas(run, "batch long, block binary")


def crowded_intervals(asked: DataFrame, span: int, salts: int) -> DataFrame:
    """(batch, block) as above for the anchors with very many holders, string by string."""

    def strings(rows: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import xxhash

        for batch in rows:
            for key, block, told in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                if not any(len(_unpack(b)[1]) for b in told.as_py()):
                    continue
                _, first, last, doc, data = _chosen(block.as_py(), told.as_py(), span, 1)
                raw, count = data.tobytes(), last - first + 1
                start = _ranges(first, count)
                w = [xxhash.xxh3_128_digest(raw[a : a + span]) for a in start.tolist()]
                columns = [pa.array([key.as_py()] * len(w), pa.int64()), pa.array(start, pa.int32()), pa.array(np.repeat(doc, count)), pa.array(w, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["batch", "start", "doc", "w"])

    def packed(key: tuple, pdf):
        import numpy as np
        import pandas as pd

        a = pdf["start"].to_numpy().astype(np.int32)
        return pd.DataFrame({"batch": [key[0]], "block": [_pack(a, a + np.int32(span))]})

    each = stored(asked.mapInArrow(strings, "batch long, start int, doc long, w binary"), "crowded-strings")
    salt = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    least = each.groupBy("w").agg(F.min("doc").alias("least")).withColumn("salt", salt)
    gone = each.withColumn("salt", F.pmod("batch", F.lit(salts)).cast("int")).join(least, ["w", "salt"]).where("least < doc")
    return gone.select("batch", "start").groupBy("batch").applyInPandas(packed, "batch long, block binary")


def dedup_report(
    docs: DataFrame, span: int = 50, group_bytes: int = 1 << 21, batch_bytes: int = 1 << 23, crowd: int = 100_000, with_text: bool = False
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) per row; ``with_text`` adds the kept bytes.

    ``batch_bytes`` of documents are packed together; a text is never split, so a longer one is a batch alone.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    batches = batches_of(docs, batch_bytes, span)
    shared = shared_anchors(batches, max(1, -(-total // (8 * batch_bytes)), min(partitions(docs.sparkSession), total // batch_bytes)), span, crowd)
    n, crowded = shared.agg(F.sum("n"), F.sum("crowded")).first()
    asked = _with(batches, shared).where("told is not null")
    found = removed_intervals(deal_segments(asked, max(1, -(-(n or 0) * 2 * span // group_bytes)), span), span)
    if crowded:
        found = found.unionByName(crowded_intervals(asked, span, salts=16))

    def run(rows: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in rows:
            for block, told in zip(batch.column(1), batch.column(2), strict=True):
                ids, none, whole, ends, data = _opened(block.as_py())
                change = np.zeros(len(data) + 1, dtype=np.int32)
                for b in told.as_py() or []:
                    start, stop = (np.frombuffer(x, np.int32) for x in _unpack(b))
                    np.add.at(change, start, 1)
                    np.add.at(change, stop, -1)
                gone = np.cumsum(change[:-1]) > 0
                raw, out, a = data.tobytes(), [], 0
                for e, n in zip(ends.tolist(), whole.tolist()):
                    mask = gone[a:e]
                    removed = int(np.count_nonzero(mask))
                    left = raw[a:e] if not removed else data[a:e][~mask].tobytes()
                    runs = int(np.count_nonzero(mask[1:] & ~mask[:-1])) + bool(removed and mask[0])
                    counts = (n, n, 1) if n else (e - a, removed, runs)
                    out.append((*counts, hashlib.sha256(left).hexdigest(), left if with_text else None))
                    a = e
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
                columns = [pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)]
                names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
                yield pa.RecordBatch.from_arrays([pa.array(ids, mask=none), *columns], names=names)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    out = _with(batches, stored(found, "removed-intervals")).mapInArrow(run, schema)
    out = out.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
    return out if with_text else out.drop("kept")


by_value(__name__)
