"""Near copies by the Jaccard similarity of word shingles: SimHash pairs and pairs of a rare shingle, verified.

SimHash ball hashing (``simhash.links``) proposes texts whose fingerprints of ``width``-word shingles differ in
at most three bits. At a similarity of 0.8 about ten of 64 bits differ, so it proposes only the closest
pairs. The others follow from their rarest shingles: texts that share at least ``percent`` of the union of
their shingle sets also share one of their first shingles in any common order, and a set of n needs only its
first n - ceil(percent n) + 1 as keys. The order puts shingles that a sample of documents shows to be
frequent last, by frequency, and the others by hash; it decides the work, never which pairs are similar.

Members of a key are first paired with one of them, its hub, so candidates grow with the memberships. What is
verified on the whole sets is joined to components. Size and position bounds drop pairs that cannot reach the
similarity, and so do parity bits: each set is folded into ``BITS`` bits, each telling whether an odd number of
shingles hash to it, and two sets differ in at least as many shingles as their bits differ in places. The bound
never drops a similar pair, and up to about ``BITS`` / 2 differing shingles little else passes it. What then is left,
members of a key that are still in different components, is compared pair by pair: bits first, inside the join,
then the whole sets of those that pass; a pair that shares several keys leaves the join at the first of them, and
seldom again. Its links join whole components, so the second search for components has a row per pair of these.
The components are those of all pairs of the similarity. The hubs only keep the open pairs few: copies of each
other are one component by then. Comparing the bits of a key's open members still takes time in the square of their
number; the pairs that leave the join, their texts and what is written do not follow it.

Defined cases: case (ASCII) and white space (ASCII) do not count; wordless and null texts are one group;
fewer words than a shingle: the whole sequence is the one shingle; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from catascope.llm.common import by_value, merged, stored
from catascope.llm.components import components
from catascope.llm.simhash import fingerprint_of, links, one_per_group, shingle_hashes, text_digest

HEAD, SAMPLE = 1 << 18, 50_000  # frequent shingles that are ordered last, documents they are counted on
BITS = 1024  # parity bits of a shingle set
BEFORE = 16  # open keys before each that a member carries


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()  # bytes: ASCII case and ASCII white space only


def node_of(words: list[bytes]) -> int:
    """Signed 64-bit hash of a sequence of words."""
    import xxhash

    return int.from_bytes(xxhash.xxh64_digest(b" ".join(words), 7), "big", signed=True)


def shingle_set(words: list[bytes], width: int):
    """Sorted distinct 64-bit hashes of the word shingles."""
    import numpy as np

    return np.unique(shingle_hashes(words, width).view(np.int64))


def parity_bits(keys) -> bytes:
    """``BITS`` bits of a shingle set: whether the number of its shingles with a place's hash is odd."""
    import numpy as np

    return np.packbits(np.bincount(keys & (BITS - 1), minlength=BITS) & 1, bitorder="little").tobytes()


def text_nodes(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, h, node, fp, n, bits) per row; h: digest of the text, node: hash of its words, fp: their SimHash, n and bits: size and parity bits of the shingle set."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            node, fp, n, bits = [], [], [], []
            for text in batch.column(2):  # a text at a time: a batch of them as Python strings takes several times its bytes
                words = words_of(text.as_py())
                hashes = shingle_hashes(words, width)
                keys = np.unique(hashes.view(np.int64))
                node.append(node_of(words))
                fp.append(fingerprint_of(hashes))
                n.append(len(keys))
                bits.append(np.frombuffer(parity_bits(keys), "<i8"))
            columns = [pa.array(node, pa.int64()), pa.array(fp, pa.int64()), pa.array(n, pa.int32()), pa.array(bits, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["doc_id", "h", "node", "fp", "n", "bits"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_digest(F.col("text")).alias("h"), "text").mapInArrow(run, f"doc_id {kind}, h string, node long, fp long, n int, bits array<long>")


def simhash_pairs(nodes: DataFrame) -> DataFrame:
    """(a, b): every node with the least of its fingerprint, and the least nodes of linked fingerprints."""
    each = nodes.select("node", "fp").distinct()
    first = stored(each.groupBy("fp").agg(F.min("node").alias("first")), "fingerprint-nodes")
    same = each.join(merged(first), "fp").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    a, b = (first.select(F.col("fp").alias(s), F.col("first").alias(f"node_{s}")) for s in "ab")
    near = links(first.select("fp")).join(merged(a), "a").join(merged(b), "b")
    return same.unionByName(near.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")))


def distinct_sets(batches: Iterator, width: int) -> Iterator:
    """(node, shingle set) of the texts with words in a task, without those that it remembers."""
    seen: set[int] = set()
    for batch in batches:
        for text in batch.column(0):
            words = words_of(text.as_py())
            node = node_of(words)
            if not words or node in seen:
                continue
            if len(seen) >= 500_000:
                seen.clear()
            seen.add(node)
            yield node, shingle_set(words, width)


def entries(docs: DataFrame, width: int, percent: int, head, batch_keys: int = 1 << 17) -> DataFrame:
    """(key, node, n, pos): the first shingles of each text in the order of ``head``, of n.

    A task leaves out texts that it remembers; ``head``: (sorted shingles, rank of each from 1). ``batch_keys`` bounds
    what a task holds of its output, not what it returns.
    """

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            sizes = [len(k) for k, _, _ in held]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([k for k, _, _ in held])),
                    pa.array(np.repeat(np.array([node for _, node, _ in held], dtype=np.int64), sizes)),
                    pa.array(np.repeat(np.array([n for _, _, n in held], dtype=np.int32), sizes)),
                    pa.array(np.concatenate([np.arange(s, dtype=np.int32) for s in sizes])),
                ],
                names=["key", "node", "n", "pos"],
            )

        for node, keys in distinct_sets(batches, width):
            n = len(keys)
            at = np.minimum(np.searchsorted(head[0], keys), max(len(head[0]) - 1, 0))
            rank = np.where(head[0][at] == keys, head[1][at], 0) if len(head[0]) else np.zeros(n, dtype=np.int32)
            keys = keys[np.argsort(rank, kind="stable")[: n + (-percent * n) // 100 + 1]]
            held.append((keys, node, n))
            size += len(keys)
            if size >= batch_keys:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return docs.select("text").mapInArrow(run, "key long, node long, n int, pos int")


def shingle_counts(docs: DataFrame, width: int, batch_keys: int = 1 << 19) -> DataFrame:
    """(key, n): how many texts have each shingle, a text that a task remembers once; added up in the tasks first."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        held, size = [], 0

        def flush() -> Iterator:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            for a in range(0, len(keys), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(keys[a : a + (1 << 16)]), pa.array(n[a : a + (1 << 16)], pa.int64())], names=["key", "n"])

        for _, keys in distinct_sets(batches, width):
            held.append(keys)
            size += len(keys)
            if size >= batch_keys:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    return docs.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def frequent(docs: DataFrame, width: int):
    """(sorted shingles, rank of each): the shingles of most documents of a sample, at most ``HEAD``."""
    import numpy as np

    step = max(1, docs.count() // SAMPLE)
    part = docs.where(F.pmod(F.xxhash64("text"), F.lit(step)) == 0)
    counts = shingle_counts(part, width).where("n > 2")
    keys = counts.orderBy(F.desc("n"), "key").limit(HEAD).select("key").toArrow().column("key").to_numpy()
    order = np.argsort(keys)
    return keys[order], (len(keys) - order).astype(np.int32)


def _possible(a: Column, b: Column, percent: int) -> Column:
    """Whether two texts that share a key can reach the similarity, by sizes and the key's positions."""
    most = F.lit(1) + F.least(a["pos"], b["pos"]) + F.least(a["n"] - a["pos"], b["n"] - b["pos"]) - 1
    return (100 + percent) * most.cast("long") >= percent * (a["n"].cast("long") + b["n"])


def _alike(a: Column, b: Column, percent: int) -> Column:
    """Whether two shingle sets can reach the similarity, by their sizes ``n`` and parity ``bits``."""
    apart = reduce(add, (F.bit_count(a["bits"][i].bitwiseXOR(b["bits"][i])) for i in range(BITS // 64)))
    both = a["n"].cast("long") + b["n"]  # sizes less differing places: at most twice the common shingles
    return (100 + percent) * (both - apart) >= 2 * percent * both


def alike_pairs(pairs: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) of nodes that can be similar by their ``marks`` (node, n, bits)."""
    a, b = (marks.select(F.col("node").alias(s), F.struct("n", "bits").alias(f"of_{s}")) for s in "ab")
    return pairs.join(merged(a), "a").join(merged(b), "b").where(_alike(F.col("of_a"), F.col("of_b"), percent)).select("a", "b")


def verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) of nodes whose shingle sets are similar."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        last, mine = None, None
        for batch in batches:
            ok = []
            for a, text_a, text_b in zip(batch.column(0), batch.column(2), batch.column(3), strict=True):
                if mine is None or a.as_py() != last:
                    last, mine = a.as_py(), shingle_set(words_of(text_a.as_py()), width)
                other = shingle_set(words_of(text_b.as_py()), width)
                both = len(np.intersect1d(mine, other, assume_unique=True))
                ok.append(100 * both >= percent * (len(mine) + len(other) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    need = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    reps = nodes.join(need, "node", "left_semi").groupBy("node").agg(F.min(F.struct("doc_id", "h")).alias("r"))
    reps = reps.select(F.col("node"), F.col("r.doc_id").alias("__doc"), F.col("r.h").alias("__h"))
    keyed = docs.select("doc_id", text_digest(F.col("text")).alias("h"), "text")
    texts = keyed.join(reps, F.col("doc_id").eqNullSafe(F.col("__doc")) & F.col("h").eqNullSafe(F.col("__h"))).dropDuplicates(["node"])
    texts = stored(texts.select("node", "text"), "candidate-texts")
    held = pairs.join(merged(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))), "b")
    held = held.join(merged(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))), "a")
    return stored(held.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long"), "similar")


def hub_pairs(shared: DataFrame, percent: int) -> DataFrame:
    """(a, b): members of a key with its hub, the least of them, where they can be similar."""
    hubs = shared.groupBy("key").agg(F.min("x").alias("hub"))
    pairs = shared.join(merged(hubs), "key").where((F.col("x.node") != F.col("hub.node")) & _possible(F.col("hub"), F.col("x"), percent))
    return pairs.select(F.col("hub.node").alias("a"), F.col("x.node").alias("b"))


def open_pairs(shared: DataFrame, labels: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """(a, b): all members of a key that are in different components and can be similar, by their ``marks`` too.

    Two texts that share several keys meet at the first of them, and at a later one only if none of the ``BEFORE`` open
    keys before it, in each of the two, is the same.
    """
    named = labels.select(F.col("node").alias("__node"), F.col("label").alias("__label"))
    members = shared.join(merged(named), F.col("x.node") == F.col("__node"), "left").select("key", "x", F.coalesce("__label", "x.node").alias("label"))
    several = members.groupBy("key").agg(F.min("label").alias("l"), F.max("label").alias("m")).where("l <> m").select("key")
    members = members.join(several, "key", "left_semi").join(merged(marks.select(F.col("node").alias("__node"), "bits")), F.col("x.node") == F.col("__node"))
    before = F.collect_list("key").over(W.partitionBy("__node").orderBy("x.pos").rowsBetween(-BEFORE, -1))
    members = stored(members.select("key", F.struct("x.*", "bits", before.alias("before")).alias("x"), "label"), "open-members")
    side = lambda s: members.select("key", F.col("x").alias(s), F.col("label").alias(f"label_{s}"))
    x, y = F.col("x"), F.col("y")
    near = (x["node"] < y["node"]) & (F.col("label_x") != F.col("label_y")) & _possible(x, y, percent) & _alike(x, y, percent) & ~F.arrays_overlap(x["before"], y["before"])
    return side("x").join(merged(side("y")), "key").where(near).select(x["node"].alias("a"), y["node"].alias("b"))


def label_pairs(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(a, b): the labels that ``edges`` (a, b) of nodes link; a node without a label is its own."""
    for s in "ab":
        edges = edges.join(labels.select(F.col("node").alias(s), F.col("label").alias(f"label_{s}")), s, "left")
    return edges.select(F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b"))


def similar_groups(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, h, label) per row; rows of one label are linked over texts of the stated similarity."""
    nodes = stored(text_nodes(docs, width), "text-nodes")
    marks = stored(nodes.select("node", "n", "bits").dropDuplicates(["node"]), "set-marks")
    # one shuffle by key serves the removal of repetitions and the count of members
    found = entries(docs, width, percent, frequent(docs, width)).repartition("key").dropDuplicates(["key", "node"])
    found = found.withColumn("members", F.count(F.lit(1)).over(W.partitionBy("key"))).where("members > 1")
    shared = stored(found.select("key", F.struct("node", "n", "pos").alias("x")), "shared-shingles")
    pairs = hub_pairs(shared, percent).unionByName(simhash_pairs(nodes)).distinct()
    tried = stored(alike_pairs(pairs, marks, percent), "similar-candidates")
    labels = components(verified(tried, docs, nodes, width, percent))
    rest = stored(open_pairs(shared, labels, marks, percent).distinct().join(tried, ["a", "b"], "left_anti"), "open-pairs")
    groups = nodes.join(labels, "node", "left").select("doc_id", "h", F.coalesce("label", "node").alias("label"))
    if not rest.isEmpty():
        over = components(label_pairs(verified(rest, docs, nodes, width, percent), labels)).select(F.col("node").alias("label"), F.col("label").alias("least"))
        groups = groups.join(over, "label", "left").select("doc_id", "h", F.coalesce("least", "label").alias("label"))
    return groups


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Rows with one left of every group of near copies, the one of the smallest doc_id."""
    return one_per_group(docs, similar_groups(docs, width, percent))


by_value(__name__)
