"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Fingerprints are linked when at most three of 64 bits differ. One of the two 32-bit halves then differs in
at most one bit (half the radius, rounded down), so each fingerprint emits, per half, the variants within
one flip of that half; the shuffle brings together fingerprints that share a variant, and the colliding
pairs are deduplicated and verified on all 64 bits. Halves one flip apart differ in parity, so only those
of odd parity emit their flips: every such pair still meets.

A variant that more than ``cap`` fingerprints share exactly would give pairs in the square of its size.
All fingerprints in such buckets take the ball over the whole word instead: every one emits its variants
within one flip and the odd ones also those at exactly two flips. Two fingerprints within three flips meet
at a variant within one flip of the first and two of the second, and whatever meets so is within three
flips, so each variant links its members to its least one: edges stay linear in the variants and no pair
is left out. Components then come from joins; nothing is collected.

Defined cases: null and wordless texts have fingerprint zero, linked like any other; fewer words than a
shingle: the whole sequence is the one shingle; repeated rows and exact copies share one fingerprint row
before the search; an empty table gives an empty result; other columns pass through ``keep_one`` untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catascope.llm.common import apart, by_value, merged, stored
from catascope.llm.components import components


def shingle_hashes(words: list[bytes], width: int):
    """Unsigned 64-bit hash of every word shingle, repeats included; fewer words than ``width`` are one shingle."""
    import numpy as np
    import xxhash

    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined, digest, width = b" ".join(words), xxhash.xxh64_intdigest, min(width, len(words))
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts, stops = (ends - sizes).tolist(), ends[width - 1 :].tolist()
    return np.fromiter((digest(joined[s:e], 42) for s, e in zip(starts, stops)), dtype=np.uint64, count=len(stops))


def fingerprint_of(hashes) -> int:
    """Signed 64-bit SimHash: a bit is set if over half of the hashes set it; zero if there are none."""
    import numpy as np

    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        h = hashes[at : at + (1 << 16)].astype("<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint(text: str | None, width: int) -> int:
    """SimHash of the word shingles of a text."""
    return fingerprint_of(shingle_hashes((text or "").encode().lower().split(), width))  # bytes: ASCII case and ASCII white space only


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp) per row."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            fp = pa.array([fingerprint(t.as_py(), width) for t in batch.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), fp], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def _bit(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), i.cast("int"))


def _flips(value: Column, bits: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), lambda i: value.bitwiseXOR(_bit(i)))


def _two_flips(value: Column) -> Column:
    pairs = lambda i: F.transform(F.sequence(i + 1, F.lit(63)), lambda j: value.bitwiseXOR(_bit(i)).bitwiseXOR(_bit(j)))
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(62)), pairs))


def half_variants(fps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(exact, flipped): (key, fp) of the halves themselves and of the single flips of odd halves."""
    halves = F.array(
        F.struct(F.lit(0).cast("long").alias("side"), F.call_function("shiftrightunsigned", F.col("fp"), F.lit(32)).alias("v")),
        F.struct(_bit(F.lit(33)).alias("side"), F.col("fp").bitwiseAND(F.lit((1 << 32) - 1)).alias("v")),
    )
    each = fps.select("fp", F.explode(halves).alias("h")).select("fp", "h.side", "h.v")
    exact = each.select((F.col("side") + F.col("v")).alias("key"), "fp")
    odd = each.where(F.bit_count("v") % 2 == 1)
    flipped = odd.select("side", "fp", F.explode(_flips(F.col("v"), 32)).alias("v")).select((F.col("side") + F.col("v")).alias("key"), "fp")
    return exact, flipped


def links(fps: DataFrame, radius: int = 3, cap: int = 64) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that connect all pairs within ``radius`` (3) bits."""
    if radius != 3:
        raise ValueError("the halves and parities used here hold for a radius of three")
    exact, flipped = half_variants(fps)
    sizes = exact.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    exact = exact.join(merged(sizes), "key")
    few = exact.where(F.col("n") <= cap).select("key", F.col("fp").alias("a"))
    pairs = few.join(merged(exact.where(F.col("n") <= cap).select("key", F.col("fp").alias("b"))), "key").where("a < b")
    pairs = pairs.unionByName(few.join(merged(flipped.select("key", F.col("fp").alias("b"))), "key"))
    near = pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius).select("a", "b")

    crowded = sizes.where(F.col("n") > cap).select("key")
    hot = exact.where(F.col("n") > cap).select("fp").unionByName(flipped.join(crowded, "key", "left_semi").select("fp")).distinct()
    hot = stored(hot, "crowded-fingerprints")
    close = hot.select("fp", F.explode(F.concat(F.array("fp"), _flips(F.col("fp"), 64))).alias("v"))
    least = close.groupBy("v").agg(F.min("fp").alias("a"))
    far = hot.where(F.bit_count("fp") % 2 == 1).select("fp", F.explode(_two_flips(F.col("fp"))).alias("v"))
    stars = close.unionByName(far).join(merged(least), "v").where("a <> fp").select("a", F.col("fp").alias("b"))
    return near.unionByName(stars).distinct()


def text_digest(text: Column) -> Column:
    """Digest of a text; null for null."""
    return F.md5(F.encode(text, "UTF-8"))


def one_per_group(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """One row of ``docs`` for each label of ``groups`` (doc_id, h, label), a row per row of ``docs``.

    It is the least by doc_id (null last) and text digest; of rows that repeat both, one stays. Other columns stay as
    they are, whatever their names.
    """
    return apart(docs, ("__digest", "__doc", "__h", "__kept"), lambda rows: _one_per_group(rows, groups))


def _one_per_group(docs: DataFrame, groups: DataFrame) -> DataFrame:
    each = groups.groupBy("doc_id", "h").agg(F.first("label").alias("label"), F.count(F.lit(1)).alias("n"))
    first = each.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("f"))
    kept = F.col("doc_id").eqNullSafe(F.col("f.doc_id")) & F.col("h").eqNullSafe(F.col("f.h"))
    odd = each.join(first, "label").select(F.col("doc_id").alias("__doc"), F.col("h").alias("__h"), kept.alias("__kept"), "n").where("not __kept or n > 1")
    odd = stored(odd.drop("n"), "odd-rows")
    keyed = docs.withColumn("__digest", text_digest(F.col("text")))
    same = F.col("doc_id").eqNullSafe(F.col("__doc")) & F.col("__digest").eqNullSafe(F.col("__h"))
    again = keyed.join(odd.where("__kept"), same, "left_semi").dropDuplicates(["doc_id", "__digest"])
    return keyed.join(odd, same, "left_anti").unionByName(again).drop("__digest")


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) per row; component_id: the smallest doc_id reachable over links."""
    rows = stored(fingerprints(docs, width), "fingerprints")
    fps = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    labels = components(links(fps.select("fp"), radius))
    named = fps.join(merged(labels.withColumnRenamed("node", "fp")), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    least = named.groupBy("label").agg(F.min("first").alias("component_id"))
    return rows.join(merged(named.select("fp", "label").join(merged(least), "label").select("fp", "component_id")), "fp")


def keep_one(docs: DataFrame, width: int = 5, radius: int = 3) -> DataFrame:
    """Rows with one left of every near-duplicate group, the one of the smallest doc_id (see ``one_per_group``)."""
    rows = stored(fingerprints(docs.select(F.struct("doc_id", text_digest(F.col("text")).alias("h")).alias("doc_id"), "text"), width), "fingerprints")
    labels = components(links(rows.select("fp").distinct(), radius)).withColumnRenamed("node", "fp")
    groups = rows.join(labels, "fp", "left").select("doc_id.doc_id", "doc_id.h", F.coalesce("label", "fp").alias("label"))
    return one_per_group(docs, groups)


by_value(__name__)
