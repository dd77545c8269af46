"""Benchmark decontamination as a prefix-filtered set join.

Item windows (``window`` consecutive words, or a whole shorter item) must be contained exactly. Their
word shingles are counted over the corpus; the rarest shingle of a window is its necessary prefix (for
full containment a prefix of one token suffices). Document positions that hold a prefix shingle are
candidates; length and position bounds drop those whose window would leave the document, and the words
themselves are compared before anything counts.

Documents emit their shingle hashes, and a broadcast of benchmark shingles keeps the positions that hold one
together with the words around them, and one sentinel row per document. The shingles are broadcast in blocks
of at most ``block_rows``, which bounds the broadcast: a benchmark of that many shingles is one pass over the
texts, a larger one takes a pass for each block, always by the same plan. Everything after works on the few
rows that are kept. Only DataFrame functions are used.

Defined cases: null or wordless texts and items have no window and no hit; texts of any length are searched whole; rows are keyed by (doc_id,
hash of the text), so repeated rows, null ids and differing texts under one id each get their own result;
empty tables give no hits; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from catascope.llm.common import apart, ascii_lower, stored, window_hashes

#: Anything but digits, ASCII letters (lower-cased afterwards) and characters beyond ASCII.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SHINGLE = 5
#: Marks the row that every document emits whether it matches or not.
SENTINEL = -7046029254386353131


def item_words(text: Column) -> Column:
    """Words of ASCII letters, digits and all other characters; case as given."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS), "")


def _hashes(words: Column) -> Column:
    # lower() folds more than A-Z: equal words stay equal, and candidates are compared exactly later
    return F.transform(words, lambda w: F.xxhash64(F.lower(w)))


def benchmark_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """(w, len, item_id): every distinct window of every item, as space-joined lower-case words."""
    words = item_words(ascii_lower(F.col("text")))
    n = F.size("words")
    starts = F.when(n >= window, F.sequence(F.lit(1), F.greatest(n - window + 1, F.lit(1)))).when(n > 0, F.array(F.lit(1)))
    return (
        benchmark.select("item_id", words.alias("words"))
        .select("item_id", F.least(n, F.lit(window)).alias("len"), "words", F.explode(starts).alias("at"))
        .select(F.array_join(F.slice("words", F.col("at"), F.col("len")), " ").alias("w"), "len", "item_id")
        .distinct()
    )


def find_occurrences(docs: DataFrame, windows: DataFrame, window: int = 10, block_rows: int = 500_000) -> tuple[DataFrame, DataFrame]:
    """(documents, occurrences): (doc_id, tk, n_words) per row and distinct (doc_id, tk, start, len, w)."""
    width = F.least(F.lit(SHINGLE), F.col("len"))
    shingles = stored(
        windows.select("w", "len").distinct()
        .withColumn("k", width)
        .withColumn("h", _hashes(F.split("w", " ")))
        .select("w", "len", "k", F.posexplode(F.coalesce(*[F.when(F.col("k") == k, window_hashes(F.col("h"), k)) for k in range(1, SHINGLE + 1)])).alias("o", "sh")),
        "benchmark-shingles",
    )
    widths = sorted((r.k for r in shingles.select("k").distinct().collect()), reverse=True) or [SHINGLE]
    keys = shingles.select("sh", "k").distinct()
    blocks = max(1, -(-keys.count() // block_rows))
    end = docs.sparkSession.createDataFrame([(SENTINEL, 0)], keys.schema)
    # hashes of all widths one after another; where a width's run begins follows from n_words alone
    n = F.col("n_words")
    runs, begin = {}, F.lit(0)
    for k in widths:
        runs[k] = begin
        begin = begin + F.greatest(n - k + 1, F.lit(0))
    position = F.coalesce(*[F.when(F.col("k") == k, F.col("p") - b) for k, b in runs.items()], F.lit(0))
    in_run = F.coalesce(*[F.when(F.col("k") == k, (F.col("p") >= b) & (F.col("p") < b + F.greatest(n - k + 1, F.lit(0)))) for k, b in runs.items()], F.lit(True))

    def context(at: Column) -> Column:
        first = F.greatest(at - (window - 1), F.lit(0))
        return ascii_lower(F.array_join(F.slice("words", first + 1, F.lit(2 * window)), " "))

    emitted = (
        docs.select("doc_id", F.xxhash64("text").alias("tk"), item_words(F.col("text")).alias("words"))
        .withColumn("h", _hashes(F.col("words")))
        .withColumn("all", F.concat(*[window_hashes(F.col("h"), k) for k in widths], F.array(F.lit(SENTINEL))))
        .select("doc_id", "tk", F.size("words").alias("n_words"), "words", F.posexplode("all").alias("p", "sh"))
    )
    met = None
    for b in range(blocks):  # the sentinels go with the first block
        block = keys.where(F.pmod(F.xxhash64("sh"), F.lit(blocks)) == b)
        held = emitted.join(F.broadcast(block if b else block.unionByName(end)), "sh").where(in_run).withColumn("at", position)
        held = held.withColumn("ctx", F.when(F.col("k") > 0, context(F.col("at"))))
        met = held if met is None else met.unionByName(held)
    met = stored(met.select("doc_id", "tk", "n_words", "k", "at", "sh", "ctx"), "benchmark-matches")

    rarity = met.where("k > 0").groupBy("sh").agg(F.count(F.lit(1)).alias("seen"))
    prefix = (
        shingles.join(rarity, "sh")
        .groupBy("w", "len", "k")
        .agg(F.count(F.lit(1)).alias("present"), F.min_by(F.struct("sh", "o"), F.struct("seen", "sh", "o")).alias("rarest"))
        .where("present = len - k + 1")  # a window with a shingle that no document has cannot occur
        .select("w", "len", F.col("rarest.sh").alias("sh"), F.col("rarest.o").alias("o"))
    )
    start = F.col("at") - F.col("o")
    words_at = F.array_join(F.slice(F.split("ctx", " "), start - F.greatest(F.col("at") - (window - 1), F.lit(0)) + 1, F.col("len")), " ")
    found = (
        met.where("k > 0").join(prefix, "sh")
        .where((start >= 0) & (start + F.col("len") <= n))
        .where(words_at == F.col("w"))
        .select("doc_id", "tk", start.alias("start"), "len", "w")
        .distinct()
    )
    return met.where("k = 0").select("doc_id", "tk", "n_words"), found


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_rows: int = 500_000) -> DataFrame:
    """One row per document: words, hit words, items with an occurring window and the digest of their ids."""
    windows = stored(benchmark_windows(benchmark, window), "benchmark-windows")
    rows, found = find_occurrences(docs, windows, window, block_rows)
    found = stored(found, "benchmark-hits")
    end = F.col("start") + F.col("len")
    before = F.max(end).over(W.partitionBy("doc_id", "tk").orderBy("start", "len").rowsBetween(W.unboundedPreceding, -1))
    hits = (
        found.select("doc_id", "tk", "start", "len").distinct()
        .withColumn("new", F.greatest(end - F.greatest(F.col("start"), F.coalesce(before, F.lit(0))), F.lit(0)))
        .groupBy("doc_id", "tk").agg(F.sum("new").alias("n_hit"))
    )
    items = (
        found.select("doc_id", "tk", "w").distinct()
        .join(windows.select("w", "item_id"), "w")
        .groupBy("doc_id", "tk")
        .agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("ids"))
    )
    a, b = hits.alias("a"), items.alias("b")
    per_doc = a.join(b, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.tk") == F.col("b.tk"))).select("a.doc_id", "a.tk", "n_hit", "ids")
    ids = F.coalesce(F.col("ids"), F.array().cast("array<string>"))
    return (
        rows.alias("r").join(per_doc.alias("x"), F.col("r.doc_id").eqNullSafe(F.col("x.doc_id")) & (F.col("r.tk") == F.col("x.tk")), "left")
        .select(
            F.col("r.doc_id").alias("doc_id"),
            F.col("r.n_words").cast("long").alias("n_words"),
            F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.size(ids).cast("long").alias("n_items"),
            F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
            (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        )
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """Documents without any occurrence of an item window, all columns kept, whatever their names."""
    windows = stored(benchmark_windows(benchmark, window), "benchmark-windows")
    _, found = find_occurrences(docs, windows, window)
    bad = found.select(F.col("doc_id").alias("__id"), F.col("tk").alias("__tk")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__tk"))
    return apart(docs, ("__id", "__tk"), lambda rows: rows.join(bad, same, "left_anti"))
