"""Delta-maintained token counts by source, language and tokenizer version.

Changes are signed: an insert adds a document and its tokens, a delete takes them away, a revision adds
the difference (and moves the document when its source or language changed). Totals are additive, so a
batch is one partial aggregate and never rereads earlier documents. ``TokenLedger`` writes each batch's sums
to a folder of its own and then commits it by the batch's marker, which names that folder: a marker gets its
name by a rename that does not overwrite, whole or not at all, so of two writers of one batch the first wins, a
half-written batch counts for nothing, and a batch that is committed again changes nothing. ``compact`` folds
the committed batches into one, so that totals read one folder and the batches since.

Defined cases: null source or language is a group of its own; null texts have no token; repeated rows are
counted as often as they are given; groups whose documents and tokens both return to zero leave the
totals; an empty batch commits and adds nothing; other columns are ignored.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catascope.llm.common import by_value
from catascope.llm.tokens import WordEncoder

KEYS = ("source", "lang", "tokenizer_version")
SCHEMA = "source string, lang string, tokenizer_version string, d_docs long, d_tokens long"


def count_tokens(docs: DataFrame, path: str, version: str) -> DataFrame:
    """``docs`` columns doc_id, source, lang, n_chars with tokenizer_version and exact n_tokens."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encoder = WordEncoder(path)
        for batch in batches:
            n = pa.array([len(encoder.ids(t.as_py())) // 4 for t in batch.column(batch.num_columns - 1)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], n], names=[*batch.schema.names[:-1], "n_tokens"])

    kept = docs.select("doc_id", "source", "lang", "n_chars", "text")
    schema = ", ".join(f"{c} {t}" for c, t in kept.dtypes if c != "text") + ", n_tokens long"
    return kept.mapInArrow(run, schema).withColumn("tokenizer_version", F.lit(version))


def inserted(rows: DataFrame, tokens: str = "n_tokens") -> DataFrame:
    return rows.select(*KEYS, F.lit(1).cast("long").alias("d_docs"), F.col(tokens).cast("long").alias("d_tokens"))


def deleted(rows: DataFrame, tokens: str = "n_tokens") -> DataFrame:
    return inserted(rows, tokens).withColumns({"d_docs": -F.col("d_docs"), "d_tokens": -F.col("d_tokens")})


def revised(rows: DataFrame, old_tokens: str, new_tokens: str, old_source: str = "source", old_lang: str = "lang") -> DataFrame:
    """Old contribution out, new contribution in; both signs of one row meet in the partial aggregate."""
    change = F.array(
        F.struct(F.col(old_source).alias("source"), F.col(old_lang).alias("lang"), F.lit(-1).cast("long").alias("d_docs"), (-F.col(old_tokens)).cast("long").alias("d_tokens")),
        F.struct(F.col("source").alias("source"), F.col("lang").alias("lang"), F.lit(1).cast("long").alias("d_docs"), F.col(new_tokens).cast("long").alias("d_tokens")),
    )
    return rows.select("tokenizer_version", F.explode(change).alias("c")).select("c.source", "c.lang", "tokenizer_version", "c.d_docs", "c.d_tokens")


class TokenLedger:
    """Committed batches of signed changes under ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, name: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _mark(self, name: str, folder: str, batches: list[str]) -> bool:
        """Make a marker, whole or not at all: a draft takes its name by a rename that does not overwrite. False where it exists.

        A writer that ends before the rename leaves a hidden draft, and the batch can be committed again. Errors other
        than an existing marker are raised.
        """
        at, fs = self._at(f"commits/{name}")
        if fs.exists(at):
            return False
        draft, _ = self._at(f"commits/.draft-{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps([folder, batches]).encode()))
        out.close()
        jvm = self.spark._jvm
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(at).toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(fs.makeQualified(draft), fs.makeQualified(at), options)
        except Py4JJavaError as e:
            fs.delete(draft, False)
            if e.java_exception.getClass().getSimpleName() != "FileAlreadyExistsException":
                raise
            return False  # another writer came first
        return True

    def _markers(self) -> dict[str, tuple[str, list[str]]]:
        """Folder and batches of every marker: a small file per batch."""
        at, fs = self._at("commits")
        if not fs.exists(at):
            return {}
        rows = self.spark.read.option("wholetext", True).text(at.toString()).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"), "value").collect()
        return {r["name"]: tuple(json.loads(r["value"])) for r in rows}

    def _write(self, rows: DataFrame) -> str:
        folder = f"data-{uuid.uuid4().hex}"
        rows.groupBy(*KEYS).agg(F.sum("d_docs").alias("d_docs"), F.sum("d_tokens").alias("d_tokens")).write.parquet(f"{self.path}/{folder}")
        return folder

    def _live(self, markers: dict[str, tuple[str, list[str]]]) -> list[str]:
        """Folders that together hold every batch once: the compaction of most batches and the batches since."""
        folded = max((m for n, m in markers.items() if n.startswith("compact-")), key=lambda m: len(m[1]), default=(None, []))
        folders = [f for n, (f, _) in markers.items() if n.startswith("batch-") and n not in folded[1]]
        return [*folders, folded[0]] if folded[0] else folders

    def _changes(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(*[f"{self.path}/{f}" for f in folders])

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Aggregate and commit the batch; False (and no work) if it was committed before."""
        at, fs = self._at(f"commits/batch-{batch_id}")
        return not fs.exists(at) and self._mark(f"batch-{batch_id}", self._write(changes), [])

    def compact(self) -> bool:
        """Fold all batches that are committed now; later totals read their sums instead. Changes no total."""
        markers = self._markers()
        batches = sorted(n for n in markers if n.startswith("batch-"))
        return bool(batches) and self._mark(f"compact-{len(batches)}-{uuid.uuid4().hex}", self._write(self._changes(self._live(markers))), batches)

    def totals(self) -> DataFrame:
        sums = self._changes(self._live(self._markers())).groupBy(*KEYS).agg(F.sum("d_docs").alias("n_docs"), F.sum("d_tokens").alias("n_tokens"))
        return sums.where("n_docs <> 0 or n_tokens <> 0")


by_value(__name__)
