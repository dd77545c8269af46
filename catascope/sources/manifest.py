"""A table as a versioned list of Parquet folders: parts are replaced whole, readers see one version or the next."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from catascope.sources.scratch import remove


class Manifest:
    """Versions are small files in ``path/_manifest``, each made by a rename that does not overwrite.

    Two writers of the same next version cannot both commit: the second gets an error and may begin again from the
    version that is now the latest. A writer that ends before its rename leaves unlisted folders only. Content is a
    dictionary whose ``parts`` map a name to {"folder": ..., ...}; folders are relative to ``path``.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        jvm = spark._jvm
        self._at = jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        folder = self._at(f"{self.path}/_manifest")
        if not self._fs.exists(folder):
            return []
        return sorted(int(f.getPath().getName()) for f in self._fs.listStatus(folder) if f.getPath().getName().isdigit())

    def read(self, version: int | None = None) -> tuple[int, dict]:
        """(version, content) of the latest or a given version; (0, no parts) where nothing is committed."""
        known = self.versions()
        if not known:
            return 0, {"parts": {}}
        version = known[-1] if version is None else version
        stream = self._fs.open(self._at(f"{self.path}/_manifest/{version}"))
        text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return version, json.loads(text)

    def commit(self, version: int, content: dict) -> None:
        """Make ``content`` the given version; an error if another writer has made it."""
        jvm = self.spark._jvm
        draft, final = self._at(f"{self.path}/_manifest/.{version}-{uuid.uuid4().hex}"), self._at(f"{self.path}/_manifest/{version}")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri() if final.toUri().getScheme() else self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        none[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            context.rename(draft, final, none)
        except Exception:
            self._fs.delete(draft, False)
            raise

    def folder(self, name: str) -> str:
        """A fresh relative folder for a part that is being written."""
        return f"{name}-{uuid.uuid4().hex[:12]}"

    def load(self, content: dict, schema, names=None) -> DataFrame:
        """The rows of all parts, or of those named."""
        parts = content["parts"]
        folders = [f"{self.path}/{parts[n]['folder']}" for n in (parts if names is None else names) if n in parts]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def clean(self, keep: int = 2) -> None:
        """Remove older versions and the folders that only they list."""
        known = self.versions()
        listed = lambda v: {p["folder"] for p in self.read(v)[1]["parts"].values()}
        live = set().union(*(listed(v) for v in known[-keep:])) if known else set()
        for v in known[:-keep]:
            for f in listed(v) - live:
                remove(self.spark, f"{self.path}/{f}")
            remove(self.spark, f"{self.path}/_manifest/{v}")
