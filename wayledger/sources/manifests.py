"""Numbered manifests: small JSON files, of which the newest says what a table consists of.

A manifest is written aside and renamed to its number, so it is there as a whole or not at all,
and of two writers that want the same number one fails and looks again.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Manifests:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def files(self):
        return self.path(self.root).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def names(self, path: str) -> list[str]:
        """What lies in a folder; nothing where there is none."""
        files, at = self.files(), self.path(path)
        return [f.getPath().getName() for f in files.listStatus(at)] if files.exists(at) else []

    def delete(self, path: str) -> None:
        self.files().delete(self.path(path), True)

    def _file(self, version: int) -> str:
        return f"{self.root}/manifests/{version:010d}"

    def versions(self) -> list[int]:
        return sorted(int(n) for n in self.names(f"{self.root}/manifests") if n.isdigit())

    def read(self, version: int) -> dict:
        stream = self.files().open(self.path(self._file(version)))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def publish(self, entry: dict) -> bool:
        """Put the manifest of ``entry["version"]`` in place; false if its number is taken."""
        jvm, files = self.spark._jvm, self.files()
        draft, final = self.path(f"{self.root}/drafts/{uuid.uuid4().hex}"), self.path(self._file(entry["version"]))
        out = files.create(draft, False)
        out.write(bytearray(json.dumps(entry), "utf-8"))
        out.close()
        files.mkdirs(final.getParent())
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        keep = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        keep[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            context.rename(draft, final, keep)
        except Exception as e:  # the bridge's error of a Java exception
            files.delete(draft, True)
            if "FileAlreadyExists" not in str(e):
                raise
            return False
        return True

    def forget(self, keep: int) -> list[dict]:
        """Delete all but the newest ``keep`` manifests; what those that are left say."""
        known = self.versions()
        kept = [self.read(v) for v in known[-keep:]]
        for v in known[:-keep]:
            self.delete(self._file(v))
        return kept
