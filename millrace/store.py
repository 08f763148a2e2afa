"""Small text files on any file system that Spark reaches; a file appears whole or not at all."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.root = root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._gateway, self._conf = spark.sparkContext._gateway, spark.sparkContext._jsc.hadoopConfiguration()
        self._files = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self._files.exists(self._path(name))

    def read(self, name: str) -> str:
        stream = self._files.open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str, replace: bool = False) -> bool:
        """False if the file was there already and is not to be replaced."""
        aside, target = self._path(f"{name}.{uuid.uuid4().hex}.new"), self._path(name)
        stream = self._files.create(aside, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        if not replace:
            if self._files.exists(target):
                self._files.delete(aside, False)
                return False
            return self._files.rename(aside, target)
        hadoop = self._jvm.org.apache.hadoop.fs
        options = self._gateway.new_array(hadoop.Options.Rename, 1)
        options[0] = hadoop.Options.Rename.OVERWRITE
        hadoop.FileContext.getFileContext(self._path("").toUri(), self._conf).rename(aside, target, options)  # the old file or the new one
        return True

    def names(self, folder: str) -> list[str]:
        if not self.exists(folder):
            return []
        return sorted(s.getPath().getName() for s in self._files.listStatus(self._path(folder)) if not s.getPath().getName().endswith(".new"))

    def delete(self, name: str) -> None:
        self._files.delete(self._path(name), True)
