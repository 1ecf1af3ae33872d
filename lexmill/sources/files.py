"""The few file operations a store needs, on any file system that Spark knows."""

from __future__ import annotations

import json
import tempfile
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


def settled(df: DataFrame) -> DataFrame:
    """``df`` as it is computed once, in the cluster's checkpoint folder (a temporary one only where none is named)."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="lexmill-"))
    return df.checkpoint(eager=True)


@dataclass
class Files:
    spark: SparkSession

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self, path: str):
        return self._path(path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        return self._fs(path).exists(self._path(path))

    def list(self, path: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs(path).listStatus(self._path(path))) if self.exists(path) else []

    def read(self, path: str) -> dict:
        stream = self._fs(path).open(self._path(path))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def create(self, path: str, value: dict, overwrite: bool = False) -> bool:
        """Write a new JSON file; False if it is there already."""
        try:
            stream = self._fs(path).create(self._path(path), overwrite)
        except Exception as e:
            if "FileAlreadyExists" in str(e) or "already exists" in str(e):
                return False
            raise
        stream.write(bytearray(json.dumps(value, sort_keys=True).encode()))
        stream.close()
        return True

    def replace(self, path: str, value: dict) -> None:
        """Put a new version in place of a JSON file, at once."""
        self.create(f"{path}.new", value, overwrite=True)
        jvm = self.spark._jvm
        rename = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = rename
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(path).toUri() if self._path(path).toUri().getScheme() else jvm.java.net.URI.create("file:///")).rename(self._path(f"{path}.new"), self._path(path), options)

    def move(self, source: str, target: str) -> bool:
        """Rename a folder; False if the target is there already."""
        if self.exists(target):
            return False
        return bool(self._fs(source).rename(self._path(source), self._path(target)))

    def copy(self, source: str, target: str) -> None:
        conf = self.spark._jsc.hadoopConfiguration()
        self.spark._jvm.org.apache.hadoop.fs.FileUtil.copy(self._fs(source), self._path(source), self._fs(target), self._path(target), False, conf)

    def make(self, path: str) -> None:
        self._fs(path).mkdirs(self._path(path))

    def delete(self, path: str) -> None:
        if self.exists(path):
            self._fs(path).delete(self._path(path), True)
