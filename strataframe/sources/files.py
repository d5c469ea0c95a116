"""Small files on whatever storage Spark reaches, through Hadoop's FileSystem."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Files:
    """Paths are relative to ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)

    def at(self, name: str) -> str:
        return f"{self.root}/{name}" if name else self.root

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(self.at(name))

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._path(name))

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Write a file that must not exist yet; False if it does. The storage decides races."""
        try:
            stream = self._fs.create(self._path(name), False)
        except Py4JJavaError as e:
            if "AlreadyExists" in str(e.java_exception.getClass().getName()) or self.exists(name):
                return False
            raise
        stream.write(bytearray(text.encode()))
        stream.close()
        return True

    def write(self, name: str, text: str) -> None:
        """Write a file in full and put it in place by one rename, so a reader sees the old or the new one."""
        draft = f"{name}.{uuid.uuid4().hex}.tmp"
        self.create(draft, text)
        options = self._jvm.org.apache.hadoop.fs.Options
        over = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        over[0] = getattr(options, "Rename").OVERWRITE
        source = self._fs.makeQualified(self._path(draft))
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(source.toUri(), self._conf).rename(source, self._fs.makeQualified(self._path(name)), over)

    def rename(self, name: str, to: str) -> None:
        """Put a file or folder in another place, whose parent is made; the place must be free."""
        target = self._path(to)
        self._fs.mkdirs(target.getParent())
        if not self._fs.rename(self._path(name), target):
            raise OSError(f"{name} could not be renamed to {to}")

    def delete(self, name: str = "") -> bool:
        return self._fs.delete(self._path(name), True)

    def names(self, name: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(name))) if self.exists(name) else []

    def size(self, name: str = "") -> int:
        return self._fs.getContentSummary(self._path(name)).getLength() if self.exists(name) else 0

    def read_json(self, name: str, default=None):
        return json.loads(self.read(name)) if self.exists(name) else default

    def write_json(self, name: str, value) -> None:
        self.write(name, json.dumps(value, sort_keys=True))
