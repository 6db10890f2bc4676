"""Small files on any file system that Spark can write: whole or not there at all."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Folder:
    """A folder on the file system of its path."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.gateway = spark.sparkContext._gateway
        self.path = path.rstrip("/")
        self.fs = self._at("").getFileSystem(self.conf)

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, name: str = "") -> dict[str, int]:
        """What lies in a folder, by name, with its time in milliseconds; nothing where there is none."""
        at = self._at(name)
        if not self.fs.exists(at):
            return {}
        return {s.getPath().getName(): s.getModificationTime() for s in self.fs.listStatus(at)}

    def read(self, name: str) -> str | None:
        try:
            stream = self.fs.open(self._at(name))
        except Py4JJavaError as e:
            if "FileNotFoundException" in str(e.java_exception.getClass().getName()):
                return None
            raise
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Make a file with its whole content, unless there is one of that name: then False.

        The content is written beside it and renamed, without leave to overwrite. A name
        node does that in one step; a file system that cannot needs a single writer.
        """
        beside, target = self._at(f".{uuid.uuid4().hex}"), self._at(name)
        stream = self.fs.create(beside, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        self.fs.mkdirs(target.getParent())
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        options = self.gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(self.fs.makeQualified(beside), self.fs.makeQualified(target), options)
        except Py4JJavaError as e:
            self.fs.delete(beside, False)
            if "FileAlreadyExistsException" in str(e.java_exception.getClass().getName()):
                return False
            raise
        return True

    def remove(self, name: str) -> bool:
        return self.fs.delete(self._at(name), True)
