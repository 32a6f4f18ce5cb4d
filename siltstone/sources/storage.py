"""Files through Hadoop's file system API, so that a table may lie in any store Spark reaches."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Storage:
    def __init__(self, spark: SparkSession, root: str):
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        path = self._path(root)
        self._fs = path.getFileSystem(self._conf)
        self._fs.setWriteChecksum(False)
        self.root = self._fs.makeQualified(path).toString()

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def at(self, *parts: str) -> str:
        return "/".join([self.root, *parts])

    def names(self, folder: str) -> list[str]:
        """Names in a folder, sorted; none where it does not exist."""
        path = self._path(self.at(folder) if folder else self.root)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def size(self, path: str) -> int:
        """Bytes of a file, or of all files below a folder."""
        return self._fs.getContentSummary(self._path(path)).getLength()

    def make(self, folder: str) -> None:
        self._fs.mkdirs(self._path(self.at(folder)))

    def read(self, path: str) -> bytes:
        stream = self._fs.open(self._path(path))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def create(self, path: str, data: bytes) -> bool:
        """Writes a file that must not exist yet; False if another writer was first.

        The bytes go to a name of their own and are then renamed, so no reader
        sees half a file.
        """
        import uuid

        target, own = self._path(path), self._path(f"{path}.{uuid.uuid4().hex}.tmp")
        if self._fs.exists(target):
            return False
        stream = self._fs.create(own, False)
        stream.write(bytearray(data))
        stream.close()
        if not self._fs.exists(target) and self._fs.rename(own, target):
            return True
        self._fs.delete(own, False)
        return False

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)
