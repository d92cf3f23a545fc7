"""The few file operations of the store, through Hadoop's file system so that any path Spark can use will do."""

from __future__ import annotations

from pyspark.sql import SparkSession

from quarry.errors import StorageError


class Files:
    def __init__(self, spark: SparkSession, root: str):
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._io = jvm.org.apache.commons.io.IOUtils
        self.root = root.rstrip("/")

    def full(self, name: str) -> str:
        return f"{self.root}/{name}" if name else self.root

    def names(self, folder: str = "") -> list[str]:
        p = self._path(self.full(folder))
        return sorted(s.getPath().getName() for s in self._fs.listStatus(p)) if self._fs.exists(p) else []

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(self.full(name)))
        try:
            return self._io.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Writes a new file under its final name; False if another writer has made it first."""
        final, draft = self._path(self.full(name)), self._path(self.full(f"{name}.draft-{id(text)}"))
        stream = self._fs.create(draft, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        if self._fs.exists(final):
            self._fs.delete(draft, False)
            return False
        lock = self._path(self.full(f"{name}.lock"))
        try:
            self._fs.create(lock, False).close()  # exclusive: of several writers one gets it
        except Exception:
            self._fs.delete(draft, False)
            return False
        if not self._fs.rename(draft, final):
            raise StorageError(f"can't write {name}")
        return True

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(self.full(name)), True)
