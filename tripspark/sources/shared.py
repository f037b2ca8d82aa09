"""The folder that the driver and all executors share, and small files in it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset and Spark is one process (as in tests), a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tripspark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call uses."""
    return f"{shared_dir(spark)}/tripspark-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}/{name}"


class Files:
    """A folder's small files, on whatever store Spark reads."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark.sparkContext._jvm, root
        self.fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        """Names in a folder; none if it does not exist."""
        if not self.fs.exists(self._path(folder)):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._path(folder)))

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def put_new(self, name: str, text: str) -> bool:
        """Write a file whole under a name that must be free; False if another writer has it."""
        draft = f"{name.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}"
        stream = self.fs.create(self._path(draft))
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if not self.fs.exists(self._path(name)) and self.fs.rename(self._path(draft), self._path(name)):
            return True
        self.fs.delete(self._path(draft), False)
        return False

    def remove(self, name: str) -> None:
        self.fs.delete(self._path(name), True)
