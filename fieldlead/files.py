"""Places in whatever file system the cluster's paths point to, through the file system interface that Spark itself writes with."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Place(str):
    """A path, local or with a scheme; ``place / "name"`` is a place in it."""

    def __truediv__(self, name: str) -> Place:
        return Place(f"{self.rstrip('/')}/{name}")

    @property
    def name(self) -> str:
        return self.rstrip("/").rsplit("/", 1)[-1]

    def sibling(self, name: str) -> Place:
        head, slash, _ = self.rstrip("/").rpartition("/")
        return Place(f"{head}{slash}{name}")

    def _open(self):
        """(file system, path). A local file system is used without its checksum files, which hand-edited files would break."""
        spark = SparkSession.getActiveSession()
        if spark is None:
            raise RuntimeError(f"{self}: reading and writing needs an active session")
        path = spark._jvm.org.apache.hadoop.fs.Path(str(self))
        system = path.getFileSystem(spark._jsc.hadoopConfiguration())
        return (system.getRawFileSystem() if system.getScheme() == "file" else system), path

    def exists(self) -> bool:
        system, path = self._open()
        return system.exists(path)

    def modified(self) -> int:
        """Milliseconds since the epoch."""
        system, path = self._open()
        return system.getFileStatus(path).getModificationTime()

    def delete(self) -> None:
        """With all that is in it; what is not there needs no deleting."""
        system, path = self._open()
        system.delete(path, True)

    def make(self) -> Place:
        system, path = self._open()
        system.mkdirs(path)
        return self

    def rename(self, target: Place) -> None:
        system, path = self._open()
        if not system.exists(path) or not system.rename(path, target._open()[1]):
            raise OSError(f"{self} could not be renamed to {target}")

    def read_text(self) -> str:
        system, path = self._open()
        stream = system.open(path)
        try:
            return SparkSession.getActiveSession()._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_text(self, text: str) -> None:
        system, path = self._open()
        stream = system.create(path, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def inside(self) -> list[Place]:
        """What lies directly in this folder, by time of change, then by name."""
        system, path = self._open()
        if not system.exists(path):
            return []
        found = [(s.getModificationTime(), s.getPath().getName()) for s in system.listStatus(path)]
        return [self / name for _, name in sorted(found)]
