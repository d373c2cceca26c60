"""Folders and small files through Hadoop's file systems, and replacing a folder as a whole.

Paths may name any file system that Spark reads; one without a scheme is on the default one. Executors write the
tables and the driver only moves folders, reads hashes and writes small files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession


class Files:
    """The file system of a path."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark._jvm
        self._path = self.jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        return self.fs.exists(self._path(path))

    def make(self, path: str) -> None:
        self.fs.mkdirs(self._path(path))

    def rename(self, old: str, new: str) -> None:
        if not self.fs.rename(self._path(old), self._path(new)):
            raise OSError(f"could not rename {old} to {new}")

    def delete(self, path: str) -> None:
        self.fs.delete(self._path(path), True)

    def claim(self, path: str) -> bool:
        """Makes an empty file, if there is none yet."""
        return self.fs.createNewFile(self._path(path))

    def names(self, folder: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._path(folder)))

    def under(self, folder: str) -> list[str]:
        """Paths of the files below a folder, relative to it, without hidden ones and marks of completion."""
        root = self.fs.makeQualified(self._path(folder)).toString().rstrip("/") + "/"
        found, each = [], self.fs.listFiles(self._path(folder), True)
        while each.hasNext():
            name = each.next().getPath().toString().removeprefix(root)
            if not any(part.startswith((".", "_")) for part in name.split("/")):
                found.append(name)
        return sorted(found)

    def write(self, path: str, text: str) -> None:
        out = self.fs.create(self._path(path), True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def read(self, path: str) -> str:
        data = self.fs.open(self._path(path))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(data)).decode()
        finally:
            data.close()

    def sha256(self, path: str) -> str:
        """The hash of a file of any size, read in pieces."""
        data = self.fs.open(self._path(path))
        try:
            return self.jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(data)
        finally:
            data.close()


def _beside(target: str, kind: str) -> str:
    folder, _, name = target.rstrip("/").rpartition("/")
    return f"{folder}/.{name}.{kind}" if folder else f".{name}.{kind}"


def recover(files: Files, target: str) -> None:
    """Puts back what a broken-off swap left behind."""
    backup = _beside(target, "backup")
    if files.exists(backup):
        if files.exists(target):
            files.delete(backup)
        else:
            files.rename(backup, target)


def replace_directory(spark: SparkSession, target: str, write: Callable[[str], None]) -> None:
    """Lets write() fill a stage, then swaps it for the target; on failure the old target stays.

    A lock file beside the target keeps out a second writer. One that a crash left behind has to be deleted by hand.
    """
    target = str(target).rstrip("/")
    files = Files(spark, target)
    stage, backup, lock = (_beside(target, kind) for kind in ("stage", "backup", "lock"))
    if not files.claim(lock):
        raise RuntimeError(f"another writer holds {lock}")
    try:
        recover(files, target)
        files.delete(stage)
        files.make(stage)
        try:
            write(stage)
            held = files.exists(target)
            if held:
                files.rename(target, backup)
            try:
                files.rename(stage, target)
            except Exception:
                if held:
                    files.rename(backup, target)
                raise
            files.delete(backup)
        finally:
            files.delete(stage)
    finally:
        files.delete(lock)
