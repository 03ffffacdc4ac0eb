"""Files and the atomic publishing of log records, on local disks and on anything Hadoop's file systems reach."""

from __future__ import annotations

import contextlib
import json
import os
import shutil
import urllib.parse
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import SparkSession


def store_for(spark: SparkSession, root: str) -> Store:
    scheme = urllib.parse.urlparse(root).scheme
    return LocalStore(root.removeprefix("file://")) if scheme in ("", "file") else HadoopStore(spark, root)


class Store:
    """Paths are relative to the root."""

    root: str
    #: Session options under which Spark looks for files here.
    listing: dict[str, str] = {}

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def url(self, name: str) -> str:
        """A path for Spark."""
        return self.path(name)

    def read(self, name: str) -> str | None:
        raise NotImplementedError

    def publish(self, name: str, text: str) -> bool:
        """Writes a whole new file at once; False if there is one by that name."""
        raise NotImplementedError

    def replace(self, name: str, text: str) -> None:
        raise NotImplementedError

    def names(self, folder: str) -> list[str]:
        raise NotImplementedError

    def delete(self, name: str) -> None:
        raise NotImplementedError

    def move(self, source: str, target: str) -> None:
        raise NotImplementedError

    def walk(self, folder: str) -> Iterator[tuple[str, float]]:
        """Every file below a folder, and when it was last changed (seconds since the epoch)."""
        raise NotImplementedError

    def move_all(self, pairs: list[tuple[str, str]]) -> None:
        with ThreadPoolExecutor(16) as pool:
            list(pool.map(lambda p: self.move(*p), pairs))


class LocalStore(Store):
    """A folder. A record is linked into place, which only one writer can do."""

    #: A local look-up takes microseconds, a Spark job for the look-ups a third of a second.
    listing = {"spark.sql.sources.parallelPartitionDiscovery.threshold": "100000"}  # noqa: RUF012

    def __init__(self, root: str) -> None:
        self.root = os.path.abspath(root)

    def url(self, name: str) -> str:
        return f"file://{self.path(name)}"

    def read(self, name: str) -> str | None:
        try:
            with open(self.path(name)) as file:
                return file.read()
        except FileNotFoundError:
            return None

    def _write(self, name: str, text: str) -> str:
        path = self.path(name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        draft = f"{os.path.dirname(path)}/.{uuid.uuid4().hex}.tmp"
        with open(draft, "w") as file:
            file.write(text)
            file.flush()
            os.fsync(file.fileno())
        return draft

    def publish(self, name: str, text: str) -> bool:
        draft = self._write(name, text)
        try:
            os.link(draft, self.path(name))
        except FileExistsError:
            return False
        finally:
            os.unlink(draft)
        return True

    def replace(self, name: str, text: str) -> None:
        os.replace(self._write(name, text), self.path(name))

    def names(self, folder: str) -> list[str]:
        try:
            return sorted(n for n in os.listdir(self.path(folder)) if not n.startswith("."))
        except FileNotFoundError:
            return []

    def walk(self, folder: str) -> Iterator[tuple[str, float]]:
        for top, _, names in os.walk(self.path(folder)):
            for n in names:
                path = os.path.join(top, n)
                with contextlib.suppress(FileNotFoundError):
                    yield os.path.relpath(path, self.root), os.stat(path).st_mtime

    def delete(self, name: str) -> None:
        path = self.path(name)
        if os.path.isdir(path):
            shutil.rmtree(path, ignore_errors=True)
        elif os.path.exists(path):
            os.unlink(path)

    def move(self, source: str, target: str) -> None:
        os.makedirs(os.path.dirname(self.path(target)), exist_ok=True)
        os.rename(self.path(source), self.path(target))


class HadoopStore(Store):
    """A Hadoop file system. Records are renamed into place, refusing to overwrite.

    That is atomic on HDFS and the like. An object store without conditional writes needs a store of its own here.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.root = root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        top = self._jvm.org.apache.hadoop.fs.Path(self.root)
        self._fs = top.getFileSystem(conf)
        self._context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(top.toUri(), conf)

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(self.path(name))

    def read(self, name: str) -> str | None:
        if not self._fs.exists(self._at(name)):
            return None
        stream = self._fs.open(self._at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _write(self, name: str, text: str):
        draft = self._at(f"{os.path.dirname(name)}/.{uuid.uuid4().hex}.tmp")
        stream = self._fs.create(draft, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        return draft

    def _rename(self, draft, name: str, kind: str) -> None:
        options = self._jvm.org.apache.hadoop.fs.Options.Rename
        chosen = self._jvm.java.lang.reflect.Array.newInstance(options.NONE.getClass(), 1)
        chosen[0] = getattr(options, kind)
        self._context.rename(draft, self._at(name), chosen)

    def publish(self, name: str, text: str) -> bool:
        draft = self._write(name, text)
        try:
            self._rename(draft, name, "NONE")
        except Exception:
            self._fs.delete(draft, False)
            if self._fs.exists(self._at(name)):
                return False
            raise
        return True

    def replace(self, name: str, text: str) -> None:
        self._rename(self._write(name, text), name, "OVERWRITE")

    def names(self, folder: str) -> list[str]:
        if not self._fs.exists(self._at(folder)):
            return []
        found = (s.getPath().getName() for s in self._fs.listStatus(self._at(folder)))
        return sorted(n for n in found if not n.startswith("."))

    def walk(self, folder: str) -> Iterator[tuple[str, float]]:
        if not self._fs.exists(self._at(folder)):
            return
        top = self._fs.makeQualified(self._at("")).toUri().getPath().rstrip("/")
        found = self._fs.listFiles(self._at(folder), True)
        while found.hasNext():
            status = found.next()
            yield status.getPath().toUri().getPath()[len(top) + 1 :], status.getModificationTime() / 1000

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)

    def move(self, source: str, target: str) -> None:
        self._fs.mkdirs(self._at(target).getParent())
        if not self._fs.rename(self._at(source), self._at(target)):
            raise OSError(f"can't move {source} to {target}")


def dumps(value: object) -> str:
    return json.dumps(value, separators=(",", ":"), sort_keys=True)
