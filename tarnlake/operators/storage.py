"""Small metadata files of a table, on whatever file system Hadoop can reach."""

from __future__ import annotations

import json
import os
import re
import tempfile
import threading
import time
import uuid
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: File systems whose rename is atomic and refuses a target that exists.
RENAMES = frozenset({"hdfs", "viewfs", "webhdfs", "ofs", "o3fs", "abfs", "abfss"})

#: Paths that are the same URI-encoded.
PLAIN = re.compile(r"[A-Za-z0-9_.=/~-]+")


class ConflictError(RuntimeError):
    """Somebody else committed first."""


@dataclass(frozen=True)
class Entry:
    path: str  # relative to the store's root, URI-encoded
    size: int
    modified: int


class Store:
    def __init__(self, spark: SparkSession, root: str) -> None:
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())
        self.root = self.fs.makeQualified(self._path(root)).toUri().toString().rstrip("/")
        self.local = urlparse(self.root).scheme in ("", "file")

    def uri(self, rel: str) -> str:
        """What Spark's readers and writers take for a (URI-encoded) relative path."""
        return f"{unquote(self.root)}/{unquote(rel)}" if rel else unquote(self.root)

    def at(self, rel: str):
        return self._path(self.uri(rel))

    def exists(self, rel: str) -> bool:
        return self.fs.exists(self.at(rel))

    def read(self, rel: str) -> str:
        stream = self.fs.open(self.at(rel))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, rel: str, text: str) -> None:
        stream = self.fs.create(self.at(rel), True)
        stream.write(bytearray(text.encode()))
        stream.close()

    def create(self, rel: str, text: str) -> None:
        """Write a file that mustn't exist yet; readers see all of it or nothing."""
        if self.local:
            target = urlparse(self.uri(rel)).path
            os.makedirs(os.path.dirname(target), exist_ok=True)
            temporary = f"{target}.{uuid.uuid4().hex}.tmp"
            with open(temporary, "w") as f:
                f.write(text)
            try:
                os.link(temporary, target)
            except FileExistsError:
                raise ConflictError(rel) from None
            finally:
                os.unlink(temporary)
            return
        if self.exists(rel):
            raise ConflictError(rel)
        if urlparse(self.root).scheme in RENAMES:
            temporary = f"{rel}.{uuid.uuid4().hex}.tmp"
            self.write(temporary, text)
            if not self.fs.rename(self.at(temporary), self.at(rel)):
                self.delete(temporary)
                raise ConflictError(rel)
            return
        # an object appears when its stream is closed; the store refuses a second one of that name
        try:
            stream = self.fs.createFile(self.at(rel)).overwrite(False).recursive().opt("fs.option.create.conditional.overwrite", "true").build()
            stream.write(bytearray(text.encode()))
            stream.close()
        except Py4JJavaError as e:
            raise ConflictError(rel) from e

    def move(self, old: str, new: str) -> None:
        self.fs.mkdirs(self.at(new).getParent())
        if not self.fs.rename(self.at(old), self.at(new)):
            raise ConflictError(new)

    def modified(self, rel: str) -> int:
        return self.fs.getFileStatus(self.at(rel)).getModificationTime()

    def names(self, rel: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.at(rel))) if self.exists(rel) else []

    def walk(self, rel: str) -> list[Entry]:
        """All files below rel."""
        if not self.exists(rel):
            return []
        if self.local:
            return self._walk_local(rel)
        out, found = [], self.fs.listFiles(self.at(rel), True)
        base = self.fs.makeQualified(self._path(unquote(self.root))).toUri().getRawPath().rstrip("/") + "/"
        while found.hasNext():
            s = found.next()
            out.append(Entry(s.getPath().toUri().getRawPath().removeprefix(base), s.getLen(), s.getModificationTime()))
        return sorted(out, key=lambda e: e.path)

    def _walk_local(self, rel: str) -> list[Entry]:
        """The same without a JVM call for each file (Hadoop's listing of local files starts a process for each, to learn its permissions)."""
        root, top, out = urlparse(self.root), self.at(rel).toUri().getPath(), []
        base = unquote(root.path).rstrip("/") + "/"
        for folder, _, names in os.walk(top, followlinks=True) if os.path.isdir(top) else [(os.path.dirname(top), [], [os.path.basename(top)])]:
            for n in names:
                if n.startswith(".") and n.endswith(".crc"):
                    continue
                whole = os.path.join(folder, n)
                path, info = whole.removeprefix(base), os.stat(whole)
                out.append(Entry(path if PLAIN.fullmatch(path) else self._path(whole).toUri().getRawPath().removeprefix(self._path(base).toUri().getRawPath().rstrip("/") + "/"), info.st_size, info.st_mtime_ns // 1_000_000))
        return sorted(out, key=lambda e: e.path)

    def delete(self, rel: str) -> None:
        self.fs.delete(self.at(rel), True)

    def read_json(self, rel: str) -> dict:
        return json.loads(self.read(rel))


class MemoryStore:
    """A store whose files live in this process; uri() points below a root where tables keep their data."""

    def __init__(self, root: str) -> None:
        self.root, self._files, self._lock = root.rstrip("/"), {}, threading.Lock()

    def uri(self, rel: str) -> str:
        return f"{self.root}/{rel}" if rel else self.root

    def exists(self, rel: str) -> bool:
        return rel in self._files or bool(self.names(rel))

    def read(self, rel: str) -> str:
        if rel not in self._files:
            raise FileNotFoundError(rel)
        return self._files[rel]

    def write(self, rel: str, text: str) -> None:
        self._files[rel] = text

    def create(self, rel: str, text: str) -> None:
        with self._lock:
            if rel in self._files:
                raise ConflictError(rel)
            self._files[rel] = text

    def names(self, rel: str) -> list[str]:
        below = f"{rel}/" if rel else ""
        return sorted({p.removeprefix(below).split("/")[0] for p in self._files if p.startswith(below)})

    def delete(self, rel: str) -> None:
        for p in [p for p in self._files if p == rel or p.startswith(f"{rel}/")]:
            del self._files[p]

    def read_json(self, rel: str) -> dict:
        return json.loads(self.read(rel))


def now_ms() -> int:
    return int(time.time() * 1000)


def pieces(df: DataFrame, least: int, rows: int) -> int:
    """Into how many parts a frame goes so that each has so many rows at most, on average: least, or more."""
    return max(least, -(-df.count() // rows))


def spread(df: DataFrame) -> tuple[int, int]:
    """How many rows a frame has, and how many its largest partition has. Only counts are shuffled, one for each partition."""
    n, most = df.groupBy(F.spark_partition_id()).count().agg(F.sum("count"), F.max("count")).first()
    return n or 0, most or 0


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share: below spark.checkpoint.dir, or, where that is unset, a local temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tarnlake-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tarnlake/{name}-{uuid.uuid4().hex}"
