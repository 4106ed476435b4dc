"""Small driver-side files through Hadoop's file system, so that a store may lie wherever Spark reads."""

from __future__ import annotations

import json
import os
import socket
import time
import uuid

from pyspark.sql import SparkSession

from ..errors import LockError


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark._jvm, root.rstrip("/")
        self.conf = spark._jsc.hadoopConfiguration()
        # an instance of its own: files that others may edit by hand carry no checksum files beside them
        self.fs = self.jvm.org.apache.hadoop.fs.FileSystem.newInstance(self._path(self.root).toUri(), self.conf)
        self.fs.setWriteChecksum(False)
        self.fs.setVerifyChecksum(False)

    def _path(self, p: str):
        return self.jvm.org.apache.hadoop.fs.Path(p)

    def at(self, *names: str) -> str:
        return "/".join([self.root, *names])

    def exists(self, path: str) -> bool:
        return self.fs.exists(self._path(path))

    def mkdirs(self, path: str) -> None:
        self.fs.mkdirs(self._path(path))

    def delete(self, path: str) -> None:
        self.fs.delete(self._path(path), True)

    def rename(self, a: str, b: str) -> bool:
        return self.exists(a) and self.fs.rename(self._path(a), self._path(b))

    def listed(self, path: str) -> list[tuple[str, int]]:
        """(name, bytes) of what a folder holds, or of the file that the path names."""
        return sorted((s.getPath().getName(), s.getLen()) for s in self.fs.listStatus(self._path(path))) if self.exists(path) else []

    def _copied(self, source, target, n: int | None = None) -> None:
        if n is None:
            self.jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, target, 1 << 20, False)
        else:  # Hadoop's own takes a small number for a buffer's size
            self.jvm.org.apache.commons.io.IOUtils.copyLarge(source, target, 0, n)

    def joined(self, folder: str, path: str) -> None:
        """One file of a folder's part files, one after another; the bytes stay in the JVM, a buffer at a time."""
        out = self.fs.create(self._path(path), True)
        try:
            for name in self.names(folder):
                if name.startswith("part-"):
                    stream = self.fs.open(self._path(f"{folder}/{name}"))
                    try:
                        self._copied(stream, out)
                    finally:
                        stream.close()
        finally:
            out.close()

    def to_local(self, path: str, local: str) -> None:
        self.fs.copyToLocalFile(False, self._path(path), self._path("file://" + os.path.abspath(local)), True)

    def from_local(self, local: str, path: str) -> None:
        self.fs.copyFromLocalFile(False, True, self._path("file://" + os.path.abspath(local)), self._path(path))

    def last_newline(self, path: str, size: int) -> int:
        """Bytes up to and including the file's last line feed, read backwards a block at a time."""
        stream, end = self.fs.open(self._path(path)), size
        try:
            while end > 0:
                begin = max(0, end - (1 << 16))
                stream.seek(begin)
                at = bytes(stream.readNBytes(end - begin)).rfind(b"\n")
                if at >= 0:
                    return begin + at + 1
                end = begin
            return 0
        finally:
            stream.close()

    def shorten(self, path: str, size: int) -> None:
        """Keeps the first `size` bytes of a file, by a copy that takes its place."""
        tmp = f"{path}.{uuid.uuid4().hex}.tmp"
        source, out = self.fs.open(self._path(path)), self.fs.create(self._path(tmp), True)
        try:
            self._copied(source, out, size)
        finally:
            source.close()
            out.close()
        self._swap(tmp, path)

    def names(self, path: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._path(path))) if self.exists(path) else []

    def size(self, path: str) -> int:
        return self.fs.getFileStatus(self._path(path)).getLen()

    def is_dir(self, path: str) -> bool:
        return self.fs.getFileStatus(self._path(path)).isDirectory()

    def read(self, path: str) -> str:
        stream = self.fs.open(self._path(path))
        try:
            return bytes(stream.readAllBytes()).decode("utf-8")
        finally:
            stream.close()

    def write(self, path: str, text: str, overwrite: bool = True) -> None:
        stream = self.fs.create(self._path(path), overwrite)
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()

    def replace(self, path: str, text: str) -> None:
        """All or nothing: a complete file takes the place of the old one by one rename."""
        tmp = f"{path}.{uuid.uuid4().hex}.tmp"
        self.write(tmp, text)
        self._swap(tmp, path)

    def _swap(self, tmp: str, path: str) -> None:
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        kind = self.jvm.org.apache.hadoop.fs.Options.Rename
        options = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
        options[0] = kind.OVERWRITE
        context.rename(self._path(tmp), self._path(path), options)

    def read_json(self, path: str) -> dict:
        return json.loads(self.read(path))


class WriterLock:
    """One writer at a time for a database: whoever creates the lock file holds it.  Re-entrant.

    The file names its holder and when its lease ends.  A holder renews the lease when it commits; a lease that ran out
    belongs to a writer that died, and the next one takes the lock over.  Readers need no lock, as what a manifest names is
    never changed; one that must not see a vacuum pass holds a shared lock, a file of its own with a lease, for which
    `exclusive` waits.
    """

    def __init__(self, files: Files, timeout: float = 30.0, lease: float = 6 * 3600.0):
        self.files, self.timeout, self.lease, self.depth = files, timeout, lease, 0
        self.path, self.shared_path = files.at("_writer.lock"), files.at("_readers")
        self.me = f"{socket.gethostname()}-{os.getpid()}-{uuid.uuid4().hex[:8]}"

    def _body(self) -> str:
        return json.dumps({"owner": self.me, "until": time.time() + self.lease})

    def owner(self) -> dict | None:
        """Who holds the lock and until when; None where nobody does."""
        return self._read(self.path)

    def _read(self, path: str) -> dict | None:
        try:
            return json.loads(self.files.read(path) or "{}")
        except ValueError:
            return {}  # half written
        except Exception:  # gone meanwhile
            return None

    def _ran_out(self, path: str) -> bool:
        held = self._read(path)
        return held is not None and "until" in held and held["until"] < time.time()

    def _taken_away(self) -> bool:
        """Removes a lock whose lease ran out.  Of several that try one has it; a fresh lock is put back."""
        aside = f"{self.path}.{uuid.uuid4().hex}"
        if not self.files.rename(self.path, aside):
            return False
        if not self._ran_out(aside):
            self.files.rename(aside, self.path)
            return False
        self.files.delete(aside)
        return True

    def renew(self) -> None:
        """Extends the lease; a lock that another writer has taken over is gone for good."""
        if self.depth:
            if (self.owner() or {}).get("owner") != self.me:
                raise LockError("LockLost", path=self.files.root)
            self.files.replace(self.path, self._body())

    def _wait(self, until: float, cause: Exception | None = None) -> None:
        if time.monotonic() > until:
            raise LockError("LockTimeout", path=self.files.root, owner=(self.owner() or {}).get("owner")) from cause
        time.sleep(0.05)

    def __enter__(self) -> WriterLock:
        if self.depth == 0:
            until = time.monotonic() + self.timeout
            while True:
                try:
                    self.files.write(self.path, self._body(), overwrite=False)
                    break
                except Exception as e:  # the file is there
                    if self._ran_out(self.path) and self._taken_away():
                        continue
                    self._wait(until, e)
        self.depth += 1
        return self

    def __exit__(self, *_) -> None:
        self.depth -= 1
        if self.depth == 0 and (self.owner() or {}).get("owner") == self.me:
            self.files.delete(self.path)

    # ---------------------------------------------------------------------------------------- shared

    def share(self) -> str:
        """A reader's lock, to be given back by `release`."""
        path = f"{self.shared_path}/{uuid.uuid4().hex}"
        self.files.mkdirs(self.shared_path)
        self.files.write(path, self._body())
        return path

    def release(self, path: str) -> None:
        self.files.delete(path)

    def readers(self) -> list[str]:
        """Shared locks whose lease has not run out."""
        paths = [f"{self.shared_path}/{n}" for n in self.files.names(self.shared_path)]
        return [p for p in paths if not self._ran_out(p)]

    def exclusive(self) -> None:
        """Waits until no reader holds a shared lock; the writer's lock must be held."""
        until = time.monotonic() + self.timeout
        while self.readers():
            self._wait(until)
