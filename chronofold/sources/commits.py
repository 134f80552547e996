"""Small files that appear whole or not at all, each under a name that only one writer gets.

A claim writes its text to a file of its own and then gives that file its name: by a hard link on a
local folder, by a rename that doesn't overwrite elsewhere. Both are one step of the file system, so
a writer that dies leaves a file without a name, which nobody reads, and of two writers one wins.
An object store has neither; there a lock service has to stand in.
"""

from __future__ import annotations

import os
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import SparkSession


class Commits:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self._jvm, self.folder = spark._jvm, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path(self.folder).getFileSystem(self._conf)

    def get(self, name: str) -> str | None:
        """The text under a name; None if there is none. An empty file is no commit."""
        path = self._path(f"{self.folder}/{name}")
        if not self._fs.exists(path):
            return None
        stream = self._fs.open(path)
        try:
            return bytes(stream.readAllBytes()).decode() or None
        finally:
            stream.close()

    def names(self) -> list[str]:
        """All names, sorted; files without a name and empty ones are left out."""
        top = self._path(self.folder)
        if not self._fs.exists(top):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(top) if s.isFile() and s.getLen() and not s.getPath().getName().startswith((".", "_")))

    def claim(self, name: str, text: str) -> bool:
        """Puts the text under the name. False, and nothing done, if another has it."""
        if not text:
            raise ValueError("a commit isn't empty")
        own, path = self.write(text), self._path(f"{self.folder}/{name}")
        if self._fs.exists(path) and self.get(name) is None:
            self._fs.delete(path, False)  # left by a writer that made the file before its contents
        done = self._give(own, path)
        self._fs.delete(self._path(own), False)
        return done

    def write(self, text: str) -> str:
        """The text in a file without a name."""
        own = f"{self.folder}/.{uuid.uuid4().hex}"
        out = self._fs.create(self._path(own), False)
        out.write(bytearray(text.encode()))
        out.close()
        return own

    def _give(self, own: str, path) -> bool:
        if urlparse(self.folder).scheme in ("", "file") and self._fs.getUri().getScheme() == "file":
            try:
                os.link(unquote(urlparse(own).path), unquote(urlparse(path.toString()).path))
            except FileExistsError:
                return False
            return True
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        none = self._jvm.java.lang.reflect.Array.newInstance(self._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            context.rename(self._path(own), path, none)
        except Exception:
            if self.get(path.getName()) is None:
                raise
            return False
        return True
