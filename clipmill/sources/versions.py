"""Numbered manifests of a folder: the highest number is the current version.

A manifest is written aside and then given its number in one step that fails if the
number is taken. So a crash leaves the version before, and of two writers that
started from one version the later one gets a ``Conflict``.
"""

from __future__ import annotations

import os
import uuid
from urllib.parse import urlparse

from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer made the next version first."""


class Versions:
    """Manifests ``m-000000000001``, ... in a folder; each is a list of lines."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def numbers(self) -> list[int]:
        fs, place = self._fs(self.folder)
        if not fs.exists(place):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(place)]
        return sorted(int(n[2:]) for n in names if n.startswith("m-"))

    def _path(self, number: int) -> str:
        return f"{self.folder}/m-{number:012d}"

    def latest(self) -> tuple[int, list[str]]:
        """(number, lines) of the current version; (0, []) before the first."""
        found = self.numbers()
        if not found:
            return 0, []
        fs, place = self._fs(self._path(found[-1]))
        stream = fs.open(place)
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        return found[-1], text.split("\n") if text else []

    def commit(self, after: int, lines: list[str]) -> int:
        """Make ``lines`` the version that follows ``after``."""
        fs, aside = self._fs(f"{self.folder}/.aside-{uuid.uuid4().hex}")
        stream = fs.create(aside, True)
        stream.write("\n".join(lines).encode())
        stream.close()
        try:
            if not self._settle(fs, aside, self._path(after + 1)):
                raise Conflict(f"{self.folder}: version {after + 1} is there already")
        finally:
            fs.delete(aside, False)
        return after + 1

    def _settle(self, fs, aside, path: str) -> bool:
        """Give a file its name, unless that is taken; one step in the file system."""
        place = self._fs(path)[1]
        if place.toUri().getScheme() in (None, "file"):  # a local rename would overwrite
            own = lambda p: urlparse(p.toUri().toString()).path
            try:
                os.link(own(aside), own(place))
            except FileExistsError:
                return False
            return True
        return not fs.exists(place) and bool(fs.rename(aside, place))

    def forget(self, keep: int) -> None:
        """Delete all manifests but the last ``keep``."""
        for number in self.numbers()[:-keep]:
            fs, place = self._fs(self._path(number))
            fs.delete(place, False)
