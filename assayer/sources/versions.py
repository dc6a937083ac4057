"""Tables that change by publishing: folders are written first, then one small file names those that count."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer has published in the meantime."""


class Versions:
    """The published states of a table below ``root``, numbered from 1.

    A writer reads the current state, writes new folders under names of their own, and publishes the next
    state: a file that is created only if it does not exist yet.  Of two writers that started from one
    state the second one gets :class:`Conflict` and starts over; folders of a failed writer are named by no state and so
    read by nobody.  Files are listed, read and created by the session's file system, so any store will do
    that creates a file exclusively.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._path(name))

    def _number(self) -> int:
        if not self.exists("_states"):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path("_states"))]
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0].isdigit()), default=0)

    def current(self) -> tuple[int, dict]:
        """Number and content of the newest state; 0 and nothing before the first."""
        number = self._number()
        if not number:
            return 0, {}
        stream = self._fs.open(self._path(f"_states/{number:09d}.json"))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return number, json.loads(text)

    def publish(self, after: int, state: dict) -> int:
        """Make ``state`` the one that follows number ``after``."""
        name = self._path(f"_states/{after + 1:09d}.json")
        try:
            stream = self._fs.create(name, False)
        except Py4JJavaError as error:
            if self._fs.exists(name):
                raise Conflict(f"state {after + 1} of {self.root} is published already") from error
            raise
        stream.write(bytearray(json.dumps(state, sort_keys=True).encode()))
        stream.close()
        return after + 1

    def folder(self) -> str:
        """A new folder name; nobody reads it before a state names it."""
        return f"data-{uuid.uuid4().hex}"

    def path(self, folder: str) -> str:
        return f"{self.root}/{folder}"
