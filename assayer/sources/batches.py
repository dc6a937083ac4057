"""Files below a folder, in batches that the driver can list."""

from __future__ import annotations

import gc
from collections.abc import Iterator
from itertools import batched, chain
from multiprocessing.pool import ThreadPool

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

# Files whose states the driver holds at a time.
FILES_AT_ONCE = 20_000
# Folders whose files are counted at a time, and threads that wait for the counts.
FOLDERS_AT_ONCE, COUNTING_THREADS = 256, 8
# A task lists whole folders, small files share a task, and no index stays in memory after its batch.
SETTINGS = {
    "spark.sql.sources.parallelPartitionDiscovery.threshold": "0",
    "spark.sql.files.openCostInBytes": "64k",
    "spark.sql.hive.filesourcePartitionFileCacheSize": "0",
}


def hidden(name: str) -> bool:
    """Names that Spark's file sources leave out."""
    out = name.startswith(".") or name.endswith("._COPYING_") or (name.startswith("_") and "=" not in name)
    return out and not name.startswith(("_metadata", "_common_metadata"))


def outermost(paths: list[str]) -> list[str]:
    """Paths but those that are read with a folder above them."""
    known = set(paths)

    def covered(path: str) -> bool:
        names = path.split("/")
        return any("/".join(names[:i]) in known and not any(map(hidden, names[i:])) for i in range(1, len(names)))

    return [path for path in dict.fromkeys(paths) if not covered(path)]


class FileBatches:
    """Files below a path (or those that a pattern stands for), some ``FILES_AT_ONCE`` at a time.

    Only one batch is listed at a time, by tasks. What the driver holds besides is one folder's own entries, as the store hands them over.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        # A session of its own, so that the settings are nobody else's.
        self.session = spark._jsparkSession.cloneSession()
        cores = spark.sparkContext.defaultParallelism
        for key, value in {**SETTINGS, "spark.sql.sources.parallelPartitionDiscovery.parallelism": str(4 * cores)}.items():
            self.session.conf().set(key, value)
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._store = self._path(path).getFileSystem(self.session.sessionState().newHadoopConf())

    def load(self, batch: list[str], **options: bool) -> DataFrame:
        """The files of a batch; parts of it that have gone meanwhile are left out."""
        reader = self.spark.read
        reader._jreader = self.session.read()
        reader = reader.format("binaryFile").options(recursiveFileLookup=True, __globPaths__=False, **options)
        try:
            return reader.load(batch)
        except AnalysisException:
            present = [path for path in batch if self._store.exists(self._path(path))]
            if len(present) in (0, len(batch)):
                raise
            return reader.load(present)

    def __iter__(self) -> Iterator[list[str]]:
        with ThreadPool(COUNTING_THREADS) as pool:
            for batch in self._gathered(pool):
                yield batch
                # Handles of Java objects are cycles; until Python collects them, the JVM keeps the index of the batch.
                gc.collect()

    def _gathered(self, pool: ThreadPool) -> Iterator[list[str]]:
        batch, held = [], 0
        for path, files in self._parts(pool):
            if batch and held + files > FILES_AT_ONCE:
                yield batch
                batch, held = [], 0
            batch.append(path)
            held += files
        yield batch

    def _parts(self, pool: ThreadPool) -> Iterator[tuple[str, int]]:
        found = {s.getPath().toString(): s.isDirectory() for s in self._store.globStatus(self._path(self.path)) or ()}
        if not found:
            self.spark.read.format("binaryFile").load(self.path)  # gives Spark's own error
        for path in outermost(list(found)):
            yield from self._split(path, pool) if found[path] else [(path, 1)]

    def _split(self, folder: str, pool: ThreadPool) -> Iterator[tuple[str, int]]:
        """(path, files) of the folder if its files fit a batch, else of what lies in it."""
        parts, known, total = self._sized(folder, pool), [], 0
        for part in parts:
            known.append(part)
            total += part[2]
            if total > FILES_AT_ONCE:
                break
        else:
            yield folder, total
            return
        for path, is_folder, files in chain(known, parts):
            if is_folder and files > FILES_AT_ONCE:
                yield from self._split(path, pool)
            elif files:
                yield path, files

    def _sized(self, folder: str, pool: ThreadPool) -> Iterator[tuple[str, bool, int]]:
        for some in batched(self._entries(folder), FOLDERS_AT_ONCE):
            yield from pool.map(lambda entry: (*entry, self._files_below(entry[0]) if entry[1] else 1), some)

    def _entries(self, folder: str) -> Iterator[tuple[str, bool]]:
        try:
            listing = self._store.listStatusIterator(self._path(folder))
            while listing.hasNext():
                status = listing.next()
                path = status.getPath()
                if not hidden(path.getName()):
                    yield path.toString(), status.isDirectory()
        except Py4JJavaError as error:
            if not _gone(error):
                raise

    def _files_below(self, folder: str) -> int:
        try:
            return self._store.getContentSummary(self._path(folder)).getFileCount()
        except Py4JJavaError as error:
            if not _gone(error):
                raise
            return 0


def _gone(error: Py4JJavaError) -> bool:
    """Whether a folder went while it was looked into; its files are then no longer there to read."""
    return error.java_exception.getClass().getName() == "java.io.FileNotFoundException"
