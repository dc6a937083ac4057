"""Folders of more files than the driver may list at once, read and written a batch at a time."""

import gc
import os
import weakref

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrameReader, DataFrameWriter

from assayer.catalogue import QUERIES
from assayer.sources import batches
from assayer.sources.readers import scan_documents


@pytest.fixture
def root(tmp_path):
    root = tmp_path / "docs"
    files = [*(f"flat/{i}.txt" for i in range(12)), *(f"many/{i}/x.txt" for i in range(7)), "s[1]*/a b%20.txt", "_p=1/x.txt", "top.txt",
             "_h/x.txt", ".h/x.txt", "flat/_no.txt", "flat/.no.txt", "many/3/no._COPYING_"]
    for name in files:
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(f"words of {name}")
    (root / "flat/empty.txt").write_text("")
    (root / "flat/cut.txt").write_bytes("Schö".encode()[:-1])
    (root / "none/below").mkdir(parents=True)
    return root


def _listed(monkeypatch):
    """How many files the indexes of files hold together that are alive, from now on."""
    load, counts, alive = DataFrameReader.load, [], []

    def counted(self, *args, **kwargs):
        df = load(self, *args, **kwargs)
        alive.append((weakref.ref(df._jdf), len(df.inputFiles())))
        counts.append(sum(n for handle, n in alive if handle() is not None))
        return df

    monkeypatch.setattr(DataFrameReader, "load", counted)
    return counts


def test_files_are_listed_a_batch_at_a_time(spark, root, monkeypatch):
    below = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(root))
    whole = {(r.path, r.length, r.modificationTime) for r in below.select("path", "length", "modificationTime").collect()}
    monkeypatch.setattr(batches, "FILES_AT_ONCE", 5)
    counts = _listed(monkeypatch)
    gc.disable()  # as if no cycle were collected by chance
    try:
        rows = scan_documents(spark, str(root)).collect()
    finally:
        gc.enable()
    assert len(rows) == 23 and {(r.path, r.length, r.modificationTime) for r in rows} == whole
    assert 0 < max(counts) <= 2 * 5 and len(counts) >= 10  # a batch is listed twice, and let go before the next
    names = {r.path.split("/docs/")[1]: r for r in rows}
    assert names["flat/cut.txt"].text is None and names["flat/cut.txt"].error.startswith("UnicodeDecodeError")
    assert all((r.text, r.error) == (f"words of {name}", None) for name, r in names.items() if name != "flat/cut.txt")


def test_paths_of_batches(spark, root, monkeypatch):
    def read(path):
        return sorted(r.path.split("/docs/")[1] for r in scan_documents(spark, path).collect())

    assert read(str(root / "top.txt")) == ["top.txt"] and read(str(root / "none")) == []
    monkeypatch.setattr(batches, "FILES_AT_ONCE", 3)
    many = [f"many/{i}/x.txt" for i in range(7)]
    assert read(f"{root}/{{many,many/3,top.txt}}") == [*many, "top.txt"] and read(f"{root}/many/[0-6]") == many
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        scan_documents(spark, f"{root}/nothing*")
    files = batches.FileBatches(spark, str(root))
    assert [r.path.split("/docs/")[1] for r in files.load([str(root / "top.txt"), str(root / "gone")]).collect()] == ["top.txt"]
    spark_hides = spark._jvm.org.apache.spark.util.HadoopFSUtils.shouldFilterOutPathName
    for name in ("a", "_a", "_a=1", ".a", ".a=1", "a._COPYING_", "_metadata", "_metadata_x", "_common_metadata", "_", "=", "a_b"):
        assert batches.hidden(name) == spark_hides(name), name


def test_a_file_that_goes_between_listing_and_reading_is_a_row(spark, root, monkeypatch):
    load = batches.FileBatches.load

    def loses(self, batch, **options):
        df = load(self, batch, **options)
        if "ignoreCorruptFiles" in options:
            os.remove(root / "flat/3.txt")
        return df

    monkeypatch.setattr(batches.FileBatches, "load", loses)
    rows = {os.path.basename(r.path): r for r in scan_documents(spark, str(root / "flat")).collect()}
    assert len(rows) == 13 and rows["3.txt"].error.startswith("OSError") and rows["3.txt"].text is None and rows["3.txt"].length == 19


def test_pages_are_written_a_batch_of_folders_at_a_time(spark, tmp_path, monkeypatch):
    rows = [(i, None if i == 33 else f"<p>page {i}</p><script>no</script>") for i in range(120)]
    spark.createDataFrame([*rows, rows[7], rows[10]], "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))

    def read():
        return sorted(map(tuple, QUERIES["scan_documents"](spark, str(tmp_path)).collect()))

    whole = read()
    assert len(whole) == 120 and whole[3] == (3, None, "page 3") and whole[20] == (20, "UnicodeDecodeError", None)
    text, made = DataFrameWriter.text, [0]

    def counted(self, path, *args, **kwargs):
        text(self, path, *args, **kwargs)
        made.append(sum(name.startswith("page_id=") for _, names, _ in os.walk(path.removeprefix("file:")) for name in names))

    monkeypatch.setattr(DataFrameWriter, "text", counted)
    monkeypatch.setattr(batches, "FILES_AT_ONCE", 20)
    counts = _listed(monkeypatch)
    assert read() == whole
    assert made[-1] == 120 and max(b - a for a, b in zip(made, made[1:])) < 60
    assert max(counts) <= 2 * 20
