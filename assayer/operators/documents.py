"""Document text: HTML extraction, chunking, change detection."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from ..scale import join_on, spread

# Elements whose text is never shown.
_HIDDEN = ("script", "style", "template")
_VERBATIM = ("pre", "textarea")
# Rows whose texts a Python worker holds as objects at a time.
PART_ROWS = 64


class _TextNodes(HTMLParser):
    """Collects the visible text nodes of one page, in order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes: list[str] = []
        self._pending: list[str] = []
        self._hidden = 0
        self._verbatim = 0

    def flush(self) -> None:
        text, self._pending = "".join(self._pending), []
        if not text or self._hidden:
            return
        if not self._verbatim and not text.strip(" \t\n\r\f"):
            text = "\n" if "\n" in text else " "
        self.nodes.append(text)

    def handle_data(self, data):
        self._pending.append(data)

    def handle_starttag(self, tag, attrs):
        self.flush()
        self._hidden += tag in _HIDDEN
        self._verbatim += tag in _VERBATIM

    def handle_startendtag(self, tag, attrs):
        self.flush()

    def handle_endtag(self, tag):
        self.flush()
        if tag in _HIDDEN and self._hidden:
            self._hidden -= 1
        if tag in _VERBATIM and self._verbatim:
            self._verbatim -= 1

    def handle_comment(self, data):
        self.flush()

    def handle_decl(self, decl):
        self.flush()


def html_text(html: str) -> str:
    parser = _TextNodes()
    parser.feed(html)
    parser.close()
    parser.flush()
    return "\n".join(parser.nodes)


def parts(batch):
    """An Arrow array or batch in slices of a few rows, so that only their texts are Python objects at a time."""
    return (batch.slice(start, PART_ROWS) for start in range(0, len(batch), PART_ROWS))


def texts_or_errors(rows: list[tuple[str | None, str | None]]) -> pa.StructArray:
    texts, errors = zip(*rows)
    return pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(errors, pa.string())], names=["text", "error"])


def tidy_text(column: Column) -> Column:
    """Three or more newlines become two; outer white space goes."""
    return F.regexp_replace(F.regexp_replace(column, r"\n{3,}", "\n\n"), r"(?U)^\s+|\s+$", "")


def parse_pages(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        for part in parts(batch):
            rows = []
            for page in part.to_pylist():
                try:
                    rows.append((html_text(page), None))
                except Exception as error:  # noqa: BLE001 - recorded with the page
                    rows.append((None, f"{type(error).__name__}: {error}"))
            yield texts_or_errors(rows)


def parsed_html(html: Column) -> Column:
    """Struct of ``text`` and ``error``, parsed in short Arrow batches; errors are never fatal."""

    @F.arrow_udf("text string, error string")
    def parse(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from parse_pages(batches)

    return parse(html)


def extract_html_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """Replace the page source by its visible ``text`` and an ``error`` column.

    A page that cannot be read keeps its row.
    """
    keep = [F.col(f"`{c}`") for c in pages.columns if c != html]
    parsed = spread(pages).select(*keep, parsed_html(F.col(f"`{html}`")).alias("__page"))
    return parsed.select(*keep, tidy_text(F.col("__page.text")).alias("text"), F.col("__page.error").alias("error"))


def document_errors(extracted: DataFrame, key: str) -> DataFrame:
    return extracted.where("error IS NOT NULL").select(key, "error")


def usable_documents(extracted: DataFrame) -> DataFrame:
    """Documents that could be read; having none at all is an error."""
    good = extracted.where("error IS NULL")
    if good.isEmpty() and not extracted.isEmpty():
        raise RuntimeError("no document could be read")
    return good


def windows(text: str, size: int, overlap: int) -> Iterator[tuple[int, int, str]]:
    """(start, end, trimmed fragment) of overlapping windows ending at white space.

    A window ends at the last blank or line feed of its second half, if there is one.
    """

    def reach(start: int) -> int:
        half, full = start + size // 2 + 1, start + size
        last = max(text.rfind(" ", half, full), text.rfind("\n", half, full))
        return full if last < 0 else last

    start, end = 0, 0
    while end < len(text):
        end = reach(start) if start + size < len(text) else len(text)
        if fragment := text[start:end].strip():
            yield start, end, fragment
        start = max(start + 1, end - overlap)


def chunked(size: int, overlap: int):
    """Rows (key, text) to the rows of their chunks, a few documents at a time."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch):
                rows = [
                    (row, number, start, end, fragment)
                    for row, body in enumerate(part.column("text").to_pylist())
                    if body
                    for number, (start, end, fragment) in enumerate(windows(body, size, overlap))
                ]
                if not rows:
                    continue
                row, number, start, end, fragment = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column("key").take(pa.array(row, pa.int64())), *(pa.array(c, pa.int32()) for c in (number, start, end)),
                     pa.array(fragment, pa.string())],
                    names=["key", "chunk_index", "start_char", "end_char", "text"])

    return split


def chunk_documents(
    documents: DataFrame, key: str, text: str = "text", *, size: int = 1200, overlap: int = 200
) -> DataFrame:
    """Chunks of every document; work stays in the partition of the document.

    Offsets are those of the untrimmed window; blank windows use no index.
    """
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("need size > overlap >= 0")
    fields = documents.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))

    key_type = fields.schema["key"].dataType.simpleString()
    chunks = spread(fields).mapInArrow(
        chunked(size, overlap), f"key {key_type}, chunk_index int, start_char int, end_char int, text string"
    )
    return chunks.withColumnRenamed("key", key)


def chunk_id(source: Column) -> Column:
    """Stable UUID of a chunk row (chunk_index, start_char, end_char, text)."""
    parts = [source.cast("string"), *[F.col(c).cast("string") for c in ("chunk_index", "start_char", "end_char")]]
    return ids.uuid5(F.concat_ws(":", *parts, F.col("text")))


STATE = ("path", "length", "modificationTime")


def detect_changed_documents(current: DataFrame, indexed: DataFrame, state=STATE) -> DataFrame:
    """Documents whose state is new or differs from what was indexed."""
    return join_on(current, indexed.select(*state), list(state), "left_anti", null_safe=True)


def removed_documents(current: DataFrame, indexed: DataFrame, key: str = "path") -> DataFrame:
    return join_on(indexed, current.select(key), [key], "left_anti")


def corpus_fingerprint(current: DataFrame, *, model: str, collection: str, state=STATE) -> DataFrame:
    """One order-free fingerprint of all document states, model and collection.

    Sums of hash parts combine on the map side; no list of files is gathered.
    """
    row = ids.sha256(F.to_json(F.struct(*state), {"ignoreNullFields": "false"}))
    parts = [F.conv(F.substring(row, 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)") for i in range(4)]
    sums = current.agg(F.count("*").alias("documents"), *[F.coalesce(F.sum(p), F.lit(0)).alias(f"s{i}") for i, p in enumerate(parts)])
    text = F.concat_ws("|", F.lit(model), F.lit(collection), *[F.col(c).cast("string") for c in ("documents", "s0", "s1", "s2", "s3")])
    return sums.select("documents", ids.sha256(text).alias("fingerprint"))
