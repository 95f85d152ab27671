"""

An event-driven scan: the entry is decompressed and parsed some kilobytes at a time, so a file of any length takes memory
for its compressed bytes and for one element's text.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from typing import IO, TYPE_CHECKING
from xml.parsers import expat

from pyspark.sql import DataFrame

from .files import small_batches

if TYPE_CHECKING:
    import pyarrow as pa

ENTRY, CHUNK = "word/document.xml", 1 << 16
#: Kinds of elements by their local names; any other keeps its name.
KINDS = {"p": "paragraph", "tbl": "table", "sectPr": "section"}
BODY = "path string, element long, kind string, start long, end long, text string"


class _Body:
    """Elements of a body as they end: (kind, start, end, text). Before the first is the prefix, after the last the suffix."""

    def __init__(self) -> None:
        self.parser = expat.ParserCreate()
        self.parser.buffer_text = False
        self.parser.StartElementHandler = self._start
        self.parser.EndElementHandler = self._end
        self.parser.CharacterDataHandler = self._text
        self.parser.DefaultHandler = lambda data: self._at()
        self.depth, self.inside, self.in_text, self.over = 0, False, False, False
        self.open: tuple[str, int, list[str]] | None = None
        self.closing: str | None = None
        self.found: list[tuple[str, int, int, str | None]] = []

    def _at(self) -> int:
        """Where an event begins, which is where the tag before it has ended."""
        at, closing = self.parser.CurrentByteIndex, self.closing
        self.closing = None
        if closing == "prefix":
            self.found.append(("prefix", 0, at, None))
        elif closing == "element" and self.open:
            kind, start, text = self.open
            self.found.append((kind, start, at, "".join(text)))
            self.open = None
        return at

    def _start(self, name: str, attributes: dict) -> None:
        at, local = self._at(), name.rpartition(":")[2]
        if not self.inside:
            if local == "body" and not self.over:
                self.inside, self.closing = True, "prefix"
            return
        if self.depth == 0:
            self.open = (KINDS.get(local, local), at, [])
        self.depth += 1
        self.in_text = local == "t"

    def _end(self, name: str) -> None:
        at = self._at()
        self.in_text = False
        if not self.inside:
            return
        if self.depth == 0:  # the body's own end
            self.inside, self.over = False, True
            self.found.append(("suffix", at, -1, None))
            return
        self.depth -= 1
        if self.depth == 0:
            self.closing = "element"

    def _text(self, data: str) -> None:
        self._at()
        if self.in_text and self.open:
            self.open[2].append(data)

    def scan(self, file: IO[bytes]) -> Iterator[tuple[str, int, int, str | None]]:
        size, suffix = 0, None
        while part := file.read(CHUNK):
            size += len(part)
            self.parser.Parse(part, False)
            for one in self.found:
                if one[0] == "suffix":
                    suffix = one[1]
                else:
                    yield one
            self.found = []
        self.parser.Parse(b"", True)
        for one in self.found:
            if one[0] == "suffix":
                suffix = one[1]
            else:
                yield one
        if suffix is None:
            raise ValueError(f"{ENTRY} has no body")
        yield ("suffix", suffix, size, None)


def body_elements(files: DataFrame) -> DataFrame:
    """[S19] path, element, kind, start, end, text of DOCX files(path, content): ranges of bytes of word/document.xml.

    element counts the body's own elements from 0; the prefix (up to the body's start tag, which is in it) has -1, the
    suffix (from the body's end tag) the number after the last. kind is prefix, paragraph, table, section, an element's own
    name, or suffix; text is what its runs hold. A file that is no archive, lacks the entry or a body, or isn't well
    formed, has one row of kind error with the reason, after the elements that were read by then.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["path", "element", "kind", "start", "end", "text"])
        for b in batches:
            for path, raw in ((p.as_py(), c.as_py()) for p, c in zip(b.column(0), b.column(1))):
                rows, number = [], -1
                try:
                    with zipfile.ZipFile(io.BytesIO(raw or b"")) as z, z.open(ENTRY) as file:
                        for kind, start, end, text in _Body().scan(file):
                            rows.append((path, number, kind, start, end, text))
                            number += 1
                            if len(rows) >= 2000:
                                yield made(rows)
                                rows = []
                except (zipfile.BadZipFile, KeyError, ValueError, expat.ExpatError) as e:
                    rows.append((path, None, "error", None, None, str(e)[:200]))
                yield made(rows)

    small_batches(files.sparkSession)
    return files.select("path", "content").mapInArrow(run, BODY)
