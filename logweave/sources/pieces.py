"""Whole XML and JSON documents cut into their elements by tasks that go through a file once and hold no more than one element.

Spark's text reader cuts files into short rows behind each closing mark, also within large files. Runs of rows are put
together to blocks, the blocks of a file meet in order in one task, and what that hands on are the texts of the elements
asked for, which Spark's own XML and JSON functions then parse, spread over all tasks.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from xml.parsers import expat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ELEMENT = "file string, kind string, at long, text string"
Found = tuple[str, int, str]


def blocks(spark: SparkSession, path: str, end: str) -> DataFrame:
    """(file, size, start, no, block): the bytes of files under a path as runs of rows that end in `end`, in order of (start, no).

    Every row is given its end again, also a file's last one, which may have had none: size, the file's, tells.
    """
    mark = end.encode()

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no = 0
        for batch in batches:
            files, starts = batch.column(0).dictionary_encode().indices.to_numpy(), batch.column(2).to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(files) != 0) | (np.diff(starts) != 0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a < b:
                    whole = mark.join(batch.column(3).slice(a, b - a).to_pylist()) + mark
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, 1) for c in range(3)), pa.array([no]), pa.array([whole], pa.binary())], ["file", "size", "start", "no", "block"])
                    no += 1

    rows = spark.read.text(path, lineSep=end, recursiveFileLookup=True)
    rows = rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("value"))
    return rows.mapInArrow(joined, "file string, size long, start long, no long, block binary")


def elements(spark: SparkSession, path: str, end: str, scanner: Callable[[], object]) -> DataFrame:
    """(file, kind, at, text) of what a scanner finds in each file: it has feed(bytes) and close(), which yield (kind, at, text)."""

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whose, size, length, scan = None, 0, 0, None

        def rows(found: Iterator[Found]) -> Iterator[pa.RecordBatch]:
            kept = list(found)
            if kept:
                yield pa.RecordBatch.from_arrays([pa.array([whose] * len(kept)), *(pa.array(list(c), t) for c, t in zip(zip(*kept, strict=True), (pa.string(), pa.int64(), pa.string()), strict=True))], ["file", "kind", "at", "text"])

        def closed() -> Iterator[pa.RecordBatch]:
            # the reader may have left out a mark of byte order
            yield from rows(scan.feed(end.encode() if length in (size, size - 3) else b""))
            yield from rows(scan.close())

        for batch in batches:
            for file, its_size, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(4), strict=True):
                if file != whose:
                    if scan is not None:
                        yield from closed()
                    whose, size, length, scan, owed = file, its_size, 0, scanner(), b""
                data = block.as_py()
                length += len(data)
                yield from rows(scan.feed(owed + data[:-1]))
                owed = data[-1:]
        if scan is not None:
            yield from closed()

    dealt = blocks(spark, path, end).repartition("file").sortWithinPartitions("file", "start", "no")
    return dealt.mapInArrow(scanned, ELEMENT)


class XmlScanner:
    """Elements at paths (kind by path, such as a/b/c), and any of the tags in `anywhere`, numbered by kind; at the end the
    kind `file` with the root's name, or null where the file is not sound XML."""

    def __init__(self, paths: dict[str, str], anywhere: tuple[str, ...] = ()):
        self.paths, self.anywhere, self.numbers = paths, anywhere, {}
        self.parser = expat.ParserCreate("utf-8")
        self.parser.StartElementHandler, self.parser.EndElementHandler, self.parser.DefaultHandler = self.start, self.stop, self.other
        self.buffer, self.base, self.last = b"", 0, 0
        self.path, self.open, self.found, self.root, self.sound, self.fresh = [], [], [], None, True, False

    def other(self, data):
        self.last, self.fresh = self.parser.CurrentByteIndex, False

    def start(self, name, attributes):
        self.last, self.fresh = self.parser.CurrentByteIndex, True
        self.root = self.root or name
        self.path.append(name)
        kind = self.paths.get("/".join(self.path)) if len(self.path) < 6 else None
        for k in (kind, name if name in self.anywhere else None):
            if k is not None:
                self.open.append((len(self.path), k, self.last, self.numbers.get(k, 0)))
                self.numbers[k] = self.numbers.get(k, 0) + 1

    def stop(self, name):
        self.last = self.parser.CurrentByteIndex
        while self.open and self.open[-1][0] == len(self.path):
            _, kind, begin, at = self.open.pop()
            # the end of an empty tag is told behind it, that of any other element before its end tag
            stop = self.last - self.base
            if not (self.fresh and self.buffer[stop - 2 : stop] == b"/>"):
                stop = self.buffer.index(b">", stop) + 1
            self.found.append((kind, at, self.buffer[begin - self.base : stop].decode("utf-8", "replace")))
        self.fresh = False
        self.path.pop()

    def feed(self, data: bytes, last: bool = False) -> Iterator[Found]:
        if self.sound:
            self.buffer += data
            try:
                self.parser.Parse(data, last)
            except expat.ExpatError:
                self.sound, self.open, self.buffer = False, [], b""
            else:
                keep = min(self.last, *(x[2] for x in self.open)) if self.open else self.last
                self.buffer, self.base = self.buffer[keep - self.base :], keep
        found, self.found = self.found, []
        yield from found

    def close(self) -> Iterator[Found]:
        yield from self.feed(b"", True)
        yield "file", 0, self.root if self.sound else None


_STRING = rb'"(?:[^"\\]++|\\.)*+"'
#: An object with up to three levels of objects inside, passed over at once; deeper ones are gone through mark by mark.
_OBJECT = rb"\{(?:[^\"{}]++|" + _STRING + rb")*+\}"
for _ in range(3):
    _OBJECT = rb"\{(?:[^\"{}]++|" + _STRING + rb"|" + _OBJECT + rb")*+\}"
_OBJECT = re.compile(_OBJECT, re.DOTALL)
_TOKEN = re.compile(rb'"(?:[^"\\]++|\\.)*+(?:"|(\\?\Z))|[{}\[\],]', re.DOTALL)


class JsonScanner:
    """The entries of an array that is a member of the root object, kind `entry`; at the end the kind `file` with the document
    without these entries. An entry's text is not looked into: whether it is sound is for the reader to tell."""

    def __init__(self, member: str):
        self.member, self.buffer, self.place, self.begin = f'"{member}"'.encode(), b"", 0, 0
        self.depth, self.object, self.key, self.wants_key, self.inside, self.at, self.rest = 0, False, b"", False, False, 0, []

    def _entry(self, stop: int, last: bool) -> Iterator[Found]:
        text = self.buffer[self.begin : stop].strip()
        if text:
            yield "entry", self.at, text.decode("utf-8", "replace")
        elif not last or self.at:
            # a comma without an entry
            self.rest.append(b",")
        self.at += 1

    def feed(self, data: bytes) -> Iterator[Found]:
        self.buffer += data
        end = len(self.buffer)
        stop = self.place
        while found := _TOKEN.search(self.buffer, stop):
            if found.group(1) is not None:
                end = found.start()
                break
            token, stop = self.buffer[found.start() : found.start() + 1], found.end()
            if self.inside and self.depth == 2 and token == b"{" and (whole := _OBJECT.match(self.buffer, found.start())):
                stop = whole.end()
                continue
            if token == b'"':
                if self.depth == 1 and self.wants_key:
                    self.key, self.wants_key = found.group(), False
            elif token in b"{[":
                self.depth += 1
                if self.depth == 1:
                    self.object = self.wants_key = token == b"{"
                elif self.depth == 2 and token == b"[" and self.object and self.key == self.member:
                    self.rest.append(self.buffer[self.begin : stop])
                    self.inside, self.begin = True, stop
            elif token == b",":
                self.wants_key = self.wants_key or self.depth == 1
                if self.inside and self.depth == 2:
                    yield from self._entry(found.start(), False)
                    self.begin = stop
            else:
                if self.inside and self.depth == 2:
                    yield from self._entry(found.start(), True)
                    self.inside, self.begin = False, found.start()
                self.depth -= 1
        if not self.inside:
            self.rest.append(self.buffer[self.begin : end])
            self.begin = end
        self.buffer, self.place, self.begin = self.buffer[self.begin :], end - self.begin, 0

    def close(self) -> Iterator[Found]:
        self.rest.append(self.buffer)
        yield "file", 0, b"".join(self.rest).decode("utf-8", "replace")
