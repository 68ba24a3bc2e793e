"""One large node-link document in byte ranges: many tasks read one JSON file, whatever its lines look like.

Where a range starts, nothing tells whether it starts inside a string, or how deep. So every range is first summed up for
each way it may start (outside a string, inside one, after a backslash in one): how it ends and how its depth changes. The
summaries, one small row for each range, put together from the first range on, give each range its true start. Then a data
source deals the ranges out again, and each task cuts out the elements whose separator lies in its range, reading on past
the end for the last one.
"""

from __future__ import annotations

import json
import re
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as files
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from skeinwork.model import PropertyGraph
from skeinwork.sources.graph_json import graph_of, no_graph

RANGE_BYTES = 64 << 20
#: What a task reads at a time past the end of its range.
MORE_BYTES = 1 << 20
SECTIONS = ("nodes", "edges", "links")
#: A backslash with what it escapes, or a token; a string's own tokens count for nothing.
_TOKEN = re.compile(rb'\\(?:.|\Z)|["{}\[\],]', re.DOTALL)
_MARK, _IN_STRING, _NOT_BLANK = re.compile(rb'["{}\[\],]'), re.compile(rb'\\.|"', re.DOTALL), re.compile(rb"[^ \t\r\n]")
_OPEN, _CLOSE = b"{[", b"}]"
#: How a range may start: outside a string, inside one, inside one after a backslash.
OUTSIDE, INSIDE, ESCAPED = 0, 1, 2


def _open_file(path: str):
    if "://" in path or path.startswith("file:"):
        system, name = files.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
        return system.open_input_file(name)
    return files.LocalFileSystem().open_input_file(path)


def summary(data: bytes, start: int) -> tuple[int, int, int]:
    """The state after data that starts in a state, the change of depth, and the least depth on the way."""
    inside, state, depth, least = start != OUTSIDE, None, 0, 0
    if start == ESCAPED and not data:
        return ESCAPED, 0, 0
    for token in _TOKEN.finditer(data, 1 if start == ESCAPED else 0):
        t = token[0]
        if t[:1] == b"\\":
            state = ESCAPED if len(t) == 1 and inside else None
        elif t == b'"':
            inside = not inside
        elif not inside and t in _OPEN:
            depth += 1
        elif not inside and t in _CLOSE:
            depth -= 1
            least = min(least, depth)
    return (state if state is not None else INSIDE if inside else OUTSIDE), depth, least


class Window:
    """Bytes of a file from a start on, of which more are read when they are asked for."""

    def __init__(self, file, start: int, length: int):
        self.file, self.start, self.more = file, start, MORE_BYTES
        file.seek(start)
        self.data = file.read(length)

    def grow(self) -> bool:
        self.file.seek(self.start + len(self.data))
        found = self.file.read(self.more)
        self.data += found
        self.more *= 2
        return bool(found)

    def tokens(self, inside: bool, escaped: bool) -> Iterator[tuple[int, bytes, int]]:
        """(position, token, end) outside of strings; a string is one token, from quote to quote. Reads on as needed."""
        at = 1 if escaped else 0
        if inside:
            at = self._string_end(at)
        while True:
            found = _MARK.search(self.data, at)
            if found is None:
                at = len(self.data)
                if not self.grow():
                    return
                continue
            at = found.start()
            end = self._string_end(at + 1) if found[0] == b'"' else at + 1
            yield at, found[0], end
            at = end

    def _string_end(self, at: int) -> int:
        """Where the string that is open at a position is over."""
        while True:
            for token in _IN_STRING.finditer(self.data, at):
                if token[0] == b'"':
                    return token.end()
                at = token.end()
            if not self.grow():
                return len(self.data)

    def after(self, at: int) -> bytes:
        """The first byte from a position on that is not blank."""
        while True:
            if found := _NOT_BLANK.search(self.data, at):
                return found[0]
            if not self.grow():
                return b""


def outline(window: Window, length: int, start: int, depth: int) -> dict:
    """What a range tells of the top level: its keys, its last string there, and the section at its end.

    section is a key, None (in no array of a key), "" (as at the range's start), or "?" (of the string before the range).
    """
    keys, last, section = [], None, ""
    for at, token, end in window.tokens(start != OUTSIDE, start == ESCAPED):
        if at >= length:
            break
        if token == b'"' and depth == 1:
            last = json.loads(window.data[at:end])
            if window.after(end) == b":":
                keys.append(last)
        elif token in _OPEN:
            if depth == 1:
                section = None if token == b"{" else "?" if last is None else last
            depth += 1
        elif token in _CLOSE:
            depth -= 1
            if depth == 1:
                section = None
    return {"keys": keys, "last": last, "section": section}


def elements(window: Window, length: int, start: int, depth: int, section: str | None, last: str | None) -> Iterator[tuple[str, int, str]]:
    """(section, position, text) of the elements whose separator, the bracket or comma before them, lies in the range."""
    begun = None
    for at, token, end in window.tokens(start != OUTSIDE, start == ESCAPED):
        if at >= length and begun is None:
            return
        if token == b'"':
            if depth == 1:
                last = json.loads(window.data[at:end])
            continue
        over = (token == b"," and depth == 2) or (token in _CLOSE and depth == 2)
        if over and begun is not None:
            text = window.data[begun:at].strip()
            if text:
                yield section, window.start + begun, text.decode()
            begun = None
        if token in _OPEN:
            if depth == 1:
                section = last if token == b"[" and last in SECTIONS else None
                begun = end if section and at < length else None
            depth += 1
        elif token in _CLOSE:
            depth -= 1
            if depth == 1:
                section = None
        elif depth == 2 and section and at < length:
            begun = end


class RangePartition(InputPartition):
    def __init__(self, value: dict):
        super().__init__(value)


class JsonElements(DataSource):
    """The elements of the sections of one JSON document: (section, start, raw). Options: path, and ranges as `plan` makes them."""

    @classmethod
    def name(cls) -> str:
        return "skeinwork_json_elements"

    def schema(self) -> str:
        return "section string, start long, raw string"

    def reader(self, schema) -> DataSourceReader:
        return JsonElementsReader(self.options["path"], json.loads(self.options["ranges"]))


class JsonElementsReader(DataSourceReader):
    def __init__(self, path: str, ranges: list[dict]):
        self.path, self.ranges = path, ranges

    def partitions(self) -> list[InputPartition]:
        return [RangePartition(r) for r in self.ranges]

    def read(self, partition: RangePartition) -> Iterator[pa.RecordBatch]:
        r = partition.value
        names, held, weight = ["section", "start", "raw"], [], 0
        with _open_file(self.path) as file:
            for element in elements(Window(file, r["at"], r["length"]), r["length"], r["state"], r["depth"], r["section"], r["last"]):
                held.append(element)
                weight += len(element[2])
                if weight > MORE_BYTES or len(held) >= 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*held, strict=True)], names=names)
                    held, weight = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*held, strict=True)], names=names)


def _by_range(spark: SparkSession, path: str, ranges: list[dict], task) -> list:
    """What a task makes of each range, in the ranges' order; a small row for each reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _open_file(path) as file:
            for batch in batches:
                for number, told in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([json.dumps(task(file, json.loads(told)))])], names=["number", "told"])

    frame = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(ranges)], "number long, told string").repartitionByRange(len(ranges), "number")
    return [json.loads(r["told"]) for r in frame.mapInArrow(run, "number long, told string").orderBy("number").collect()]


def plan(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> tuple[list[dict], set[str]] | None:
    """The ranges of a document with how each starts, and the keys of its top level; None if it is no whole JSON object."""
    with _open_file(path) as file:
        size = file.size()
        if Window(file, 0, min(size, MORE_BYTES)).after(0) != b"{":
            return None
    ranges = [{"at": at, "length": min(range_bytes, size - at)} for at in range(0, size, range_bytes)]

    def sums(file, r):
        data = Window(file, r["at"], r["length"]).data
        return [summary(data, s) for s in (OUTSIDE, INSIDE, ESCAPED)]

    state, depth, top = OUTSIDE, 0, []
    for r, told in zip(ranges, _by_range(spark, path, ranges, sums), strict=True):
        r |= {"state": state, "depth": depth}
        state, change, least = told[state]
        if depth + least <= 1 or depth <= 1:
            top.append(r)
        depth += change
    if (state, depth) != (OUTSIDE, 0):
        return None
    outlines = _by_range(spark, path, top, lambda file, r: outline(Window(file, r["at"], r["length"]), r["length"], r["state"], r["depth"]))
    told = {r["at"]: o for r, o in zip(top, outlines, strict=True)}
    section, last, keys = None, None, set()
    for r in ranges:
        r |= {"section": section, "last": last}
        if o := told.get(r["at"]):
            keys.update(o["keys"])
            section = section if o["section"] == "" else last if o["section"] == "?" else o["section"]
            section = section if section in SECTIONS else None
            last = o["last"] if o["last"] is not None else last
    return ranges, keys


def read_large_graph(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> PropertyGraph:
    """The graph that read_graph gives of a JSON document, read in ranges by as many tasks; positions are those of bytes.

    path is a local one or a URI of a file system that pyarrow opens. A missing file is an empty graph, with a warning, and
    so is one whose brackets and strings do not close.
    """
    try:
        found = plan(spark, path, range_bytes)
    except FileNotFoundError:
        found = None
    if found is None:
        warnings.warn(f"no graph at {path}", stacklevel=2)
        return no_graph(spark)
    ranges, keys = found
    spark.dataSource.register(JsonElements)
    rows = spark.read.format(JsonElements.name()).option("path", path).option("ranges", json.dumps(ranges)).load()
    of = lambda section: rows.filter(F.col("section") == section).select("raw", F.col("start").alias("pos"))
    return graph_of(of("nodes"), of("edges" if "edges" in keys else "links"))
