"""Workbooks as a source of Spark: ``spark.read.format("folio_xlsx")`` and ``spark.readStream.format("folio_xlsx")``.

A partition is a sheet of a file, or a range of its rows where the sheet's part is larger than ``partbytes``, so the sheets of one
file are read by as many tasks.  A task streams the sheet's part through a parser that keeps one row, and stops behind its
last row.  Columns that the schema asked for leaves out are not made: give a schema to prune them.  With option ``filters``
(``true``) and ``spark.sql.python.filterPushdown.enabled`` filters on ``path``, ``sheet``, ``sheet_idx`` and ``r`` choose files,
sheets and rows before anything is planned.

Options: ``path`` (a file, a folder or a pattern), ``partbytes``, ``filters``, ``hidden`` (``false`` leaves hidden sheets out),
and for streams ``maxfilespertrigger``.

The planner and the tasks open files themselves, so paths must be on file systems that every node mounts; for stores
that only Spark's readers can open ``sources.office.cells`` reads whole files through ``binaryFile``.

Defined results
    file that is no workbook   no rows
    empty sheet                no rows
    stored order               rows and columns without a reference follow the last
    stream                     a file is read once, when it is first seen; files of one moment go by name
"""

from __future__ import annotations

import glob
import os
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

NAME = "folio_xlsx"
SCHEMA = "path string, sheet_idx int, sheet string, r int, c int, f string, t string, n double, s string, b boolean, e string"
#: Bytes of a sheet's part, unpacked, that a partition is given.
PART_BYTES = 32 << 20
LAST_ROW = 1_048_576


@dataclass
class Rows(InputPartition):
    """Rows ``low`` to ``high`` of a sheet of a file."""

    path: str
    sheet_idx: int
    low: int
    high: int


def found_files(path: str) -> list[str]:
    path = re.sub(r"^file:/+", "/", path)
    spots = glob.glob(os.path.join(path, "**", "*.xls[xm]"), recursive=True) if os.path.isdir(path) else glob.glob(path)
    return sorted(p for p in spots if os.path.isfile(p))


def _opened(path: str):
    from .ooxml import Package
    from .xlsx import sheets

    with open(path, "rb") as f:
        package = Package(f.read())
    return package, *sheets(package)


class _Choice:
    """What filters ask for: sets of paths, sheets and indexes, and a range of rows."""

    def __init__(self) -> None:
        self.sets: dict[str, set] = {}
        self.low, self.high = 1, LAST_ROW

    def take(self, f) -> bool:
        """Whether the filter is met by the choice alone."""
        name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
        if name in ("path", "sheet", "sheet_idx") and isinstance(f, (EqualTo, In)):
            values = set(f.value) if isinstance(f, In) else {f.value}
            self.sets[name] = self.sets.get(name, values) & values
            return True
        if name == "r" and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
            low, high = {EqualTo: (f.value, f.value), GreaterThan: (f.value + 1, LAST_ROW), GreaterThanOrEqual: (f.value, LAST_ROW), LessThan: (1, f.value - 1), LessThanOrEqual: (1, f.value)}[type(f)]
            self.low, self.high = max(self.low, low), min(self.high, high)
            return True
        return False

    def holds(self, name: str, value) -> bool:
        return name not in self.sets or value in self.sets[name]


def planned(files: list[str], options, choice: _Choice) -> Iterator[Rows]:
    """Partitions of some files: each sheet cut by its size, as far as its rows are numbered evenly."""
    most, hidden = int(options.get("partbytes", PART_BYTES)), options.get("hidden", "true").lower() != "false"
    for path in files:
        if not choice.holds("path", path):
            continue
        try:
            package, listed, _ = _opened(path)
        except (OSError, zipfile.BadZipFile, AttributeError):
            continue
        for i, sheet in enumerate(listed):
            if sheet["hidden"] and not hidden or not choice.holds("sheet", sheet["name"]) or not choice.holds("sheet_idx", i):
                continue
            name = package.names.get(sheet["path"].lstrip("/").lower())
            size = package.zip.getinfo(name).file_size if name else 0
            last = _last_row(package, name) if size > most else LAST_ROW
            step = max(1, -(-last // max(1, -(-size // most)))) if size > most else LAST_ROW
            for low in range(1, last + 1, step):
                high = LAST_ROW if low + step > last else low + step - 1
                if low <= choice.high and high >= choice.low:
                    yield Rows(path, i, max(low, choice.low), min(high, choice.high))


_ROW = re.compile(rb'<(?:\w+:)?row\b[^>]*?\br="(\d+)"')


def _last_row(package, name: str) -> int:
    """The last row that a sheet's dimension names; without one the last that is numbered."""
    last, tail = LAST_ROW, b""
    with package.zip.open(name) as part:
        while piece := part.read(1 << 20):
            if not tail and (m := re.search(rb'<(?:\w+:)?dimension\s+ref="[A-Z]+\d+:[A-Z]+(\d+)"', piece[:4096])):
                return min(LAST_ROW, int(m[1]))
            tail = tail[-256:] + piece
            for m in _ROW.finditer(tail):
                last = int(m[1])
    return min(LAST_ROW, last)


def sheet_rows(part: Rows, names: list[str]) -> Iterator[tuple]:
    """The cells of a partition, the columns asked for alone."""
    from ..formula.parser import column_number
    from .ooxml import attribute, child, children, local
    from .xlsx import _CELL, _cell

    package, listed, book = _opened(part.path)
    sheet = listed[part.sheet_idx]
    name = package.names.get(sheet["path"].lstrip("/").lower())
    if name is None:
        return
    with package.zip.open(name) as stream:
        if b"<!DOCTYPE" in stream.read(4096).upper().replace(b" ", b""):
            return
    r = 0
    with package.zip.open(name) as stream:
        above = []
        for event, node in ElementTree.iterparse(stream, ("start", "end")):
            if event == "start":
                above.append(node)
                continue
            above.pop()
            if local(node.tag) != "row":
                continue
            r = int(attribute(node, "r") or r + 1)
            if r > part.high:
                return
            c = 0
            for cell in children(node, "c") if r >= part.low else ():
                m = _CELL.fullmatch(attribute(cell, "r") or "")
                c = column_number(m[1]) if m else c + 1
                f = child(cell, "f")
                t, n, s, b, e = _cell(cell, book)
                if t == "z" and f is None:
                    continue
                whole = {"path": part.path, "sheet_idx": part.sheet_idx, "sheet": sheet["name"], "r": r, "c": c, "f": f.text if f is not None else None, "t": t, "n": n, "s": s, "b": b, "e": e}
                yield tuple(whole[x] for x in names)
            # A row that is done is dropped from the tree above it.
            node.clear()
            if above:
                above[-1].clear()


class _Reader(DataSourceReader):
    def __init__(self, schema, options) -> None:
        self.names, self.options, self.choice = schema.fieldNames(), dict(options), _Choice()

    def partitions(self) -> list[Rows]:
        return list(planned(found_files(self.options["path"]), self.options, self.choice)) or [Rows("", 0, 1, 0)]

    def read(self, partition: Rows) -> Iterator[tuple]:
        return sheet_rows(partition, self.names) if partition.path else iter(())


class _ChoosyReader(_Reader):
    def pushFilters(self, filters):
        for f in filters:
            if not self.choice.take(f):
                yield f


class _StreamReader(DataSourceStreamReader):
    """Files in order of the moment they changed and of name; an offset is the last of them that was read."""

    def __init__(self, schema, options) -> None:
        self.names, self.options, self.at = schema.fieldNames(), dict(options), None

    def initialOffset(self) -> dict:
        return {"moment": 0, "path": ""}

    def _after(self, start: dict) -> list[tuple[int, str]]:
        seen = sorted((os.stat(p).st_mtime_ns, p) for p in found_files(self.options["path"]))
        return [x for x in seen if x > (start["moment"], start["path"])]

    def latestOffset(self) -> dict:
        self.at = self.at or self.initialOffset()
        ahead = self._after(self.at)[: int(self.options.get("maxfilespertrigger", 1 << 30))]
        if ahead:
            self.at = {"moment": ahead[-1][0], "path": ahead[-1][1]}
        return self.at

    def partitions(self, start: dict, end: dict) -> list[Rows]:
        # After a restart the query tells where it stood.
        self.at = max((self.at or end, end), key=lambda o: (o["moment"], o["path"]))
        files = [p for m, p in self._after(start) if (m, p) <= (end["moment"], end["path"])]
        return list(planned(files, self.options, _Choice()))

    def read(self, partition: Rows) -> Iterator[tuple]:
        return sheet_rows(partition, self.names)

    def commit(self, end: dict) -> None:
        pass


class WorkbookSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        # Spark refuses a reader that takes filters unless the session lets it.
        return (_ChoosyReader if self.options.get("filters", "false").lower() == "true" else _Reader)(schema, self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(schema, self.options)


def register(spark) -> None:
    """Makes ``folio_xlsx`` known to a session."""
    spark.dataSource.register(WorkbookSource)
