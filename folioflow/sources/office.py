"""Office packages as tables: cells, blocks, slides, parts and relationships."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

CELLS = "path string, sheet_idx int, sheet string, r int, c int, f string, t string, n double, s string, b boolean, e string, style int, shown string, shared_row int, shared_col int"
BLOCKS = "path string, pos int, type string, level int, label string, text string, runs array<struct<text:string,bold:boolean,italic:boolean,link:string>>, rows array<array<struct<text:string,colspan:int,rowspan:int>>>"
SLIDES = "path string, slide int, pos int, type string, text string"


def files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", "content")


def parsed(found: DataFrame, schema: str, parse: Callable[[bytes], Iterator[tuple]], batch: int = 5000, most: int = 8 << 20) -> DataFrame:
    """Rows that ``parse`` yields from each file, in batches, so a large file is never one frame.  A file that cannot be read has no rows.

    Small files share a frame, until ``batch`` rows or ``most`` bytes of files: a frame costs far more than a small file's rows.
    """
    names = [x.strip().split(" ")[0] for x in _fields(schema)]
    return found.mapInPandas(_gathered(parse, names, batch, most), schema)


def _gathered(parse: Callable[[bytes], Iterator[tuple]], names: list[str], batch: int, most: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    for row in parse(bytes(content)):
                        held.append((path, *row))
                        if len(held) >= batch:
                            yield _frame(held, names)
                            held, size = [], 0
                except (KeyError, ValueError, OSError, EOFError, AttributeError, _bad_zip()):
                    pass
                size += len(content)
                if held and size >= most:
                    yield _frame(held, names)
                    held, size = [], 0
        if held:
            yield _frame(held, names)

    return run


def _bad_zip() -> type:
    import zipfile

    return zipfile.BadZipFile


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame({n: pd.Series([r[i] for r in rows], dtype=object) for i, n in enumerate(names)})


def _fields(schema: str) -> list[str]:
    """A schema's fields, commas inside types left alone."""
    out, depth, held = [], 0, ""
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            out.append(held)
            held = ""
        else:
            held += c
    return [*out, held]


def cells(spark: SparkSession, path: str, glob: str = "*.xls[xm]", hidden: bool = True, display: bool = False) -> DataFrame:
    """Cells of workbooks; ``display`` adds their texts under their formats."""
    from .xlsx import read_cells

    return parsed(files(spark, path, glob), CELLS, lambda content: read_cells(content, hidden, display))


def merges(spark: SparkSession, path: str, glob: str = "*.xls[xm]") -> DataFrame:
    from .xlsx import read_merges

    return parsed(files(spark, path, glob), "path string, sheet string, r1 int, r2 int, c1 int, c2 int", read_merges)


def links(spark: SparkSession, path: str, glob: str = "*.xls[xm]") -> DataFrame:
    from .xlsx import read_links

    return parsed(files(spark, path, glob), "path string, sheet string, r1 int, r2 int, c1 int, c2 int, target string", read_links)


def comments(spark: SparkSession, path: str, glob: str = "*.xls[xm]") -> DataFrame:
    from .xlsx import read_comments

    return parsed(files(spark, path, glob), "path string, sheet string, r int, c int, author string, text string", read_comments)


def tables(spark: SparkSession, path: str, glob: str = "*.xls[xm]") -> DataFrame:
    from .xlsx import read_tables

    return parsed(files(spark, path, glob), "path string, sheet string, name string, r1 int, r2 int, c1 int, c2 int, header_rows int, columns array<string>", read_tables)


def geometry(spark: SparkSession, path: str, glob: str = "*.xls[xm]") -> DataFrame:
    from .xlsx import read_geometry

    return parsed(files(spark, path, glob), "path string, sheet string, rtl boolean, frozen_rows int, frozen_cols int, hidden_rows array<int>, hidden_cols array<int>", read_geometry)


def blocks(spark: SparkSession, path: str, glob: str = "*.docx") -> DataFrame:
    from .docx import read_blocks

    return parsed(files(spark, path, glob), BLOCKS, read_blocks)


def slides(spark: SparkSession, path: str, glob: str = "*.pptx") -> DataFrame:
    from .pptx import read_items

    return parsed(files(spark, path, glob), SLIDES, read_items)


def parts(spark: SparkSession, path: str, glob: str = "*.*x") -> DataFrame:
    """Parts of packages with their sizes."""
    from .ooxml import Package

    def read(content: bytes) -> Iterator[tuple]:
        for info in Package(content).zip.infolist():
            yield info.filename, info.file_size

    return parsed(files(spark, path, glob), "path string, part string, bytes long", read)


def relationships(spark: SparkSession, path: str, glob: str = "*.*x") -> DataFrame:
    """Relationships with their targets resolved."""
    from .ooxml import Package

    def read(content: bytes) -> Iterator[tuple]:
        package = Package(content)
        for name in ["", *package.zip.namelist()]:
            if not name.endswith(".rels"):
                for r in package.relations(name).values():
                    yield name, r.id, r.kind, r.target, r.external

    return parsed(files(spark, path, glob), "path string, source string, id string, kind string, target string, external boolean", read)
