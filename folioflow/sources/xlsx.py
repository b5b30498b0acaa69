"""Cells of spreadsheets."""

from __future__ import annotations

import re
from collections.abc import Iterator

from ..formula.formats import builtin, format_value
from ..formula.parser import column_number
from .ooxml import Package, attribute, child, children, local

_CELL = re.compile(r"([A-Z]{1,3})(\d{1,7})")


def _shared(package: Package, path: str | None) -> list[str]:
    """Shared texts: runs joined, phonetic guides left out."""
    out = []
    for si in children(package.xml(path) if path else None, "si"):
        out.append("".join(t.text or "" for node in si if local(node.tag) in ("t", "r") for t in ([node] if local(node.tag) == "t" else children(node, "t"))))
    return out


def _formats(package: Package, path: str | None) -> list[str]:
    """The number format of each cell style."""
    root = package.xml(path) if path else None
    own = {int(attribute(n, "numFmtId")): attribute(n, "formatCode") or "General" for n in children(child(root, "numFmts"), "numFmt")}
    return [own.get(i, builtin(i)) for x in children(child(root, "cellXfs"), "xf") for i in [int(attribute(x, "numFmtId") or 0)]]


def sheets(package: Package) -> tuple[list[dict], dict]:
    """Worksheets in order, and what they share: ``system``, ``shared``, ``formats``."""
    main = package.main() or "xl/workbook.xml"
    root, relations = package.xml(main), package.relations(main)
    find = lambda kind: next((r.target for r in relations.values() if r.kind == kind), None)
    properties = child(root, "workbookPr")
    system = 1904 if properties is not None and (attribute(properties, "date1904") or "0").lower() in ("1", "true") else 1900
    out = []
    for s in children(child(root, "sheets"), "sheet"):
        r = relations.get(s.attrib.get("{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id", ""))
        if r is not None and r.kind == "worksheet":
            out.append({"name": attribute(s, "name"), "path": r.target, "hidden": (attribute(s, "state") or "visible") != "visible"})
    return out, {"system": system, "shared": _shared(package, find("sharedStrings")), "formats": _formats(package, find("styles"))}


def read_cells(content: bytes, hidden: bool = True, display: bool = False) -> Iterator[tuple]:
    """``sheet_idx, sheet, r, c, f, t, n, s, b, e, style, shown, shared_row, shared_col`` of every cell with a value, formula or style.

    Rows and columns without a reference follow the last; children of shared formulas
    name their master.  ``shown`` is the text under the cell's format.
    """
    package = Package(content)
    listed, book = sheets(package)
    for i, sheet in enumerate(listed):
        if sheet["hidden"] and not hidden:
            continue
        masters: dict[str, tuple[int, int]] = {}
        r = 0
        for row in children(child(package.xml(sheet["path"]), "sheetData"), "row"):
            r = int(attribute(row, "r") or r + 1)
            c = 0
            for cell in children(row, "c"):
                m = _CELL.fullmatch(attribute(cell, "r") or "")
                c = column_number(m[1]) if m else c + 1
                found = _cell(cell, book)
                style = int(attribute(cell, "s") or 0)
                f = child(cell, "f")
                formula, master = (f.text if f is not None else None), (None, None)
                if f is not None and attribute(f, "t") == "shared":
                    if f.text:
                        masters[attribute(f, "si") or ""] = (r, c)
                    else:
                        master = masters.get(attribute(f, "si") or "", (None, None))
                if found[0] == "z" and formula is None and master[0] is None and not style:
                    continue
                shown = _shown(found, style, book) if display else None
                yield (i, sheet["name"], r, c, formula, *found, style, shown, *master)


def _cell(cell, book: dict) -> tuple:
    """``t, n, s, b, e`` of a cell."""
    kind, v = attribute(cell, "t") or "n", child(cell, "v")
    raw = v.text if v is not None else None
    if kind == "inlineStr":
        inline = child(cell, "is")
        return "s", None, "".join(t.text or "" for n in (inline if inline is not None else []) if local(n.tag) in ("t", "r") for t in ([n] if local(n.tag) == "t" else children(n, "t"))), None, None
    if raw is None:
        return "z", None, None, None, None
    if kind == "s":
        i = int(raw)
        return ("s", None, book["shared"][i], None, None) if i < len(book["shared"]) else ("z", None, None, None, None)
    if kind in ("str", "d"):
        return "s", None, raw, None, None
    if kind == "b":
        return "b", None, None, raw.strip() == "1", None
    if kind == "e":
        return "e", None, None, None, raw
    try:
        return "n", float(raw), None, None, None
    except ValueError:
        return "s", None, raw, None, None


def _shown(found: tuple, style: int, book: dict) -> str:
    t, n, s, b, e = found
    code = book["formats"][style] if style < len(book["formats"]) else "General"
    return {"n": lambda: format_value(n, code, "viewer", book["system"]), "s": lambda: s, "b": lambda: "TRUE" if b else "FALSE", "e": lambda: e, "z": lambda: ""}[t]()


def read_merges(content: bytes) -> Iterator[tuple[str, int, int, int, int]]:
    """``sheet, r1, r2, c1, c2`` of merged ranges."""
    package = Package(content)
    for sheet in sheets(package)[0]:
        for m in children(child(package.xml(sheet["path"]), "mergeCells"), "mergeCell"):
            ends = [_CELL.fullmatch(x) for x in (attribute(m, "ref") or "").split(":")]
            if all(ends):
                a, b = ends[0], ends[-1]
                yield sheet["name"], int(a[2]), int(b[2]), column_number(a[1]), column_number(b[1])


def _area(ref: str) -> tuple[int, int, int, int] | None:
    """``r1, r2, c1, c2`` of a reference to a cell or range."""
    ends = [_CELL.fullmatch(x.replace("$", "")) for x in ref.split(":")]
    if not all(ends):
        return None
    a, b = ends[0], ends[-1]
    return int(a[2]), int(b[2]), column_number(a[1]), column_number(b[1])


def read_links(content: bytes) -> Iterator[tuple]:
    """``sheet, r1, r2, c1, c2, target`` of hyperlinks, inner places written ``#place``."""
    package = Package(content)
    for sheet in sheets(package)[0]:
        relations = package.relations(sheet["path"])
        for link in children(child(package.xml(sheet["path"]), "hyperlinks"), "hyperlink"):
            area = _area(attribute(link, "ref") or "")
            relation = relations.get(link.attrib.get("{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id", ""))
            place = attribute(link, "location")
            target = (relation.target if relation else "") + (f"#{place}" if place else "")
            if area and target:
                yield sheet["name"], *area, target


def read_comments(content: bytes) -> Iterator[tuple]:
    """``sheet, r, c, author, text`` of comments."""
    package = Package(content)
    for sheet in sheets(package)[0]:
        for relation in package.relations(sheet["path"]).values():
            root = package.xml(relation.target) if relation.kind == "comments" else None
            authors = [a.text or "" for a in children(child(root, "authors"), "author")]
            for comment in children(child(root, "commentList"), "comment"):
                area, who = _area(attribute(comment, "ref") or ""), int(attribute(comment, "authorId") or 0)
                if area:
                    text = "".join(t.text or "" for t in comment.iter() if local(t.tag) == "t")
                    yield sheet["name"], area[0], area[2], authors[who] if who < len(authors) else None, text


def read_tables(content: bytes) -> Iterator[tuple]:
    """``sheet, name, r1, r2, c1, c2, header_rows, columns`` of tables."""
    package = Package(content)
    for sheet in sheets(package)[0]:
        for relation in package.relations(sheet["path"]).values():
            root = package.xml(relation.target) if relation.kind == "table" else None
            area = _area(attribute(root, "ref") or "") if root is not None else None
            if area:
                columns = [attribute(c, "name") or "" for c in children(child(root, "tableColumns"), "tableColumn")]
                yield sheet["name"], attribute(root, "displayName") or attribute(root, "name"), *area, int(attribute(root, "headerRowCount") or 1), columns


def read_geometry(content: bytes) -> Iterator[tuple]:
    """``sheet, rtl, frozen_rows, frozen_cols, hidden_rows, hidden_cols``; of a span of columns at most 300 count."""
    package = Package(content)
    for sheet in sheets(package)[0]:
        root = package.xml(sheet["path"])
        view = child(child(root, "sheetViews"), "sheetView")
        pane = child(view, "pane")
        frozen = [int(float(attribute(pane, k) or 0)) if pane is not None and (attribute(pane, "state") or "").startswith("frozen") else 0 for k in ("ySplit", "xSplit")]
        rows = [int(attribute(r, "r")) for r in children(child(root, "sheetData"), "row") if (attribute(r, "hidden") or "0") in ("1", "true") and attribute(r, "r")]
        cols = [c for x in children(child(root, "cols"), "col") if (attribute(x, "hidden") or "0") in ("1", "true") for c in range(int(attribute(x, "min")), min(int(attribute(x, "max")), int(attribute(x, "min")) + 299) + 1)]
        yield sheet["name"], view is not None and (attribute(view, "rightToLeft") or "0") in ("1", "true"), *frozen, rows, cols
