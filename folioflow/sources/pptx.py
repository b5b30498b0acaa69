"""Texts of presentations, slide by slide."""

from __future__ import annotations

from collections.abc import Iterator

from .ooxml import Package, attribute, child, children, local

MAX_SLIDES = 400


def read_items(content: bytes, most: int = MAX_SLIDES) -> Iterator[tuple[int, int, str, str]]:
    """``slide, pos, type, text``: titles and bodies in the order of the slides' list; a slide that cannot be read is empty."""
    package = Package(content)
    main = package.main() or "ppt/presentation.xml"
    relations = package.relations(main)
    order = [relations.get(x.attrib.get("{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id", "")) for x in children(child(package.xml(main), "sldIdLst"), "sldId")]
    for i, relation in enumerate([r for r in order if r is not None][:most], 1):
        root = package.xml(relation.target)
        tree = child(child(root, "cSld"), "spTree") if root is not None else None
        pos = 0
        for kind, text in _shapes(tree, 0):
            if text:
                yield i, pos, kind, text
                pos += 1


def _shapes(node, depth: int) -> Iterator[tuple[str, str]]:
    """Shapes in the order of the tree, groups up to eight deep."""
    for n in [] if node is None or depth > 8 else node:
        name = local(n.tag)
        if name == "sp":
            place = child(child(child(n, "nvSpPr"), "nvPr"), "ph")
            title = place is not None and (attribute(place, "type") or "") in ("title", "ctrTitle")
            yield "TITLE" if title else "BODY", _body(child(n, "txBody"))
        elif name == "grpSp":
            yield from _shapes(n, depth + 1)
        elif name == "graphicFrame":
            for table in (t for t in n.iter() if local(t.tag) == "tbl"):
                rows = ["\t".join(_body(child(c, "txBody")) for c in children(r, "tc") if (attribute(c, "vMerge") or "0") != "1" and (attribute(c, "hMerge") or "0") != "1") for r in children(table, "tr")]
                yield "TABLE", "\n".join(rows)


def _body(body) -> str:
    lines = []
    for p in children(body, "p"):
        lines.append("".join("\n" if local(x.tag) == "br" else "".join(t.text or "" for t in children(x, "t")) for x in p if local(x.tag) in ("r", "fld", "br")))
    return "\n".join(lines).strip()


PLACED = "path string, slide int, pos int, type string, text string, x long, y long, width long, height long, placed_by string"
TABLES = "path string, slide int, table int, r int, c int, rowspan int, colspan int, text string"


def _slides(package: Package, most: int) -> Iterator[tuple[int, str]]:
    """Numbers and parts of the slides, in the order of their list."""
    main = package.main() or "ppt/presentation.xml"
    relations = package.relations(main)
    order = [relations.get(x.attrib.get("{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id", "")) for x in children(child(package.xml(main), "sldIdLst"), "sldId")]
    yield from enumerate([r.target for r in order if r is not None][:most], 1)


def _box(sp) -> tuple[int, int, int, int] | None:
    form = child(child(sp, "spPr"), "xfrm")
    at, size = child(form, "off"), child(form, "ext")
    return None if at is None or size is None else (int(attribute(at, "x")), int(attribute(at, "y")), int(attribute(size, "cx")), int(attribute(size, "cy")))


def _place(sp) -> tuple[str, str | None] | None:
    """Type and number of the placeholder that a shape fills; a body where no type is said, and any title is a title."""
    mark = child(child(child(sp, "nvSpPr"), "nvPr"), "ph")
    if mark is None:
        return None
    kind = attribute(mark, "type") or "body"
    return {"ctrTitle": "title", "subTitle": "body", "obj": "body"}.get(kind, kind), attribute(mark, "idx")


def _boxes(root) -> dict:
    """Boxes of a layout's or master's placeholders by type, and by type and number."""
    out: dict = {}
    for sp in children(child(child(root, "cSld"), "spTree"), "sp"):
        place, box = _place(sp), _box(sp)
        if place and box:
            out[place[0], None] = out[place] = box
    return out


def read_placed(content: bytes, most: int = MAX_SLIDES) -> Iterator[tuple]:
    """Texts with their boxes: a shape's own, else that of the placeholder it fills in the layout, else in the master; ``placed_by`` says which."""
    package = Package(content)
    known: dict[str, dict] = {}

    def inherited(part: str, kind: str) -> str | None:
        return next((r.target for r in package.relations(part).values() if r.kind == kind), None)

    def boxes(part: str | None) -> dict:
        if part is not None and part not in known:
            known[part] = _boxes(package.xml(part))
        return known.get(part, {})

    for number, part in _slides(package, most):
        layout = inherited(part, "slideLayout")
        master = inherited(layout, "slideMaster") if layout else None
        pos = 0
        for sp in children(child(child(package.xml(part), "cSld"), "spTree"), "sp"):
            text, place, box, by = _body(child(sp, "txBody")), _place(sp), _box(sp), "slide"
            if box is None and place is not None:
                for by, held in (("layout", boxes(layout)), ("master", boxes(master))):
                    box = held.get(place) or held.get((place[0], None))
                    if box:
                        break
            if text:
                yield number, pos, "TITLE" if place and place[0] == "title" else "BODY", text, *(box or (None,) * 4), by if box else None
                pos += 1


def read_tables(content: bytes, most: int = MAX_SLIDES) -> Iterator[tuple]:
    """Cells of the tables on slides; cells that a merge covers are no cells of their own."""
    package = Package(content)
    for number, part in _slides(package, most):
        root, table = package.xml(part), 0
        for tbl in [] if root is None else [t for t in root.iter() if local(t.tag) == "tbl"]:
            for r, tr in enumerate(children(tbl, "tr")):
                for c, tc in enumerate(children(tr, "tc")):
                    if not any(attribute(tc, k) in ("1", "true") for k in ("hMerge", "vMerge")):
                        yield number, table, r, c, int(attribute(tc, "rowSpan") or 1), int(attribute(tc, "gridSpan") or 1), _body(child(tc, "txBody"))
            table += 1
