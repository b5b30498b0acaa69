"""Blocks of word-processor documents: headings, paragraphs, list items, tables, notes."""

from __future__ import annotations

import re
from collections.abc import Iterator

from ..formula.formats import list_label
from .ooxml import Package, attribute, child, children, flag, local

_KEPT = {"hyperlink", "fldSimple", "sdt", "sdtContent", "ins", "moveTo", "smartTag", "customXml", "dir", "bdo"}
# Characters of symbol fonts that bullets are written in, as plain ones.
BULLETS = {"\uf0b7": "•", "\uf0a7": "▪", "\uf0d8": "➢", "\uf0fc": "✓", "\uf076": "❖", "\uf0a8": "◻", "\uf06e": "■", "o": "◦", "§": "▪"}


def bullet(text: str) -> str:
    """A bullet's text: known symbols as plain characters, other private ones as a dot."""
    if not text:
        return "•"
    return BULLETS.get(text[0], "•" if "\uf000" <= text[0] <= "\uf0ff" else text)


class Styles:
    """Paragraph styles with what they inherit, a cycle walked once."""

    def __init__(self, root) -> None:
        self.nodes = {attribute(s, "styleId"): s for s in children(root, "style")}

    def chain(self, style: str | None) -> list:
        out, seen = [], set()
        while style in self.nodes and style not in seen:
            seen.add(style)
            out.append(self.nodes[style])
            base = child(self.nodes[style], "basedOn")
            style = attribute(base, "val") if base is not None else None
        return out

    def heading(self, style: str | None) -> int | None:
        """Level of a heading style: its outline level, or what its name says; a title is 0."""
        for node in self.chain(style):
            outline = child(child(node, "pPr"), "outlineLvl")
            if outline is not None and int(attribute(outline, "val") or 9) < 9:
                return int(attribute(outline, "val")) + 1
            name = child(node, "name")
            text = (attribute(name, "val") or "").lower() if name is not None else ""
            if text == "title":
                return 0
            if text.startswith("heading") and text[7:].strip().isdigit():
                return int(text[7:])
        return None


class Numbering:
    """List counters: deeper levels start again when a higher one moves."""

    def __init__(self, root) -> None:
        abstract = {attribute(a, "abstractNumId"): {int(attribute(lv, "ilvl")): lv for lv in children(a, "lvl")} for a in children(root, "abstractNum")}
        self.lists, self.counts = {}, {}
        for n in children(root, "num"):
            base = child(n, "abstractNumId")
            key, overrides = attribute(base, "val") if base is not None else None, children(n, "lvlOverride")
            starts = {int(attribute(o, "ilvl")): int(attribute(child(o, "startOverride"), "val")) for o in overrides if child(o, "startOverride") is not None}
            self.lists[attribute(n, "numId")] = (abstract.get(key, {}), starts, ("num", attribute(n, "numId")) if overrides else ("abstract", key))

    def label(self, number: str, level: int) -> str | None:
        levels, starts, key = self.lists.get(number, ({}, {}, ("none", number)))
        if level not in levels:
            return None
        counts = self.counts.setdefault(key, {})

        def first(lv: int) -> int:
            start = child(levels.get(lv), "start")
            return starts.get(lv, int(attribute(start, "val")) if start is not None else 1)

        counts[level] = counts[level] + 1 if level in counts else first(level)
        for deeper in [k for k in counts if k > level]:
            del counts[deeper]
        text = child(levels[level], "lvlText")
        label = attribute(text, "val") or "" if text is not None else ""
        for lv in range(level + 1):
            kind = child(levels.get(lv), "numFmt")
            name = attribute(kind, "val") if kind is not None else "decimal"
            if name == "bullet":
                return bullet(label)
            label = label.replace(f"%{lv + 1}", list_label(counts.get(lv, first(lv)), name))
        return label


def _runs(node, relations, notes: list) -> Iterator[tuple[str, bool, bool, str | None]]:
    """``text, bold, italic, link`` of the runs of a paragraph; deleted and hidden text is left out."""
    for n in node:
        name = local(n.tag)
        if name == "r":
            properties = child(n, "rPr")
            if flag(child(properties, "vanish")):
                continue
            text = "".join(_piece(p, notes) for p in n)
            if text:
                yield text, flag(child(properties, "b")), flag(child(properties, "i")), None
        elif name == "hyperlink":
            target = relations.get(n.attrib.get("{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id", ""))
            for text, b, i, _ in _runs(n, relations, notes):
                yield text, b, i, target.target if target else None
        elif name in _KEPT:
            yield from _runs(n, relations, notes)
        elif name == "AlternateContent":
            choice = child(n, "Choice")
            yield from _runs(choice if choice is not None else child(n, "Fallback"), relations, notes) if (choice is not None or child(n, "Fallback") is not None) else ()
        elif name in ("oMath", "oMathPara"):
            text = "".join(t.text or "" for t in n.iter() if local(t.tag) == "t")
            if text:
                yield text, False, False, None


def _piece(p, notes: list) -> str:
    name = local(p.tag)
    if name == "t":
        return p.text or ""
    if name in ("footnoteReference", "endnoteReference"):
        key = (name[:-9], attribute(p, "id"))
        if key not in notes:
            notes.append(key)
        return f"[{notes.index(key) + 1}]"
    if name in ("br", "cr"):
        return "" if attribute(p, "type") in ("page", "column") else "\n"
    return {"tab": "\t", "noBreakHyphen": "‑", "softHyphen": "­"}.get(name, "")


def read_blocks(content: bytes) -> Iterator[tuple]:
    """``pos, type, level, label, text, runs, rows`` of every block.

    ``runs`` are ``(text, bold, italic, link)``; ``rows`` of a table are rows of ``(text, colspan, rowspan)``.
    Notes follow the body as blocks of type ``NOTE``, numbered by first mention.
    """
    package = Package(content)
    main = package.main() or "word/document.xml"
    relations = package.relations(main)
    part = lambda kind: next((package.xml(r.target) for r in relations.values() if r.kind == kind), None)
    styles, numbering, notes = Styles(part("styles")), Numbering(part("numbering")), []
    pos = 0

    def walk(node) -> Iterator[tuple]:
        for n in [] if node is None else node:
            name = local(n.tag)
            if name == "p":
                yield _paragraph(n, styles, numbering, relations, notes)
            elif name == "tbl":
                yield "TABLE", None, None, "", [], _table(n, relations, notes)
            elif name in _KEPT:
                yield from walk(n)

    for block in walk(child(package.xml(main), "body")):
        if block[0] != "TABLE" and not block[3]:
            continue
        yield (pos, *block)
        pos += 1
    bodies = {}
    for kind in ("footnote", "endnote"):
        for n in children(part(f"{kind}s"), kind):
            if (attribute(n, "type") or "normal") == "normal":
                bodies[kind, attribute(n, "id")] = "\n".join("".join(r[0] for r in _runs(p, relations, [])) for p in children(n, "p")).strip()
    for i, key in enumerate(notes, 1):
        yield pos, "NOTE", i, f"[{i}]", bodies.get(key, ""), [], []
        pos += 1


def _paragraph(p, styles: Styles, numbering: Numbering, relations, notes) -> tuple:
    properties = child(p, "pPr")
    style = child(properties, "pStyle")
    name = attribute(style, "val") if style is not None else None
    outline = child(properties, "outlineLvl")
    level = int(attribute(outline, "val")) + 1 if outline is not None and int(attribute(outline, "val")) < 9 else styles.heading(name)
    number = child(properties, "numPr")
    if number is None:
        number = next((x for s in styles.chain(name) if (x := child(child(s, "pPr"), "numPr")) is not None), None)
    runs = list(_runs(p, relations, notes))
    text = "".join(r[0] for r in runs)
    if number is not None and child(number, "numId") is not None and attribute(child(number, "numId"), "val") != "0" and level is None:
        depth = int(attribute(child(number, "ilvl"), "val")) if child(number, "ilvl") is not None else 0
        return "LIST_ITEM", depth, numbering.label(attribute(child(number, "numId"), "val"), depth), text, runs, []
    return ("PARAGRAPH" if level is None else "HEADING"), level, None, text, runs, []


def _table(table, relations, notes) -> list[list[tuple[str, int, int]]]:
    """Rows of cells with their spans; cells that continue a vertical merge lengthen the one above."""
    out, above = [], {}
    for tr in _deep(table, "tr"):
        row, column = [], 0
        before = child(child(tr, "trPr"), "gridBefore")
        column += int(attribute(before, "val")) if before is not None else 0
        for tc in _deep(tr, "tc"):
            properties = child(tc, "tcPr")
            span = child(properties, "gridSpan")
            width = int(attribute(span, "val")) if span is not None else 1
            merge = child(properties, "vMerge")
            if merge is not None and (attribute(merge, "val") or "continue") == "continue" and column in above:
                cell = above[column]
                cell[2] += 1
            else:
                cell = ["\n".join("".join(r[0] for r in _runs(p, relations, notes)) for p in _deep(tc, "p")), width, 1]
                row.append(cell)
                above[column] = cell
            column += width
        out.append(row)
    return [[tuple(c) for c in row] for row in out]


def _deep(node, name: str) -> Iterator:
    """Children of a name, those inside kept wrappers too."""
    for n in node:
        if local(n.tag) == name:
            yield n
        elif local(n.tag) in _KEPT:
            yield from _deep(n, name)


#: What a run may be given by the document, its styles and itself.
_SWITCHES = ("b", "i", "strike", "dstrike", "caps", "smallCaps", "vanish", "rtl")
RUNS = "path string, pos int, run int, text string, bold boolean, italic boolean, underline string, strike boolean, caps boolean, size double, colour string, highlight string, font string, raised string, link string"


def run_properties(node) -> dict:
    """What a properties element says; what it does not mention is missing."""
    out = {}
    for e in [] if node is None else node:
        name, value = local(e.tag), attribute(e, "val")
        if name in _SWITCHES:
            out[name] = flag(e)
        elif name == "u":
            out["u"] = value or "single"
        elif name == "rFonts":
            font = attribute(e, "ascii") or attribute(e, "hAnsi")
            out |= {"font": font} if font else {}
        elif name == "sz" and value and value.lstrip("-").isdigit():
            out["sz"] = int(value) / 2
        elif name in ("color", "highlight", "vertAlign") and value:
            out[name] = value.lower() if value.lower() == "auto" else value
    return out


def read_runs(content: bytes) -> Iterator[tuple]:
    """Every visible run with what it looks like, as columns of ``RUNS`` say.

    Later words win: the document's defaults, the paragraph style from its oldest ancestor on, the character style likewise, the
    run itself.  A paragraph without a style has the default one.  Fields give their results, not their codes; a HYPERLINK's address is the link.
    """
    package = Package(content)
    main = package.main() or "word/document.xml"
    relations = package.relations(main)
    part = lambda kind: next((package.xml(r.target) for r in relations.values() if r.kind == kind), None)
    root = part("styles")
    styles = Styles(root)
    base = run_properties(child(child(child(root, "docDefaults"), "rPrDefault"), "rPr"))
    usual = next((k for k, n in styles.nodes.items() if attribute(n, "type") == "paragraph" and (attribute(n, "default") or "0") in ("1", "true")), None)

    def styled(style: str | None) -> dict:
        out: dict = {}
        for node in reversed(styles.chain(style)):
            out |= run_properties(child(node, "rPr"))
        return out

    def runs(node, given: dict, link: str | None, fields: list) -> Iterator[tuple]:
        for n in node:
            name = local(n.tag)
            if name == "r":
                own = child(n, "rPr")
                style = child(own, "rStyle")
                look = given | (styled(attribute(style, "val")) if style is not None else {}) | run_properties(own)
                for text in _field_texts(n, fields):
                    shown = fields[-1] if fields else None
                    target = link or next((f["link"] for f in reversed(fields) if f["link"]), None)
                    if text and not look.get("vanish") and (shown is None or all(f["result"] for f in fields)):
                        yield text, look, target
            elif name == "hyperlink":
                relation = relations.get(n.attrib.get("{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id", ""))
                yield from runs(n, given, relation.target if relation else "#" + (attribute(n, "anchor") or ""), fields)
            elif name in _KEPT:
                yield from runs(n, given, link, fields)
            elif name == "AlternateContent":
                for kind in ("Choice", "Fallback"):
                    if child(n, kind) is not None:
                        yield from runs(child(n, kind), given, link, fields)
                        break

    fields: list[dict] = []
    for pos, p in enumerate(x for x in child(package.xml(main), "body").iter() if local(x.tag) == "p"):
        style = child(child(p, "pPr"), "pStyle")
        given = base | styled(attribute(style, "val") if style is not None else usual)
        for i, (text, look, link) in enumerate(runs(p, given, None, fields)):
            get = look.get
            shown = text.upper() if get("caps") else text
            yield pos, i, shown, bool(get("b")), bool(get("i")), get("u"), bool(get("strike") or get("dstrike")), bool(get("caps")), get("sz"), get("color"), get("highlight"), get("font"), get("vertAlign"), link


def _field_texts(run, fields: list[dict]) -> Iterator[str]:
    """The texts of a run, field codes followed as they begin, part and end."""
    for piece in run:
        name = local(piece.tag)
        if name == "fldChar":
            kind = attribute(piece, "fldCharType")
            if kind == "begin":
                fields.append({"code": "", "result": False, "link": None})
            elif kind == "separate" and fields:
                found = re.match(r'\s*HYPERLINK\s+(?:\\l\s+)?"([^"]*)"', fields[-1]["code"])
                fields[-1] |= {"result": True, "link": found[1] if found else None}
            elif kind == "end" and fields:
                fields.pop()
        elif name == "instrText" and fields:
            fields[-1]["code"] += piece.text or ""
        elif name == "sym":
            code = attribute(piece, "char") or ""
            yield bullet(chr(int(code, 16) | 0xF000)) if re.fullmatch("[0-9A-Fa-f]{4}", code) else ""
        else:
            yield _piece(piece, [])
