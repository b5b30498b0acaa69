"""Word-processor documents from blocks: one package a document."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import DataFrame

_W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_DOC = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PKG = "http://schemas.openxmlformats.org/package/2006"
_KIND = "application/vnd.openxmlformats-officedocument.wordprocessingml"


class _Links:
    """External targets, each stored once."""

    def __init__(self) -> None:
        self.ids: dict[str, str] = {}

    def id(self, target: str) -> str:
        return self.ids.setdefault(target, f"lnk{len(self.ids) + 1}")


def _text(text: str) -> str:
    lines = text.split("\n")
    return "<w:br/>".join("<w:tab/>".join(f'<w:t xml:space="preserve">{escape(p)}</w:t>' if p else "" for p in line.split("\t")) for line in lines)


def _run(run: dict, links: _Links) -> str:
    marks = ("<w:b/>" if run.get("bold") else "") + ("<w:i/>" if run.get("italic") else "")
    body = f"<w:r>{f'<w:rPr>{marks}</w:rPr>' if marks else ''}{_text(run['text'])}</w:r>"
    return f'<w:hyperlink r:id="{links.id(run["link"])}">{body}</w:hyperlink>' if run.get("link") else body


def _paragraph(block: dict, links: _Links, style: str = "") -> str:
    held = block.get("runs")
    runs = list(held) if held is not None and len(held) else [{"text": block["text"]}] if block.get("text") else []
    return f"<w:p>{f'<w:pPr>{style}</w:pPr>' if style else ''}{''.join(_run(r, links) for r in runs)}</w:p>"


def _table(rows: list) -> str:
    """Cells with their spans; a tall cell leaves a continuing cell in the rows below."""
    open_cells: dict[int, tuple[int, int]] = {}
    out = []
    for row in rows:
        cells, column, waiting = [], 0, list(row)
        while waiting or column in open_cells:
            if column in open_cells:
                width, left = open_cells.pop(column)
                cells.append(f'<w:tc><w:tcPr><w:gridSpan w:val="{width}"/><w:vMerge/></w:tcPr><w:p/></w:tc>')
                if left > 1:
                    open_cells[column] = (width, left - 1)
                    column += width
                    continue
                column += width
                continue
            cell = waiting.pop(0)
            width, height = cell["colspan"], cell["rowspan"]
            merge = '<w:vMerge w:val="restart"/>' if height > 1 else ""
            body = "".join(f"<w:p><w:r>{_text(x)}</w:r></w:p>" for x in cell["text"].split("\n"))
            cells.append(f'<w:tc><w:tcPr><w:gridSpan w:val="{width}"/>{merge}</w:tcPr>{body}</w:tc>')
            if height > 1:
                open_cells[column] = (width, height - 1)
                column += width
                continue
            column += width
        out.append(f"<w:tr>{''.join(cells)}</w:tr>")
    return f"<w:tbl>{''.join(out)}</w:tbl>"


def _rows(block: dict) -> list:
    return [[dict(c) if isinstance(c, dict) else {"text": c[0], "colspan": c[1], "rowspan": c[2]} for c in row] for row in (block.get("rows") if block.get("rows") is not None else [])]


def document(blocks: list[dict]) -> bytes:
    """A package from blocks ``type, level, text, runs, rows`` as the reader gives them."""
    links, body, headings = _Links(), [], set()
    for b in blocks:
        if b["type"] == "TABLE":
            body.append(_table_block(b))
        elif b["type"] == "HEADING":
            level = int(b["level"] or 1)
            headings.add(level)
            body.append(_paragraph(b, links, f'<w:pStyle w:val="H{level}"/>'))
        elif b["type"] == "LIST_ITEM":
            body.append(_paragraph(b, links, f'<w:numPr><w:ilvl w:val="{int(b["level"] or 0)}"/><w:numId w:val="1"/></w:numPr>'))
        elif b["type"] != "NOTE":
            body.append(_paragraph(b, links))
    styles = "".join(f'<w:style w:type="paragraph" w:styleId="H{n}"><w:name w:val="{f"heading {n}" if n else "title"}"/></w:style>' for n in sorted(headings))
    levels = "".join(f'<w:lvl w:ilvl="{i}"><w:start w:val="1"/><w:numFmt w:val="decimal"/><w:lvlText w:val="%{i + 1}."/></w:lvl>' for i in range(9))
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{_PKG}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
        f'<Override PartName="/word/document.xml" ContentType="{_KIND}.document.main+xml"/><Override PartName="/word/styles.xml" ContentType="{_KIND}.styles+xml"/><Override PartName="/word/numbering.xml" ContentType="{_KIND}.numbering+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{_PKG}/relationships"><Relationship Id="r1" Type="{_DOC}/officeDocument" Target="word/document.xml"/></Relationships>',
        "word/document.xml": f'<w:document xmlns:w="{_W}" xmlns:r="{_DOC}"><w:body>{"".join(body)}</w:body></w:document>',
        "word/styles.xml": f'<w:styles xmlns:w="{_W}">{styles}</w:styles>',
        "word/numbering.xml": f'<w:numbering xmlns:w="{_W}"><w:abstractNum w:abstractNumId="0">{levels}</w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="0"/></w:num></w:numbering>',
        "word/_rels/document.xml.rels": f'<Relationships xmlns="{_PKG}/relationships"><Relationship Id="s" Type="{_DOC}/styles" Target="styles.xml"/><Relationship Id="n" Type="{_DOC}/numbering" Target="numbering.xml"/>'
        + "".join(f'<Relationship Id="{i}" Type="{_DOC}/hyperlink" Target={quoteattr(t)} TargetMode="External"/>' for t, i in links.ids.items()) + "</Relationships>",
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, xml in parts.items():
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?>{xml}')
    return out.getvalue()


def _table_block(block: dict) -> str:
    return _table(_rows(block))


def packages(blocks: DataFrame, key: str = "path") -> DataFrame:
    """``key, content``: a package for every document of a table of blocks."""
    kind = dict(blocks.dtypes)[key]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        rows = group.sort_values("pos").astype(object)
        rows = rows.where(rows.notna(), None).to_dict("records")
        return pd.DataFrame({key: [group[key].iloc[0]], "content": [document(rows)]})

    return blocks.groupBy(key).applyInPandas(run, f"{key} {kind}, content binary")
