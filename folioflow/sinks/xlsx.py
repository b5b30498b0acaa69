"""Workbooks from cells: one package a workbook, written in the task that holds it."""

from __future__ import annotations

import io
import re
import zipfile
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import DataFrame

from ..formula.parser import column_letters

_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_DOC = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PKG = "http://schemas.openxmlformats.org/package/2006"
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
_TYPES = {"main": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml", "sheet": "application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml", "strings": "application/vnd.openxmlformats-officedocument.spreadsheetml.sharedStrings+xml", "styles": "application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"}


def sheet_names(names: list[str]) -> list[str]:
    """Names a workbook may have: no ``\\ / ? * [ ] :``, at most 31 characters, none twice whatever the case."""
    out, seen = [], set()
    for name in names:
        base = re.sub(r"[\\/?*\[\]:]", "_", name or "Sheet")[:31] or "Sheet"
        made, n = base, 2
        while made.lower() in seen:
            made = f"{base[: 31 - len(str(n)) - 2]}({n})"
            n += 1
        seen.add(made.lower())
        out.append(made)
    return out


def workbook(cells: list[dict], system: int = 1900) -> bytes:
    """A package from cells ``sheet, r, c, f, t, n, s, b, e, format``; texts and formats are stored once each."""
    order = list(dict.fromkeys(x["sheet"] for x in cells))
    names = dict(zip(order, sheet_names(order), strict=True))
    strings: dict[str, int] = {}
    formats: dict[str, int] = {"General": 0}
    bodies = []
    for sheet in order:
        rows: dict[int, list[str]] = {}
        for x in sorted((x for x in cells if x["sheet"] == sheet), key=lambda x: (x["r"], x["c"])):
            style = formats.setdefault(x.get("format") or "General", len(formats))
            kind, value = _value(x, strings)
            formula = f"<f>{escape(x['f'].lstrip('='))}</f>" if x.get("f") else ""
            rows.setdefault(x["r"], []).append(f'<c r="{column_letters(x["c"])}{x["r"]}"{kind}{f" s=\"{style}\"" if style else ""}>{formula}{value}</c>')
        data = "".join(f'<row r="{r}">{"".join(c)}</row>' for r, c in rows.items())
        bodies.append(f'{_HEAD}<worksheet xmlns="{_MAIN}"><sheetData>{data}</sheetData></worksheet>')
    n = len(bodies)
    codes = "".join(f'<numFmt numFmtId="{163 + i}" formatCode={quoteattr(c)}/>' for c, i in formats.items() if i)
    xfs = "".join(f'<xf numFmtId="{163 + i if i else 0}" fontId="0" fillId="0" borderId="0" applyNumberFormat="1"/>' for i in formats.values())
    files = {
        "[Content_Types].xml": f'<Types xmlns="{_PKG}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
        + f'<Override PartName="/xl/workbook.xml" ContentType="{_TYPES["main"]}"/><Override PartName="/xl/sharedStrings.xml" ContentType="{_TYPES["strings"]}"/><Override PartName="/xl/styles.xml" ContentType="{_TYPES["styles"]}"/>'
        + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{_TYPES["sheet"]}"/>' for i in range(1, n + 1)) + "</Types>",
        "_rels/.rels": f'<Relationships xmlns="{_PKG}/relationships"><Relationship Id="rId1" Type="{_DOC}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{_MAIN}" xmlns:r="{_DOC}">' + ('<workbookPr date1904="1"/>' if system == 1904 else "") + "<sheets>"
        + "".join(f'<sheet name={quoteattr(names[s])} sheetId="{i}" r:id="rId{i}"/>' for i, s in enumerate(order, 1)) + '</sheets><calcPr fullCalcOnLoad="1"/></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_PKG}/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{_DOC}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, n + 1))
        + f'<Relationship Id="rId{n + 1}" Type="{_DOC}/sharedStrings" Target="sharedStrings.xml"/><Relationship Id="rId{n + 2}" Type="{_DOC}/styles" Target="styles.xml"/></Relationships>',
        "xl/sharedStrings.xml": f'<sst xmlns="{_MAIN}" uniqueCount="{len(strings)}">' + "".join(f'<si><t xml:space="preserve">{escape(s)}</t></si>' for s in strings) + "</sst>",
        "xl/styles.xml": f'<styleSheet xmlns="{_MAIN}">' + (f'<numFmts count="{len(formats) - 1}">{codes}</numFmts>' if codes else "")
        + f'<fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellXfs count="{len(formats)}">{xfs}</cellXfs></styleSheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in [*files.items(), *((f"xl/worksheets/sheet{i}.xml", b) for i, b in enumerate(bodies, 1))]:
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), body if body.startswith("<?") else _HEAD + body)
    return out.getvalue()


def _value(x: dict, strings: dict[str, int]) -> tuple[str, str]:
    t = x.get("t") or "z"
    if t == "n":
        n = x["n"]
        return "", f"<v>{int(n) if n == int(n) and abs(n) < 1e15 else repr(n)}</v>"
    if t == "s":
        return ' t="s"', f"<v>{strings.setdefault(x['s'], len(strings))}</v>"
    if t == "b":
        return ' t="b"', f"<v>{int(x['b'])}</v>"
    return (' t="e"', f"<v>{escape(x['e'])}</v>") if t == "e" else ("", "")


def packages(cells: DataFrame, key: str = "workbook_id") -> DataFrame:
    """``key, content``: a package for every workbook of a table of cells."""
    kind = dict(cells.dtypes)[key]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        rows = group.astype(object).where(group.notna(), None).to_dict("records")
        for x in rows:
            x["r"], x["c"] = int(x["r"]), int(x["c"])
        return pd.DataFrame({key: [group[key].iloc[0]], "content": [workbook(rows)]})

    return cells.groupBy(key).applyInPandas(run, f"{key} {kind}, content binary")
