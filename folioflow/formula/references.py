"""Rewriting the references of a formula: filled elsewhere, or rows and columns inserted or deleted."""

from __future__ import annotations

from collections.abc import Callable

from .parser import MAX_COL, MAX_ROW, column_letters, column_number, split_cell, tokens

OFF = "#REF!"


def _rebuilt(text: str, change: Callable) -> str:
    """The formula with every reference passed through ``change``, all else as it was."""
    body, lead = (text[1:], "=") if text.startswith("=") else (text, "")
    out, at = [lead], 0
    for m in tokens(body):
        if m["ref"]:
            start, end = m.span("ref")
            out += [body[at:start], change(m)]
            at = end
    return "".join(out) + body[at:]


def _prefix(m) -> str:
    return f"{m['sheet']}!" if m["sheet"] else ""


def _cell(fixed_c: bool, c: int, fixed_r: bool, r: int) -> str | None:
    if not (1 <= c <= MAX_COL and 1 <= r <= MAX_ROW):
        return None
    return f"{'$' * fixed_c}{column_letters(c)}{'$' * fixed_r}{r}"


def shift(text: str, rows: int, cols: int) -> str:
    """As if the formula were filled so many rows down and columns right: relative parts move, fixed ones stay."""

    def moved_cell(cell: str) -> str | None:
        fc, c, fr, r = split_cell(cell)
        return _cell(fc, c if fc else c + cols, fr, r if fr else r + rows)

    def change(m) -> str:
        if m["c1"]:
            parts = [moved_cell(x) for x in (m["c1"], m["c2"]) if x]
        elif m["col1"]:
            parts = []
            for x in (m["col1"], m["col2"]):
                c = column_number(x.lstrip("$")) + (0 if x[0] == "$" else cols)
                parts.append(f"{'$' * (x[0] == '$')}{column_letters(c)}" if 1 <= c <= MAX_COL else None)
        else:
            parts = []
            for x in (m["row1"], m["row2"]):
                r = int(x.lstrip("$")) + (0 if x[0] == "$" else rows)
                parts.append(f"{'$' * (x[0] == '$')}{r}" if 1 <= r <= MAX_ROW else None)
        return OFF if None in parts else _prefix(m) + ":".join(parts)

    return _rebuilt(text, change)


def _after(a: int, b: int, at: int, count: int) -> tuple[int, int] | None:
    """Where a span of rows or columns lies once ``count`` are inserted (or deleted, if negative) at ``at``."""
    if count >= 0:
        return (a + count if a >= at else a), (b + count if b >= at else b)
    gone = -count
    last = at + gone - 1
    if a >= at and b <= last:
        return None
    first = a if a < at else max(at, a - gone)
    end = b if b < at else at - 1 if b <= last else b - gone
    return first, end


def restructure(text: str, sheet: str, own_sheet: str, axis: str, at: int, count: int) -> str:
    """As after ``count`` rows or columns (``axis`` ``row`` or ``col``) came in at ``at`` of ``sheet``, or went if negative."""

    def change(m) -> str:
        target = m["sheet"].strip("'").replace("''", "'") if m["sheet"] else own_sheet
        if target.lower() != sheet.lower():
            return m["ref"]
        if m["c1"]:
            ends = [split_cell(m["c1"]), split_cell(m["c2"] or m["c1"])]
            span = _after(*sorted(e[3 if axis == "row" else 1] for e in ends), at, count)
            if span is None:
                return OFF
            if ends[0][3 if axis == "row" else 1] > ends[1][3 if axis == "row" else 1]:
                span = span[::-1]
            made = [_cell(fc, v if axis == "col" else c, fr, v if axis == "row" else r) for (fc, c, fr, r), v in zip(ends, span, strict=True)]
            return OFF if None in made else _prefix(m) + (":".join(made) if m["c2"] else made[0])
        whole = ("col1", "col2") if m["col1"] else ("row1", "row2")
        if (axis == "col") != bool(m["col1"]):
            return m["ref"]
        number = (lambda x: column_number(x.lstrip("$"))) if axis == "col" else (lambda x: int(x.lstrip("$")))
        span = _after(*sorted(number(m[k]) for k in whole), at, count)
        if span is None:
            return OFF
        show = column_letters if axis == "col" else str
        return _prefix(m) + ":".join(f"{'$' * (m[k][0] == '$')}{show(v)}" for k, v in zip(whole, span, strict=True))

    return _rebuilt(text, change)
