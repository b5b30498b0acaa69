"""Paragraphs of rich text."""

from __future__ import annotations

import re

#: Codecs of the character sets that documents name.
CODECS = {1250: "cp1250", 1251: "cp1251", 1252: "cp1252", 1256: "cp1256", 65001: "utf-8", 932: "cp932", 936: "gbk", 949: "cp949", 950: "big5"}
CHARSETS = {0: 1252, 161: 1253, 162: 1254, 177: 1255, 178: 1256, 204: 1251, 238: 1250, 128: 932, 134: 936, 129: 949, 136: 950}
#: Destinations whose text is no part of the document's.
SKIPPED = frozenset("fonttbl colortbl stylesheet info pict object header footer headerl headerr footerl footerr themedata listtable listoverridetable generator xmlnstbl datastore latentstyles rsidtbl fldinst".split())
_TOKEN = re.compile(rb"\\([a-zA-Z]+)(-?\d+)? ?|\\'([0-9a-fA-F]{2})|\\([^a-zA-Z])|([{}])|\r|\n|([^\\{}\r\n]+)")
_SPECIAL = {"emdash": "—", "endash": "–", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”", "bullet": "•", "tab": "\t"}


def read_paragraphs(content: bytes) -> list[tuple[str, str]]:
    """``(type, text)``: paragraphs, and rows of tables with cells parted by tabs."""
    page = re.search(rb"\\ansicpg(\d+)", content[:2000])
    default = CODECS.get(int(page[1]), "cp1252") if page else "cp1252"
    fonts = {int(f): CODECS.get(CHARSETS.get(int(c), 0), default) for f, c in re.findall(rb"\\f(\d+)[^{}\\]*(?:\\[a-z]+(?!\w)[^{}\\]*)*?\\fcharset(\d+)", content)}
    out: list[tuple[str, str]] = []
    stack: list[tuple] = []
    state = {"skip": False, "uc": 1, "codec": default}
    text: list[str] = []
    row: list[str] = []
    raw = bytearray()
    pending, in_row = 0, False

    def flush() -> None:
        if raw:
            text.append(bytes(raw).decode(state["codec"], "replace"))
            raw.clear()

    def end(kind: str = "PARAGRAPH") -> None:
        flush()
        body = "".join(text)
        text.clear()
        if kind == "CELL":
            row.append(body.strip())
        elif body.strip():
            out.append((kind, body.strip("\r\n")))

    star = False
    for m in _TOKEN.finditer(content):
        word, number, code, symbol, brace, plain = m.groups()
        if brace == b"{":
            flush()
            stack.append(dict(state))
            star = False
            continue
        if brace == b"}":
            flush()
            state = stack.pop() if stack else state
            star = False
            continue
        if symbol == b"*":
            star = True
            continue
        if word is not None:
            name, n = word.decode(), int(number) if number else None
            if star or name in SKIPPED:
                if name != "fldrslt":
                    state["skip"] = True
                star = False
                continue
            if name == "uc":
                state["uc"] = n or 0
            elif name == "f" and n is not None:
                flush()
                state["codec"] = fonts.get(n, default)
            elif state["skip"]:
                continue
            elif name in ("par", "page", "sect"):
                if in_row and name == "par":
                    flush()
                    text.append("\n")
                else:
                    end()
            elif name == "line":
                flush()
                text.append("\n")
            elif name == "trowd":
                in_row = True
            elif name == "cell":
                end("CELL")
            elif name == "row":
                out.append(("ROW", "\t".join(row)))
                row.clear()
                in_row = False
            elif name == "pard":
                in_row = False
            elif name == "intbl":
                in_row = True
            elif name == "u" and n is not None:
                flush()
                text.append(chr(n % 65536))
                pending = state["uc"]
            elif name in _SPECIAL:
                flush()
                text.append(_SPECIAL[name])
            continue
        if state["skip"]:
            continue
        if code is not None:
            if pending:
                pending -= 1
            else:
                raw.append(int(code, 16))
        elif symbol is not None:
            flush()
            mapped = {b"~": "\u00a0", b"-": "\u00ad", b"_": "‑", b"\\": "\\", b"{": "{", b"}": "}"}.get(symbol)
            if symbol in (b"\n", b"\r"):
                end()
            elif mapped:
                text.append(mapped)
        elif plain is not None:
            raw.extend(plain[pending:])
            pending = max(0, pending - len(plain))
    end()
    joined = [(k, t.encode("utf-16", "surrogatepass").decode("utf-16", "replace")) for k, t in out]
    return joined


RUNS = "path string, pos int, run int, text string, bold boolean, italic boolean, underline boolean, strike boolean, size double, colour string, link string"


def colour_table(content: bytes) -> list[str | None]:
    """The colours that a document numbers; the first is often left to the reader."""
    found = re.search(rb"\\colortbl([^{}]*)}", content)
    out: list[str | None] = []
    for entry in (found[1].split(b";")[:-1] if found else []):
        parts = {k: int(v) for k, v in re.findall(rb"\\(red|green|blue)(\d+)", entry)}
        out.append("%02X%02X%02X" % tuple(parts.get(k, 0) for k in (b"red", b"green", b"blue")) if parts else None)
    return out


def read_runs(content: bytes) -> list[tuple]:
    """``pos, run, text, bold, italic, underline, strike, size, colour, link`` of every run of one look; groups end what they began."""
    page = re.search(rb"\\ansicpg(\d+)", content[:2000])
    codec = CODECS.get(int(page[1]), "cp1252") if page else "cp1252"
    colours = colour_table(content)
    plain = {"bold": False, "italic": False, "underline": False, "strike": False, "size": 12.0, "colour": None}
    state: dict = {**plain, "dest": "text", "uc": 1, "link": None}
    stack: list[dict] = []
    out: list[list] = []
    code: list[str] = []
    pos, pending, star = 0, 0, False

    def add(text: str) -> None:
        if state["dest"] == "code":
            code.append(text)
        elif state["dest"] == "text" and text:
            look = [state[k] for k in (*plain, "link")]
            if out and out[-1][0] == pos and out[-1][2:] == look:
                out[-1][1] += text
            else:
                out.append([pos, text, *look])

    for m in _TOKEN.finditer(content):
        word, number, hexed, symbol, brace, body = m.groups()
        if brace == b"{":
            stack.append(dict(state))
        elif brace == b"}":
            closed, state = state, (stack.pop() if stack else state)
            if closed["dest"] == "code" and state["dest"] != "code":
                found = re.search(r'HYPERLINK\s+(?:\\l\s+)?"?([^"\s]+)', "".join(code))
                code.clear()
                if found and stack:
                    state["link"] = found[1]
        elif symbol == b"*":
            star = True
            continue
        elif word is not None:
            name, n = word.decode(), int(number) if number else None
            if name == "fldinst":
                state["dest"] = "code"
            elif name == "fldrslt":
                state["dest"] = "text"
            elif star or name in SKIPPED:
                state["dest"] = "skip"
            elif name in ("b", "i", "ul", "strike"):
                state[{"b": "bold", "i": "italic", "ul": "underline", "strike": "strike"}[name]] = n != 0
            elif name == "ulnone":
                state["underline"] = False
            elif name == "fs" and n:
                state["size"] = n / 2
            elif name == "cf":
                state["colour"] = colours[n] if n is not None and n < len(colours) else None
            elif name == "plain":
                state |= plain
            elif name == "uc":
                state["uc"] = n or 0
            elif name in ("par", "sect", "page", "row") and state["dest"] == "text":
                pos += 1
            elif name == "line":
                add("\n")
            elif name == "cell":
                add("\t")
            elif name == "u" and n is not None:
                add(chr(n % 65536))
                pending = state["uc"]
            elif name in _SPECIAL:
                add(_SPECIAL[name])
        elif hexed is not None:
            if pending:
                pending -= 1
            else:
                add(bytes([int(hexed, 16)]).decode(codec, "replace"))
        elif symbol is not None:
            add({b"~": "\u00a0", b"-": "\u00ad", b"_": "‑", b"\\": "\\", b"{": "{", b"}": "}"}.get(symbol, ""))
        elif body is not None:
            add(body[pending:].decode(codec, "replace"))
            pending = max(0, pending - len(body))
        star = False
    numbered, last = [], (-1, -1)
    for at, text, *look in out:
        last = (at, last[1] + 1 if last[0] == at else 0)
        numbered.append((*last, text, *look))
    return numbered
