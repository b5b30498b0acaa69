"""Number and date formats in two dialects.

``editor``: the plainer one.  ``viewer``: fractions, ``[>100]`` conditions and the day
1900-02-29 that spreadsheets believe in.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, timedelta
from decimal import ROUND_HALF_UP, Decimal

# Built-in format codes by id, and where the dialects differ.
BUILTIN = {
    0: "General", 1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 9: "0%", 10: "0.00%", 11: "0.00E+00", 14: "mm-dd-yy", 15: "d-mmm-yy", 16: "d-mmm", 17: "mmm-yy",
    18: "h:mm AM/PM", 19: "h:mm:ss AM/PM", 20: "h:mm", 21: "h:mm:ss", 22: "m/d/yy h:mm", 37: "#,##0;(#,##0)", 38: "#,##0;[Red](#,##0)", 39: "#,##0.00;(#,##0.00)", 40: "#,##0.00;[Red](#,##0.00)",
    45: "mm:ss", 46: "[h]:mm:ss", 47: "mm:ss.0", 48: "##0.0E+0", 49: "@",
}
VIEWER_BUILTIN = BUILTIN | {12: "# ?/?", 13: "# ??/??", 14: "yyyy-mm-dd", 22: "yyyy-mm-dd h:mm"}
MONTHS = "January February March April May June July August September October November December".split()
DAYS = "Monday Tuesday Wednesday Thursday Friday Saturday Sunday".split()
COLOURS = ("black", "blue", "cyan", "green", "magenta", "red", "white", "yellow")

_PIECE = re.compile(r'"[^"]*"|\\.|_.|\*.|\[[^\]]*\]|AM/PM|A/P|General|[yY]+|[mM]+|[dD]+|[hH]+|[sS]+|[0#?]+|E[+-]|.', re.I | re.S)


@dataclass(frozen=True)
class Section:
    pieces: tuple[str, ...]
    condition: tuple[str, float] | None
    colour: str | None
    is_date: bool


def builtin(number: int, dialect: str = "viewer") -> str:
    return (VIEWER_BUILTIN if dialect == "viewer" else BUILTIN).get(number, "General")


_parsed: dict[str, tuple[Section, ...]] = {}


def sections(code: str) -> tuple[Section, ...]:
    """The up to four sections of a code."""
    if code not in _parsed:
        parts, quoted, held, i = [], False, "", 0
        while i < len(code):
            c = code[i]
            if c == "\\" and not quoted:
                held += code[i : i + 2]
                i += 2
                continue
            quoted ^= c == '"'
            if c == ";" and not quoted:
                parts.append(held)
                held = ""
            else:
                held += c
            i += 1
        _parsed[code] = tuple(_section(p) for p in [*parts, held][:4])
    return _parsed[code]


def _section(text: str) -> Section:
    pieces, condition, colour = [], None, None
    for p in _PIECE.findall(text):
        if p[0] == "[":
            inner = p[1:-1]
            if m := re.fullmatch(r"(<=|>=|<>|<|>|=)(-?\d+\.?\d*)", inner):
                condition = m[1], float(m[2])
                continue
            if inner.lower() in COLOURS or re.fullmatch(r"(?i)color\d+", inner):
                colour = inner.lower()
                continue
            if inner.startswith("$"):
                sign = inner[1:].split("-")[0]
                if sign:
                    pieces.append(f'"{sign}"')
                continue
            if not re.fullmatch(r"(?i)h+|m+|s+", inner):
                continue
        pieces.append(p)
    plain = [p for p in pieces if p[0] not in '"\\_*']
    date = any(re.fullmatch(r"(?i)y+|d+|h+|s+|m+|am/pm|a/p|\[[hms]+\]", p) for p in plain)
    return Section(tuple(pieces), condition, colour, date)


def _meets(value: float, condition: tuple[str, float]) -> bool:
    op, x = condition
    return {"<": value < x, "<=": value <= x, ">": value > x, ">=": value >= x, "=": value == x, "<>": value != x}[op]


def general(value: float, digits: int = 11) -> str:
    """A number without a format: so many significant digits."""
    if value == 0:
        return "0"
    if value == int(value) and abs(value) < 10**digits:
        return str(int(value))
    if abs(value) >= 10**digits or abs(value) < 1e-9:
        mantissa, exponent = f"{value:.{digits - 6}E}".split("E")
        mantissa = mantissa.rstrip("0").rstrip(".") if "." in mantissa else mantissa
        return f"{mantissa}E{exponent[0]}{int(exponent[1:]):02d}"
    text = f"{value:.{digits}g}"
    return f"{float(text):.{digits + 8}f}".rstrip("0").rstrip(".") if "e" in text else text


def format_value(value: float, code: str, dialect: str = "viewer", system: int = 1900) -> str:
    """A number as its format shows it."""
    if value != value or value in (float("inf"), float("-inf")):
        return "#NUM!"
    parts = sections(code or "General")
    chosen, negative = _choose(parts, value, dialect)
    if chosen is None:
        return "#####"
    if not chosen.pieces:
        return ""
    if chosen.is_date:
        return _date(value, chosen, dialect, system)
    shown = abs(value) if negative else value
    return _number(shown, chosen, dialect)


def _choose(parts: tuple[Section, ...], value: float, dialect: str) -> tuple[Section | None, bool]:
    """The section for a value, and whether its sign is the section's own affair."""
    if dialect == "viewer" and any(p.condition for p in parts):
        for p in parts[:3]:
            if p.condition and _meets(value, p.condition):
                return p, value < 0 and len(parts) > 1
        rest = [p for p in parts[:3] if not p.condition]
        return (rest[0], False) if rest else (None, False)
    if value < 0 and len(parts) > 1:
        return parts[1], True
    if value == 0 and len(parts) > 2:
        return parts[2], False
    return parts[0], False


def _literal(p: str) -> str:
    if p[0] == '"':
        return p[1:-1]
    if p[0] == "\\":
        return p[1:]
    return " " if p[0] == "_" else "" if p[0] == "*" else p


def _is_digits(p: str) -> bool:
    return p[0] in "0#?" and not p.strip("0#?")


def _rounded(value: float, places: int) -> Decimal:
    return Decimal(repr(abs(value))).quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP)


def _number(value: float, section: Section, dialect: str) -> str:
    pieces = list(section.pieces)
    if any(p.lower() == "general" for p in pieces):
        body = general(abs(value), 11 if dialect == "viewer" else 15)
        return ("-" if value < 0 else "") + "".join(body if p.lower() == "general" else _literal(p) for p in pieces)
    digits = [i for i, p in enumerate(pieces) if _is_digits(p)]
    if not digits:
        return ("-" if value < 0 and "@" not in pieces else "") + "".join(general(value) if p == "@" else _literal(p) for p in pieces)
    if "/" in pieces and dialect == "viewer":
        return _fraction(value, pieces)
    value *= 100 ** sum(p == "%" for p in pieces)
    exponent = next((i for i, p in enumerate(pieces) if p[:1] in "Ee" and len(p) == 2 and p[1] in "+-"), None)
    if exponent is not None:
        return _exponent(value, pieces, exponent)
    point = next((i for i, p in enumerate(pieces) if p == "."), None)
    before = [i for i in digits if point is None or i < point]
    after = [i for i in digits if point is not None and i > point]
    first, last = digits[0], digits[-1]
    grouping = any(pieces[i] == "," for i in range(first, before[-1] if before else first))
    scale = 0
    i = last + 1
    while i < len(pieces) and pieces[i] == ",":
        scale += 1
        i += 1
    if point is not None and before:
        j = before[-1] + 1
        while j < point and pieces[j] == ",":
            scale += 1
            j += 1
    value /= 1000**scale
    pattern = "".join(pieces[k] for k in after)
    number = _rounded(value, len(pattern))
    whole, _, part = f"{number:f}".partition(".")
    keep = len(pattern.rstrip("#?"))
    while len(part) > keep and part.endswith("0"):
        part = part[:-1]
    part += " " * (len(pattern) - len(part) - pattern.count("#")) if "?" in pattern else ""
    mask = "".join(pieces[k] for k in before)
    least = mask.count("0")
    whole = whole.lstrip("0").rjust(least, "0")
    if grouping and whole:
        whole = f"{int(whole):,}".rjust(least) if least <= 1 else re.sub(r"(?<=\d)(?=(\d{3})+$)", ",", whole)
    whole = whole.rjust(least + mask.count("?")) if "?" in mask else whole
    out, placed = [], False
    simple = all(pieces[k] in ",." or _is_digits(pieces[k]) for k in range(first, last + 1))
    if not simple and point is None:
        return ("-" if value < 0 else "") + _interleaved(whole, pieces, digits)
    for k, p in enumerate(pieces):
        if k in before or (k == point and not before):
            if not placed:
                out.append(whole)
                placed = True
            if k == point:
                out.append("." + part if part or keep else "." if pattern and "0" in pattern else "")
        elif k == point:
            out.append("." + part)
        elif k in after or (p == "," and first <= k <= last + scale):
            continue
        else:
            out.append(_literal(p))
    sign = "-" if value < 0 and number != 0 else ""
    return sign + "".join(out)


def _interleaved(whole: str, pieces: list[str], digits: list[int]) -> str:
    """Digits dealt from the right into a mask with text between them, as for telephone numbers."""
    rest, out = whole, []
    for k in range(len(pieces) - 1, -1, -1):
        if k in digits:
            n = len(pieces[k])
            take = rest if k == digits[0] else rest[-n:]
            rest = rest[: len(rest) - len(take)]
            out.append(take.rjust(pieces[k].count("0"), "0"))
        else:
            out.append(_literal(pieces[k]))
    return "".join(reversed(out))


def _exponent(value: float, pieces: list[str], at: int) -> str:
    mask = "".join(p for p in pieces[:at] if _is_digits(p) or p == ".")
    whole, _, part = mask.partition(".")
    step = max(1, len(whole))
    power = 0 if value == 0 else int(f"{abs(value):e}".split("e")[1])
    power = power // step * step if step > 1 else power
    scaled = _rounded(abs(value) / 10.0**power, len(part))
    if scaled >= 10**step:
        power += step
        scaled = _rounded(abs(value) / 10.0**power, len(part))
    digits = "".join(p for p in pieces[at + 1 :] if _is_digits(p))
    sign = "-" if power < 0 else "+" if pieces[at][1] == "+" else ""
    tail = "".join(_literal(p) for p in pieces[at + 1 :] if not _is_digits(p))
    return f"{'-' if value < 0 else ''}{scaled:f}{pieces[at][0]}{sign}{abs(power):0{len(digits)}d}{tail}"


def nearest_fraction(x: float, largest: int) -> tuple[int, int]:
    """The closest fraction with a denominator up to ``largest``; of equals the smallest denominator."""
    best = min(range(1, largest + 1), key=lambda q: (round(abs(x - round(x * q) / q), 12), q))
    return round(x * best), best


def _fraction(value: float, pieces: list[str]) -> str:
    at = pieces.index("/")
    digits = [i for i, p in enumerate(pieces) if _is_digits(p)]
    fixed = "".join(p for p in pieces[at + 1 :] if p.isdigit() and p.strip("0"))
    numerator = max(i for i in digits if i < at)
    has_whole = any(i < numerator for i in digits)
    x = abs(value)
    whole = int(x) if has_whole else 0
    if fixed:
        q = int(fixed)
        p = round((x - whole) * q)
    else:
        width = sum(len(pieces[i]) for i in digits if i > at)
        p, q = nearest_fraction(x - whole, 10**width - 1)
    if has_whole and p == q:
        whole, p = whole + 1, 0
    sign = "-" if value < 0 else ""
    if p == 0 and has_whole:
        return f"{sign}{whole}"
    return f"{sign}{whole} {p}/{q}" if has_whole and whole else f"{sign}{p}/{q}"


def serial_parts(value: float, system: int = 1900, phantom_day: bool = True) -> tuple[int, int, int, int, float]:
    """``(year, month, day, weekday, seconds)``; with the phantom day serial 60 is 1900-02-29 and earlier ones lie a day later."""
    days = int(value // 1)
    seconds = (value - days) * 86400
    if system == 1904:
        at = datetime(1904, 1, 1) + timedelta(days=days)
    elif phantom_day and days == 60:
        return 1900, 2, 29, 2, seconds
    else:
        at = datetime(1899, 12, 31 if phantom_day and days < 60 else 30) + timedelta(days=days)
    return at.year, at.month, at.day, at.weekday(), seconds


def _date(value: float, section: Section, dialect: str, system: int) -> str:
    if value < 0 or value > 2958466:
        return "#####"
    lows = [p.lower() for p in section.pieces]
    fraction = next((len(b) for a, b in zip(section.pieces, section.pieces[1:], strict=False) if a == "." and not b.strip("0")), 0)
    seconds_total = round(value * 86400, fraction)
    value = seconds_total / 86400 if any(p.strip("[]") in ("s", "ss") for p in lows) else value + 1e-9
    year, month, day, weekday, seconds = serial_parts(value, system, dialect == "viewer")
    seconds = min(max(seconds, 0), 86399.999999)
    clock = round(seconds, fraction) if any(p in ("s", "ss") for p in lows) else seconds
    hour, minute, second = int(clock // 3600), int(clock % 3600 // 60), clock % 60
    half = any(p in ("am/pm", "a/p") for p in lows)
    out, last, skip = [], "", False
    for i, p in enumerate(section.pieces):
        low = lows[i]
        if skip:
            skip = False
            continue
        if low[0] == "[":
            unit = {"h": 3600, "m": 60, "s": 1}[low[1]]
            out.append(str(int(round(value * 86400, 6) // unit)).rjust(len(low) - 2, "0"))
            last = low[1]
        elif not low.strip("y"):
            out.append(f"{year:04d}" if len(low) > 2 else f"{year % 100:02d}")
        elif not low.strip("d"):
            out.append(str(day) if low == "d" else f"{day:02d}" if low == "dd" else DAYS[weekday][:3] if low == "ddd" else DAYS[weekday])
        elif not low.strip("h"):
            h = (hour + 11) % 12 + 1 if half else hour
            out.append(str(h) if low == "h" else f"{h:02d}")
            last = "h"
        elif not low.strip("s"):
            out.append(str(int(second)) if low == "s" else f"{int(second):02d}")
            last = "s"
        elif not low.strip("m"):
            coming = next((x for x in lows[i + 1 :] if x[0] in "yhds[" or not x.strip("m")), "")
            if last == "h" or coming[:1] == "s" or coming[:2] == "[s":
                out.append(str(minute) if low == "m" else f"{minute:02d}")
                last = "m"
            else:
                name = MONTHS[month - 1]
                out.append(str(month) if low == "m" else f"{month:02d}" if low == "mm" else name[:3] if low == "mmm" else name[0] if low == "mmmmm" else name)
        elif low in ("am/pm", "a/p"):
            mark = "AM" if hour < 12 else "PM"
            out.append(mark if low == "am/pm" else mark[0])
        elif low == "." and i + 1 < len(lows) and not lows[i + 1].strip("0") and last == "s":
            out.append("." + f"{second % 1:.{len(lows[i + 1])}f}"[2:])
            skip = True
        else:
            out.append(_literal(p))
    return "".join(out)


def format_text(text: str, code: str) -> str:
    """Text under a format: the fourth section, or a lone one with ``@``."""
    parts = sections(code or "General")
    chosen = parts[3] if len(parts) > 3 else next((p for p in parts if "@" in p.pieces), None)
    return text if chosen is None else "".join(text if p == "@" else _literal(p) for p in chosen.pieces)


def roman(n: int) -> str:
    """Roman numerals from 1 to 3999, plain digits beyond."""
    if not 0 < n < 4000:
        return str(n)
    out = ""
    for value, letters in zip((1000, 900, 500, 400, 100, 90, 50, 40, 10, 9, 5, 4, 1), "M CM D CD C XC L XL X IX V IV I".split(), strict=True):
        out += letters * (n // value)
        n %= value
    return out


def repeated_letter(n: int) -> str:
    """a … z, aa, bb, …: list labels of text documents."""
    return chr(97 + (n - 1) % 26) * ((n - 1) // 26 + 1)


def base26_letter(n: int) -> str:
    """a … z, aa, ab, …: list labels of slides."""
    out = ""
    while n:
        n, d = divmod(n - 1, 26)
        out = chr(97 + d) + out
    return out


def ordinal(n: int) -> str:
    return f"{n}{'th' if 10 <= n % 100 <= 20 else {1: 'st', 2: 'nd', 3: 'rd'}.get(n % 10, 'th')}"


# Letters of the abjad and of the alphabet, in their orders.
ABJAD = "أ ب ج د هـ و ز ح ط ي ك ل م ن س ع ف ص ق ر ش ت ث خ ذ ض ظ غ".split()
ALPHABET = "أ ب ت ث ج ح خ د ذ ر ز س ش ص ض ط ظ ع غ ف ق ك ل م ن هـ و ي".split()


def _from_letters(letters: list[str], n: int) -> str:
    """The n-th of some letters, written once more for every time round."""
    return letters[(n - 1) % len(letters)] * ((n - 1) // len(letters) + 1) if n > 0 else str(n)


def arabic_digits(n: int) -> str:
    return "".join(chr(0x660 + int(c)) if c.isdigit() else c for c in str(n))


#: List numbers by the kind that a document names.
LABELS = {
    "decimal": str, "decimalZero": lambda n: f"{n:02d}", "decimalEnclosedParen": lambda n: f"({n})", "upperRoman": roman, "lowerRoman": lambda n: roman(n).lower(),
    "lowerLetter": repeated_letter, "upperLetter": lambda n: repeated_letter(n).upper(), "ordinal": ordinal, "arabicIndic": arabic_digits, "hindiNumbers": arabic_digits,
    "arabicAlpha": lambda n: _from_letters(ALPHABET, n), "hindiLetters": lambda n: _from_letters(ALPHABET, n), "arabicAbjad": lambda n: _from_letters(ABJAD, n), "hindiCounting": lambda n: _from_letters(ABJAD, n),
}


def list_label(n: int, kind: str) -> str:
    """A list number of a kind of ``LABELS``; plain digits for any other."""
    return LABELS.get(kind, str)(n)
