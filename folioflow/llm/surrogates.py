"""Surrogates for personal data: keyed, type-consistent, distinct, the same wherever an entity recurs.

Every entity has one canonical form: an address in lower case, a telephone number as its
national digits, a card or account number without blanks, a name in lower case.  Its
letters and digits are numbered by class (digits, vowels and consonants of its script,
hexadecimal digits, bytes of an address) and the number is sent through a keyed Feistel
permutation of all strings of that format; the result is written in the case and
punctuation of each mention.  So the surrogate has the type, script, case and format of
the original, different originals have different surrogates, and the same original has
the same one in every document and spelling, without a table.

Names.  Listed given names are permuted in a keyed order of the names of their gender
and script.  Other name words keep what shows gender: the endings of Slavic surnames and
the last vowel of others.  Parts of a name, those of a hyphenated one too, are replaced one
by one whatever title stands before them, so a person stays one person when later named by
surname alone: every other whole word of a text that is a part of a name found in it, in
its own or all upper case, is replaced too.  The host of a mail address is replaced for
itself, so mailboxes of one host stay together.  Card and account numbers keep the state
of their check digits.

Collision checks: the distinct entities of the whole corpus are gathered, and a
surrogate that equals itself, some original or another surrogate is drawn again with
the next tweak until none does.  From try ``TRIES`` on a draw is one character longer each time, so
crowded formats get room.  Such overrides are rare; they are broadcast if
under ``OVERRIDES`` rows and joined by text otherwise.  Listed given names are drawn once:
their permutation has no fixed point, and what it gives are names that many bear.

Defined results
    null text              null, no entities
    empty text             empty
    null doc_id            kept
    repeated rows          one result each, with the same surrogates
    ties                   of overlapping matches the first, then the longest
    very long texts        read whole
    empty table            empty result
    clashing columns       kept; only the text column and ``out`` are written
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .common import checkpointed, spare

#: At most so many overrides are broadcast.
OVERRIDES = 20_000
TRIES = 12

# Given names by script and gender, titles by gender, words between the parts of a name.
GIVEN = {
    ("latin", "m"): "James John Robert Michael William David Richard Thomas Charles Daniel Matthew Anthony Mark Steven Paul Andrew Kenneth George Edward Brian Kevin Ronald Timothy Jason Jeffrey Ryan Gary Nicholas Eric Jonathan Stephen Benjamin Samuel Gregory Patrick Alexander Peter Henry Walter Hans Karl Jürgen Wolfgang Klaus Stefan Friedrich Pierre Jean Jacques Michel Philippe Olivier Laurent Carlos Juan José Luis Javier Miguel Alejandro Fernando".split(),
    ("latin", "f"): "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Margaret Lisa Betty Sandra Ashley Emily Donna Michelle Carol Amanda Melissa Deborah Stephanie Rebecca Laura Helen Sharon Cynthia Kathleen Amy Angela Anna Ingrid Katharina Ursula Monika Sabine Heike Greta Marie Claire Nathalie Isabelle Sophie Camille Juliette Sylvie Maria Carmen Lucía Isabel Pilar Dolores Teresa Elena".split(),
    ("cyrillic", "m"): "Иван Сергей Алексей Дмитрий Андрей Николай Павел Владимир Михаил Александр Борис Виктор".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана Екатерина Людмила Галина Вера".split(),
    ("greek", "m"): "Γιώργος Νίκος Δημήτρης Κώστας Παύλος Γιάννης Βασίλης Πέτρος".split(),
    ("greek", "f"): "Μαρία Ελένη Κατερίνα Σοφία Αγγελική Βασιλική Δέσποινα Ιωάννα".split(),
}
TITLES = {
    "m": ("Mr", "Herr", "Monsieur", "Señor", "господин", "κύριος", "السيد"),
    "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "госпожа", "κυρία", "السيدة"),
    "?": ("Dr", "Prof", "доктор", "الدكتور", "الدكتورة"),
}
PARTICLES = ("van", "von", "der", "den", "de", "del", "di", "da", "la", "le", "bin", "ibn")
#: Family names of one letter, before one or two more letters and an honorific.
CHINESE = "王李张劉刘陈陳杨楊黄黃赵趙吴吳周徐孙孫马馬朱胡郭何高林罗羅郑鄭梁谢謝宋唐许許邓鄧韩韓冯馮曹彭曾萧田董潘袁蔡蒋余于杜叶程魏苏吕丁任卢姚沈钟姜崔谭陆范汪廖石金贾韦夏付方邹熊白孟秦邱侯江尹薛"
KOREAN = "김이박최정강조윤장임한오서신권황안송류홍"

_GIVEN = {name: (script, gender) for (script, gender), names in GIVEN.items() for name in names}
_PROPER = {name.upper(): name for name in _GIVEN}
_GIVEN |= {name.upper(): where for name, where in _GIVEN.items()}
_TITLE = {t: g for g, titles in TITLES.items() for t in titles}
_LOW = "a-zà-öø-ÿа-яёα-ωά-ώ"
_HIGH = "A-ZÀ-ÖØ-ÞА-ЯЁΑ-ΩΆ-Ώ"
#: A word of a name: letters, the first no lower-case one; parts may be tied by an apostrophe or a hyphen.
_NAME = rf"(?:[^\W\d_{_LOW}][^\W\d_]*['’])?[^\W\d_{_LOW}][^\W\d_]+(?:-[^\W\d_{_LOW}][^\W\d_]+)*"
_BETWEEN = rf"(?:(?:{'|'.join(PARTICLES)})[ ]){{0,2}}"
_PATTERN = re.compile(
    r"(?P<email>(?<![\w.+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})"
    r"|(?P<secret>(?i:\b(?:token|password|passwd|secret|api[_-]?key)\b\"?(?:\s*[=:]\s*|\s+is\s+(?=[A-Za-z+/_\-]*\d))[\"']?)(?P<secret_value>[A-Za-z0-9+/_\-]{6,}))"
    r"|(?P<ip>(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d))"
    r"|(?P<ip6>(?<![\w:.])[0-9A-Fa-f]{0,4}:[0-9A-Fa-f:]*:[0-9A-Fa-f:]+(?![\w:]))"
    r"|(?P<iban>\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b)"
    r"|(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))"
    r"|(?P<card>(?<![\d.-])[2-6]\d{3}(?:[ -]?\d{4}){2}[ -]?\d{3,4}(?![\d-]))"
    r"|(?P<phone>(?<![\w.])(?:\+?\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?)\d{3,4}[ .-]?\d{3,4}(?!\d)|(?<![\w.])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)|(?<![\w.-])(?:1[ .-])?\d{3}[.-]\d{3}[.-]\d{4}(?![\w-]))"
    r"|(?P<access>\b(?:AKIA|ASIA|AROA)[0-9A-Z]{16}\b|\b(?:gh[pousr]_|github_pat_|glpat-|sk-|xox[abprs]-)[A-Za-z0-9_-]{16,})"
    r"|(?P<hex>\b(?=[0-9a-f]*\d)(?=[0-9a-f]*[a-f])[0-9a-f]{32,128}\b)"
)
_LISTED = "|".join(sorted(_GIVEN, key=len, reverse=True))
_TITLED = re.compile(rf"\b(?P<title>{'|'.join(sorted(_TITLE, key=len, reverse=True))})\.?[ ]{_BETWEEN}(?P<first>{_NAME})(?:[ ](?:[{_HIGH}]\.[ ])?{_BETWEEN}(?P<last>{_NAME}))?")
_GIVEN_NAME = re.compile(rf"\b(?P<first>{_LISTED})[ ](?:[{_HIGH}]\.[ ])?{_BETWEEN}(?P<last>{_NAME})")
#: Family name first, where a list or a line shows that a comma is no clause's.
_FAMILY_FIRST = re.compile(rf"(?:^|(?<=\n)|(?<=[;(:][ ]))(?P<last>{_NAME}),[ ](?P<first>{_LISTED})(?=[ ][{_HIGH}]\.|[;)\n]|\.?\Z)", re.M)
#: Names marked by an honorific behind them.
_HONOURED = re.compile(rf"[{CHINESE}][\u4e00-\u9fff]{{1,2}}(?=先生|女士|小姐|博士|教授)|[\u4e00-\u9fff]{{2,4}}(?=さん|様|氏)|[{KOREAN}][가-힣]{{1,2}}(?=[ ]?(?:씨|님))")
_HONORIFIC = re.compile("先生|女士|小姐|博士|教授|さん|様|氏|씨|님")
# Endings of Slavic surnames, which show gender.
_ENDINGS = re.compile("(?:ова|ева|ёва|ина|ына|ская|цкая|ов|ев|ёв|ин|ын|ский|цкий)$")
_LAST_VOWEL = re.compile("[aeo]$")
_MARK = re.compile("[0-9@]")
#: What every entity without a digit or an at sign holds: one of these in lower case, or in the text as it is.
_SECRET_WORDS = ("passw", "secret", "token", "api_key", "api-key", "apikey")
_KEY_HEADS = ("AKIA", "ASIA", "AROA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "sk-", "xox")
_WORD = re.compile(r"[^\W\d_]+")
_NAME_WORDS = frozenset(_GIVEN) | frozenset(_TITLE)

# Alphabets; a letter moves within its own.
_ALPHABETS = [
    "aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", "0123456789",
    "àáâãäåæèéêëìíîïòóôõöøùúûüýÿœ", "ÀÁÂÃÄÅÆÈÉÊËÌÍÎÏÒÓÔÕÖØÙÚÛÜÝŒ", "çñß", "ÇÑ",
    "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщъь", "АЕЁИОУЫЭЮЯ", "БВГДЖЗЙКЛМНПРСТФХЦЧШЩ",
    "αεηιουωάέήίόύώ", "βγδζθκλμνξπρσςτφχψ", "ΑΕΗΙΟΥΩ", "ΒΓΔΖΘΚΛΜΝΞΠΡΣΤΦΧΨ",
]
_CLASS = {c: a for a in _ALPHABETS for c in a}
_HEX = {c: "0123456789abcdef" for c in "0123456789abcdef"}
#: Scripts written without spaces, in which a name has no word boundaries.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u30ff\u3400-\u9fff\U00020000-\U0003ffff]")


def _alphabet(c: str) -> str:
    """The alphabet of a letter or digit; '' for other characters.

    Outside the fixed ones it is the letters of one script and case, or the ten digits, among the 256 code points
    around.  Kinds of under eight there are one; a letter without others may also become a Latin one.
    """
    if c in _CLASS or c.isascii():
        return _CLASS.get(c, "")

    def family(x: str) -> tuple[str, str] | None:
        kind = unicodedata.category(x)
        if kind == "Nd":
            return kind, chr(ord(x) - unicodedata.digit(x))
        return (kind, unicodedata.name(x, "").split(" ")[0]) if kind[0] == "L" and x not in _CLASS else None

    if family(c) is None:
        return ""
    first = ord(c) & ~255
    found = [(x, k) for x in map(chr, range(first, first + 256)) if (k := family(x))]
    sizes = Counter(k for _, k in found)
    same = "".join(x for x, k in found if k == family(c) or (sizes[k] < 8 and sizes[family(c)] < 8))
    return same if len(same) > 1 else same + _ALPHABETS[1]


def _classes(text: str) -> dict[str, str]:
    """The alphabets of a text's letters and digits."""
    if text.isascii():
        return _CLASS
    return {c: a for c in set(text) if (a := _alphabet(c))}


def _round(key: bytes, tweak: str, turn: int, value: int, size: int) -> int:
    return int.from_bytes(hmac.digest(key, f"{tweak}|{turn}|{value}".encode(), hashlib.sha256), "big") % size


def permute(key: bytes, tweak: str, sizes: list[int], digits: list[int]) -> list[int]:
    """A keyed permutation of all digit strings with these sizes, by eight Feistel rounds over two halves."""
    cut = (len(sizes) + 1) // 2
    a = b = 1
    for s in sizes[:cut]:
        a *= s
    for s in sizes[cut:]:
        b *= s
    left = right = 0
    for s, d in zip(sizes[:cut], digits[:cut], strict=True):
        left = left * s + d
    for s, d in zip(sizes[cut:], digits[cut:], strict=True):
        right = right * s + d
    for turn in range(0, 8, 2):
        left = (left + _round(key, tweak, turn, right, a)) % a
        right = (right + _round(key, tweak, turn + 1, left, b)) % b
    out = []
    for s in reversed(sizes[cut:]):
        right, d = divmod(right, s)
        out.append(d)
    for s in reversed(sizes[:cut]):
        left, d = divmod(left, s)
        out.append(d)
    return out[::-1]


def _by_class(key: bytes, tweak: str, text: str, classes: dict[str, str], fixed: frozenset[int] = frozenset()) -> str:
    at = [i for i, c in enumerate(text) if c in classes and i not in fixed]
    if not at:
        return text
    alphabets = [classes[text[i]] for i in at]
    shape = "".join(classes[c][0] if c in classes else c for c in text)
    moved = permute(key, f"{tweak}|{shape}", [len(a) for a in alphabets], [a.index(text[i]) for i, a in zip(at, alphabets, strict=True)])
    out = list(text)
    for i, a, d in zip(at, alphabets, moved, strict=True):
        out[i] = a[d]
    return "".join(out)


def luhn_digit(digits: str) -> int:
    """The check digit that makes a number valid."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def _bare(value: str) -> str:
    return re.sub(r"[ -]", "", value)


def _national(value: str) -> tuple[int, str]:
    """How many digits of a telephone number come before the national ones, and those."""
    digits = re.sub(r"\D", "", value)
    if value[0] == "+":
        ahead = len(re.match(r"\+(\d{1,3})(?=[ .(-])|\+(\d)", value)[0]) - 1
    else:
        ahead = 1 if digits[0] == "0" or (len(digits) == 11 and digits[0] == "1") else 0
    return ahead, digits[ahead:]


def canonical(kind: str, value: str) -> str:
    """The one form of an entity that all its spellings share."""
    if kind == "email" or kind == "surname":
        return value.lower().replace("’", "'")
    if kind.startswith("given:"):
        return _PROPER.get(value.upper(), value)
    if kind == "phone":
        return _national(value)[1]
    if kind in ("iban", "ssn", "card"):
        return _bare(value)
    if kind == "ip6":
        return ipaddress.IPv6Address(value).exploded
    return value


def _cased(like: str, new: str) -> str:
    """``new`` in the case of ``like``: letter by letter, or as a whole where their lengths differ."""
    if like.isupper() and len(like) > 1:
        return new.upper()
    if len(like) != len(new):
        return new[:1].upper() + new[1:] if like[:1].isupper() else new
    return "".join(u if c.isupper() and len(u := n.upper()) == 1 else n for c, n in zip(like, new, strict=True))


def _filled(like: str, digits: str, ahead: int = 0) -> str:
    """``like`` with its digits and letters, but for the first ``ahead``, replaced in order; what is left over comes last."""
    out, at, rest = list(like), [i for i, c in enumerate(like) if c.isalnum()][ahead:], list(digits)
    for i in at:
        out[i] = rest.pop(0)
    return "".join(out) + "".join(rest)


def spelled(kind: str, value: str, new: str) -> str:
    """The canonical surrogate ``new`` as the mention ``value`` would be written."""
    if kind in ("email", "surname") or kind.startswith("given:"):
        return _cased(value, new)
    if kind == "phone":
        return _filled(value, new, _national(value)[0])
    if kind in ("iban", "ssn", "card"):
        return _filled(value, new)
    if kind == "ip6":
        short = ipaddress.IPv6Address(new).compressed
        return short.upper() if value.isupper() else short
    return new


def surrogate(key: bytes, kind: str, value: str, tries: int = 0) -> str:
    """The replacement of a value of some kind, as it is spelled; ``tries`` counts overrides.  From ``TRIES`` on each makes it one character longer."""
    return spelled(kind, value, _new(key, kind, canonical(kind, value), tries))


def _keyed_order(key: bytes, names: list[str]) -> list[str]:
    return sorted(names, key=lambda n: hmac.digest(key, f"order|{n}".encode(), hashlib.sha256))


_orders: dict[tuple[bytes, str], dict[str, str]] = {}


def _given(key: bytes, kind: str) -> dict[str, str]:
    """Each listed name's successor in a keyed order, so none stays."""
    if (key, kind) not in _orders:
        _, script, gender = kind.split(":")
        order = _keyed_order(key, GIVEN[script, gender])
        _orders[key, kind] = dict(zip(order, [*order[1:], order[0]], strict=True))
    return _orders[key, kind]


def _host(key: bytes, host: str, top: str) -> str:
    """Another host of that form, the same for every mailbox of it."""
    return next(h for turn in range(1 << 20) if (h := _by_class(key, f"host|{turn}|{top}", host, _CLASS)) != host or not any(c in _CLASS for c in host))


def _iban_check(country: str, account: str) -> int:
    """Check digits of an account number, by remainder 97."""
    return 98 - int("".join(str(int(c, 36)) for c in f"{account}{country}00")) % 97


def _new(key: bytes, kind: str, value: str, tries: int) -> str:
    """The canonical surrogate of a canonical value."""
    tweak, more = f"{kind}|{tries}", max(0, tries - TRIES + 1)
    if kind == "ip":
        return ".".join(map(str, permute(key, tweak, [256] * (4 + more), [int(x) for x in value.split(".")] + [0] * more)))
    if kind == "ip6":
        groups = permute(key, tweak, [1 << 16] * 8, [int(x, 16) for x in value.split(":")])
        return ":".join(f"{g:04x}" for g in groups)
    if kind == "card":
        offset = (int(value[-1]) - luhn_digit(value[:-1])) % 10
        body = value[1:-1] + "0" * more
        new = value[0] + _by_class(key, f"{tweak}|{offset}", body, _classes(body))
        return new + str((luhn_digit(new) + offset) % 10)
    if kind == "iban":
        country, account = value[:2], value[4:] + "0" * more
        offset = (int(value[2:4]) - _iban_check(country, value[4:])) % 97
        new = _by_class(key, f"{tweak}|{country}|{offset}", account, _classes(account))
        return f"{country}{(_iban_check(country, new) - 2 + offset) % 97 + 2:02d}{new}"
    if kind.startswith("given:"):
        return _given(key, kind)[value]
    if more:
        value = _longer(kind, value, more)
    if kind == "email":
        local, _, domain = value.partition("@")
        host, dot, top = domain.rpartition(".")
        return _by_class(key, f"{tweak}|{domain}", local, _CLASS) + "@" + _host(key, host, top) + dot + top
    if kind == "access":
        head = re.match(r"[A-Z]{4}|[a-z_]+[-_]|\w+-", value)[0]
        return head + _by_class(key, f"{tweak}|{head}", value[len(head) :], _CLASS)
    if kind == "surname":
        end = (_ENDINGS.search(value) or _LAST_VOWEL.search(value)) if len(value) > 3 else None
        stem = value[: end.start()] if end else value
        return _by_class(key, tweak, stem, _classes(stem)) + value[len(stem) :]
    if kind in ("hex", "secret") and all(c in _HEX for c in value):
        return _by_class(key, tweak, value, _HEX)
    return _by_class(key, tweak, value, _classes(value))


def _longer(kind: str, value: str, more: int) -> str:
    """``value`` with its last letter or digit written ``more`` times more; of an address, that of the local part."""
    part = value.partition("@")[0] if kind == "email" else value
    at = max((i + 1 for i, c in enumerate(part) if c in _classes(c)), default=len(part))
    return value[:at] + (value[at - 1] if at and value[at - 1] in _classes(value[at - 1]) else "a") * more + value[at:]


def _is_ip6(value: str) -> bool:
    """Whether it is an address of version 6, long enough to be no other use of colons."""
    try:
        ipaddress.IPv6Address(value)
    except ValueError:
        return False
    groups = [g for g in value.split(":") if g]
    return len(groups) >= 3 or len(groups[0]) == 4 if groups else False


def _is_card(value: str) -> bool:
    """Whether the check digit is right; other long numbers are no cards."""
    digits = _bare(value)
    return luhn_digit(digits[:-1]) == int(digits[-1])


def find(text: str | None) -> list[tuple[int, int, str, str]]:
    """``(start, end, kind, value)`` of every entity, in order and apart."""
    out: list[tuple[int, int, str, str]] = []
    if not text:
        return out
    low = text.lower()
    if _MARK.search(text) or any(w in low for w in _SECRET_WORDS) or any(w in text for w in _KEY_HEADS):
        for m in _PATTERN.finditer(text):
            kind = "secret" if m["secret"] else m.lastgroup
            start, end = m.span("secret_value") if kind == "secret" else m.span()
            if (kind != "ip6" or _is_ip6(m[0])) and (kind != "card" or _is_card(m[0])):
                out.append((start, end, kind, text[start:end]))
    honoured = not text.isascii() and _HONORIFIC.search(text)
    if honoured or not _NAME_WORDS.isdisjoint(_WORD.findall(text)):
        for m in _TITLED.finditer(text):
            out += _parts(m, "first", m["last"] is not None)
            if m["last"] is not None:
                out += _parts(m, "last", False)
        for pattern in (_GIVEN_NAME, _FAMILY_FIRST):
            for m in pattern.finditer(text):
                out += [*_parts(m, "first", True), *_parts(m, "last", False)]
        if honoured:
            out += [(*m.span(), "surname", m[0]) for m in _HONOURED.finditer(text)]
        out.sort(key=lambda x: (x[0], -x[1]))
        apart, stop = [], 0
        for x in out:
            if x[0] >= stop:
                apart.append(x)
                stop = x[1]
        out = _mentions(text, apart)
    return out


def _parts(m: re.Match, group: str, first: bool) -> list[tuple[int, int, str, str]]:
    """The parts of one word of a name: those that hyphens tie, each for itself.  A last name is no given name, even a listed one."""
    out, at = [], m.start(group)
    alone = group == "first" and not first  # after a title: a surname, unless it is a listed given name
    for part in m[group].split("-"):
        given = part in _GIVEN and (first or alone)
        out.append((at, at + len(part), f"given:{':'.join(_GIVEN[part])}" if given else "surname", part))
        at += len(part) + 1
    return out


def _mentions(text: str, found: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """``found`` with every other whole word of the text that is a part of a name found, of the kind first found, also where it is all upper case."""
    kinds: dict[str, str] = {}
    for _, _, kind, value in found:
        if kind == "surname" or kind.startswith("given:"):
            kinds.setdefault(value, kind)
            kinds.setdefault(value.upper(), kind)
    known = Counter(value for _, _, _, value in found)
    more = [v for v in kinds if text.count(v) > known[v]]
    if not more:
        return found

    def whole(name: str) -> str:
        before, after = ("" if _UNSPACED.match(c) else edge for c, edge in ((name[0], r"(?<!\w)"), (name[-1], r"(?!\w)")))
        return before + re.escape(name) + after

    words = re.compile("|".join(whole(v) for v in sorted(more, key=len, reverse=True)))
    out, k = [], 0
    for m in words.finditer(text):
        while k < len(found) and found[k][1] <= m.start():
            k += 1
        if k == len(found) or m.end() <= found[k][0]:
            out.append((*m.span(), kinds[m[0]], m[0]))
    return sorted(found + out)


def replace(key: bytes, text: str | None, overrides: dict[tuple[str, str], int]) -> tuple[str | None, list[str]]:
    found = find(text)
    if not found:
        return text, []
    out, at = [], 0
    for start, end, kind, value in found:
        out += [text[at:start], surrogate(key, kind, value, overrides.get((kind, canonical(kind, value)), 0))]
        at = end
    return "".join(out) + text[at:], [kind for _, _, kind, _ in found]


_FOUND = ArrayType(StructType([StructField("kind", StringType()), StructField("value", StringType())]))
_REPLACED = StructType([StructField("text", StringType()), StructField("kinds", ArrayType(StringType()))])


def _text(x: object) -> str | None:
    return x if isinstance(x, str) else None


def entities(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The distinct ``kind`` and canonical ``value`` of all documents."""

    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([sorted({(k, canonical(k, v)) for _, _, k, v in find(_text(t))}) for t in batch])

    found = docs.select(F.explode(F.pandas_udf(scan, _FOUND)(F.col(text_col))).alias("e"))
    return found.select("e.kind", "e.value").distinct()


def _drawn(key: bytes, table: DataFrame, tries: int) -> DataFrame:
    def draw(kinds: pd.Series, values: pd.Series) -> pd.Series:
        return pd.Series([_new(key, k, canonical(k, v), tries) for k, v in zip(kinds, values, strict=True)], dtype=object)

    return table.withColumn("drawn", F.pandas_udf(draw, StringType())("kind", "value"))


def overrides(found: DataFrame, key: bytes) -> DataFrame:
    """``kind, value, tries`` of the entities whose first surrogate is taken: by an original, itself included, or another surrogate.

    Listed given names are not drawn again, but nothing else may take what they give.
    """
    # Drawn once and kept: the checks below read the draws several times.
    every = checkpointed(_drawn(key, found, 0))
    first = every.where(~F.col("kind").startswith("given:"))
    found = first.select("kind", "value")
    # Formats are permuted apart and kinds told apart by their text, so what is taken is a matter of the text alone.
    taken = every.select(F.col("value").alias("used"), F.lit(1).alias("n")).unionByName(every.select(F.col("drawn").alias("used"), F.lit(0).alias("n")))
    taken = taken.groupBy(F.lower("used").alias("used")).agg(F.sum("n").alias("originals"), F.sum(1 - F.col("n")).alias("draws"))
    taken = checkpointed(taken)
    clash = taken.where("(originals > 0 and draws > 0) or draws > 1").select("used")
    left = checkpointed(first.join(clash, F.lower("drawn") == clash.used, "left_semi").select("kind", "value"))
    done = left.withColumn("tries", F.lit(0)).limit(0)
    used = taken.select("used")
    tries = 0
    # From TRIES on draws grow longer, so room never runs out: the end comes when none is left.
    while not left.isEmpty():
        tries += 1
        again = checkpointed(_drawn(key, left, tries))
        crowded = again.groupBy("drawn").count().where("count > 1").select("drawn")
        good = again.join(used, F.lower("drawn") == used.used, "left_anti").join(crowded, "drawn", "left_anti")
        good = checkpointed(good.select("kind", "value", "drawn"))
        done = done.unionByName(good.select("kind", "value", F.lit(tries).alias("tries")))
        used = checkpointed(used.unionByName(good.select(F.lower("drawn").alias("used"))))
        left = checkpointed(left.join(good, ["kind", "value"], "left_anti"))
    return checkpointed(done)


def pseudonymize(docs: DataFrame, key: bytes, text_col: str = "text", out: str = "pii_kinds") -> DataFrame:
    """``docs`` with surrogates in the text, and the kinds replaced in a column ``out``."""
    changed = overrides(entities(docs, text_col), key)
    made, mark, held = spare(docs, "replaced", "text_hash", "text_overrides")
    if (n := changed.count()) <= OVERRIDES:
        shared = docs.sparkSession.sparkContext.broadcast({(r.kind, r.value): r.tries for r in changed.collect()} if n else {})

        def put(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield pd.DataFrame([replace(key, _text(t), shared.value) for t in batch], columns=["text", "kinds"])

        result = docs.withColumn(made, F.pandas_udf(put, _REPLACED)(F.col(text_col)))
    else:
        def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                yield pd.Series([sorted({(k, canonical(k, v)) for _, _, k, v in find(_text(t))}) for t in batch])

        digest = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)
        every = docs.select(digest.alias("h"), F.pandas_udf(scan, _FOUND)(F.col(text_col)).alias("e")).where(F.size("e") > 0)
        every = every.select("h", F.explode("e").alias("e")).select("h", "e.kind", "e.value").distinct()
        own = every.join(changed, ["kind", "value"]).groupBy("h").agg(F.collect_list(F.struct("kind", "value", F.col("tries").cast(IntegerType()).alias("tries"))).alias(held))

        def put_each(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
            for texts, extra in batches:
                yield pd.DataFrame(
                    [replace(key, _text(t), {(x["kind"], x["value"]): x["tries"] for x in e} if e is not None else {}) for t, e in zip(texts, extra, strict=True)],
                    columns=["text", "kinds"],
                )

        result = docs.withColumn(mark, digest).join(own.withColumnRenamed("h", mark), mark, "left")
        result = result.withColumn(made, F.pandas_udf(put_each, _REPLACED)(F.col(text_col), F.col(held))).drop(mark, held)
    return result.withColumns({text_col: F.col(f"{made}.text"), out: F.col(f"{made}.kinds")}).drop(made)
