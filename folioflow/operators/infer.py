"""What a typed text, a file name or a file's first bytes are."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import dates

# Document types by the end of a file name.
EXTENSIONS = {
    "pdf": ("pdf",), "docx": ("docx",), "xlsx": ("xlsx", "xlsm"), "pptx": ("pptx",), "rtf": ("rtf",), "csv": ("csv",), "txt": ("txt", "md", "log"), "html": ("html", "htm"),
    "image": ("png", "jpg", "jpeg", "gif", "bmp", "webp", "svg"), "json": ("json",), "unsupported": ("doc", "xls", "ppt"),
}
# Media types that a picker of documents accepts, the last one any.
ACCEPTED = (
    "application/pdf", "application/msword", "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "application/vnd.ms-excel",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "application/vnd.ms-powerpoint", "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "application/rtf", "text/rtf", "text/html", "text/plain", "text/csv", "text/markdown", "image/jpeg", "image/png", "image/webp", "image/bmp", "image/gif", "*/*",
)
# Image types by leading bytes, as hexadecimal digits.
MAGIC = (("image/png", "89504E47"), ("image/jpeg", "FFD8FF"), ("image/gif", "47494638"), ("image/bmp", "424D"))


def document_type(name: Column) -> Column:
    """Type by extension; ``unknown`` without a known one."""
    ending = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    chain = None
    for kind, ends in EXTENSIONS.items():
        chain = F.when(ending.isin(*ends), kind) if chain is None else chain.when(ending.isin(*ends), kind)
    return chain.otherwise("unknown")


def accepted(media_type: Column, listed_only: bool = False) -> Column:
    """Whether a picker offers files of a media type; ``listed_only`` leaves the catch-all out."""
    return F.coalesce(F.lower(media_type).isin(*ACCEPTED[:-1]), F.lit(False)) if listed_only else media_type.isNotNull()


def image_type(content: Column) -> Column:
    """Media type of an image by its first bytes, else null."""
    head = F.hex(F.substring(content, 1, 12))
    chain = None
    for kind, digits in MAGIC:
        chain = F.when(head.startswith(digits), kind) if chain is None else chain.when(head.startswith(digits), kind)
    chain = chain.when(head.startswith("52494646") & head.endswith("57454250"), "image/webp")
    start = F.lower(F.decode(F.substring(content, 1, 256), "ISO-8859-1"))
    return chain.when(start.rlike(r"^\s*(<\?xml|<svg|<!--)") & start.contains("<svg"), "image/svg+xml")


def data_uri(content: Column) -> Column:
    """A URI in one line, whether or not the session breaks base64 into lines; null where the bytes are no known image."""
    return F.concat(F.lit("data:"), image_type(content), F.lit(";base64,"), F.replace(F.base64(content), F.lit("\r\n"), F.lit("")))


def typed_input(text: Column) -> Column:
    """What a typed text becomes: ``kind`` (blank, formula, text, bool, number, date, time), the number ``n``, the text ``s`` and the format ``nf`` it suggests."""
    t = F.trim(text)
    grouped, plain, percent = r"^[+-]?\d{1,3}(,\d{3})+(\.\d+)?$", r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$", r"^[+-]?(\d+\.?\d*|\.\d+)%$"
    iso, slashed, clock = r"^(\d{4})-(\d{1,2})-(\d{1,2})$", r"^(\d{1,2})/(\d{1,2})/(\d{4})$", r"^(\d{1,2}):(\d{2})(?::(\d{2}))?$"

    def part(pattern: str, i: int) -> Column:
        return F.coalesce(F.regexp_extract(t, pattern, i).try_cast("int"), F.lit(0))

    a, b = part(slashed, 1), part(slashed, 2)
    swap = b > 12
    day_first = dates.date(part(slashed, 3), F.when(swap, a).otherwise(b), F.when(swap, b).otherwise(a))
    in_iso = dates.date(part(iso, 1), part(iso, 2), part(iso, 3))
    time = (part(clock, 1) * 3600 + part(clock, 2) * 60 + part(clock, 3)) / 86400
    empty, none = F.lit(None).cast("double"), F.lit(None).cast("string")

    def made(kind: str, n: Column = empty, s: Column = none, nf: str | None = None) -> Column:
        return F.struct(F.lit(kind).alias("kind"), n.alias("n"), s.alias("s"), F.lit(nf).cast("string").alias("nf"))

    return (
        F.when(F.coalesce(t, F.lit("")) == "", made("blank"))
        .when(t.startswith("=") & (F.length(t) > 1), made("formula", s=t))
        .when(text.startswith("'"), made("text", s=F.substring(text, F.lit(2), F.length(text))))
        .when(F.upper(t).isin("TRUE", "FALSE"), made("bool", F.when(F.upper(t) == "TRUE", 1.0).otherwise(0.0)))
        .when(t.rlike(plain), made("number", t.try_cast("double")))
        .when(t.rlike(grouped), made("number", F.replace(t, F.lit(",")).try_cast("double"), nf="#,##0"))
        .when(t.rlike(percent), made("number", F.regexp_replace(t, "%$", "").try_cast("double") / 100, nf="0%"))
        .when(t.rlike(iso) & part(iso, 2).between(1, 12) & part(iso, 3).between(1, 31), made("date", in_iso, nf="yyyy-mm-dd"))
        .when(t.rlike(slashed) & F.least(a, b).between(1, 12) & F.greatest(a, b).between(1, 31), made("date", day_first, nf="dd/mm/yyyy"))
        .when(t.rlike(clock) & (part(clock, 2) < 60) & (part(clock, 3) < 60), made("time", time, nf="h:mm"))
        .otherwise(made("text", s=text))
    )


def column_index(letters: Column) -> Column:
    """Number of a column by its letters."""
    codes = F.transform(F.split(F.upper(letters), ""), lambda c: F.ascii(c) - 64)
    return F.aggregate(F.filter(codes, lambda c: c > 0), F.lit(0), lambda a, c: a * 26 + c)


def column_name(n: Column) -> Column:
    """Letters of a column by its number, as many as it takes; ``@`` for 0."""
    letters, before = [F.chr((n - 1) % 26 + 65)], 1
    for k in range(1, 7):
        # Names of more than k letters begin after all shorter ones.
        before += 26**k
        rest = n.cast("long") - before
        letters.insert(0, F.when(rest >= 0, F.chr(F.floor(rest / 26**k).cast("long") % 26 + 65)).otherwise(""))
    return F.concat(*letters)


def cell_of(a1: Column) -> Column:
    """Row and column of a cell such as ``$B$7``; null where it is none."""
    pattern = r"^\$?([A-Za-z]{1,3})\$?(\d{1,7})$"
    hit = a1.rlike(pattern)
    return F.when(hit, F.struct(F.regexp_extract(a1, pattern, 2).try_cast("int").alias("r"), column_index(F.regexp_extract(a1, pattern, 1)).alias("c")))
