"""Page layout from positioned glyphs and words: lines, segments, marks, paragraphs, headers, chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Gaps in font sizes: between words, between segments, and where a line is cut.
WORD_GAP, SEGMENT_GAP, LINE_CUT = 0.20, 2.5, 7.0


def islands(df: DataFrame, group: list[str], start: str, end: str, size: str, gap: float, out: str) -> DataFrame:
    """Numbers runs whose next start lies within ``gap`` sizes of the furthest end so far."""
    order = Window.partitionBy(*group).orderBy(start, end)
    far = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    jump = F.coalesce(F.col(start) - far > F.col(size) * gap, F.lit(False)).cast("int")
    return df.withColumn("__j", jump).withColumn(out, F.sum("__j").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__j")


def line_boxes(df: DataFrame, group: list[str]) -> DataFrame:
    """Box and text of every group of glyphs ``u, x0, x1, top, bottom``."""
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x0", "u"))), lambda g: g.u), "")
    return df.groupBy(*group).agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("top").alias("top"), F.max("bottom").alias("bottom"), text.alias("text"))


def banded(glyphs: DataFrame, page: str = "page", key: str = "id", base: str = "base", font: str = "font") -> DataFrame:
    """``page, id, band``: glyphs from the lowest baseline on share a line while theirs lies within half a font size of the running mean.  One page is a group."""
    kinds = dict(glyphs.dtypes)

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values([base, key], kind="stable")
        band, n, mean, size, out = -1, 0, 0.0, 0.0, []
        for y, f in zip(frame[base], frame[font], strict=True):
            if n and abs(y - mean) <= 0.5 * max(size, f):
                n += 1
                mean, size = mean + (y - mean) / n, max(size, f)
            else:
                band, n, mean, size = band + 1, 1, y, f
            out.append(band)
        return pd.DataFrame({page: frame[page], key: frame[key], "band": out})

    return glyphs.select(page, key, base, font).groupBy(page).applyInPandas(one, f"{page} {kinds[page]}, {key} {kinds[key]}, band long")


# Words that end no sentence, Arabic and English.
OPEN_ENDERS = (
    "و", "أو", "او", "ثم", "في", "من", "على", "إلى", "الى", "عن", "مع", "بين", "حتى", "إذا", "اذا", "لكن", "أن", "ان", "إن", "لأن", "لان", "كما", "التي", "الذي", "الذين", "بحيث", "حيث", "حول",
    "خلال", "عند", "لدى", "نحو", "ضد", "دون", "بدون", "عبر", "قبل", "بعد", "أثناء", "بسبب", "عندما", "أما",
    "the", "of", "and", "or", "to", "in", "with", "for", "a", "an", "by", "as", "at", "on", "from", "that", "which", "is", "are", "was", "were", "be", "if", "but", "than", "between", "during", "after", "before",
)


def open_ender(word: Column) -> Column:
    """Whether a word bears no stop and is one after which a sentence goes on."""
    return F.coalesce(word.rlike(r"[\p{L}\x{064B}-\x{0652}]$") & F.lower(F.regexp_replace(word, r"[^\p{L}]", "")).isin(*OPEN_ENDERS), F.lit(False))


def continues(before: Column, word: Column) -> Column:
    """Whether a word goes on with the sentence of the one before across a soft break."""
    return F.coalesce(word.rlike(r"^\p{L}") & (before.rlike("[,،]$") | open_ender(before)), F.lit(False))


def paragraph_starts(words: DataFrame, page: str = "page", order: str = "pos", out: str = "starts") -> DataFrame:
    """``words`` (``line, text, t, b``) with whether a paragraph starts at each.

    A new line starts one if it lies further down than usual.  A piece at the same height, a neighbouring cell or column, and a jump up
    to the next column start one unless the sentence goes on there.
    """
    w = Window.partitionBy(page).orderBy(order)
    rows = words.withColumns({"__l": F.lag("line").over(w), "__w": F.lag("text").over(w), "__dy": F.col("t") - F.lag("t").over(w), "__h": F.greatest(F.lit(0.004), F.lag("b").over(w) - F.lag("t").over(w))})
    moved = F.col("__l").isNotNull() & (F.col("line") != F.col("__l"))
    steps = rows.where(moved & (F.col("__dy") > 0.002)).groupBy(page).agg(upper_median("__dy").alias("__usual"), F.count("*").alias("__n"))
    rows = rows.join(steps.where("__n >= 3").drop("__n"), page, "left")
    dy, h = F.col("__dy"), F.col("__h")
    limit = F.when(F.col("__usual").isNull(), 2.1 * h).otherwise(F.greatest(1.7 * F.col("__usual"), 1.6 * h))
    broken = ~continues(F.col("__w"), F.col("text"))
    new = F.when(~moved, False).when(F.abs(dy) < 0.35 * h, broken).when(dy > limit, True).when(dy < -2.4 * h, broken).otherwise(False)
    return rows.withColumn(out, new).drop("__l", "__w", "__dy", "__h", "__usual")


def page_words(words: DataFrame, page: str = "page", order: str = "pos", starts: str = "starts") -> DataFrame:
    """``words`` (``line, text``) with ``start``, ``end`` and ``said`` in the page's text: what stands before each word, and the word.

    A word hyphenated at the end of a line joins the next one, where that is Latin and in lower case.  A paragraph begins on a new line, after a
    full stop if the one before has no stop of its own; so a heading is not read into its first sentence.
    """
    w = Window.partitionBy(page).orderBy(order)

    def joins(a: Column, a_line: Column, b: Column, b_line: Column, b_starts: Column) -> Column:
        latin = ~a.rlike(r"[\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}]")
        return F.coalesce(~b_starts & (a_line != b_line) & a.endswith("-") & (F.length(a) > 2) & b.rlike(r"^\p{Ll}") & latin, F.lit(False))

    text, line, new = F.col("text"), F.col("line"), F.col(starts)
    before, after = (lambda c: F.lag(c).over(w)), (lambda c: F.lead(c).over(w))
    stopped = before("text").rlike(r"""[.,!?:;،؛؟…)"”»\]]$""")
    gap = F.when(before(order).isNull(), "").when(joins(before("text"), before("line"), text, line, new), "").when(new, F.when(stopped, "\n").otherwise(".\n")).otherwise(" ")
    kept = F.when(joins(text, line, after("text"), after("line"), after(starts)), F.substring(text, F.lit(1), F.length(text) - 1)).otherwise(text)
    rows = words.withColumns({"__gap": gap, "__kept": kept})
    upto = F.sum(F.length("__gap") + F.length("__kept")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("end", upto.cast("int")).withColumn("start", (F.col("end") - F.length("__kept")).cast("int"))
    return rows.withColumn("said", F.concat("__gap", "__kept")).drop("__gap", "__kept")


def page_texts(placed: DataFrame, page: str = "page", order: str = "pos") -> DataFrame:
    """The text of every page from what ``page_words`` gives, and where it ends."""
    parts = F.sort_array(F.collect_list(F.struct(order, "said")))
    return placed.groupBy(page).agg(F.array_join(F.transform(parts, lambda p: p.said), "").alias("text"), F.max("end").alias("end"))


def word_at(placed: DataFrame, asked: DataFrame, page: str = "page", offset: str = "offset") -> DataFrame:
    """``asked`` with ``word``, ``start`` and ``end`` of the last word that starts at or before each offset of its page; null before the first.

    Words and offsets of a page stand in one order, and a running frame, which keeps one row, has the last word.
    """
    asks = asked.select(F.col(page).alias("__page"), F.col(offset).cast("long").alias("__at"), F.struct(*asked.columns).alias("__asked"))
    word = F.struct(F.col("text").alias("word"), "start", "end").alias("__word")
    words = placed.where(F.col(page).isNotNull()).select(F.col(page).alias("__page"), F.col("start").cast("long").alias("__at"), F.lit(None).cast(asks.schema["__asked"].dataType).alias("__asked"), word)
    both = words.unionByName(asks.withColumn("__word", F.lit(None).cast(words.schema["__word"].dataType)))
    upto = Window.partitionBy("__page").orderBy("__at", F.col("__word").isNull(), "__word.end").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("__last", F.last("__word", ignorenulls=True).over(upto)).where("__asked is not null")
    return found.select("__asked.*", "__last.word", "__last.start", "__last.end")


#: Characters that the first, the second and any later chunk of a page may have, and how short a piece in another language joins its neighbour.
FIRST_CHUNK, SECOND_CHUNK, LATER_CHUNK, SHORT_SWITCH = 300, 800, 1400, 40


def merged_chunks(chunks: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Chunks ``(start, end, language)`` joined to larger ones: of one language, or with a short piece in another, which takes the longer one's."""
    out: list[tuple[int, int, str]] = []
    held: tuple[int, int, str] | None = None
    for one in chunks:
        joined = one if held is None else _joined(len(out), held, one)
        if joined is None:
            out.append(held)
        held = joined or one
    return out + [held] if held else out


def _joined(n: int, held: tuple[int, int, str], one: tuple[int, int, str]) -> tuple[int, int, str] | None:
    """The chunk after ``n`` others and the next one as a single chunk, or None if they stay apart."""
    (_, _, other), (start, end, lang) = held, one
    most = (FIRST_CHUNK, SECOND_CHUNK, LATER_CHUNK)[min(n, 2)]
    a, b = held[1] - held[0], end - start
    if end - held[0] <= most and (lang == other or min(a, b) < SHORT_SWITCH):
        return held[0], end, other if lang == other or a >= b else lang
    return None


def merge_chunks(chunks: DataFrame, page: str = "page") -> DataFrame:
    """``page, start, end, lang`` of the joined chunks.  Pages come one after the other in a task's batches; none is gathered, and many share a batch."""
    kind = dict(chunks.dtypes)[page]
    parts = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = chunks.select(page, F.col("start").cast("long"), F.col("end").cast("long"), "lang").repartition(parts, page).sortWithinPartitions(page, "start", "end", "lang")
    return dealt.mapInArrow(_merging, f"{page} {kind}, start long, end long, lang string")


def _merging(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``merged_chunks`` of rows sorted by page: a page goes on from batch to batch, and what is joined leaves with the batch."""
    at, n, held, schema = None, 0, None, None
    for batch in batches:
        schema = batch.schema
        out: list[tuple] = []
        for page, start, end, lang in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            one = (start, end, lang)
            joined = _joined(n, held, one) if held is not None and page == at else None
            if joined is not None:
                held = joined
                continue
            if held is not None:
                out.append((at, *held))
            n, at, held = n + 1 if held is not None and page == at else 0, page, one
        if out:
            yield _batch(out, schema)
    if held is not None:
        yield _batch([(at, *held)], schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def useful_line(text) -> object:
    """Lines with three letters or more, or of numbers alone."""
    return (F.length(F.regexp_replace(text, r"[^\p{L}]", "")) >= 3) | text.rlike(r"^[\d\s.,%()+/-]+$")


def attach_marks(marks: DataFrame, bases: DataFrame, font: str = "font") -> DataFrame:
    """Each mark's base glyph: least distance plus shares of the offset of centres and of the baselines' distance.

    Glyphs meet only in neighbouring cells of a grid as wide as the reach of a mark.
    """
    cell = 1.2
    m = marks.select("page", F.col("id").alias("mark"), F.col("x0").alias("mx0"), F.col("x1").alias("mx1"), F.col("base").alias("my"), F.col(font).alias("mf"))
    b = bases.select("page", F.col("id").alias("glyph"), F.col("x0").alias("bx0"), F.col("x1").alias("bx1"), F.col("base").alias("by"), F.col(font).alias("bf"))
    size = bases.groupBy("page").agg(F.max(font).alias("__f"))
    b = b.join(size, "page").withColumn("__cell", F.floor(F.col("by") / (F.col("__f") * cell)))
    m = m.join(size, "page").withColumn("__c", F.floor(F.col("my") / (F.col("__f") * cell))).withColumn("__cell", F.explode(F.array(F.col("__c") - 1, F.col("__c"), F.col("__c") + 1)))
    d = F.greatest(F.lit(0.0), F.col("bx0") - F.col("mx1"), F.col("mx0") - F.col("bx1"))
    dy = F.abs(F.col("by") - F.col("my"))
    centre = F.abs((F.col("mx0") + F.col("mx1")) / 2 - (F.col("bx0") + F.col("bx1")) / 2)
    near = m.drop("__f").join(b.drop("__f"), ["page", "__cell"]).where((dy <= 1.2 * F.col("bf")) & (d <= 0.9 * F.col("bf")))
    score = d + 0.15 * centre + 0.35 * dy
    return near.groupBy("page", "mark").agg(F.min_by("glyph", F.struct(score, F.col("glyph"))).alias("glyph"), F.min(score).alias("score"))


def without_margins(words: DataFrame, page: str = "page", top: float = 0.078, bottom: float = 0.91, least: int = 25) -> DataFrame:
    """Words of head and foot lines dropped where the body has enough words."""
    margin = (F.col("b") < top) | (F.col("t") > bottom)
    body = F.count_if(~margin).over(Window.partitionBy(page))
    return words.withColumn("__m", margin).withColumn("__body", body).where(~F.col("__m") | (F.col("__body") < least)).drop("__m", "__body")


def upper_median(column: str):
    """The middle value, of two the larger."""
    ordered = F.sort_array(F.collect_list(column))
    return F.get(ordered, F.floor(F.size(ordered) / 2).cast("int"))


def paragraphs(lines: DataFrame, page: str = "page", order: str = "line") -> DataFrame:
    """``lines`` of ``t``, ``b`` with a paragraph number: a new one at a larger step down than usual, or up."""
    w = Window.partitionBy(page).orderBy(order)
    step = F.col("t") - F.lag("t").over(w)
    steps = lines.withColumn("__step", step)
    usual = steps.where("__step > 0").groupBy(page).agg(upper_median("__step").alias("__usual"))
    height = F.col("b") - F.col("t")
    limit = F.when(F.col("__usual").isNull(), 2.1 * height).otherwise(F.greatest(1.7 * F.col("__usual"), 1.6 * height))
    new = F.coalesce((F.col("__step") > limit) | (F.col("__step") <= 0), F.lit(False)).cast("int")
    return steps.join(usual, page, "left").withColumn("__new", new).withColumn("paragraph", F.sum("__new").over(w)).drop("__step", "__usual", "__new")


def hocr_words(df: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page",)) -> DataFrame:
    """Words of recognised pages: ``line, pos, text, x0, y0, x1, y1, conf``; confidence 60 where none is given."""
    tag = r"(?s)<span[^>]*class=['\"](ocr_line|ocrx_word)['\"][^>]*title=['\"]([^'\"]*)['\"][^>]*>((?:(?!<span|</span).)*)"
    rows = df.select(*keep, F.posexplode(F.regexp_extract_all(F.col(html), F.lit(tag), F.lit(0))).alias("pos", "m"))
    kind, title, body = (F.regexp_extract("m", tag, i) for i in (1, 2, 3))
    rows = rows.select(*keep, "pos", kind.alias("kind"), title.alias("title"), body.alias("body"))
    rows = rows.withColumn("line", F.sum((F.col("kind") == "ocr_line").cast("int")).over(Window.partitionBy(*keep).orderBy("pos")))
    box = [F.regexp_extract("title", r"bbox (\d+) (\d+) (\d+) (\d+)", i).try_cast("int") for i in range(1, 5)]
    conf = F.coalesce(F.regexp_extract("title", r"x_wconf (\d+)", 1).try_cast("int"), F.lit(60))
    plain = F.regexp_replace(F.col("body"), "<[^>]*>", "")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(a), F.lit(b))
    words = rows.where("kind = 'ocrx_word'")
    return words.select(*keep, "line", "pos", F.trim(plain).alias("text"), box[0].alias("x0"), box[1].alias("y0"), box[2].alias("x1"), box[3].alias("y1"), conf.alias("conf")).where("text != ''")


def confident(words: DataFrame) -> DataFrame:
    """Words recognised well enough: confidence 15, or 30 for one or two letters."""
    letters = F.length(F.regexp_replace("text", r"[^\p{L}]", ""))
    return words.where((F.col("conf") >= 15) & ((F.col("conf") >= 30) | (letters > 2)))


def glued(words: DataFrame, keep: tuple[str, ...] = ("page",)) -> DataFrame:
    """Lone punctuation joined to the word before it on its line."""
    lone = F.col("text").rlike(r"^\p{P}+$")
    w = Window.partitionBy(*keep, "line").orderBy("pos")
    rows = words.withColumn("__start", (~lone | F.lag("pos").over(w).isNull()).cast("int")).withColumn("__g", F.sum("__start").over(w))
    parts = F.sort_array(F.collect_list(F.struct("pos", "text")))
    text = F.array_join(F.transform(parts, lambda p: p.text), "")
    return rows.groupBy(*keep, "line", "__g").agg(F.min("pos").alias("pos"), text.alias("text"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.max("conf").alias("conf")).drop("__g")


def relative_boxes(words: DataFrame, width: str, height: str) -> DataFrame:
    """Boxes as shares of the page."""
    return words.select("*", (F.col("x0") / F.col(width)).alias("l"), (F.col("y0") / F.col(height)).alias("t"), (F.col("x1") / F.col(width)).alias("r"), (F.col("y1") / F.col(height)).alias("b"))


def better_pass(words: DataFrame) -> DataFrame:
    """The recognition pass of each page whose confident words add up to more."""
    scores = words.groupBy("page", "pass").agg(F.sum(F.when(F.col("conf") >= 50, F.col("conf")).otherwise(0)).alias("score"))
    return scores.groupBy("page").agg(F.max_by("pass", F.struct("score", F.negative("pass"))).alias("pass"), F.max("score").alias("score"))


def xy_order(boxes: list[tuple[float, float, float, float]], font: float, depth: int = 0) -> list[int]:
    """Reading order of boxes ``(x0, top, x1, bottom)``: split at the widest gutter few boxes span, else top to bottom."""
    order = list(range(len(boxes)))

    def cut(rows: list[int], level: int) -> list[int]:
        if len(rows) > 3 and level < 8:
            gap = _gutter([boxes[i] for i in rows], max(1.2 * font, 8.0))
            if gap is not None:
                left = [i for i in rows if boxes[i][2] <= gap]
                right = [i for i in rows if boxes[i][0] >= gap]
                across = [i for i in rows if boxes[i][2] > gap > boxes[i][0]]
                if left and right:
                    out, rest_l, rest_r = [], left, right
                    for s in sorted(across, key=lambda i: boxes[i][1]):
                        above_l = [i for i in rest_l if boxes[i][1] < boxes[s][1]]
                        above_r = [i for i in rest_r if boxes[i][1] < boxes[s][1]]
                        out += cut(above_l, level + 1) + cut(above_r, level + 1) + [s]
                        rest_l, rest_r = [i for i in rest_l if boxes[i][1] >= boxes[s][1]], [i for i in rest_r if boxes[i][1] >= boxes[s][1]]
                    return out + cut(rest_l, level + 1) + cut(rest_r, level + 1)
        return sorted(rows, key=lambda i: (round(boxes[i][1] / max(font, 1e-9) * 2), boxes[i][0]))

    return cut(order, depth)


def _gutter(boxes: list[tuple[float, float, float, float]], least: float) -> float | None:
    """Middle of the widest vertical strip that at most 12 % of the boxes cross."""
    edges = sorted({b[0] for b in boxes} | {b[2] for b in boxes})
    allowed, best, run = 0.12 * len(boxes), None, None
    low, high = min(b[0] for b in boxes), max(b[2] for b in boxes)
    for a, b in zip(edges, edges[1:], strict=False):
        crossing = sum(x[0] < b and x[2] > a for x in boxes)
        if crossing <= allowed and low < a and b < high:
            run = (run[0], b) if run else (a, b)
            if run[1] - run[0] >= least and (best is None or run[1] - run[0] > best[1] - best[0]):
                best = run
        else:
            run = None
    return (best[0] + best[1]) / 2 if best else None


def reading_order(df: DataFrame, font: str = "font") -> DataFrame:
    """``page, id, seq`` of boxes in reading order, one page a group."""

    def one(page: pd.DataFrame) -> pd.DataFrame:
        page = page.sort_values("id").reset_index(drop=True)
        boxes = list(page[["x0", "top", "x1", "bottom"]].itertuples(index=False, name=None))
        seq = xy_order(boxes, float(page[font].median()))
        return pd.DataFrame({"page": page["page"].iloc[0], "id": page["id"].iloc[seq].to_numpy(), "seq": range(len(seq))})

    return df.groupBy("page").applyInPandas(one, "page long, id long, seq long")


def chunk(parts: list[str], least: int = 90, most: int = 420) -> list[str]:
    """Sentences gathered into chunks: ended at a sentence once long enough, cut at a clause or blank where too long."""
    out, held = [], ""
    for s in parts:
        held = f"{held} {s}".strip()
        while len(held) > most:
            at = max((held.rfind(c, 140, most) for c in (",", ";", ":", "،", "؛")), default=-1)
            at = at + 1 if at > 0 else held.rfind(" ", 1, most)
            at = at if at > 0 else most
            out.append(held[:at].strip())
            held = held[at:].strip()
        if len(held) >= least:
            out.append(held)
            held = ""
    return out + [held] if held else out
