"""Chat formatting in budgeted windows.

Prefix sums of turn tokens choose turn-aligned spans.  Every window keeps the
system turn, repeats a limited history before its span, and leaves the repeated
turns out of the loss mask, so each assistant text is a target exactly once.

Template.  A turn is ``<s>role\\ntext</s>``.  Control strings inside a text
(``<s> </s> [INST] [/INST]``) get a backslash after their first character, or one
more if they have some already; taking one away again restores the text exactly.

Native expressions only.  All turns are sorted and numbered over the whole table, so
a very long conversation is many small groups, not one, whatever its turn numbers.
Only the token counts of a conversation meet in one row, where one fold carries the
running sums and open spans from group to group.  History goes back as far as its
budget, found by cells of the running sums.

Defined results
    null text or role    empty
    null turn            comes first
    null conv_id         a conversation of its own
    repeated rows, ties  all kept; order is by turn, then role, then text
    long turns           never split or dropped: one that exceeds the budget has a window alone
    empty table          empty result
    clashing columns     ignored; only the four named columns are read
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

#: Turns that a ``block`` of the result counts.
BLOCK = 64
#: At most so many turns of a conversation are one group while spans are laid.
GROUP = 128
#: Parts that the windows of a system turn are dealt to.
SALTS = 16

_CONTROL = r"([<\[])(\\*)(/?(?:s>|INST\]))"
_ESCAPED = r"([<\[])\\(\\*)(/?(?:s>|INST\]))"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def escape_role(role: Column) -> Column:
    """A role holds no line break of its own, as one ends it."""
    bare = F.replace(F.replace(role, F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n"))
    return escape(bare)


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))


def marked(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<s>"), escape_role(role), F.lit("\n"), escape(text), F.lit("</s>"))


def estimated_tokens(formatted: Column) -> Column:
    """Four code points a token, rounded up."""
    return F.ceil(F.length(formatted) / 4).cast("long")


def format_windows(
    turns: DataFrame,
    budget: int = 1024,
    history: int = 256,
    target_role: str = "assistant",
    tokens=estimated_tokens,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """One row per window: ``conv_id, block, span, text, n_repeated, n_turns, n_tokens, fresh_at, loss``.

    ``span`` counts the windows of a conversation and ``block`` is the place of the first
    fresh turn in units of ``BLOCK``.  ``n_repeated`` counts the turns at the head of the window that earlier windows
    hold too, and ``fresh_at`` the code points they take; ``loss`` holds ``start`` and
    ``end`` code points of the targets in ``text``.  A span takes turns while system
    turn, full history and span fit in ``budget``.  ``tokens`` maps a marked-up turn to
    its token count.
    """
    empty = F.lit("")
    rows = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col), empty).alias("role"),
        F.coalesce(F.col(text_col), empty).alias("text"),
    )
    rows = rows.withColumn("t", tokens(marked(F.col("role"), F.col("text"))).cast("long"))
    order = ["conv_id", "turn", "role", "text"]
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # ``at`` follows the order of all turns; written once, so that it is one number wherever it is read.
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    rows = checkpointed(rows.select("conv_id", "role", "text", "t", F.monotonically_increasing_id().alias("at")))
    zero, system = F.lit(0).cast("long"), F.col("role") == "system"
    groups = rows.groupBy("conv_id", F.floor(F.col("at") / GROUP).alias("g")).agg(F.sort_array(F.collect_list(F.struct("at", "t", system.alias("system")))).alias("turns"))
    groups = checkpointed(groups.select("conv_id", F.col("turns")[0]["at"].alias("g"), "turns"))
    convs = groups.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("g", "turns"))).alias("groups")).withColumn("first", F.col("groups")[0]["turns"][0])
    room = F.greatest(F.lit(1), F.lit(budget - history) - F.when(F.col("first.system"), F.col("first.t")).otherwise(0)).cast("long")
    convs = convs.select("conv_id", "groups", room.alias("room"), F.when(F.col("first.system"), F.col("first.at")).alias("head_at"), F.when(F.col("first.system"), F.col("first.t")).alias("head_t"))

    def state(cum: Column, held: Column, n: Column, i: Column) -> Column:
        """Tokens before the next turn, tokens of the open span, its number from 1, and turns before."""
        return F.struct(cum.alias("cum"), held.alias("held"), n.alias("n"), i.alias("i"))

    def step(a: Column, x: Column) -> Column:
        """A span opens where its sum would pass the room; the leading system turn is in none."""
        opens = (a.n == 0) | (a.held + x.t > F.col("room"))
        after = state(a.cum + x.t, F.when(opens, x.t).otherwise(a.held + x.t), a.n + opens.cast("long"), a.i + 1)
        return F.when(x["at"].eqNullSafe(F.col("head_at")), state(a.cum, a.held, a.n, a.i + 1)).otherwise(after)

    start = state(zero, zero, zero, zero)
    carried = F.aggregate(
        "groups",
        F.struct(start.alias("s"), F.array().cast("array<struct<g:bigint,s:struct<cum:bigint,held:bigint,n:bigint,i:bigint>>>").alias("out")),
        lambda a, x: F.struct(F.aggregate(x.turns, a.s, step).alias("s"), F.concat(a.out, F.array(F.struct(x.g.alias("g"), a.s.alias("s")))).alias("out")),
    )
    convs = checkpointed(convs.select("conv_id", "room", "head_at", "head_t", carried.alias("c")))
    opened = convs.select("room", "head_at", F.inline("c.out"))
    laid = F.aggregate(
        "turns",
        F.struct(F.col("s").alias("s"), F.array().cast("array<struct<at:bigint,cum:bigint,n:bigint,i:bigint,opens:boolean>>").alias("out")),
        lambda a, x: F.transform(
            F.array(step(a.s, x)),
            lambda b: F.struct(b.alias("s"), F.concat(a.out, F.array(F.struct(x["at"].alias("at"), a.s.cum.alias("cum"), b.n.alias("n"), a.s.i.alias("i"), (b.n > a.s.n).alias("opens")))).alias("out")),
        )[0],
    )
    placed = groups.join(opened, "g").select("conv_id", "head_at", F.inline(laid["out"])).where(~F.col("at").eqNullSafe(F.col("head_at"))).drop("head_at")
    placed = checkpointed(placed)
    # Tokens between a span and what it repeats are at most the history: their cells of that width are the same or neighbours.
    cell = F.floor(F.col("cum") / max(1, history))
    spans = placed.where("opens").select(F.col("conv_id").alias("c"), F.col("n").alias("span_n"), F.col("cum").alias("span_cum"), F.col("at").alias("span_at"), F.explode(F.array(cell, cell - 1)).alias("cell"))
    near = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("p.cell") == F.col("s.cell")) & (F.col("at") < F.col("span_at")) & (F.col("span_cum") - F.col("cum") <= history)
    past = placed.withColumn("cell", cell).alias("p").join(spans.alias("s"), near).select("conv_id", "at", F.col("span_n").alias("n"), "i", F.lit(False).alias("own"))
    dealt = placed.select("conv_id", "at", "n", "i", F.lit(True).alias("own")).unionByName(past).join(rows.drop("conv_id"), "at").withColumn("rank", F.lit(1))
    # The system turn goes to every window; a conversation of it alone has one.
    sent = convs.where("head_at is not null").select("conv_id", F.col("head_at").alias("at"), F.explode(F.sequence(F.lit(1).cast("long"), F.greatest(F.lit(1), F.col("c.s.n")))).alias("n"))
    sent = sent.withColumn("salt", F.pmod("n", F.lit(SALTS)).cast("int"))
    heads = rows.where(system).select("at", "role", "text", "t", F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt"))
    sent = sent.join(heads, ["at", "salt"]).drop("salt").withColumns({"rank": F.lit(0), "i": zero, "own": F.col("n") == 1})
    windows = dealt.unionByName(sent).groupBy("conv_id", "n").agg(F.sort_array(F.collect_list(F.struct("rank", "at", "role", "text", "t", "own", "i"))).alias("all"))
    made = F.transform("all", lambda x: F.struct(x["rank"].alias("rank"), x.role.alias("role"), x.text.alias("text"), x.own.alias("own"), x.t.alias("t"), x.i.alias("i"), marked(x.role, x.text).alias("fmt")))
    windows = windows.select("conv_id", (F.col("n") - 1).alias("span"), made.alias("all"))
    spans = windows.select(
        "conv_id",
        "span",
        F.when(F.col("all")[0]["rank"] == 0, F.col("all")[0]).alias("system"),
        F.filter("all", lambda x: (x["rank"] == 1) & ~x.own).alias("past"),
        F.filter("all", lambda x: (x["rank"] == 1) & x.own).alias("new"),
    )
    spans = spans.withColumns({"own_head": F.coalesce(F.col("system.own"), F.lit(False)), "block": F.floor(F.coalesce(F.get("new", F.lit(0))["i"], zero) / BLOCK).cast("long")})
    head_text = F.coalesce(F.col("system.fmt"), empty)
    before = F.concat(head_text, F.array_join(F.transform("past", lambda x: x.fmt), ""))
    spans = spans.withColumn("before", before)
    loss = F.aggregate(
        "new",
        F.struct(F.length("before").alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")),
        lambda a, x: F.struct(
            (a.at + F.length(x.fmt)).alias("at"),
            F.when(
                x.role == target_role,
                F.concat(a.spans, F.array(F.struct((a.at + F.length(x.fmt) - F.length(escape(x.text)) - 4).alias("start"), (a.at + F.length(x.fmt) - 4).alias("end")))),
            ).otherwise(a.spans).alias("spans"),
        ),
        lambda a: a.spans,
    )
    system_repeated = (F.col("system").isNotNull() & ~F.col("own_head")).cast("int")
    return spans.select(
        "conv_id",
        "block",
        "span",
        F.concat("before", F.array_join(F.transform("new", lambda x: x.fmt), "")).alias("text"),
        (system_repeated + F.size("past")).cast("long").alias("n_repeated"),
        (F.col("system").isNotNull().cast("int") + F.size("past") + F.size("new")).cast("long").alias("n_turns"),
        F.when(F.col("own_head"), 0).otherwise(F.length("before")).alias("fresh_at"),
        (F.coalesce(F.col("system.t"), F.lit(0)) + F.aggregate(F.concat("past", "new"), F.lit(0).cast("long"), lambda a, x: a + x.t)).cast("long").alias("n_tokens"),
        loss.alias("loss"),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """One row per conversation, read from the windows' own text and masks.

    The digest of a conversation covers all its turns in order, so this gathers one
    conversation's text in one row, as the digest itself demands.
    """
    # What a window repeats is left behind; the rest of its text, with the mask, is all that moves.
    tail = F.substring(F.col("text"), F.col("fresh_at") + 1, F.length("text"))
    spans = F.transform("loss", lambda x: F.struct((x.start - F.col("fresh_at")).alias("start"), (x.end - F.col("fresh_at")).alias("end")))
    rows = windows.select("conv_id", F.struct("block", "span", tail.alias("text"), spans.alias("loss")).alias("w"), F.length("text").alias("n"))
    rows = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("w")).alias("w"), F.sum("n").alias("n"))

    def turns_of(w: Column) -> Column:
        pieces = F.filter(F.split(w["text"], "</s>"), lambda p: p != "")
        return F.transform(pieces, lambda p: F.concat(unescape_role(F.regexp_extract(p, r"^<s>([^\n]*)\n", 1)), F.lit("\n"), unescape(F.regexp_replace(p, r"^<s>[^\n]*\n", "")), F.lit("\n")))

    def targets_of(w: Column) -> Column:
        return F.array_join(F.transform(w["loss"], lambda x: unescape(F.substring(w["text"], x.start + 1, x.end - x.start))), "")

    turns = F.flatten(F.transform("w", turns_of))
    loss = F.array_join(F.transform("w", targets_of), "")
    rows = rows.select("conv_id", "n", turns.alias("turns"), loss.alias("loss"))
    return rows.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join("turns", ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.col("n").cast("long").alias("formatted_chars"),
    )
