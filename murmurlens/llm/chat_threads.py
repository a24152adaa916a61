"""Chat formatting by quotation linking, in DataFrame operations only.

Messages quote others line by line, each level one ``>`` more.  A message is cut into
lines with their levels, and a quoted passage is what stands on consecutive lines.
Lines are normalised (lower case, letters and digits only, one space between words)
and hashed, and the join of quoted with own lines of a conversation links a message to
those it quotes; a shortened quotation still holds whole lines of its source.  The
source of a line is the latest message before that says it itself.  A message replies
to the latest source of its shallowest quotation that has one.  Messages linked by
replies are a thread, and in the order of (root, turn) every message follows the one it
replies to, quotations left out.

Nothing pairs up equal lines: said and quoted lines of one hash are put in order, and a
source is a running maximum, first inside ranges of turns, then over the ranges' maxima.
A conversation of any size is so spread over hashes and ranges.  Chains of
replies are followed by doubling, a written table for each step.

Null counts as the empty text; messages whose lines are all quoted keep an empty text.
A null turn comes before all others, null conversations are one conversation, a null
role stays null.  Every row comes back; equal turns are in the order of a hash of role
and text, and repeated rows get equal rows.  Lines of fewer than ``SHORTEST``
characters, once normalised, say too little to link by.  Other columns are not looked
at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from murmurlens.functions.common import computed_once
from murmurlens.session import materialise

#: Stands for a null turn or conversation.
_NONE = -(1 << 63)
#: Turns that are put in order together.
RANGE = 4096
#: Characters a normalised line needs to link by.
SHORTEST = 8
_MARKS = "^((?:[ \\t]*>)+)[ \\t]?"
#: Lines that introduce a quotation ("Ann wrote:"); they go with it.
_INTRODUCTION = "(?i)^.{0,200}\\b(wrote|writes|said|schrieb|a écrit|escribió)\\s*:\\s*$"


def lines_of(text: Column) -> Column:
    """(level, line) of every line, marks taken off; an introduction right before a quotation has the quotation's level."""
    raw = F.split(F.coalesce(text, F.lit("")), "\\r?\\n")
    cut = F.transform(raw, lambda l: F.struct(
        F.length(F.regexp_replace(F.regexp_extract(l, _MARKS, 1), "[^>]", "")).alias("level"),
        F.regexp_replace(l, _MARKS, "").alias("line")))

    def settled(cut: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            following = F.get(cut, i + 1)
            introduces = F.coalesce(x["line"].rlike(_INTRODUCTION) & (following["level"] > x["level"]), F.lit(False))
            return F.struct(F.when(introduces, following["level"]).otherwise(x["level"]).alias("level"), x["line"].alias("line"), introduces.alias("introduces"))

        return F.transform(cut, one)

    return F.get(F.transform(F.array(cut), settled), F.lit(0))


def normalised(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), "[^\\p{L}\\p{N}]+", " "))


def own_text(lines: Column) -> Column:
    """The lines that are not quoted, blank lines around them taken off."""
    own = F.transform(F.filter(lines, lambda x: x["level"] == 0), lambda x: x["line"])
    return F.regexp_replace(F.array_join(own, "\n"), "^\\s+|\\s+$", "")


def _keys(lines: Column, quoted: bool) -> Column:
    """(level, hash) of the lines of the wanted kind that say enough."""
    wanted = F.filter(lines, lambda x: ((x["level"] > 0) if quoted else (x["level"] == 0)) & ~x["introduces"])
    said = F.transform(wanted, lambda x: F.struct(x["level"].alias("level"), normalised(x["line"]).alias("said")))
    return F.array_distinct(F.transform(
        F.filter(said, lambda x: F.length(x["said"]) >= SHORTEST), lambda x: F.struct(x["level"].alias("level"), F.xxhash64(x["said"]).alias("hash"))))


def parsed_messages(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, __conv, __turn and __tie (never null, a message's place) and __lines."""
    rows = messages.select(
        "conv_id", "turn", "role", "text", F.coalesce("conv_id", F.lit(_NONE)).cast("long").alias("__conv"),
        F.coalesce("turn", F.lit(_NONE)).cast("long").alias("__turn"), F.xxhash64("role", "text").alias("__tie"))
    lines = lines_of(F.col("text"))
    return computed_once(rows.withColumn("__lines", lines), "__lines", lines).drop("text")


def reply_links(parsed: DataFrame) -> DataFrame:
    """(__conv, place, source): the places (turn, tie) of each quoting message and of the one it replies to."""
    place = F.struct("__turn", "__tie").alias("place")

    def lines(quoted: bool) -> DataFrame:
        keys = parsed.select("__conv", place, F.explode(_keys(F.col("__lines"), quoted)).alias("k"))
        return keys.select("__conv", "place", F.col("k.level").alias("level"), F.col("k.hash").alias("hash"))

    quotes = lines(True).distinct()
    said = lines(False).join(quotes.select("__conv", "hash").distinct(), ["__conv", "hash"], "left_semi").distinct()
    rows = said.unionByName(quotes).withColumn("range", F.floor(F.col("place.__turn") / RANGE))
    is_said = F.col("level") == 0
    # the latest speaker of earlier ranges
    latest = rows.where(is_said).groupBy("__conv", "hash", "range").agg(F.max("place").alias("last"))
    ranges = latest.unionByName(rows.where(~is_said).select("__conv", "hash", "range", F.lit(None).cast(latest.schema["last"].dataType).alias("last")).distinct())
    ranges = ranges.groupBy("__conv", "hash", "range").agg(F.max("last").alias("last"))
    over_ranges = Window.partitionBy("__conv", "hash").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("__conv", "hash", "range", F.max("last").over(over_ranges).alias("before"))
    # and of the same range; a message's own lines come after its quotations
    inside = Window.partitionBy("__conv", "hash", "range").orderBy("place", F.col("level").desc()).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("within", F.max(F.when(is_said, F.col("place"))).over(inside)).where(~is_said)
    found = rows.join(ranges, ["__conv", "hash", "range"]).withColumn("source", F.coalesce("within", "before")).where(F.col("source").isNotNull())
    best = F.max(F.struct((-F.col("level")).alias("level"), "source")).alias("best")
    return found.groupBy("__conv", "place").agg(best).select("__conv", "place", F.col("best.source").alias("source"))


def thread_roots(links: DataFrame) -> DataFrame:
    """(__conv, place, root, depth) of the messages that reply to another."""
    current = materialise(links.select("__conv", "place", F.col("source").alias("root"), F.lit(1).cast("long").alias("depth")), "chat-roots")
    while True:
        above = current.select("__conv", F.col("place").alias("root"), F.col("root").alias("further"), F.col("depth").alias("more"))
        moved = current.join(above, ["__conv", "root"], "left")
        moved = moved.select("__conv", "place", F.coalesce("further", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("further").isNotNull().alias("moved"))
        moved = materialise(moved, "chat-roots")
        current = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return current


def threaded_messages(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text without quotations, n_quoted lines, reply_to, root (turns) and depth of every message.

    Ordered by (conv_id, root, turn) every message follows the one it replies to.
    """
    parsed = parsed_messages(messages)
    links = materialise(reply_links(parsed), "chat-links")
    roots = thread_roots(links)
    linked = links.join(roots, ["__conv", "place"]).select(
        "__conv", F.col("place.__turn").alias("__turn"), F.col("place.__tie").alias("__tie"), F.col("source.__turn").alias("__source"), F.col("root.__turn").alias("__root"), "depth")
    out = parsed.select(
        "conv_id", "turn", "role", "__conv", "__turn", "__tie", own_text(F.col("__lines")).alias("text"),
        F.size(F.filter("__lines", lambda x: x["level"] > 0)).cast("long").alias("n_quoted"))
    out = out.join(linked, ["__conv", "__turn", "__tie"], "left")

    def shown(turn: Column) -> Column:
        return F.nullif(turn, F.lit(_NONE))

    return out.select(
        "conv_id", "turn", "role", "text", "n_quoted", shown(F.col("__source")).alias("reply_to"),
        shown(F.coalesce("__root", "__turn")).alias("root"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"))
