"""Chat formatting by quotation linking; built-in column functions only.

Lines that begin with ``>`` marks are quoted, as deep as they have marks; lines of one depth in a row are a
passage. Passages are normalised (marks off, white space squeezed, lower case) and hashed. A message's own
text (its unquoted lines) is hashed in the same way as a whole, by passage and by line, and the first turn of
a conversation that has a hash is its original. A message replies to the earlier turn that owns the most
quoted characters of its outermost quotes (ties: the later turn); deeper quotes are linked too and reported.
Threads follow from the replies: the root of a message is reached by doubling steps along reply_to. Ordered
by (conv_id, thread_turn, turn) every reply comes after what it answers, without the quoted lines.

Messages without a linked quote are roots of their own. Null texts count as empty; rows with a null conv_id
or turn link to nothing. Rows alike in conv_id and turn are one message in several parts: they share reply_to,
and each keeps its own text. An empty table gives an empty result. Other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.functions.session import cut, written
from verdigris.llm.common import hub_join, let

MARKS = r"^(?:\x20{0,3}+>)++\x20?"
#: A line that announces a quote goes with the quote below it.
ANNOUNCES = r"(?i)\b(?:wrote|writes|schrieb|a écrit|escribió)\s*:\s*$"


def normalised(text: Column) -> Column:
    """A passage as it is compared: lower case, runs of white space as one space."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def passages_of(text: Column) -> Column:
    """array<struct<level, lines>>: runs of lines of equal quote depth, marks taken off."""
    lines = F.transform(
        F.split(text, "\n", -1),
        lambda x: F.struct(F.length(F.regexp_replace(F.regexp_extract(x, MARKS, 0), "[^>]", "")).alias("level"), F.regexp_replace(x, MARKS, "").alias("line")),
    )

    def runs(lines: Column) -> Column:
        heads = F.filter(F.transform(lines, lambda x, i: F.when((i == 0) | (x["level"] != F.get(lines, i - 1)["level"]), i)), lambda i: i.isNotNull())
        return let(
            heads,
            lambda heads: F.transform(
                heads,
                lambda h, k: F.struct(
                    F.get(lines, h)["level"].alias("level"),
                    F.transform(F.slice(lines, h + 1, F.coalesce(F.get(heads, k + 1), F.size(lines)) - h), lambda x: x["line"]).alias("lines"),
                ),
            ),
        )

    return let(lines, runs)


def parsed(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, passages, and own_text: the message without quotes and their announcements."""
    rows = messages.select("conv_id", "turn", "role", passages_of(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("passages"))

    def own(p: Column, i: Column) -> Column:
        last = F.element_at(p["lines"], -1)
        announced = F.coalesce(F.get(F.col("passages"), i + 1)["level"] > 0, F.lit(False)) & last.rlike(ANNOUNCES)
        return F.when(p["level"] == 0, F.when(announced, F.slice(p["lines"], 1, F.size(p["lines"]) - 1)).otherwise(p["lines"])).otherwise(F.array().cast("array<string>"))

    return rows.withColumn("own_lines", F.flatten(F.transform("passages", own)))


def _hash(text: Column) -> Column:
    return F.md5(text)


def originals(rows: DataFrame) -> DataFrame:
    """conv_id, hash and origin: the first turn whose own text has the passage, as a whole, a passage or a line."""
    own_passages = F.transform(F.filter("passages", lambda p: p["level"] == 0), lambda p: F.array_join(p["lines"], " "))
    units = F.concat(F.array(F.array_join("own_lines", " ")), own_passages, F.col("own_lines"))
    units = F.array_distinct(F.filter(F.transform(units, normalised), lambda u: u != ""))
    told = rows.where("conv_id is not null and turn is not null").select("conv_id", "turn", F.explode(units).alias("u"))
    return told.groupBy("conv_id", _hash(F.col("u")).alias("hash")).agg(F.min("turn").alias("origin"))


def quotes(rows: DataFrame) -> DataFrame:
    """conv_id, turn, passage, level, whole, size and hash of every quoted passage and of each of its lines."""

    def unit(whole: bool, text: Column) -> Column:
        return F.struct(F.lit(whole).alias("whole"), normalised(text).alias("u"))

    def units(p: Column) -> Column:
        lines = F.array_distinct(F.transform(p["lines"], lambda x: unit(False, x)))
        return F.struct(p["level"].alias("level"), F.concat(F.array(unit(True, F.array_join(p["lines"], " "))), lines).alias("units"))

    quoted = F.transform(F.filter("passages", lambda p: p["level"] > 0), units)
    found = rows.where("conv_id is not null and turn is not null").select("conv_id", "turn", F.posexplode(quoted).alias("passage", "q"))
    found = found.select("conv_id", "turn", "passage", F.col("q.level").alias("level"), F.explode("q.units").alias("e")).select("*", "e.*").where("u <> ''")
    return found.select("conv_id", "turn", "passage", "level", "whole", F.length("u").cast("long").alias("size"), _hash(F.col("u")).alias("hash"))


def quote_links(rows: DataFrame) -> DataFrame:
    """conv_id, turn, level, origin and size: how much of each quote depth comes from which earlier turn."""
    quoted = written(quotes(rows))
    often = quoted.groupBy("conv_id", "hash").agg(F.count(F.lit(1)).alias("n"))
    found = hub_join(quoted, originals(rows).join(often, ["conv_id", "hash"]), ["conv_id", "hash"], quoted.count(), by_place=True).where("origin < turn")
    # A passage found whole and by its lines counts with the larger of the two.
    size = F.greatest(F.max(F.when(F.col("whole"), F.col("size"))), F.sum(F.when(~F.col("whole"), F.col("size"))))
    whole = found.groupBy("conv_id", "turn", "passage", "level", "origin").agg(size.alias("size"))
    return whole.groupBy("conv_id", "turn", "level", "origin").agg(F.sum("size").alias("size"))


def replies(links: DataFrame) -> DataFrame:
    """conv_id, turn, reply_to, n_quoted_turns and quote_depth of messages with linked quotes."""
    outer = links.groupBy("conv_id", "turn").agg(F.min("level").alias("level"))
    best = links.join(outer, ["conv_id", "turn", "level"]).groupBy("conv_id", "turn").agg(F.max(F.struct("size", "origin"))["origin"].alias("reply_to"))
    seen = links.groupBy("conv_id", "turn").agg(F.countDistinct("origin").alias("n_quoted_turns"), F.max("level").cast("long").alias("quote_depth"))
    return best.join(seen, ["conv_id", "turn"])


def threads(answers: DataFrame, most_rounds: int = 64) -> DataFrame:
    """conv_id, turn, root: where following reply_to ends. Every round doubles the steps taken."""
    now = cut(answers.select("conv_id", "turn", F.col("reply_to").alias("root")))
    total = now.count()
    for _ in range(most_rounds):
        ahead = now.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("next"))
        steps = now.groupBy("conv_id", "root").agg(F.count(F.lit(1)).alias("n")).join(ahead, ["conv_id", "root"], "left")
        after = hub_join(now, steps, ["conv_id", "root"], total).select("conv_id", "turn", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        after = cut(after)
        now = after.drop("moved")
        if not after.where("moved").take(1):
            return now
    raise RuntimeError(f"reply chains did not end in {most_rounds} rounds")


def reply_ordered(messages: DataFrame) -> DataFrame:
    """conv_id, thread_turn, turn, role, reply_to, quote_depth, n_quoted_turns, n_quoted_lines and text without quotes.

    Sorting by conv_id, thread_turn and turn gives each conversation in reply order.
    """
    rows = written(parsed(messages))
    answers = cut(replies(quote_links(rows)))
    roots = threads(answers)
    linked = answers.join(roots, ["conv_id", "turn"])
    quoted = F.aggregate("passages", F.lit(0), lambda n, p: n + F.when(p["level"] > 0, F.size(p["lines"])).otherwise(0))
    told = rows.select("conv_id", "turn", "role", quoted.cast("long").alias("n_quoted_lines"), F.trim(F.array_join("own_lines", "\n")).alias("text"))
    return told.join(linked, ["conv_id", "turn"], "left").select(
        "conv_id",
        F.coalesce("root", "turn").alias("thread_turn"),
        "turn",
        "role",
        "reply_to",
        F.coalesce("quote_depth", F.lit(0)).cast("long").alias("quote_depth"),
        F.coalesce("n_quoted_turns", F.lit(0)).cast("long").alias("n_quoted_turns"),
        "n_quoted_lines",
        "text",
    )
