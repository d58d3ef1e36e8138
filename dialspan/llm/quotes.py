"""Conversations in order of their replies, without quotes; DataFrame functions only.

A line's quote level is the number of ``>`` it begins with. A passage is a run of lines of one
level, ended by a line without letters and digits, by one that announces a quote, or by another
level. Passages are normalised (lower case, letters and digits only, so that lines may break
elsewhere) and hashed; a quoted passage belongs to the first message of its conversation that
has it as a passage of its own. Of a passage that no earlier message has as a whole (a part of one,
or several in one run) each line belongs to the first message that has it as a line of its own. A
message replies to the message with most of its quoted lines at the lowest level that is found
(of equals the later). Hashes are grouped before they are joined, to one row for each passage or
line of a conversation, so that neither a line that all messages have nor a conversation that
holds a third of them multiplies rows.
Threads follow the reply links by pointer doubling, in as many rounds as the logarithm of
the longest chain.

Texts are split and normalised once and written as the hashes of their passages, each with
those of its lines. Joins have one row on their right for each key, so that a hot key makes long
tasks, which Spark splits, but no more rows.

A null text is empty. A message with a null conversation or turn replies to nothing. Rows
with the same conversation and turn are one message in links; each is returned.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut

PREFIX = r"^(?:[ \t]*>)+"
ATTRIBUTION = r"(?i)^(?:on|am|le|el) .{1,200} (?:wrote|schrieb|écrit|escribió) ?:\s*$"


def level(line: Column) -> Column:
    """How many ``>`` a line begins with; lines without any aren't searched."""
    return F.when(line.contains(">"), F.length(F.regexp_replace(F.regexp_extract(line, PREFIX, 0), "[^>]", ""))).otherwise(0)


def normalised(line: Column) -> Column:
    bare = F.when(line.contains(">"), F.regexp_replace(line, PREFIX, "")).otherwise(line)
    return F.lower(F.regexp_replace(bare, r"[^\p{L}\p{N}]+", ""))


def own_text(text: Column) -> Column:
    """The text without quoted lines and without lines that announce a quote."""
    lines = F.split(F.coalesce(text, F.lit("")), r"\r?\n")
    kept = F.filter(lines, lambda x: (level(x) == 0) & ~announces(x))
    return F.trim(F.regexp_replace(F.array_join(kept, "\n"), r"\n{3,}", "\n\n"))


def announces(line: Column) -> Column:
    return line.contains(":") & line.rlike(ATTRIBUTION)


def passages(messages: DataFrame, conversation: list[str]) -> DataFrame:
    """conversation, turn, level, passage (its hash) and lines (hashes of its lines, in order) of the messages' passages."""
    line = lambda x: F.struct(level(x).alias("level"), F.when(announces(x), "").otherwise(normalised(x)).alias("words"))
    rows = messages.select(*conversation, "turn", F.split(F.coalesce("text", F.lit("")), r"\r?\n").alias("_text"))
    rows = rows.select(*conversation, "turn", F.explode(F.array(F.transform("_text", line))).alias("_lines"))  # made once a row
    # words have neither blanks nor line breaks: these part lines, and those passages, which begin with their level
    before = lambda i: F.get("_lines", i - 1)
    joined = lambda x, i: (i > 0) & (before(i)["level"] == x["level"]) & (before(i)["words"] != "")
    part = lambda x, i: F.when(x["words"] == "", "").when(joined(x, i), F.concat(F.lit(" "), x["words"])).otherwise(F.concat(F.lit("\n"), x["level"].cast("string"), F.lit(" "), x["words"]))
    found = F.split(F.array_join(F.transform("_lines", part), ""), "\n")
    rows = rows.select(*conversation, "turn", F.explode(found).alias("_p")).where("_p <> ''").select(*conversation, "turn", F.split("_p", " ").alias("_p"))
    lines = F.slice("_p", F.lit(2), F.size("_p") - 1)
    number = lambda words: F.xxhash64(words, F.length(words))
    return rows.select(*conversation, "turn", F.get("_p", F.lit(0)).cast("int").alias("level"), number(F.array_join(lines, "")).alias("passage"), F.transform(lines, number).alias("lines"))


def reply_links(messages: DataFrame, conversation: list[str]) -> DataFrame:
    """conversation, turn, reply_to (a turn) and matched (lines) of the messages that quote an earlier one."""
    parts = cut(passages(messages, conversation))
    own = parts.where("level = 0")
    wholes = own.groupBy(*conversation, "passage").agg(F.min("turn").alias("origin"))
    single = own.select(*conversation, "turn", F.explode("lines").alias("hash")).groupBy(*conversation, "hash").agg(F.min("turn").alias("origin"))
    quoted = parts.where("level > 0").join(wholes, [*conversation, "passage"], "left").withColumn("whole", F.coalesce(F.col("origin") < F.col("turn"), F.lit(False)))
    votes = quoted.where("whole").groupBy(*conversation, "passage", "turn", "level", "origin").agg(F.max(F.size("lines")).cast("long").alias("n"))  # repeated ones count once
    votes = votes.select(*conversation, "turn", "level", "origin", "n")
    rest = quoted.where("NOT whole").select(*conversation, "turn", "level", F.explode("lines").alias("hash")).distinct()
    rest = rest.join(single, [*conversation, "hash"]).where("origin < turn")
    votes = votes.unionByName(rest.select(*conversation, "turn", "level", "origin", F.lit(1).cast("long").alias("n")))
    votes = votes.groupBy(*conversation, "turn", "level", "origin").agg(F.sum("n").alias("n"))
    best = votes.groupBy(*conversation, "turn").agg(F.max(F.struct(-F.col("level"), "n", "origin")).alias("best"))
    return best.select(*conversation, "turn", F.col("best.origin").alias("reply_to"), F.col("best.n").alias("matched"))


def threads(links: DataFrame, conversation: list[str]) -> DataFrame:
    """conversation, turn, thread (the turn that the chain of replies begins with) and depth of the messages in ``links``."""
    active = cut(links.select(*conversation, "turn", F.col("reply_to").alias("thread"), F.lit(1).cast("long").alias("depth")))
    done: list[DataFrame] = []
    while True:
        up = reduce(DataFrame.unionByName, done, active)
        up = up.select(*conversation, F.col("turn").alias("thread"), F.col("thread").alias("above"), F.col("depth").alias("more"))
        step = active.join(up, [*conversation, "thread"], "left")
        moved = F.col("above").isNotNull()
        step = cut(step.select(*conversation, "turn", F.coalesce("above", "thread").alias("thread"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), moved.alias("moved")))
        done.append(step.where(~F.col("moved")).drop("moved"))  # their threads have begun; only the others are joined again
        active = step.where("moved").drop("moved")
        if active.limit(1).count() == 0:
            return reduce(DataFrame.unionByName, done)


def ordered(messages: DataFrame, conversation: list[str] | None = None) -> DataFrame:
    """``messages`` (conversation, turn, text, ...) with own text and reply_to, matched, thread and depth.

    In order of (conversation, thread, turn) every message stands after that which it replies
    to. A message that quotes nothing known begins a thread; its depth is 0.
    """
    conversation = conversation or ["conv_id"]
    links = cut(reply_links(messages, conversation))
    found = links.join(threads(links, conversation), [*conversation, "turn"])
    kept = messages.drop("reply_to", "matched", "thread", "depth").withColumn("text", own_text(F.col("text")))
    out = kept.join(found, [*conversation, "turn"], "left")
    return out.withColumns({"matched": F.coalesce("matched", F.lit(0)), "thread": F.coalesce("thread", "turn"), "depth": F.coalesce("depth", F.lit(0))})


def with_quotes(messages: DataFrame) -> DataFrame:
    """Messages of ``conversations`` that quote the turn before, and in that the first line of the turn before it."""
    text = F.coalesce(F.col("text"), F.lit(""))
    plain = messages.groupBy("conv_id", "turn").agg(F.min("role").alias("role"), F.min(text).alias("text"))
    before = plain.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("_one"))
    older = plain.select("conv_id", (F.col("turn") + 2).alias("turn"), F.split("text", "\n")[0].alias("_two"))
    joined = plain.join(before, ["conv_id", "turn"], "left").join(older, ["conv_id", "turn"], "left")
    quote = F.concat(F.lit("> "), F.regexp_replace("_one", "\n", "\n> "))
    nested = F.concat(F.lit("> > "), F.col("_two"))
    return joined.select("conv_id", "turn", "role", F.concat_ws("\n", nested, quote, "text").alias("text"))
