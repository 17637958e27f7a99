"""Chat formatting by quotation linking: nested quotes are parsed, linked to the messages they quote, and taken out.

A line's quote level is the number of `>` before its text. A passage is a run of lines of one level above 0. Passages are
normalised (ASCII lower case, white space as one blank, blank lines left out), hashed, and joined to the messages of the
same conversation without their quotes: to a whole message, however its lines are broken, or to as many consecutive lines
of one as the passage has. For that, messages give the runs of those lengths only that passages of their conversation
have. Of equal originals the latest before the quoting message is taken. A message replies to the original of its
shallowest linked passage. The threads of replies are followed to their first message by pointer jumping; ordered by
(order_thread, turn), a thread stands together and each reply comes after what it replies to.

All work on executors is DataFrame operations. A conversation is never gathered in one row, and a passage that a
conversation repeats very often costs one sorted pass, not a pair for each repetition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rippleframe.llm.common import shared_dir, written

_QUOTE = r"^(?:[ \t]*>)+[ \t]?"
_ATTRIBUTION = r"(?i)^[ \t]*on [^\n]{1,200} wrote:[ \t\r]*$"
_ANY = r"(?m)^[ \t]*>"


def normalised(x: Column) -> Column:
    low = F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.trim(F.regexp_replace(low, r"[ \t-\r]+", " "))


def level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, _QUOTE, 0), "[^>]", ""))


def without_quotes(text: Column) -> Column:
    """A message's own lines; a line that only says who wrote what is quoted goes too. Texts without quotes stay as they are."""
    own = F.filter(F.split(text, "\n"), lambda x: ~x.rlike(_QUOTE) & ~x.rlike(_ATTRIBUTION))
    return F.when(text.rlike(_ANY), F.trim(F.array_join(own, "\n"))).otherwise(text)


def bare_lines(text: Column) -> Column:
    """The normalised lines of a text that are not blank."""
    return F.filter(F.transform(F.split(text, "\n"), normalised), lambda x: x != "")


def passages(messages: DataFrame) -> DataFrame:
    """conv, turn, row, first (line), level, lines (how many are not blank), hash: the quoted passages of messages (conv, turn, row, body)."""
    lines = messages.where(F.col("body").rlike(_ANY)).select("conv", "turn", "row", F.posexplode(F.split("body", "\n")).alias("at", "line"))
    lines = lines.withColumn("level", level(F.col("line")))
    own = Window.partitionBy("conv", "turn", "row").orderBy("at")
    lines = lines.withColumn("new", F.coalesce((F.lag("level").over(own) != F.col("level")).cast("int"), F.lit(1)))
    lines = lines.withColumn("run", F.sum("new").over(own)).where("level > 0")
    bare = normalised(F.regexp_replace("line", _QUOTE, ""))
    runs = lines.groupBy("conv", "turn", "row", "run", "level").agg(F.min("at").alias("first"), F.sort_array(F.collect_list(F.struct("at", bare.alias("text")))).alias("part"))
    kept = F.filter(F.transform("part", lambda x: x["text"]), lambda x: x != "")
    runs = runs.withColumn("kept", kept).where(F.size("kept") > 0)
    return runs.select("conv", "turn", "row", "first", "level", F.size("kept").alias("lines"), F.sha2(F.array_join("kept", " "), 256).alias("hash"))


def originals(messages: DataFrame, lengths: DataFrame) -> DataFrame:
    """conv, turn, lines, hash: each message without its quotes, whole (lines 0) and by runs of as many lines as lengths (conv, lines) has."""
    own = messages.select("conv", "turn", bare_lines(without_quotes(F.col("body"))).alias("own")).where(F.size("own") > 0)
    wanted = lengths.groupBy("conv").agg(F.collect_set("lines").alias("wanted"))
    n = F.size("own")
    runs = own.join(wanted, "conv").withColumn("many", F.explode(F.concat(F.array(F.lit(0)), F.filter("wanted", lambda x: x <= n))))
    runs = runs.withColumn("at", F.explode(F.when(F.col("many") == 0, F.array(F.lit(1))).otherwise(F.sequence(F.lit(1), n - F.col("many") + 1))))
    text = F.array_join(F.slice("own", F.col("at"), F.when(F.col("many") == 0, n).otherwise(F.col("many"))), " ")
    return runs.select("conv", "turn", F.col("many").alias("lines"), F.sha2(text, 256).alias("hash")).distinct()


def roots(spark: SparkSession, replies: DataFrame, most: int = 64) -> DataFrame:
    """conv, turn, root of messages that reply to something (conv, turn, reply_to), by pointer jumping.

    A reply is later than what it replies to, so the jumps end: after k of them a message points 2^k replies back.
    """
    scratch = shared_dir(spark)
    now = written(spark, replies.select("conv", "turn", F.col("reply_to").alias("root")), f"{scratch}/0")
    for k in range(1, most):
        up = now.select(F.col("conv").alias("c"), F.col("turn").alias("t"), F.col("root").alias("further"))
        after = now.join(up, (F.col("conv") == F.col("c")) & (F.col("root") == F.col("t")), "left")
        after = written(spark, after.select("conv", "turn", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), f"{scratch}/{k}")
        now = after.select("conv", "turn", "root")
        if after.where("moved").isEmpty():
            return now
    raise RuntimeError("threads did not settle")


def link(chats: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per message: conv, turn, role, content, quote_depth, n_passages, n_linked, reply_to, order_thread.

    A null text is empty. A null conversation or turn has its quotes taken out but is linked with nothing. Rows that
    repeat conversation and turn share their links. Messages that are quoted only by themselves or by earlier ones are
    no originals. Other columns are not read. An empty table gives an empty result. order_thread is the first turn of the
    message's thread.
    """
    spark = chats.sparkSession
    messages = chats.select(chats[conv].alias("conv"), chats[turn].alias("turn"), chats[role].alias("role"), F.coalesce(chats[text], F.lit("")).alias("body"))
    known = messages.where("conv is not null and turn is not null").withColumn("row", F.xxhash64("body"))
    quoted = passages(known.select("conv", "turn", "row", "body").distinct())
    quoted = written(spark, quoted, f"{shared_dir(spark)}/quoted")
    index = originals(known, quoted.select("conv", "lines").distinct())
    none = [F.lit(None).cast(t).alias(c) for c, t in (("row", "long"), ("first", "int"), ("level", "int"))]
    rows = index.select("conv", "hash", "lines", "turn", F.lit(0).alias("kind"), *none)
    asked = quoted.withColumn("lines", F.explode(F.array(F.lit(0), F.col("lines"))))
    rows = rows.unionByName(asked.select("conv", "hash", "lines", "turn", F.lit(1).alias("kind"), "row", "first", "level"))
    # The quote of a turn sorts before an original of the same turn, so it sees earlier turns only.
    before = Window.partitionBy("conv", "hash", "lines").orderBy("turn", F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1)
    origin = F.last(F.when(F.col("kind") == 0, F.col("turn")), ignorenulls=True).over(before)
    found = rows.withColumn("origin", origin).where("kind = 1").groupBy("conv", "turn", "row", "first", "level").agg(F.max("origin").alias("origin"))
    best = F.min(F.when(F.col("origin").isNotNull(), F.struct("level", (-F.col("origin")).alias("o"))))
    found = found.groupBy("conv", "turn").agg(F.max("level").alias("depth"), F.count(F.lit(1)).alias("n"), F.count("origin").alias("linked"), (-best["o"]).alias("reply_to"))
    found = written(spark, found, f"{shared_dir(spark)}/found")
    threads = roots(spark, found.where("reply_to is not null"))
    found = found.join(threads, ["conv", "turn"], "left")
    found = found.select(F.col("conv").alias("c"), F.col("turn").alias("t"), "depth", "n", "linked", "reply_to", "root")
    out = messages.join(found, (F.col("conv") == F.col("c")) & (F.col("turn") == F.col("t")), "left")
    return out.select(
        "conv", "turn", "role", without_quotes(F.col("body")).alias("content"), F.coalesce("depth", F.lit(0)).cast("long").alias("quote_depth"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_passages"), F.coalesce("linked", F.lit(0)).cast("long").alias("n_linked"), "reply_to",
        F.coalesce("root", "turn").alias("order_thread"),
    )
