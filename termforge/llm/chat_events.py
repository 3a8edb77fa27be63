"""Chat transcripts rebuilt from an event log.

An event is (conv_id, seq, msg, kind, role, text). Events of a conversation are folded in
the order of ``seq``:

* ``open`` starts message ``msg`` of ``role``, with ``text`` as its first piece;
* ``delta`` appends a streamed piece;
* ``edit`` replaces what the message says so far;
* ``regenerate`` discards it and waits for new deltas.

So a message says what its last edit said, or nothing if a regeneration came later, and then all
later pieces in order. Messages are ordered by number and rendered with a
role header and an end mark each.

The fold needs no Python: an array of a message's events is sorted, cut at the last edit or
regeneration and joined. One shuffle by conversation serves all steps.

Defined results: an event that repeats (conv_id, seq) is one event, the one with the least
(msg, kind, role, text); events without conv_id, seq, msg or kind, and of other kinds, are ignored; a null
text is empty; a message without ``open`` has the role ``UNKNOWN_ROLE``; of several the last
one names the role; a message that says nothing in the end is kept, empty; a message may have any number of
events, of any length. An empty log gives no conversations. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termforge.llm.common import table

HEADER, MIDDLE, END, UNKNOWN_ROLE = "<|im_start|>", "\n", "<|im_end|>\n", "unknown"
KINDS = ("open", "delta", "edit", "regenerate")
#: Characters in a streamed piece of the log that ``as_events`` writes.
PIECE = 40


def final_messages(events: DataFrame) -> DataFrame:
    """(conv_id, msg, role, text): what each message says after all its events."""
    known = events.select(
        "conv_id", F.col("seq").cast("bigint").alias("seq"), F.col("msg").cast("bigint").alias("msg"),
        F.col("kind").cast("string").alias("kind"), F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).where(F.col("kind").isin(*KINDS) & F.expr("conv_id IS NOT NULL AND seq IS NOT NULL AND msg IS NOT NULL"))
    event = F.min(F.struct("msg", "kind", "role", "text")).alias("e")
    once = known.repartition("conv_id").groupBy("conv_id", "seq").agg(event).select("conv_id", "seq", "e.*")
    log = once.groupBy("conv_id", "msg").agg(F.array_sort(F.collect_list(F.struct("seq", "kind", "role", "text"))).alias("log"))
    since = F.array_max(F.transform(F.filter("log", lambda e: e["kind"].isin("edit", "regenerate")), lambda e: e["seq"]))
    said = F.filter("log", lambda e: (F.col("since").isNull() | (e["seq"] >= F.col("since"))) & (e["kind"] != "regenerate"))
    roles = F.transform(F.filter("log", lambda e: (e["kind"] == "open") & e["role"].isNotNull()), lambda e: e["role"])
    return log.withColumn("since", since).select(
        "conv_id", "msg", F.coalesce(F.try_element_at(roles, F.lit(-1)), F.lit(UNKNOWN_ROLE)).alias("role"),
        F.array_join(F.transform(said, lambda e: e["text"]), "").alias("text"),
    )


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, messages, rendered): each conversation as one string."""
    line = F.concat(F.lit(HEADER), "role", F.lit(MIDDLE), "text", F.lit(END))
    lines = messages.select("conv_id", F.struct("msg", line.alias("line")).alias("m")).groupBy("conv_id").agg(F.array_sort(F.collect_list("m")).alias("m"))
    return lines.select("conv_id", F.size("m").cast("bigint").alias("messages"), F.array_join(F.transform("m", lambda m: m["line"]), "").alias("rendered"))


def reconstruct(events: DataFrame) -> DataFrame:
    """(conv_id, messages, rendered) from an event log."""
    return render(final_messages(events))


def as_events(conversations: DataFrame, piece: int = PIECE) -> DataFrame:
    """The log of a client that streamed ``conversations``.

    Users' turns come whole and, every third time, misspelt at first and then edited.
    Assistants' turns are streamed in pieces; every third one is broken off and
    regenerated. Every seventh event is delivered twice. Rows without conv_id or turn are left out.
    Messages are numbered by turn, role and text, so different rows of a turn are
    messages of their own; rows equal in all four columns are one.
    """
    turns = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.col("role").cast("string").alias("role"), F.coalesce("text", F.lit("")).alias("text")
    ).where("conv_id IS NOT NULL AND turn IS NOT NULL")
    turns = turns.withColumn("msg", F.dense_rank().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("bigint"))
    again = F.expr("pmod(conv_id + turn, 3) = 0")
    kind = lambda k, t: F.struct(F.lit(k).alias("kind"), t.alias("text"))
    text, cut = F.col("text"), F.expr("substring(text, 1, length(text) div 2)")
    pieces = F.expr(f"transform(sequence(0, greatest(0, length(text) - 1) div {piece}), k -> substring(text, k * {piece} + 1, {piece}))")
    deltas = F.transform(pieces, lambda t: kind("delta", t))
    opened = F.array(kind("open", F.lit("")))
    whole = F.when(again, F.array(kind("open", F.reverse(text)), kind("edit", text))).otherwise(F.array(kind("open", text)))
    streamed = F.when(again, F.concat(opened, F.array(kind("delta", cut), kind("regenerate", F.lit(""))), deltas)).otherwise(F.concat(opened, deltas))
    steps = turns.select("conv_id", "msg", "role", F.posexplode(F.when(F.col("role") == "assistant", streamed).otherwise(whole)).alias("k", "e"))
    log = steps.select("conv_id", (F.col("msg") * (1 << 32) + F.col("k")).alias("seq"), "msg", "e.kind", "role", "e.text")
    return log.withColumn("times", F.explode(F.when(F.expr("pmod(seq, 7) = 0"), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("times")


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, logged as events and rebuilt from these."""
    return reconstruct(as_events(table(spark, sf_dir, "conversations")))


ORACLE_OP9 = f"""
SELECT conv_id, count(*) AS messages,
       string_agg('{HEADER}' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn) AS rendered
FROM conversations GROUP BY conv_id
"""
