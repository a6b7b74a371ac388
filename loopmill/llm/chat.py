"""Chat formatting by perspective rotation: every participant of a dialogue in turn becomes the assistant.

DataFrame functions only. A dialogue is ranked by one global sort and prefix sums over its parts, and rendered
in chunks of a fixed number of turns, so that no task ever holds a whole dialogue.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loopmill.llm.common import materialize

CHUNK_TURNS = 64
#: Roles that speak in no turn of their own and are rendered under their own name.
CONTEXT_ROLES = ("system",)
UNKNOWN = "unknown"
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
_LOW = (1 << 33) - 1


def ranked_turns(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, role, text and rank (from 0) of each message in its dialogue, by turn, then role, then text.

    A null conv_id is a dialogue of its own; null turns come first; a null role is ``unknown``, a null text empty.
    """
    rows = conversations.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit(UNKNOWN)).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")
    )
    order = ["conv_id", "turn", "role", "text", "tie"]  # equal rows are told apart, to be dealt out
    ordered = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialize(ordered.select("conv_id", "role", "text", F.monotonically_increasing_id().alias("at")))
    part, inside = F.shiftrightunsigned("at", 33), F.col("at").bitwiseAND(F.lit(_LOW))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    # one row for each partition of the sort
    position = placed.withColumn("part", part).join(F.broadcast(parts), "part").withColumn("position", F.col("start") + inside)
    first = position.groupBy("conv_id").agg(F.min("position").alias("first")).withColumnRenamed("conv_id", "own")
    return position.join(first, F.col("conv_id").eqNullSafe(F.col("own"))).select("conv_id", "role", "text", (F.col("position") - F.col("first")).alias("rank"))


def _safe(text: Column) -> Column:
    """Marks of the template inside a text are broken up."""
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def _name(role: Column, speaker: Column, context: tuple[str, ...]) -> Column:
    return F.when(role == speaker, F.lit("assistant")).when(role.isin(*context), role).otherwise(F.concat(F.lit("user name="), F.translate(_safe(role), "\r\n\t ", "____")))


def rotate(
    conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", chunk_turns: int = CHUNK_TURNS, context: tuple[str, ...] = CONTEXT_ROLES
) -> DataFrame:
    """conv_id, speaker, chunk, turns, rendered, masks, own_turns: one row for each participant and chunk.

    In ``rendered`` the speaker is the assistant and the others are users with names; ``masks`` is an array of
    (start, length) in characters over what the speaker says, closing mark included: the parts to learn from.
    Dialogues of up to ``chunk_turns`` messages have chunk 0 alone; joined in order, chunks give the dialogue.
    A dialogue of context roles alone has no participant and no row. Other columns are not looked at.
    """
    turns = materialize(ranked_turns(conversations, conv_id, turn, role, text))
    people = turns.filter(~F.col("role").isin(*context)).select(F.col("conv_id").alias("own"), F.col("role").alias("speaker")).distinct()
    chunks = turns.groupBy("conv_id", F.floor(F.col("rank") / chunk_turns).alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("rank", "role", _safe(F.col("text")).alias("text")))).alias("messages"))
    views = chunks.join(people, F.col("conv_id").eqNullSafe(F.col("own")))
    speaker = F.col("speaker")
    parts = F.transform("messages", lambda m: F.struct(F.concat(F.lit(OPEN), _name(m["role"], speaker, context), F.lit("\n")).alias("head"), F.concat(m["text"], F.lit(CLOSE)).alias("said"), (m["role"] == speaker).alias("own")))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def step(a: Column, m: Column) -> Column:
        after_head = a["at"] + F.length(m["head"])
        span = F.array(F.struct(after_head.alias("start"), F.length(m["said"]).alias("length")))
        return F.struct((after_head + F.length(m["said"]) + 1).alias("at"), F.when(m["own"], F.concat(a["spans"], span)).otherwise(a["spans"]).alias("spans"))

    rendered = views.withColumn("parts", parts)
    return rendered.select(
        "conv_id",
        "speaker",
        "chunk",
        F.size("messages").cast("long").alias("turns"),
        F.array_join(F.transform("parts", lambda m: F.concat(m["head"], m["said"], F.lit("\n"))), "").alias("rendered"),
        F.aggregate("parts", begin, step, lambda a: a["spans"]).alias("masks"),
        F.size(F.filter("parts", lambda m: m["own"])).cast("long").alias("own_turns"),
    )
