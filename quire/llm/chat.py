"""Multi-party perspective rotation, in DataFrame operations alone.

For every participant of a conversation the dialogue is rendered once with that
speaker as assistant and all others as named users. A rendered dialogue is a
sequence of turn rows, each with its text, its place in the dialogue's string and
its loss mask (the assistant's content counts, everything else doesn't), so that
a conversation of any length never sits in one row or one task. ``joined`` makes
whole strings of it where conversations are known to be short.

Places come from sums of lengths: per chunk of ``chunk`` turn numbers first, then
inside the chunk; turns without a number are in the first one, so a conversation of
millions of them sorts them in one task. Turns of a conversation are ordered by turn,
null first, then by role, null first, and text.

The marks that open and close a turn can't be forged: in names and contents a ``<|``
gets a space between its signs, and so does a ``|>`` in names.

Edge cases: a null role is a speaker of its own, shown as "unknown" and told from a
role of that name by ``anonymous``; null and empty texts render as empty content; a null conversation id is one conversation;
repeated rows are repeated turns; system turns are context for everyone and no
perspective, unless ``narrators`` is empty; a conversation of narrators alone
gives no rows; an empty table gives an empty table; extra columns are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OPEN, MID, CLOSE = "<|", "|>\n", "<|end|>\n"


def rotate(turns: DataFrame, narrators: tuple[str, ...] = ("system",), chunk: int = 4096, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, perspective, anonymous, turn, speaker, tag, rendered, char_start, char_end, content_start, content_end, loss).

    ``rendered`` is the turn's piece of the dialogue string, [char_start, char_end) its place there and
    [content_start, content_end) that of its content; loss tells whether the content is trained on, and
    ``anonymous`` whether the perspective is that of a null role.
    """
    t = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"), F.coalesce(F.col(role), F.lit("unknown")).alias("speaker"), F.coalesce(F.col(text), F.lit("")).alias("content"))
    t = t.withColumn("content", F.replace("content", F.lit("<|"), F.lit("< |"))).withColumn("content_chars", F.length("content"))
    cast = t.select("conv_id", F.col("role").alias("_r")).distinct()
    cast = cast.where(F.col("_r").isNull() | ~F.col("_r").isin(*narrators)) if narrators else cast
    c = cast.select(F.col("conv_id").alias("_c"), "_r", F.coalesce("_r", F.lit("unknown")).alias("perspective"), F.col("_r").isNull().alias("anonymous"))
    rows = t.join(c, F.col("conv_id").eqNullSafe(F.col("_c"))).drop("_c")
    mine = F.col("role").eqNullSafe(F.col("_r"))
    shown = F.replace(F.replace("speaker", F.lit("<|"), F.lit("< |")), F.lit("|>"), F.lit("| >"))
    tag = F.when(mine, "assistant").when(F.coalesce(F.col("role").isin(*narrators), F.lit(False)) if narrators else F.lit(False), shown).otherwise(F.concat(F.lit("user name="), shown))
    head = F.length(F.concat(F.lit(OPEN), "tag", F.lit(MID)))
    rows = rows.withColumn("tag", tag).withColumn("head", head).withColumn("chars", F.col("head") + F.col("content_chars") + len(CLOSE)).withColumn("chunk", F.floor(F.coalesce("turn", F.lit(0)) / chunk))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id", "perspective", "anonymous").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = rows.groupBy("conv_id", "perspective", "anonymous", "chunk").agg(F.sum("chars").alias("n")).withColumn("base", before)
    sums = sums.select(F.col("conv_id").alias("_c"), F.col("perspective").alias("_p"), F.col("anonymous").alias("_a"), F.col("chunk").alias("_k"), "base")
    inner = F.coalesce(F.sum("chars").over(Window.partitionBy("conv_id", "perspective", "anonymous", "chunk").orderBy("turn", "role", "content").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("inner", inner).join(sums, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("perspective") == F.col("_p")) & (F.col("anonymous") == F.col("_a")) & (F.col("chunk") == F.col("_k")))
    start = (F.col("base") + F.col("inner")).cast("long")
    return rows.select(
        "conv_id", "perspective", "anonymous", "turn", "speaker", "tag", F.concat(F.lit(OPEN), "tag", F.lit(MID), "content", F.lit(CLOSE)).alias("rendered"),
        start.alias("char_start"), (start + F.col("chars")).alias("char_end"), (start + F.col("head")).alias("content_start"), (start + F.col("head") + F.col("content_chars")).alias("content_end"), mine.alias("loss"),
    )


def joined(rows: DataFrame) -> DataFrame:
    """(conv_id, perspective, anonymous, dialogue, masks): whole strings and their trained intervals; for short conversations."""
    part = F.sort_array(F.collect_list(F.struct("char_start", "rendered", "loss", "content_start", "content_end")))
    by = rows.groupBy("conv_id", "perspective", "anonymous").agg(part.alias("p"))
    masks = F.transform(F.filter("p", lambda x: x.loss), lambda x: F.struct(x.content_start.alias("from"), x.content_end.alias("to")))
    return by.select("conv_id", "perspective", "anonymous", F.array_join(F.transform("p", lambda x: x.rendered), "").alias("dialogue"), masks.alias("masks"))
