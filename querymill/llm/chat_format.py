"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: the turns before it are its context, its reply alone is
trainable. A conversation is written once as a string of turns,

    ### role: text</turn>

each ended by a line feed; an example is the part of it up to the end of a reply. Control strings inside roles and texts are
broken up by backslashes, reversibly, so that a marker is only ever a marker. All in DataFrame functions.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

HEAD, END = "### ", "</turn>\n"
TARGET = "assistant"


def escaped(text: Column) -> Column:
    r"""``\`` as ``\\``, and a ``\`` inside every ``</turn>`` and ``###``; a null is empty."""
    doubled = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(F.replace(doubled, F.lit("</turn>"), F.lit("<\\/turn>")), "#(?=##)", "#\\\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit(":"), F.lit("\\:"))


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns, formatted): each conversation of ``turns`` (conv_id, turn, role, text) in order of turn, as a whole.

    ``turns`` lists role, start and stop of its text in ``formatted``, in code points. Rows without a turn number come first; of rows with one number the
    order is that of role and text; repeated rows are repeated turns. Rows without a conversation are one conversation, without an id.
    Without rows there are none.
    """
    head = F.concat(F.lit(HEAD), _role(F.col("role")), F.lit(": "))
    pieces = turns.select("conv_id", "turn", "role", "text", head.alias("head"), escaped(F.col("text")).alias("body"))
    pieces = pieces.withColumn("piece", F.concat("head", "body", F.lit(END)))
    so_far = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    placed = pieces.withColumn("after", F.sum(F.length("piece")).over(so_far)).select(
        "conv_id", F.struct(
            "after", "piece", "role", (F.col("after") - F.length("body") - len(END)).cast("int").alias("start"), (F.col("after") - len(END)).cast("int").alias("stop"),
        ).alias("part"),
    )
    listed = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    return listed.select(
        "conv_id", F.transform("parts", lambda p: F.struct(p["role"].alias("role"), p["start"].alias("start"), p["stop"].alias("stop"))).alias("turns"),
        F.array_join("parts.piece", "").alias("formatted"),
    )


def examples(turns: DataFrame, target: str = TARGET) -> DataFrame:
    """(conv_id, example, text, loss_start, loss_end, last): one row for each turn of ``target``, numbered from 0, in order.

    ``text`` ends with the reply and its end marker; code points ``loss_start`` to ``loss_end`` of it (from 0, end not included) are trainable.
    Turns after the last reply are the context of no example; they come as a row with an empty span. ``last`` marks that row: of
    each conversation the one whose text is the whole of it.
    """
    whole = conversations(turns)
    replies = F.transform(F.filter("turns", lambda t: t["role"] == target), lambda t: F.struct(t["start"].alias("start"), t["stop"].alias("stop")))
    trailing = ~F.coalesce(F.element_at("turns", -1)["role"] == target, F.lit(False))
    length = F.length("formatted")
    spans = F.when(trailing, F.concat(replies, F.array(F.struct(length.alias("start"), length.alias("stop"))))).otherwise(replies)
    rows = whole.select("conv_id", "formatted", F.size(spans).alias("rows"), F.posexplode(spans).alias("example", "span"))
    stop = F.when(F.col("span.start") == F.length("formatted"), F.length("formatted")).otherwise(F.col("span.stop") + len(END))
    return rows.select(
        "conv_id", "example", F.substr("formatted", F.lit(1), stop).alias("text"),
        F.col("span.start").alias("loss_start"), F.col("span.stop").alias("loss_end"), (F.col("example") == F.col("rows") - 1).alias("last"),
    )


def turns_of(text: Column) -> Column:
    """(role, text) of every turn of a formatted string."""
    parts = F.slice(F.split(text, END), 1, F.greatest(F.size(F.split(text, END)) - 1, F.lit(0)))
    head = r"(?s)^### ((?:[^\\:]|\\.)*): "
    return F.transform(parts, lambda p: F.struct(
        unescaped(F.regexp_extract(p, head, 1)).alias("role"), unescaped(F.regexp_replace(p, head, "")).alias("text"),
    ))


def read_back(made: DataFrame) -> DataFrame:
    """Of each conversation, from its ``examples``: n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars.

    formatted_chars counts the code points of the conversation as written once, that is of its last row.
    """
    loss = unescaped(F.substr("text", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start")))
    said = turns_of(F.col("text"))
    digest = F.sha2(F.array_join(F.transform(said, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256)
    whole = F.when(F.col("last"), F.struct(F.size(said).cast("long").alias("n_turns"), digest.alias("turns_sha256"), F.length("text").cast("long").alias("formatted_chars")))
    rows = made.select("conv_id", "example", loss.alias("loss"), whole.alias("whole"))
    losses = F.array_join(F.array_sort("losses")["loss"], "")
    return rows.groupBy("conv_id").agg(F.max("whole").alias("whole"), F.collect_list(F.struct("example", "loss")).alias("losses")).select(
        "conv_id", "whole.n_turns", "whole.turns_sha256", F.length(losses).cast("long").alias("loss_chars"), F.sha2(losses, 256).alias("loss_sha256"), "whole.formatted_chars",
    )
