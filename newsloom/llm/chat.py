"""Chat formatting by event-sourced reconstruction.

A log holds events (conv_id, seq, event, msg, role, text). It is partitioned by
conversation and sorted by seq; streamed deltas, edits and regenerations fold into final
messages, which a template renders.

Events: ``message`` and ``edit`` set a message's text, ``delta`` appends to it,
``regenerate`` sets it and drops the messages after it (in msg order) that were last
touched before; ``delete`` drops the message.

One exchange, by conversation, serves all steps, and every step is a DataFrame function.
A rendered conversation is one row, so a conversation has to fit a row (2 GB); its
messages are folded by windows, which spill, before they meet in that row.

Defined cases: null texts and roles are empty; ties in seq are ordered by event, role and
text; a message with no setting event starts empty; an empty log gives no rows; the key
may be null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TURN, END = "<|turn|>", "<|end|>"
#: What follows the first character of a control string; ``<`` or ``[`` comes first. The
#: template's own markers and, so that a text can't open a turn in other templates
#: either, the usual ones of sentence and instruction.
_REST = r"\||/?s>|/?INST\]"


def escape(text: Column) -> Column:
    r"""Put one ``\`` after the first character of whatever reads like a control string.

    Backslashes already there are kept and one is added, so ``unescape`` undoes it exactly.
    """
    return F.regexp_replace(text, rf"([<\[])(\\*)(?={_REST})", r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*)(?={_REST})", "$1$2")


def _role(role: Column) -> Column:
    r"""A role in one line: ``\`` and line ends are written ``\\`` and ``\n``."""
    return F.replace(F.replace(escape(role), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def _unrole(role: Column) -> Column:
    halves = F.transform(F.split(role, r"\\\\"), lambda x: F.replace(x, F.lit("\\n"), F.lit("\n")))
    return unescape(F.array_join(halves, "\\"))


def fold_events(log: DataFrame) -> DataFrame:
    """(conv_id, msg, role, text): the final messages of every conversation."""
    setting = F.col("event").isin("message", "edit", "regenerate", "delete")
    order = W.partitionBy("conv_id", "msg").orderBy("seq", "event", "role", "text")
    earlier = W.partitionBy("conv_id").orderBy("msg").rowsBetween(W.unboundedPreceding, -1)
    folded = (
        log.repartition("conv_id")
        .select("conv_id", "msg", "seq", "event", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
        .withColumn("n", F.row_number().over(order))
        .withColumn("epoch", F.sum(F.when(setting, 1).otherwise(0)).over(order.rowsBetween(W.unboundedPreceding, 0)))
        .withColumn("last_epoch", F.max("epoch").over(W.partitionBy("conv_id", "msg")))
        .groupBy("conv_id", "msg")
        .agg(
            F.max("seq").alias("last_seq"),
            F.max(F.when(F.col("event") == "regenerate", F.col("seq"))).alias("regenerated"),
            F.max_by("role", F.when(F.col("role") != "", F.col("n"))).alias("role"),
            F.max_by("event", F.when(setting, F.col("n"))).alias("last_set"),
            F.array_sort(
                F.collect_list(F.when(F.col("epoch") == F.col("last_epoch"), F.struct("n", "text")))
            ).alias("pieces"),
        )
    )
    kept = folded.withColumn("cut", F.max("regenerated").over(earlier)).where(
        (F.coalesce("last_set", F.lit("")) != "delete") & (F.col("cut").isNull() | (F.col("last_seq") > F.col("cut")))
    )
    return kept.select(
        "conv_id", "msg", F.coalesce("role", F.lit("")).alias("role"),
        F.array_join(F.transform("pieces", lambda p: p["text"]), "").alias("text"),
    )


def render(messages: DataFrame, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, formatted, segments): one row per conversation.

    ``segments`` (struct of text and loss) joined are ``formatted``; those under loss hold
    the escaped texts of the trained roles and nothing else.
    """
    turns = (
        messages.groupBy("conv_id")
        .agg(F.array_sort(F.collect_list(F.struct("msg", "role", "text"))).alias("turns"))
        .select("conv_id", "turns")
    )

    def pieces(t: Column) -> Column:
        def piece(text: Column, loss: Column) -> Column:
            return F.struct(text.alias("text"), loss.alias("loss"))

        return F.array(
            piece(F.concat(F.lit(TURN), _role(t["role"]), F.lit("\n")), F.lit(False)),
            piece(escape(t["text"]), t["role"].isin(*trained)),
            piece(F.lit(END + "\n"), F.lit(False)),
        )

    cut = turns.select("conv_id", F.flatten(F.transform("turns", pieces)).alias("segments"))
    return cut.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def parse(formatted: Column) -> Column:
    """The turns (struct of role and text) read back from a rendered conversation."""
    raw = F.filter(F.split(formatted, r"<\|turn\|>"), lambda x: x != "")

    def turn(x: Column) -> Column:
        at = F.locate("\n", x)
        body = F.substr(x, at + 1, F.length(x) - at - F.lit(len(END) + 1))
        return F.struct(_unrole(F.substr(x, F.lit(1), at - 1)).alias("role"), unescape(body).alias("text"))

    return F.transform(raw, turn)


def as_log(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A table of finished turns as a log: every row is its own message, in turn order."""
    rows = conversations.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text")
    ).repartition("conv_id")
    seq = F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    return rows.select("conv_id", seq.alias("seq"), F.lit("message").alias("event"), seq.alias("msg"), "role", "text")


def format_report(log: DataFrame) -> DataFrame:
    """What reads back from each rendered conversation, as counts and digests."""
    out = render(fold_events(log)).withColumn("turns", parse(F.col("formatted")))
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"]))
    return (
        out.withColumn("loss_text", F.array_join(loss, ""))
        .select(
            "conv_id",
            F.size("turns").cast("long").alias("n_turns"),
            F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
            F.length("loss_text").cast("long").alias("loss_chars"),
            F.sha2("loss_text", 256).alias("loss_sha256"),
            F.length("formatted").cast("long").alias("formatted_chars"),
        )
    )
