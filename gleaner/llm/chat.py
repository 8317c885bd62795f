"""Event-sourced chat reconstruction and rendering, all on DataFrame functions.

A log has one row per event: conversation, message (any orderable key; messages render in its order), ``seq``
(any orderable value), ``kind``, ``role``, ``text``. Kinds:

* ``start``, ``edit`` and ``regenerate`` reset the message: what came before is void, their text begins anew;
* ``delta`` appends its text.

A message's text is its last reset's text followed by the later deltas in ``seq`` order. Events delivered twice
(equal in every column) count once. Unknown kinds raise no error and append nothing.

Nulls: null text is empty, null role is the empty role, a null conversation id is a conversation of its own.
A message without a reset keeps all its deltas. Ties in ``seq``: resets first, then by text. Events fold per
message, so a conversation that holds a large part of the log is spread over tasks; only its finished text, one
row by definition, meets in one place.

Template, one mark per turn: ``### role: text</turn>\\n``. In texts a backslash becomes ``\\b``, ``</turn>``
becomes ``\\e`` and ``###`` becomes ``\\h`` (roles: also ``:`` becomes ``\\c``), so no text can hold a mark and
every escape reads back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEAD, SEP, TAIL = "### ", ": ", "</turn>\n"
RESETS = ["start", "edit", "regenerate"]


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\b"))
    text = F.replace(text, F.lit("</turn>"), F.lit("\\e"))
    return F.replace(text, F.lit("###"), F.lit("\\h"))


def unescape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\h"), F.lit("###"))
    text = F.replace(text, F.lit("\\e"), F.lit("</turn>"))
    return F.replace(text, F.lit("\\b"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(":"), F.lit("\\c"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\c"), F.lit(":")))


def fold_events(events: DataFrame, conv: str = "conv_id", msg: str = "msg", seq: str = "seq") -> DataFrame:
    """One row per message: ``conv_id``, ``msg``, ``role`` (the latest given), ``text``."""
    reset = F.col("kind").isin(RESETS)
    step = F.when(reset, 0).when(F.col("kind") == "delta", 1)
    ev = events.select(F.col(conv).alias("conv_id"), F.col(msg).alias("msg"), F.col(seq).alias("seq"),
                       step.alias("step"), "role", F.coalesce("text", F.lit("")).alias("text"))
    folded = ev.groupBy("conv_id", "msg").agg(
        F.max(F.when(F.col("step") == 0, F.struct("seq", "text"))).alias("reset"),
        F.max_by("role", F.when(F.col("role").isNotNull(), F.struct("seq", "role"))).alias("role"),
        F.sort_array(F.collect_set(F.when(F.col("step") == 1, F.struct("seq", "text")))).alias("deltas"))
    later = F.filter("deltas", lambda d: F.col("reset").isNull() | (d["seq"] >= F.col("reset.seq")))
    text = F.concat(F.coalesce("reset.text", F.lit("")),
                    F.array_join(F.transform(later, lambda d: d["text"]), ""))
    return folded.select("conv_id", "msg", F.coalesce("role", F.lit("")).alias("role"), text.alias("text"))


def render(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: ``conv_id``, ``formatted`` and ``loss_spans``, one entry per turn in order:
    the place and length (in characters, from the turn's own mark) of what is under the loss; length 0: nothing."""
    head = F.concat(F.lit(HEAD), escape_role(F.col("role")), F.lit(SEP))
    body = escape(F.col("text"))
    turn = F.struct("msg", F.concat(head, body, F.lit(TAIL)).alias("segment"), F.length(head).alias("start"),
                    F.when(F.col("role") == loss_role, F.length(body)).otherwise(0).alias("length"))
    turns = messages.select("conv_id", turn.alias("turn"))
    per_conv = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    return per_conv.select(
        "conv_id", F.array_join(F.transform("turns", lambda t: t["segment"]), "").alias("formatted"),
        F.transform("turns", lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length"))).alias("loss_spans"))


def read_back(rendered: DataFrame) -> DataFrame:
    """What ``render`` wrote: ``turns`` (array of role and text) and ``loss_texts`` (array, in order)."""
    pieces = F.split("formatted", TAIL)
    cut = rendered.withColumn("_pieces", F.slice(pieces, 1, F.size(pieces) - 1))

    def turn(p: Column) -> Column:
        rest = F.substr(p, F.lit(len(HEAD) + 1))
        at = F.position(F.lit(SEP), rest)
        return F.struct(unescape_role(F.substr(rest, F.lit(1), at - 1)).alias("role"),
                        unescape(F.substr(rest, at + len(SEP))).alias("text"))

    masked = F.zip_with("_pieces", "loss_spans", lambda p, s: F.when(
        s["length"] > 0, unescape(F.substr(p, s["start"] + 1, s["length"]))))
    return cut.select("*", F.transform("_pieces", turn).alias("turns"),
                      F.filter(masked, lambda x: x.isNotNull()).alias("loss_texts")).drop("_pieces")


def digest(rendered: DataFrame) -> DataFrame:
    """Per conversation: counts and checksums of the turns and of the text under the loss, from the output."""
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return read_back(rendered).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


def events_from_turns(turns: DataFrame) -> DataFrame:
    """An event log whose fold gives back the rows of ``turns`` (conv_id, turn, role, text).

    Each row streams in as a start and two deltas; every third turn is first drafted and then regenerated, every
    fifth is sent unfinished and then edited. Rows that share a turn stay apart, ordered by role and text."""
    same = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    text = F.coalesce("text", F.lit(""))
    half = (F.length(text) / 2).cast("int")
    rows = turns.select("conv_id", "turn", "role", text.alias("text"), half.alias("half"),
                        F.row_number().over(same).alias("copy")).withColumn("msg", F.struct("turn", "copy"))
    first, rest = F.substr("text", F.lit(1), F.col("half")), F.substr("text", F.col("half") + 1)

    def event(step: int, kind: str, body: Column, when: Column) -> Column:
        return F.when(when, F.struct(F.lit(step).alias("step"), F.lit(kind).alias("kind"), body.alias("text")))

    always, drafted = F.lit(True), F.pmod("turn", F.lit(3)) == 1
    edited = (F.pmod("turn", F.lit(5)) == 2) & ~drafted
    steps = F.array(event(0, "start", F.lit(""), always), event(1, "delta", first, always),
                    event(2, "regenerate", F.lit(""), drafted), event(3, "delta", first, drafted),
                    event(4, "delta", rest, ~edited | edited.isNull()), event(5, "edit", F.col("text"), edited))
    out = rows.select("conv_id", "msg", "role", F.explode(F.filter(steps, lambda e: e.isNotNull())).alias("e"))
    return out.select("conv_id", "msg", F.struct("msg", "e.step").alias("seq"), "e.kind", "role", "e.text")
