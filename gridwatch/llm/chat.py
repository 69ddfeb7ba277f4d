"""Chat formatting with a grammar round trip (operator 5).

Grammar of a formatted conversation, one after the other per turn::

    <|im_start|>ROLE\\nTEXT<|im_end|>\\n

The parser is deterministic: it splits at ``<|im_end|>``, expects each part to
begin with the only ``<|im_start|>`` in it, and takes the role up to the first
line end.  In texts, ``<``, one or more backslashes, ``|`` loses one
backslash; in roles, a backslash and a letter stand for one character.  A turn
is first rendered as it is and parsed on its own; one that does not come back
identical is escaped (every such sequence gains a backslash, which no text can
undo).  Whole conversations are then reparsed and compared with their source.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridwatch.llm.common import fresh

START, END = "<|im_start|>", "<|im_end|>\n"
TRAINED_ROLE = "assistant"


def escape_text(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\|", r"<\\$1|")


def unescape_text(c: Column) -> Column:
    return F.regexp_replace(c, r"<\\(\\*)\|", r"<$1|")


#: Role escapes: backslash first, so every backslash is followed by its code.
ROLE_CODES = (("\\", "\\s"), ("\n", "\\n"), ("\r", "\\r"), ("|", "\\p"))


def escape_role(c: Column) -> Column:
    for plain, code in ROLE_CODES:
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def unescape_role(c: Column) -> Column:
    for plain, code in reversed(ROLE_CODES):
        c = F.replace(c, F.lit(code), F.lit(plain))
    return c


def render_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(END))


def parse(formatted: Column) -> Column:
    """Array of (role, text) of a formatted conversation; null where it does
    not follow the grammar."""
    parts = F.split(F.concat(F.lit("\n"), formatted), r"<\|im_end\|>", -1)
    turns = F.slice(parts, F.lit(1), F.size(parts) - 1)
    good = (F.element_at(parts, -1) == "\n") & F.forall(
        turns, lambda t: t.startswith("\n" + START) & (F.locate(START, t, 3) == 0)
        & (F.locate("\n", t, 2) > 0))
    inner = F.transform(turns, lambda t: F.substr(t, F.lit(len(START) + 2)))
    return F.when(good, F.transform(inner, lambda t: F.struct(
        unescape_role(F.substring_index(t, "\n", 1)).alias("role"),
        unescape_text(F.substr(t, F.locate("\n", t, 1) + 1)).alias("text"))))


def _safe(turns: DataFrame, role: str, text: str) -> DataFrame:
    """``turns`` with role and text as they go into the output."""
    plain = parse(render_turn(F.col(role), F.col(text)))
    same = F.coalesce((F.size(plain) == 1) & (F.get(plain, F.lit(0))["role"] == F.col(role))
                      & (F.get(plain, F.lit(0))["text"] == F.col(text)), F.lit(False))
    return (turns.withColumn("__same", same)
            .withColumn("__role", F.when(F.col("__same"), F.col(role)).otherwise(escape_role(F.col(role))))
            .withColumn("__text", F.when(F.col("__same"), F.col(text)).otherwise(escape_text(F.col(text))))
            .drop("__same"))


def format_conversations(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                         text_col: str = "text", trained_role: str = TRAINED_ROLE) -> DataFrame:
    """One row per conversation: id, ``formatted``, ``loss_spans`` (begin,
    length: code points of ``formatted`` under the loss mask, one span per
    text of ``trained_role``; turn: its number, from 0), ``turns`` (parsed back)
    and ``round_trip``.

    Turns are ordered by turn number (null first), ties by role, then text.
    A null role or text counts as empty; a null id is a conversation.
    ``round_trip`` says that the reparsed turns equal the source; with these
    escapes it always holds.  Extra columns are left out; an empty table gives
    no rows.  A conversation is one output row, so its turns meet in one task;
    the work grows in proportion to its turns.
    """
    rows = df.select(F.col(id_col).alias("__id"), F.col(turn_col).alias("turn"),
                     F.coalesce(F.col(role_col), F.lit("")).alias("role"),
                     F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = _safe(rows, "role", "text")
    turn = F.struct("turn", "role", "text", "__role", "__text")
    by = rows.groupBy("__id").agg(F.sort_array(F.collect_list(turn)).alias("source"))
    # positions as running sums over the turns' rows, which stay where they are
    each = by.select("__id", F.posexplode("source").alias("nth", "t"))
    shown = render_turn(F.col("t.__role"), F.col("t.__text"))
    before = Window.partitionBy("__id").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.coalesce(F.sum("size").over(before), F.lit(0)) + 1 + len(START) + F.length("t.__role") + 1
    each = each.withColumn("shown", shown).withColumn("size", F.length("shown")).withColumn("begin", begin)
    span = F.struct(F.col("begin").cast("int").alias("begin"), F.length("t.__text").alias("length"), F.col("nth").alias("turn"))
    entry = F.struct("nth", "shown", F.struct(F.col("t.role"), F.col("t.text")).alias("turn"),
                     F.when(F.col("t.role") == trained_role, span).alias("span"))
    out = (each.groupBy("__id").agg(F.sort_array(F.collect_list(entry)).alias("all"))
           .select("__id", F.concat_ws("", F.col("all.shown")).alias("formatted"),
                   F.filter(F.col("all.span"), lambda s: s.isNotNull()).alias("loss_spans"), F.col("all.turn").alias("source")))
    out = out.withColumn("turns", parse(F.col("formatted")))
    name = fresh(id_col, ["formatted", "loss_spans", "turns", "round_trip"])
    return out.select(F.col("__id").alias(name), "formatted", "loss_spans", "turns",
                      F.coalesce(F.col("turns") == F.col("source"), F.lit(False)).alias("round_trip"))


def loss_texts(formatted: str = "formatted", spans: str = "loss_spans") -> Column:
    """The texts under the loss mask, unescaped: every span cut from its own
    turn of the formatted text, which is split once."""
    def cut_out(parts: Column) -> Column:
        def one(s: Column) -> Column:
            part = F.get(parts, s["turn"])
            # a part begins at the line end before it, its text behind the role's line
            return unescape_text(F.substr(part, F.locate("\n", part, 2) + 1, s["length"]))
        return F.transform(spans, one)

    parts = F.split(F.concat(F.lit("\n"), F.col(formatted)), r"<\|im_end\|>", -1)
    return F.element_at(F.transform(F.array(parts), cut_out), 1)


def digests(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Digest columns read back from the output of ``format_conversations``."""
    turns = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    loss = F.concat_ws("", loss_texts())
    return formatted.select(
        id_col, F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "round_trip")
