"""Chat formatting with a round trip through its grammar, in DataFrame functions only.

    conversation := turn*
    turn         := "<s>" role form text "</s>"
    form         := "[INST]" (text as it is) | "[/INST]" (text escaped)

A turn is first rendered as it is and parsed again. Where the parser does not give the
source back, because the text or role holds a control string, the turn is escaped:
backslashes are doubled and a backslash is put inside every control string, so that none
is left. Unescaping drops a backslash and keeps what follows it. A turn that still came
back different would fail the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BEGIN, END, PLAIN, ESCAPED = "<s>", "</s>", "[INST]", "[/INST]"
CONTROL = (BEGIN, END, PLAIN, ESCAPED)


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for control in CONTROL:
        text = F.replace(text, F.lit(control), F.lit(f"{control[0]}\\{control[1:]}"))
    return text


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _render(role: Column, text: Column, form: str) -> Column:
    return F.concat(F.lit(BEGIN), role, F.lit(form), text, F.lit(END))


def parse(formatted: Column) -> Column:
    """Turns (role, text) of the rendered text, by splitting at the control strings."""
    pieces = F.split(formatted, r"</s>", -1)
    turns = F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0)))
    return F.transform(turns, _turn)


def _turn(piece: Column) -> Column:
    body = F.substr(piece, F.lit(len(BEGIN) + 1))
    plain, escaped = F.locate(PLAIN, body), F.locate(ESCAPED, body)
    is_plain = (plain > 0) & ((escaped == 0) | (plain < escaped))
    at = F.when(is_plain, plain).otherwise(escaped)
    role = F.substr(body, F.lit(1), at - 1)
    text = F.substr(body, at + F.when(is_plain, len(PLAIN)).otherwise(len(ESCAPED)))
    # Control strings stand between the parts only: a part that holds one is no part.
    free = ~F.concat(role, F.lit(" "), text).rlike(r"<s>|</s>|\[INST\]|\[/INST\]")
    return F.struct(
        F.when(free, F.when(is_plain, role).otherwise(unescape(role))).alias("role"),
        F.when(free, F.when(is_plain, text).otherwise(unescape(text))).alias("text"),
    )


def render_turn(role: Column, text: Column) -> Column:
    """A turn as it is if the parser gives it back, else escaped."""
    source = F.array(F.struct(role.alias("role"), text.alias("text")))
    plain, escaped = _render(role, text, PLAIN), _render(escape(role), escape(text), ESCAPED)
    failed = F.raise_error(F.lit("a turn does not survive its round trip")).cast("string")
    return F.when(parse(plain).eqNullSafe(source), plain).when(parse(escaped).eqNullSafe(source), escaped).otherwise(failed)


def format_chats(conversations: DataFrame) -> DataFrame:
    """One row per conv_id: ``formatted``, from rows of conv_id, turn, role, text.

    Turns are in order of turn, then role, then text, null turns first; repeated rows are
    repeated turns. Null roles and texts are empty; null conv_ids form one conversation.
    A conversation is one output text, so its turns meet in one row; they are rendered
    before they do. Other columns are not read; an empty table gives no rows.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    turns = conversations.select("conv_id", F.col("turn"), role.alias("role"), text.alias("text"))
    turns = turns.select("conv_id", F.struct("turn", "role", "text", render_turn(F.col("role"), F.col("text")).alias("shown")).alias("t"))
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return grouped.select("conv_id", F.array_join("t.shown", "").alias("formatted"))


def read_chats(formatted: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep`` and the turns read back: ``turns`` array of (role, text)."""
    return formatted.select(*keep, parse(F.col("formatted")).alias("turns"))


def loss_text(turns: Column, role: str = "assistant") -> Column:
    """All text under the loss mask: that of the turns of ``role``, in order."""
    return F.array_join(F.transform(F.filter(turns, lambda t: t["role"] == role), lambda t: t["text"]), "")
