"""Chat formatting: a finite-state machine checks the order of roles, a declarative template makes text segments with loss flags.

Each turn becomes an opening mark, its escaped text and a closing mark.  Control strings inside texts are broken up
reversibly: a backslash becomes backslash-b, and backslash-e goes after the first character of a control string, so a
reader can find the turns again by the marks alone.  DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Mark:
    """Opening and closing mark of a role, and whether its text is learned from."""

    open: str
    close: str
    loss: bool = False


TEMPLATE = {
    "system": Mark("<<SYS>>\n", "\n<</SYS>>\n\n"),
    "user": Mark("[INST] ", " [/INST]"),
    "assistant": Mark("<s>", "</s>", loss=True),
}
#: Any other role: <|role|> text <|end|>, never learned from.
OTHER = Mark("<|", "<|end|>")
CONTROL = ("<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<s>", "</s>", "<|", "|>")
#: state and role -> state; a conversation is valid when it ends in one of the last states.
TURNS = {("start", "system"): "system", ("start", "user"): "user", ("system", "user"): "user", ("user", "assistant"): "assistant", ("assistant", "user"): "user"}
LAST = ("assistant",)


def escape(c: Column) -> Column:
    c = F.replace(c, F.lit("\\"), F.lit("\\b"))
    for s in CONTROL:
        c = F.replace(c, F.lit(s), F.lit(f"{s[0]}\\e{s[1:]}"))
    return c


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\e"), F.lit("")), F.lit("\\b"), F.lit("\\"))


def _by_role(role: Column, pick, other: Column) -> Column:
    out = other
    for name, mark in TEMPLATE.items():
        out = F.when(role == name, F.lit(pick(mark))).otherwise(out)
    return out


def _quoted(s: str) -> str:
    return "\\Q" + s + "\\E"


#: Groups: opening mark, other role, text, closing mark.
TURN = (
    "(?s)(" + "|".join(_quoted(m.open) for m in TEMPLATE.values()) + "|" + _quoted("<|") + "(.*?)" + _quoted("|>") + ")(.*?)("
    + "|".join(_quoted(m.close) for m in [*TEMPLATE.values(), OTHER]) + ")"
)


def format_chats(rows: DataFrame) -> DataFrame:
    """conv_id, valid, segments (text, loss), formatted of conversations (conv_id, turn, role, text).

    Turns are taken in the order of turn, then role and escaped text (nulls first).  A null text counts as empty, a null role as
    one with an empty name; repeated turns stay.  A conversation that breaks the turn order is formatted all the same and
    not valid.  Rows with a null conv_id form one conversation.  Extra columns are ignored; an empty table gives an empty result.
    A conversation is one training text and so one row: turns are escaped before they meet.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    opened = _by_role(role, lambda m: m.open, F.concat(F.lit(OTHER.open), escape(role), F.lit("|>")))
    turn = rows.select(
        "conv_id",
        F.struct("turn", role.alias("role"), escape(text).alias("body"), opened.alias("open"), _by_role(role, lambda m: m.close, F.lit(OTHER.close)).alias("close"), _by_role(role, lambda m: m.loss, F.lit(False)).alias("loss")).alias("t"),
    )
    conv = turn.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    step = F.create_map(*[F.lit(x) for (s, r), to in TURNS.items() for x in (f"{s} {r}", to)])
    end = F.aggregate("ts", F.lit("start"), lambda s, t: F.coalesce(F.try_element_at(step, F.concat(s, F.lit(" "), t["role"])), F.lit("broken")))
    piece = lambda c, loss: F.struct(c.alias("text"), loss.alias("loss"))
    segments = F.flatten(F.transform("ts", lambda t: F.array(piece(t["open"], F.lit(False)), piece(t["body"], t["loss"]), piece(t["close"], F.lit(False)))))
    return conv.select("conv_id", end.isin(*LAST).alias("valid"), segments.alias("segments")).withColumn("formatted", F.array_join(F.col("segments.text"), ""))


def read_back(chats: DataFrame) -> DataFrame:
    """conv_id, turns (role, text), loss_text of formatted conversations, and their valid and formatted: turns by the marks, loss text by the flags."""
    of = lambda g: F.regexp_extract_all("formatted", F.lit(TURN), g)
    names = {m.open: r for r, m in TEMPLATE.items()}

    def role(mark: Column, other: Column) -> Column:
        out = unescape(other)
        for opened, r in names.items():
            out = F.when(mark == opened, F.lit(r)).otherwise(out)
        return out

    turns = F.transform(F.arrays_zip(of(1).alias("a"), of(2).alias("b"), of(3).alias("c")), lambda x: F.struct(role(x["a"], x["b"]).alias("role"), unescape(x["c"]).alias("text")))
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    return chats.select("conv_id", turns.alias("turns"), loss.alias("loss_text"), "valid", "formatted")
