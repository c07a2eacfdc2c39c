"""Chat formatting (operator 5): a finite-state machine over roles and a declarative template, in DataFrame functions.

The template names, for each role, its header, whether its text counts for the loss, and the machine's moves. Texts
are escaped so that no control string occurs in them; reading a formatted conversation back gives every role and
text exactly.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """``opening`` + header + ``after_role`` + text + ``closing`` for each turn."""

    opening: str = "### "
    after_role: str = ": "
    closing: str = "</turn>\n"
    headers: tuple[tuple[str, str], ...] = (("system", "System"), ("user", "User"), ("assistant", "Assistant"))
    loss: tuple[str, ...] = ("assistant",)
    #: (state, role) → state; a move that is not listed leads to "invalid", which no move leaves.
    moves: tuple[tuple[str, str, str], ...] = (
        ("start", "system", "ready"), ("start", "user", "asked"), ("ready", "user", "asked"), ("asked", "assistant", "answered"), ("answered", "user", "asked"),
    )
    accepting: tuple[str, ...] = ("answered",)

    def __post_init__(self) -> None:
        """A template that could not be read back is refused."""
        controls = [self.opening.strip(), self.closing.strip()]
        if not all(controls) or not self.after_role or any("\\" in c for c in (*controls, self.after_role)):
            raise ValueError("opening and closing must have signs other than white space, after_role any, and none a backslash")
        if controls[0] in controls[1] or controls[1] in controls[0]:
            raise ValueError("opening and closing must not hold each other")
        shown = [h for _, h in self.headers]
        if len(set(shown)) < len(shown) or any(self.after_role in h or h[:1] in ("?", "=", "") for h in shown):
            raise ValueError("headers must differ, must not hold after_role and must not begin with ? or =")

    @property
    def escapes(self) -> tuple[tuple[str, str], ...]:
        """Control string → what stands for it in a text; the backslash itself first, and the last only in roles."""
        return (("\\", "\\\\"), (self.opening.strip(), "\\h"), (self.closing.strip(), "\\e"), (self.after_role, "\\c"))


TEMPLATE = Template()


def escaped(text: Column, t: Template = TEMPLATE, role: bool = False) -> Column:
    for plain, code in t.escapes if role else t.escapes[:3]:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column, t: Template = TEMPLATE) -> Column:
    """Inverse of ``escaped``: codes are read between doubled backslashes only."""

    def codes(part: Column) -> Column:
        for plain, code in t.escapes[1:]:
            part = F.replace(part, F.lit(code), F.lit(plain))
        return part

    return F.array_join(F.transform(F.split(text, r"\\\\", -1), codes), "\\")


def _header(role: Column, t: Template) -> Column:
    """Known roles by their header; any other, null too, by a marked escaped name, so that each reads back."""
    out = F.when(role.isNull(), F.lit("?"))
    for name, shown in t.headers:
        out = out.when(role == name, F.lit(shown))
    return out.otherwise(F.concat(F.lit("="), escaped(role, t, role=True)))


def _role(header: Column, t: Template) -> Column:
    out = F.when(header == "?", F.lit(None).cast("string"))
    for name, shown in t.headers:
        out = out.when(header == shown, F.lit(name))
    return out.otherwise(unescaped(F.substring(header, 2, 2147483647), t))


def format_chats(df: DataFrame, template: Template = TEMPLATE, conv_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text") -> DataFrame:
    """One row for each conversation: conv_id, valid, state, segments (text, loss), formatted.

    Turns are ordered by number, then role, then text; a repeated row is a turn of its own. A null text is empty; a
    null or unknown role is written under a marked header and makes the turn order invalid. Conversations of invalid
    order are formatted as well, with ``valid`` false. Rows without conv_id form one conversation. An empty table gives
    no rows. A conversation is one training record, so its turns, very long texts too, meet in one task whatever the method.
    """
    t = template
    turns = F.sort_array(F.collect_list(F.struct(F.col(turn_column).alias("turn"), F.col(role_column).alias("role"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))))
    # The exchange moves a row for each turn; partial aggregation joins turns of one task.
    grouped = df.groupBy(F.col(conv_column).alias("conv_id")).agg(turns.alias("turns"))
    moves = F.create_map(*(F.lit(x) for a, r, b in t.moves for x in (f"{a}|{r}", b)))
    state = F.aggregate("turns", F.lit("start"), lambda s, x: F.coalesce(F.try_element_at(moves, F.concat_ws("|", s, F.coalesce(x["role"], F.lit("?")))), F.lit("invalid")))
    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    segments = F.flatten(F.transform("turns", lambda x: F.array(
        segment(F.concat(F.lit(t.opening), _header(x["role"], t), F.lit(t.after_role)), F.lit(False)),
        segment(escaped(x["text"], t), F.coalesce(x["role"].isin(*t.loss), F.lit(False))),
        segment(F.lit(t.closing), F.lit(False)),
    )))
    out = grouped.select("conv_id", state.alias("state"), segments.alias("segments"))
    return out.select("conv_id", F.col("state").isin(*t.accepting).alias("valid"), "state", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"))


def read_back(formatted: Column, template: Template = TEMPLATE) -> Column:
    """array<struct<role, text>> of a formatted conversation, from the string alone."""
    t = template
    parts = F.split(formatted, "\\Q" + t.closing + "\\E", -1)
    bodies = F.slice(parts, F.lit(1), F.size(parts) - 1)

    def turn(body: Column) -> Column:
        body = F.substring(body, len(t.opening) + 1, 2147483647)
        at = F.instr(body, t.after_role)
        return F.struct(_role(F.substring(body, F.lit(1), at - 1), t).alias("role"), unescaped(F.substring(body, at + len(t.after_role), F.lit(2147483647)), t).alias("text"))

    return F.transform(bodies, turn)


def loss_text(segments: Column, template: Template = TEMPLATE) -> Column:
    """All text under the loss mask, unescaped, in order, with nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"], template)), "")
