"""Chat formatting by a finite-state machine over roles, in DataFrame functions only.

A declarative template says how each role's turn begins and ends, which turns count for the loss, and which role may follow
which. Control strings inside texts are escaped reversibly, so the formatted text can be read back without doubt.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Turn:
    begin: str
    end: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """turns by role; any other role is written with its name after other. Transitions: (state, role) to state."""

    start: str = "<s>"
    turns: dict[str, Turn] = field(default_factory=lambda: {"system": Turn("[SYS] ", " [/SYS]"), "user": Turn("[INST] ", " [/INST]"), "assistant": Turn("[OUT] ", "</s>", True)})
    other: Turn = Turn("[ROLE ", " [/ROLE]")
    transitions: dict[tuple[str, str], str] = field(default_factory=lambda: {("begin", "system"): "system", ("begin", "user"): "user", ("system", "user"): "user", ("user", "assistant"): "assistant", ("assistant", "user"): "user"})
    accepting: tuple[str, ...] = ("assistant",)

    def controls(self) -> list[str]:
        """What a text must not contain as it is: every marker without its outer blanks."""
        marks = [self.start, self.other.begin, self.other.end, *(x for t in self.turns.values() for x in (t.begin, t.end))]
        return sorted({m.strip() for m in marks if m.strip()})


TEMPLATE = Template()
#: Codes after a backslash, by which the first character of a control string is replaced.
CODES = {"<": "l", "[": "b", "]": "c"}


def escape(text: Column, template: Template = TEMPLATE) -> Column:
    """A backslash is doubled; the first character of each control string becomes a backslash and its code."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in template.controls():
        out = F.replace(out, F.lit(c), F.lit("\\" + CODES[c[0]] + c[1:]))
    return out


def unescape(text: Column) -> Column:
    def codes(part: Column) -> Column:
        for char, code in CODES.items():
            part = F.replace(part, F.lit("\\" + code), F.lit(char))
        return part

    return F.array_join(F.transform(F.split(text, r"\\\\"), codes), "\\")


def _role_name(role: Column) -> Column:
    out = F.replace(role, F.lit("\\"), F.lit("\\\\"))
    for char, code in CODES.items():
        out = F.replace(out, F.lit(char), F.lit("\\" + code))
    return out


def _segments(turn: Column, template: Template) -> Column:
    """Three segments of a turn: begin, text, end; only the text of a role with loss is flagged."""
    role, text = turn["role"], escape(turn["text"], template)
    seg = lambda x, loss: F.struct(x.alias("text"), F.lit(loss).alias("loss"))
    out = F.array(seg(F.concat(F.lit(template.other.begin), _role_name(role), F.lit("] ")), False), seg(text, False), seg(F.lit(template.other.end), False))
    for name, t in template.turns.items():
        out = F.when(role == name, F.array(seg(F.lit(t.begin), False), seg(text, t.loss), seg(F.lit(t.end), False))).otherwise(out)
    return out


def _state(turns: Column, template: Template) -> Column:
    pairs = [x for (state, role), after in template.transitions.items() for x in (F.lit(f"{state}\n{role}"), F.lit(after))]
    table = F.create_map(*pairs)
    return F.aggregate(turns, F.lit("begin"), lambda s, t: F.coalesce(F.try_element_at(table, F.concat(s, F.lit("\n"), t["role"])), F.lit("error")))


def format_chats(conversations: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """conv_id, valid, segments (text, loss) in order: one row per conversation; their texts together are the formatted chat.

    conversations: conv_id, turn, role, text. Turns go by number; ties, repeated and null numbers by role and text; a null role
    or text is empty. A conversation whose roles the machine refuses is formatted as well, with valid false. A null
    conv_id is a conversation of its own. Extra columns are left behind. The turns of one conversation meet in one row, because its
    formatted text is one value; nothing wider than that is gathered.
    """
    turn = F.struct(F.col("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    turns = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    start = F.array(F.struct(F.lit(template.start).alias("text"), F.lit(False).alias("loss")))
    segments = F.concat(start, F.flatten(F.transform("turns", lambda t: _segments(t, template))))
    return turns.select("conv_id", _state(F.col("turns"), template).isin(*template.accepting).alias("valid"), segments.alias("segments"))


def read_turns(formatted: Column, template: Template = TEMPLATE) -> Column:
    """Array of (role, text) read back from a formatted chat."""
    q = re.escape
    known = "|".join(f"({q(t.begin)})(.*?){q(t.end)}" for t in template.turns.values())
    pattern = f"(?s){known}|{q(template.other.begin)}([^\\]]*)\\] (.*?){q(template.other.end)}"
    whole = F.regexp_extract_all(formatted, F.lit(pattern), F.lit(0))

    def turn(x: Column) -> Column:
        head = F.substring_index(x, "] ", 1)
        rest = F.substring(x, F.length(head) + 3, 2147483647)
        body = F.substring(rest, F.lit(1), F.length(rest) - len(template.other.end))
        out = F.struct(unescape(F.substring(head, len(template.other.begin) + 1, 2147483647)).alias("role"), unescape(body).alias("text"))
        for name, t in template.turns.items():
            body = F.substring(x, F.lit(len(t.begin) + 1), F.length(x) - len(t.begin) - len(t.end))
            out = F.when(x.startswith(t.begin), F.struct(F.lit(name).alias("role"), unescape(body).alias("text"))).otherwise(out)
        return out

    return F.transform(whole, turn)


def chat_digests(formatted: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, valid: read back from what format_chats gives."""
    text = F.array_join(F.transform("segments", lambda s: s["text"]), "")
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    read = formatted.select("conv_id", "valid", text.alias("formatted"), loss.alias("loss")).withColumn("turns", read_turns(F.col("formatted"), template))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), digest(lines).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), digest(F.col("loss")).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "valid")
