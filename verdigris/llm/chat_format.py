"""Chat formatting: a finite-state machine over roles and a declarative template, in DataFrame functions only.

Every turn becomes three segments: its opening (mark, role, line feed), its text and its closing mark.  A segment
carries a loss flag, set for the texts of the roles that the template trains.  Control strings inside a text are
escaped reversibly: '%' becomes '%25', and the first character of a control string its own %-code, so that no control
string is left in a text and decoding restores it exactly.

Turns are ordered by (turn, role, text), nulls first; repeated rows stay.  A null text or role is empty.  A null
conv_id is one conversation.  Conversations whose order the machine rejects are formatted too, with valid = false, so
that nothing is lost.  Other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """opening + role + newline + text + closing for every turn; moves: (state, role) -> state."""

    opening: str = "<|im_start|>"
    closing: str = "<|im_end|>\n"
    trained: tuple[str, ...] = ("assistant",)
    controls: tuple[str, ...] = ("<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>")
    moves: dict[tuple[str, str], str] = field(default_factory=lambda: {("start", "system"): "told", ("start", "user"): "asked", ("told", "user"): "asked", ("asked", "assistant"): "answered", ("answered", "user"): "asked"})
    accepted: tuple[str, ...] = ("asked", "answered")

    def escape(self, text: Column) -> Column:
        out = F.replace(text, F.lit("%"), F.lit("%25"))
        for c in self.controls:
            out = F.replace(out, F.lit(c), F.lit(f"%{ord(c[0]):02X}{c[1:]}"))
        return out

    def unescape(self, text: Column) -> Column:
        for c in sorted({c[0] for c in self.controls}):
            text = F.replace(text, F.lit(f"%{ord(c):02X}"), F.lit(c))
        return F.replace(text, F.lit("%25"), F.lit("%"))

    def role_in(self, role: Column) -> Column:
        return F.replace(self.escape(role), F.lit("\n"), F.lit("%0A"))

    def role_out(self, role: Column) -> Column:
        return self.unescape(F.replace(role, F.lit("%0A"), F.lit("\n")))

    def valid(self, roles: Column) -> Column:
        steps = F.create_map(*(F.lit(x) for (state, role), to in self.moves.items() for x in (f"{state}\n{role}", to)))
        end = F.aggregate(roles, F.lit("start"), lambda s, r: F.coalesce(F.try_element_at(steps, F.concat(s, F.lit("\n"), r)), F.lit("rejected")))
        return end.isin(*self.accepted)


def format_chats(rows: DataFrame, template: Template = Template()) -> DataFrame:
    """rows: conv_id, turn, role, text.  Returns conv_id, valid, segments (array of text, loss) and formatted."""
    turn = F.struct("turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))

    def segments(t: Column) -> Column:
        one = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        head = F.concat(F.lit(template.opening), template.role_in(t["role"]), F.lit("\n"))
        return F.array(one(head, F.lit(False)), one(template.escape(t["text"]), t["role"].isin(*template.trained)), one(F.lit(template.closing), F.lit(False)))

    out = turns.select("conv_id", template.valid(F.transform("turns", lambda t: t["role"])).alias("valid"), F.flatten(F.transform("turns", segments)).alias("segments"))
    return out.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """Adds turns (array of role, text) parsed from the formatted string, and trained (array of texts under the mask)."""
    pieces = F.slice(F.split("formatted", _quoted(template.opening), -1), 2, 1 << 30)

    def turn(p: Column) -> Column:
        cut = F.instr(p, "\n")
        text = F.substr(p, cut + 1, F.length(p) - cut - len(template.closing))
        return F.struct(template.role_out(F.substr(p, F.lit(1), cut - 1)).alias("role"), template.unescape(text).alias("text"))

    trained = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: template.unescape(s["text"]))
    return formatted.withColumns({"turns": F.transform(pieces, turn), "trained": trained})


def _quoted(s: str) -> str:
    return "".join(f"\\{c}" if c in r"\.[]{}()<>*+-=!?^$|" else c for c in s)
