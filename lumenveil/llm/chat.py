"""Chat formatting: a finite-state machine over roles and a declarative template, in DataFrame expressions.

A template says how a turn of each role opens and closes, and which roles are learned from. Formatting
gives one string, and segments (text, loss) that joined are that string; only the text of a learned
role has loss. Control strings inside texts are escaped reversibly: a backslash follows every backslash and
every character that starts a control string, so no control string survives in escaped text, and
dropping the added backslashes restores it.

The machine starts in `start`; a role without a transition from the current state makes the conversation
invalid from that turn on (first_invalid, from 0); ending in a state that isn't final makes it incomplete.
Invalid conversations are formatted all the same and marked.

Defined cases: null texts are empty; null roles are the empty role; turns are ordered by turn (null first),
then role, then text; repeated rows are repeated turns; a row with a null conv_id belongs to no other and is a conversation of
its own; an empty table gives an empty result; extra columns, also such as are named t or segments, are ignored. A
conversation is one row, however long: its turns are formatted, read back and masked in time linear in its text.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import running


@dataclass(frozen=True)
class Template:
    """open: before the role; middle: between the escaped role and the escaped text; close: after the text."""

    open: str = "[INST]<role>"
    middle: str = "</role>"
    close: str = "[/INST]</s>"
    learned: tuple[str, ...] = ("assistant",)
    #: Also escaped: control strings of the model's own vocabulary.
    reserved: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
    start: str = "start"
    final: tuple[str, ...] = ("assistant",)
    #: (state, role) -> state.
    moves: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "system",
            ("start", "user"): "user",
            ("system", "user"): "user",
            ("user", "assistant"): "assistant",
            ("assistant", "user"): "user",
        }
    )

    def starts(self) -> str:
        """First characters of all control strings, and the backslash."""
        found = {c[0] for c in (self.open, self.middle, self.close, *self.reserved) if c}
        if "\\" in found:
            raise ValueError("a control string can't start with a backslash")
        return "\\" + "".join(sorted(found))

    def check(self) -> None:
        for c in (self.open, self.middle, self.close, *self.reserved):
            if len(c) < 2 or c[1] == "\\":
                raise ValueError("a control string has two characters at least, the second no backslash")


def _q(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _class(chars: str) -> str:
    return "[" + "".join("\\" + c for c in chars) + "]"


def escape(col: str, template: Template) -> str:
    return f"regexp_replace({col}, {_q('(' + _class(template.starts()) + ')')}, {_q('$1' + chr(92) * 2)})"


def unescape(col: str, template: Template) -> str:
    return f"regexp_replace({col}, {_q('(' + _class(template.starts()) + ')' + chr(92) * 2)}, '$1')"


def format_chats(rows: DataFrame, template: Template = Template()) -> DataFrame:
    """rows (conv_id, turn, role, text) -> conv_id, segments (array of text, loss), formatted, valid, first_invalid."""
    template.check()
    alone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()).alias("_own")
    turns = rows.select("conv_id", alone, F.struct("turn", F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("t"))
    df = turns.groupBy("conv_id", "_own").agg(F.sort_array(F.collect_list("t")).alias("_turns"))
    learned = f"x.role IN ({', '.join(map(_q, template.learned))})" if template.learned else "false"
    segments = (
        f"flatten(transform(_turns, x -> array("
        f"struct(concat({_q(template.open)}, {escape('x.role', template)}, {_q(template.middle)}) AS text, false AS loss), "
        f"struct({escape('x.text', template)} AS text, {learned} AS loss), "
        f"struct({_q(template.close)} AS text, false AS loss))))"
    )
    moves = " ".join(f"WHEN s.state = {_q(a)} AND x.role = {_q(r)} THEN {_q(b)}" for (a, r), b in template.moves.items())
    machine = (
        f"aggregate(_turns, struct({_q(template.start)} AS state, 0 AS n, -1 AS bad), (s, x) -> struct("
        f"CASE {moves} ELSE 'invalid' END AS state, s.n + 1 AS n, "
        f"if(s.bad = -1 AND CASE {moves} ELSE 'invalid' END = 'invalid', s.n, s.bad) AS bad))"
    )
    df = df.withColumn("segments", F.expr(segments)).withColumn("_end", F.expr(machine))
    return df.select(
        "conv_id",
        "segments",
        F.expr("array_join(transform(segments, x -> x.text), '')").alias("formatted"),
        (F.col("_end.state").isin(*template.final)).alias("valid"),
        F.expr("if(_end.bad < 0, NULL, _end.bad)").alias("first_invalid"),
    )


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """formatted (conv_id, formatted, ...) plus turns: array of role and text, parsed from the string alone."""
    # Splits are by literal strings; escaped text holds none of them.
    lit = lambda s: _q("".join("\\" + c if not c.isalnum() else c for c in s))
    pieces = f"filter(split(formatted, {lit(template.close)}, -1), (x, i) -> i < size(split(formatted, {lit(template.close)}, -1)) - 1)"
    n = len(template.open)
    one = f"split(substring(x, {n + 1}), {lit(template.middle)}, 2)"
    turns = f"transform({pieces}, x -> struct({unescape(f'{one}[0]', template)} AS role, {unescape(f'{one}[1]', template)} AS text))"
    return formatted.withColumn("turns", F.expr(turns))


def mask_spans(segments: Column) -> Column:
    """array (start, length) of the segments with loss, in code points of the formatted string."""
    ends = running("g.n", "size(g.n)", "x + p")
    return F.expr(
        "filter(transform(array(struct(segments AS s, transform(segments, x -> length(x.text)) AS n)), g -> "
        f"zip_with(g.s, zip_with({ends}, g.n, (e, n) -> struct(e - n AS start, n AS length)), (x, y) -> if(x.loss, y, NULL)))[0], y -> y IS NOT NULL)"
    )


def learned_text(template: Template = Template()) -> Column:
    """All text under the loss mask of the segments, unescaped, in order."""
    return F.expr(f"array_join(transform(filter(segments, x -> x.loss), x -> {unescape('x.text', template)}), '')")
