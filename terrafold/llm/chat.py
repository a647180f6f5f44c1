"""Chat formatting: a finite-state machine over roles and a declarative template.

Each turn becomes an opening control string, the text, and a closing control string; every segment says whether it counts
for the loss. Control strings inside texts get a ``~`` after their first character (and one more if they have some already),
which reading takes off again, so other text is left as it is. The machine tests the order of turns; conversations that
break it are formatted too and marked ``valid = false``.

Null texts and roles are empty; turns are ordered by (turn, role, text), null turns first; rows with a null ``conv_id``
make one conversation. The contract asks for one digest per conversation, so a conversation is one row.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """``roles``: role to (opening, closing, counts for the loss). Other roles are named between ``other`` strings."""

    begin: str = "<s>"
    roles: dict[str, tuple[str, str, bool]] = field(default_factory=lambda: {
        "system": ("[SYS]", "[/SYS]", False), "user": ("[INST]", "[/INST]", False), "assistant": ("[OUT]", "</s>", True)})
    other: tuple[str, str, str] = ("[ROLE]", "[TEXT]", "[/TEXT]")

    def controls(self) -> list[str]:
        return [self.begin, *(x for a, b, _ in self.roles.values() for x in (a, b)), *self.other]


#: State and role to the next state; what is missing is an error, and every state but ``start``, ``system`` and ``error`` may end.
MACHINE = {"start": {"system": "system", "user": "user"}, "system": {"user": "user"}, "user": {"assistant": "assistant"}, "assistant": {"user": "user"}}
CHAT = Template()


def _quote(x: str) -> str:
    return "".join("\\" + c if c in "[]/<>^$.|?*+()\\{}" else c for c in x)


def _marked(t: Template, tilde: str) -> str:
    heads = sorted({c[0] for c in t.controls()})
    tails = sorted({c[1:] for c in t.controls()})
    return f"({'|'.join(map(_quote, heads))}){tilde}(~*)({'|'.join(map(_quote, tails))})"


def escape(text: Column, t: Template = CHAT) -> Column:
    return F.regexp_replace(text, _marked(t, ""), "$1~$2$3")


def unescape(text: Column, t: Template = CHAT) -> Column:
    return F.regexp_replace(text, _marked(t, "~"), "$1$2$3")


def _by_role(role: Column, t: Template, pick, other: Column) -> Column:
    out = None
    for name, spec in t.roles.items():
        out = F.when(role == name, F.lit(pick(spec))) if out is None else out.when(role == name, F.lit(pick(spec)))
    return out.otherwise(other)


def _states(roles: Column) -> Column:
    """The machine's last state after all roles."""

    def step(state: Column, role: Column) -> Column:
        out = None
        for s, moves in MACHINE.items():
            for r, to in moves.items():
                hit = (state == s) & (role == r)
                out = F.when(hit, to) if out is None else out.when(hit, to)
        return out.otherwise("error")

    return F.aggregate(roles, F.lit("start"), step)


def format_chats(turns: DataFrame, t: Template = CHAT) -> DataFrame:
    """``conv_id, formatted, segments (text, loss), loss_spans (start, length), valid`` per conversation."""
    rows = turns.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("x"))
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("turns"))

    def parts(x: Column) -> Column:
        role = x["role"]
        opening = _by_role(role, t, lambda s: s[0], F.concat(F.lit(t.other[0]), escape(role, t), F.lit(t.other[1])))
        return F.array(F.struct(opening.alias("text"), F.lit(False).alias("loss")),
                       F.struct(escape(x["text"], t).alias("text"), _by_role(role, t, lambda s: s[2], F.lit(False)).alias("loss")),
                       F.struct(_by_role(role, t, lambda s: s[1], F.lit(t.other[2])).alias("text"), F.lit(False).alias("loss")))

    begin = F.array(F.struct(F.lit(t.begin).alias("text"), F.lit(False).alias("loss")))
    chats = chats.select("conv_id", F.concat(begin, F.flatten(F.transform("turns", parts))).alias("segments"), _states(F.transform("turns", lambda x: x["role"])).alias("_end"))
    lengths = F.transform("segments", lambda s: F.struct(F.length(s["text"]).alias("n"), s["loss"].alias("loss")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    spans = F.aggregate(lengths, zero, lambda a, s: F.struct((a["at"] + s["n"]).alias("at"), F.when(
        s["loss"], F.concat(a["spans"], F.array(F.struct(a["at"].alias("start"), s["n"].alias("length"))))).otherwise(a["spans"]).alias("spans")), lambda a: a["spans"])
    return chats.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments", spans.alias("loss_spans"),
                        F.col("_end").isin("user", "assistant").alias("valid"))


def read_turns(formatted: Column, t: Template = CHAT) -> Column:
    """``array<struct<role, text>>`` of a formatted conversation: escaped text holds no control string, so openings split it."""
    openings = [a for a, _, _ in t.roles.values()] + [t.other[0]]
    pieces = F.filter(F.split(F.substring(formatted, len(t.begin) + 1, 2**31 - 1), f"(?={'|'.join(map(_quote, openings))})"), lambda p: p != "")

    def turn(p: Column) -> Column:
        cut = lambda a, b: F.substr(p, F.lit(len(a) + 1), F.length(p) - len(a) - len(b))
        role = F.split_part(cut(t.other[0], t.other[2]), F.lit(t.other[1]), F.lit(1))
        rest = F.substr(p, F.length(role) + len(t.other[0]) + len(t.other[1]) + 1, F.length(p) - F.length(role) - sum(map(len, t.other)))
        out = None
        for name, (a, b, _) in t.roles.items():
            hit, value = F.startswith(p, F.lit(a)), F.struct(F.lit(name).alias("role"), unescape(cut(a, b), t).alias("text"))
            out = F.when(hit, value) if out is None else out.when(hit, value)
        return out.otherwise(F.struct(unescape(role, t).alias("role"), unescape(rest, t).alias("text")))

    return F.transform(pieces, turn)


def read_loss(formatted: Column, spans: Column, t: Template = CHAT) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["length"]), t)), "")


def chat_digests(turns: DataFrame, t: Template = CHAT) -> DataFrame:
    """What the formatted text and its loss spans say about each conversation."""
    made = format_chats(turns, t)
    back = made.select("conv_id", "valid", read_turns(F.col("formatted"), t).alias("turns"), read_loss(F.col("formatted"), F.col("loss_spans"), t).alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    line = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.encode(line, "UTF-8"), 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
                       F.sha2(F.encode("loss", "UTF-8"), 256).alias("loss_sha256"), "formatted_chars", "valid")
