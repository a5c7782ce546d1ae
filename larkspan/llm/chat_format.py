"""Chat formatting by a declarative template and a finite-state machine over roles.

The template is data: a header and a loss flag for each role, the end mark of a turn, and the
transitions of the state machine. One row comes out per conversation: the formatted text, its
segments with their loss flags, and whether the roles followed the machine. Everything is built
from DataFrame functions.

Control strings inside texts are escaped with a backslash: ``\\`` becomes ``\\\\``, ``#`` becomes
``\\#`` and ``</`` becomes ``<\\/``, so neither a header nor an end mark can occur inside a text.

Defined cases: a null text or role is an empty one; a role the template does not know is written as a
length-prefixed name, bears no loss and leads to the error state; turns with equal numbers are ordered
by role and text, a null number comes first; repeated rows are repeated turns; rows without a conversation
id form one conversation; an empty table gives no rows; further columns are ignored. A conversation is one
training example and one row of output, so it must fit in a row; only the turns of one conversation
ever meet, as partial lists gathered before the shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """``roles``: header and loss flag by role. ``moves``: next state by (state, role); what is missing
    leads to ``error``. A conversation is valid when it ends in one of ``final``."""

    roles: dict[str, tuple[str, bool]] = field(
        default_factory=lambda: {
            "system": ("### System: ", False),
            "user": ("### User: ", False),
            "assistant": ("### Assistant: ", True),
        }
    )
    end: str = "</turn>\n"
    moves: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "briefed",
            ("start", "user"): "asked",
            ("briefed", "user"): "asked",
            ("asked", "assistant"): "answered",
            ("answered", "user"): "asked",
        }
    )
    final: tuple[str, ...] = ("answered",)


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    text = F.replace(text, F.lit("#"), F.lit("\\#"))
    return F.replace(text, F.lit("</"), F.lit("<\\/"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _header(role: Column, template: Template) -> Column:
    name = escape(role)
    out = F.concat(F.lit("### Role["), F.length(name).cast("string"), F.lit("]: "), name, F.lit("|"))
    for known, (header, _) in template.roles.items():
        out = F.when(role == known, header).otherwise(out)
    return out


def format_conversations(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """``turns(conv_id, turn, role, text)`` to one row per conversation: conv_id, formatted,
    segments array<struct<text, loss>>, state, valid."""
    template = template or Template()
    bears_loss = [r for r, (_, loss) in template.roles.items() if loss]
    rows = turns.select(
        "conv_id",
        F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"),
    )
    groups = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    pieces = F.flatten(
        F.transform(
            "turns",
            lambda t: F.array(
                F.struct(_header(t["role"], template).alias("text"), F.lit(False).alias("loss")),
                F.struct(escape(t["text"]).alias("text"), t["role"].isin(bears_loss).alias("loss")),
                F.struct(F.lit(template.end).alias("text"), F.lit(False).alias("loss")),
            ),
        )
    )
    table = F.create_map(*[F.lit(x) for (state, role), to in template.moves.items() for x in (f"{state} {role}", to)])
    state = F.aggregate(
        "turns",
        F.lit("start"),
        lambda s, t: F.coalesce(F.try_element_at(table, F.concat_ws(" ", s, t["role"])), F.lit("error")),
    )
    return (
        groups.select("conv_id", pieces.alias("segments"), state.alias("state"))
        .select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments", "state")
        .withColumn("valid", F.col("state").isin(list(template.final)))
    )


def read_back(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """The turns, as array<struct<role, text>>, from the formatted text alone, and the text under
    the loss mask from the segments."""
    template = template or Template()

    def turn(part: Column) -> Column:
        size = F.regexp_extract(part, r"^### Role\[(\d+)\]: ", 1)
        begin = F.length(size) + F.lit(len("### Role[]: ") + 1)
        n = size.cast("int")
        role, text = part.substr(begin, n), part.substr(begin + n + 1, F.length(part))
        for known, (header, _) in template.roles.items():
            here = part.startswith(header)
            role = F.when(here, known).otherwise(role)
            text = F.when(here, part.substr(F.lit(len(header) + 1), F.length(part))).otherwise(text)
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    parts = F.split("formatted", template.end, -1)
    spoken = F.filter("segments", lambda s: s["loss"])
    return formatted.select(
        "conv_id",
        F.transform(F.slice(parts, 1, F.size(parts) - 1), turn).alias("turns"),
        F.array_join(F.transform(spoken, lambda s: unescape(s["text"])), "").alias("loss_text"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )
