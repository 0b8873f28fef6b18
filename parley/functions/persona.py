"""Persona instructions inside user messages.

Two detectors with different rules: ``persona_instruction`` searches anywhere in the message,
``persona_switch`` only at its start. Positions are found on the original text with
case-insensitive patterns, so lowercasing never shifts an offset.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parley import fixed
from parley.functions.arrays import let
from parley.functions.text import SPACE, WORD, strip

_EDGE = " ,.;:-"


def _unicode_space(pattern: str) -> str:
    return pattern.replace(r"\s", f"[{SPACE}]")


def _and_split(text: Column) -> Column:
    """Struct (head, rest) around the first free-standing ``and``; null without one."""
    pattern = rf"(?is)^(.*?)[{SPACE}]+and[{SPACE}]+(.*)$"
    return F.when(
        text.rlike(pattern),
        F.struct(
            strip(F.regexp_extract(text, pattern, 1)).alias("name"),
            strip(F.regexp_extract(text, pattern, 2)).alias("rest"),
        ),
    )


def _split_name(name: Column) -> Column:
    """Struct (name, rest): cut at a time or place suffix, else at the first ``and``."""
    padded = F.lower(F.concat(F.lit(" "), name, F.lit(" ")))
    whole = F.struct(name.alias("name"), F.lit("").alias("rest"))
    cut = F.coalesce(_and_split(name), whole)
    for marker in reversed(fixed.PERSONA_SUFFIXES):
        at = F.instr(padded, marker)
        head = strip(F.substring(name, F.lit(1), at - 1))
        cut = F.when(at > 0, F.struct(head.alias("name"), F.lit("").alias("rest"))).otherwise(cut)
    return cut


def persona_instruction(message: Column) -> Column:
    """Struct (name, remainder, raw) of the first persona instruction in a message, else null.

    Patterns are tried in order; one whose name is generic or shorter than two characters
    gives way to the next.
    """

    def candidates(text: Column) -> Column:
        found = []
        for lead in fixed.PERSONA_LEADS:
            head = _unicode_space(lead + fixed.PERSONA_ARTICLE)
            # the first letter is looked at before anything dearer is tried
            first = lead.removeprefix("(?:")[0]
            pattern = rf"(?iu)(?=[{first}])(?<![{WORD}]){head}{fixed.PERSONA_NAME}[\s\S]*"
            found.append(
                F.struct(
                    F.regexp_extract(text, pattern, 0).alias("tail"),
                    strip(F.regexp_extract(text, pattern, 1)).alias("name"),
                )
            )
        return F.array(*found)

    tail_rest = rf"(?iu)[{SPACE}]+and[{SPACE}]+([^\n]+)\z"

    def resolve(text: Column) -> Column:
        split = F.transform(
            F.filter(candidates(text), lambda c: c["tail"] != ""),
            lambda c: F.struct(c["tail"].alias("tail"), _split_name(c["name"]).alias("part")),
        )
        usable = F.filter(
            split,
            lambda c: (F.length(c["part"]["name"]) >= 2)
            & ~F.lower(c["part"]["name"]).isin(fixed.GENERIC_PERSONAS),
        )
        return let(
            F.get(usable, F.lit(0)),
            lambda c: F.when(
                c.isNotNull(),
                F.struct(
                    c["part"]["name"].alias("name"),
                    F.coalesce(
                        F.nullif(c["part"]["rest"], F.lit("")),
                        F.nullif(strip(F.regexp_extract(strip(c["tail"]), tail_rest, 1)), F.lit("")),
                        F.lit(fixed.PERSONA_DEFAULT_REMAINDER),
                    ).alias("remainder"),
                    text.alias("raw"),
                ),
            ),
        )

    return let(strip(message), resolve)


def persona_switch(message: Column) -> Column:
    """Struct (persona, remainder); persona is null and remainder the message without a switch."""
    leads = "|".join(_unicode_space(p) for p in fixed.SWITCH_LEADS)
    pattern = rf"(?iu)^(?:{leads})([^\n]+)\z"
    separators = "|".join(fixed.SWITCH_SEPARATORS)
    cut = rf"(?is)^(.*?)({separators})(.*)$"

    def remainder_of(rest: Column) -> Column:
        for lead in fixed.SWITCH_REMAINDER_LEADS:
            rest = F.when(
                F.startswith(F.lower(rest), F.lit(lead)),
                strip(F.substring(rest, F.lit(len(lead) + 1), F.length(rest))),
            ).otherwise(rest)
        return rest

    def split(raw: Column) -> Column:
        has_cut = raw.rlike(cut)
        head = F.when(has_cut, F.btrim(F.regexp_extract(raw, cut, 1), F.lit(_EDGE))).otherwise(raw)
        rest = F.when(has_cut, F.btrim(F.regexp_extract(raw, cut, 3), F.lit(_EDGE))).otherwise("")
        return F.struct(head.alias("persona"), remainder_of(rest).alias("rest"))

    def resolve(text: Column) -> Column:
        raw = F.btrim(strip(F.regexp_extract(text, pattern, 1)), F.lit("."))
        empty = "|".join(fixed.SWITCH_EMPTY_LEADS)
        return let(
            split(raw),
            lambda s: F.when(
                s["persona"] != "",
                F.struct(
                    s["persona"].alias("persona"),
                    F.when(
                        (s["rest"] == "") | F.lower(s["rest"]).rlike(f"^(?:{empty})"),
                        F.lit(fixed.SWITCH_DEFAULT_REMAINDER),
                    )
                    .otherwise(s["rest"])
                    .alias("remainder"),
                ),
            ),
        )

    kept = F.struct(F.lit(None).cast("string").alias("persona"), message.alias("remainder"))
    return F.coalesce(let(strip(message), resolve), kept)
