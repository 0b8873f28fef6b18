"""Replay of conversations: persona, mood, scene and history as folds over turns.

Input is one row per turn: session key, turn number, ``user`` and ``assistant`` (which may be
null). The persona of a turn applies to the turn itself; mood, scene and history seen by its
prompt are those of the turns before.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley import fixed
from parley.functions import cues, render
from parley.functions.persona import persona_instruction, persona_switch
from parley.functions.text import parse_salvaged, slug, strip
from parley.operators.pairing import pair_messages
from parley.operators.validate import valid_profiles
from parley.plans.folds import Order, carry, items_before, last_rows, number, settle
from parley.plans.once import once
from parley.plans.sizes import checked_broadcast

DYNAMIC = "dynamic/"
HISTORY_PART = 64


def hear_personas(turns: DataFrame, keep_text: bool = False) -> DataFrame:
    """Add ``persona`` (null without an instruction); the rest of the message becomes ``user``."""
    heard = once(turns, "persona", persona_instruction(F.col("user")))
    if keep_text:
        return heard
    return heard.withColumn("user", F.coalesce("persona.remainder", "user"))


def _salted_slug(order: Order) -> Column:
    """Slug to look up; rows without an instruction are spread, not gathered on one null key."""
    nowhere = F.concat(F.lit("\x00"), F.pmod(F.xxhash64(*order.keys, order.by), F.lit(1024)).cast("string"))
    return F.coalesce(slug(F.col("persona.name")), nowhere)


def resolve_switches(turns: DataFrame, profiles: DataFrame, order: Order) -> DataFrame:
    """Add ``switch_id`` and ``switch_name``: a stored profile by slug, else ``dynamic/<slug>``.

    A dynamic profile keeps, for the whole session, the name it was first called by.
    """
    known = valid_profiles(profiles).select(
        F.col("id").alias("__slug"), F.col("name").alias("__known")
    )
    found = turns.withColumn("__slug", _salted_slug(order)).join(
        checked_broadcast(known), "__slug", "left"
    )
    asked = F.col("persona").isNotNull()
    named = found.withColumn(
        "switch_id",
        F.when(
            asked,
            F.when(F.col("__known").isNotNull(), F.col("__slug")).otherwise(
                F.concat(F.lit(DYNAMIC), F.col("__slug"))
            ),
        ),
    )
    called = F.col("persona.name")
    if order.block is None:
        # dealt out by session here, so that this window and all later folds share the shuffle
        named = named.repartition(*order.keys)
        window = Window.partitionBy(*order.keys, "switch_id").orderBy(order.by)
        from_start = window.rowsBetween(Window.unboundedPreceding, 0)
        named = named.withColumn("__first", F.first(called).over(from_start))
    else:
        first = named.where(asked).groupBy(*order.keys, "switch_id").agg(
            F.min_by(called, order.by).alias("__first")
        )
        # rows that ask for nobody stay where they are; they would all meet on one null key
        quiet = named.where(~asked).withColumn("__first", F.lit(None).cast("string"))
        named = named.where(asked).join(first, [*order.keys, "switch_id"], "left").unionByName(quiet)
    return named.withColumn(
        "switch_name", F.when(asked, F.coalesce("__known", "__first"))
    ).drop("__slug", "__known", "__first")


def carry_persona(
    turns: DataFrame, order: Order, initial_id: str = fixed.DEFAULT_CHARACTER, initial_name: str | None = None
) -> DataFrame:
    """Add ``character_id`` and ``character_name`` as of the turn."""
    switch = F.when(
        F.col("switch_id").isNotNull(), F.struct("switch_id", "switch_name")
    )
    carried = carry(turns, order, {"__who": switch})
    return carried.withColumns(
        {
            "character_id": F.coalesce(F.col("__who.switch_id"), F.lit(initial_id)),
            "character_name": F.coalesce(F.col("__who.switch_name"), F.lit(initial_name or initial_id)),
        }
    ).drop("__who")


_EMOTION_CUE = "__cue_emotion"
_WORLD_CUES = {n: f"__cue_{n}" for n in fixed.WORLD_DEFAULTS}


def hear_cues(turns: DataFrame) -> DataFrame:
    """Add the mood and scene cues of every turn, for the folds below.

    The cues hold the only Python step of a replay (NFKC of the few texts that need it), and a
    Python step makes Spark forget how rows are partitioned. With all cues taken before the
    first fold, the folds share one shuffle.
    """
    reply = F.coalesce("assistant", F.lit(""))
    named = {_EMOTION_CUE: cues.emotion_cue(F.col("user"), reply)}
    named |= {_WORLD_CUES[n]: c for n, c in cues.world_cues(F.col("user"), reply).items()}
    return turns.withColumns(named)


def _with_cues(turns: DataFrame) -> DataFrame:
    return turns if _EMOTION_CUE in turns.columns else hear_cues(turns)


def without_cues(turns: DataFrame) -> DataFrame:
    return turns.drop(_EMOTION_CUE, *_WORLD_CUES.values())


def carry_emotion(
    turns: DataFrame, order: Order, character: str = "character_id", *, before: bool = False
) -> DataFrame:
    """Add ``emotion`` of the character: after the turn, or as the turn's prompt sees it."""
    heard = _with_cues(turns)
    carried = carry(heard, order.within(character), {"emotion": F.col(_EMOTION_CUE)}, before=before)
    filled = carried.withColumn("emotion", F.coalesce("emotion", F.lit(fixed.DEFAULT_EMOTION)))
    return filled if heard is turns else without_cues(filled)


def carry_world(turns: DataFrame, order: Order, *, before: bool = False) -> DataFrame:
    """Add ``location``, ``time``, ``current_event`` and ``story_progress``."""
    seen = _with_cues(turns)
    carried = carry(seen, order, {n: F.col(c) for n, c in _WORLD_CUES.items()}, before=before)
    filled = carried.withColumns(
        {n: F.coalesce(n, F.lit(d)) for n, d in fixed.WORLD_DEFAULTS.items()}
    )
    return filled if seen is turns else without_cues(filled)


def carry_history(turns: DataFrame, order: Order, pairs: int = fixed.HISTORY_PAIRS) -> DataFrame:
    """Add ``history``: the last ``pairs`` turns before this one, oldest first."""
    item = F.struct(F.col("user").alias("user"), F.coalesce("assistant", F.lit("")).alias("assistant"))
    return items_before(turns, order, item, pairs, "history")


def history_store(
    turns: DataFrame, order: Order, line: Column, part: int = HISTORY_PART
) -> tuple[DataFrame, DataFrame]:
    """Whole histories, every line written once: (turns, pieces).

    A piece is (session, ``part``, ``told``): the ``line`` of turns ``p * part`` to
    ``(p + 1) * part - 1`` of the session. A turn gets ``last`` and ``upto``: its history is the
    pieces before ``last`` and the first ``upto`` characters of that one. Rows and bytes of both
    grow with the turns, however long a session is; ``told_parts`` gives the texts of chosen turns.
    """
    numbered = settle(number(turns, order, "__no"), order)
    cut = numbered.withColumns({"__line": line, "last": F.floor((F.col("__no") - 1) / part)})
    keys = [*order.keys, "last"]
    lines = F.array_sort(F.collect_list(F.struct("__no", "__line")))
    pieces = (
        cut.groupBy(*keys)
        .agg(F.array_join(F.transform(lines, lambda x: x["__line"]), "").alias("told"))
        .withColumnRenamed("last", "part")
    )
    earlier = Window.partitionBy(*keys).orderBy("__no").rowsBetween(Window.unboundedPreceding, -1)
    upto = F.coalesce(F.sum(F.length("__line")).over(earlier), F.lit(0)).cast("int")
    return cut.withColumn("upto", upto).drop("__no", "__line"), pieces


def told_parts(turns: DataFrame, pieces: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The given turns of a history store once per piece of their histories: adds ``part`` and ``told``."""
    reached = turns.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("last"))))
    whole = F.col("part") < F.col("last")
    told = F.when(whole, F.col("told")).otherwise(F.col("told").substr(F.lit(1), F.col("upto")))
    return reached.join(pieces, [*keys, "part"]).withColumn("told", told).drop("upto")


def history_parts(turns: DataFrame, order: Order, line: Column, part: int = HISTORY_PART) -> DataFrame:
    """Every turn once per part of its whole history: adds ``part``, ``last`` and ``told``.

    The expansion of a history store for all turns: no task holds a session, but the rows written
    grow with the square of a session's length because the histories do.
    """
    return told_parts(*history_store(turns, order, line, part), order.keys)


def replay_states(
    turns: DataFrame,
    profiles: DataFrame,
    order: Order,
    initial_id: str = fixed.DEFAULT_CHARACTER,
    initial_name: str | None = None,
    *,
    before: bool = True,
) -> DataFrame:
    """One row per turn with persona, world, history and emotion.

    ``before=True`` gives what the turn's prompt sees, ``False`` the state after the turn.
    """
    heard = hear_cues(hear_personas(turns))
    switched = resolve_switches(settle(heard, order), profiles, order)
    voiced = settle(carry_persona(switched, order, initial_id, initial_name), order)
    placed = settle(carry_world(voiced, order, before=before), order)
    recalled = settle(carry_history(placed, order), order)
    return without_cues(carry_emotion(recalled, order, before=before))


def synthesize_profiles(requests: DataFrame, name: str = "name", reply: str = "reply") -> DataFrame:
    """Profile columns for persona requests, from a model's reply when it holds a whole profile.

    A reply that is no JSON object, or lacks a required field, gives the template profile.
    """
    fields = [*fixed.PROFILE_REQUIRED, fixed.PROFILE_OPTIONAL]
    schema = T.StructType([T.StructField(f, T.StringType()) for f in fields])
    asked = strip(F.col(name))
    read = requests.withColumn("__p", parse_salvaged(F.col(reply), schema))
    given = lambda f: F.nullif(F.col(f"__p.{f}"), F.lit(""))
    said_name = F.coalesce(F.nullif(strip(F.coalesce(given("name"), F.col(name))), F.lit("")), F.col(name))
    read = read.withColumn("__name", said_name)
    values = {f: strip(F.coalesce(given(f), F.lit(""))) for f in fields}
    values["name"] = strip(F.col("__name"))
    values[fixed.PROFILE_OPTIONAL] = strip(
        F.coalesce(
            given(fixed.PROFILE_OPTIONAL), F.concat(F.lit("Respond as "), F.col("__name"), F.lit(" would."))
        )
    )
    whole = F.col("__p").isNotNull() & render.filled_profile(values, fixed.PROFILE_REQUIRED)
    called = lambda default: F.coalesce(F.nullif(asked, F.lit("")), F.lit(default))
    template = {
        "name": called("Character"),
        "role": called("Roleplay character"),
        **{f: F.lit(text) for f, text in fixed.PROFILE_TEMPLATE.items()},
        fixed.PROFILE_OPTIONAL: F.concat(
            F.lit("Respond like "),
            called("the persona"),
            F.lit("; do not mention being an AI unless asked."),
        ),
    }
    return read.select(
        *[c for c in requests.columns if c not in fields],
        *[F.when(whole, values[f]).otherwise(template[f]).alias(f) for f in fields],
    )


def persona_usage(turns: DataFrame, order: Order) -> DataFrame:
    """Switch messages per session and dynamic persona."""
    return (
        turns.where(F.startswith(F.col("switch_id"), F.lit(DYNAMIC)))
        .groupBy(*order.keys, "switch_id")
        .agg(F.count("*").alias("uses"), F.min_by("switch_name", order.by).alias("name"))
    )


def template_profile(name: Column) -> dict[str, Column]:
    """Profile of a persona known by its name alone."""
    return {
        "name": name,
        "role": name,
        **{f: F.lit(text) for f, text in fixed.PROFILE_TEMPLATE.items()},
        fixed.PROFILE_OPTIONAL: F.concat(
            F.lit("Respond like "), name, F.lit("; do not mention being an AI unless asked.")
        ),
    }


def personas_to_save(
    usage: DataFrame, saved: DataFrame, uses: int = fixed.SAVE_PERSONA_AFTER
) -> DataFrame:
    """Whole profiles of dynamic personas used often enough in a session and not saved yet, by slug."""
    often = usage.where(F.col("uses") >= uses).select(
        F.substring("switch_id", F.lit(len(DYNAMIC) + 1), F.length("switch_id")).alias("id"), "name"
    )
    new = often.groupBy("id").agg(F.min("name").alias("name")).join(saved.select("id"), "id", "left_anti")
    return new.select("id", *[c.alias(f) for f, c in template_profile(F.col("name")).items()])


def recent_pairs(
    messages: DataFrame, key: str, by: str, n: int = fixed.RECENT_MESSAGES, text: str = "text"
) -> DataFrame:
    """Pairs among the last ``n`` messages of every session; an orphan reply in front drops out."""
    last = last_rows(messages, [key], [F.desc(by)], n, "__rn").drop("__rn")
    return pair_messages(last, key, by, text=text, keep_blank=True, order=Order((key,), by))


def _switched(turns: DataFrame, order: Order, initial: str, use_remainder: bool) -> DataFrame:
    heard = once(turns, "__switch", persona_switch(F.col("user"))).withColumn(
        "__persona", F.col("__switch.persona")
    )
    if use_remainder:
        heard = heard.withColumn(
            "user", F.when(F.col("__persona").isNotNull(), F.col("__switch.remainder")).otherwise(F.col("user"))
        )
    heard = settle(heard.drop("__switch"), order)
    voiced = settle(carry(heard, order, {"persona": F.col("__persona")}), order)
    return voiced.withColumn("persona", F.coalesce("persona", F.lit(initial))).drop("__persona")


def switch_store(
    turns: DataFrame,
    order: Order,
    initial: str = fixed.SWITCH_DEFAULT_PERSONA,
    *,
    use_remainder: bool = True,
    end: str = fixed.END_MARK,
) -> tuple[DataFrame, DataFrame]:
    """Replay with start-of-message persona switches as a history store: (turns with ``persona``, pieces).

    ``switch_told`` makes the prompts of chosen turns from it.
    """
    said = F.struct(F.col("user").alias("user"), F.coalesce("assistant", F.lit("")).alias("assistant"))
    voiced = _switched(turns, order, initial, use_remainder)
    return history_store(voiced, order, render.history_chat(F.array(said), end))


def switch_told(turns: DataFrame, pieces: DataFrame, keys: Sequence[str], end: str = fixed.END_MARK) -> DataFrame:
    """Prompts of the given turns of a ``switch_store``: the rows of a turn in order of ``part``."""
    prompt = F.concat(
        F.when(F.col("part") == 0, render.tagged_opening(render.persona_prompt(F.col("persona")), end)).otherwise(""),
        F.col("told"),
        F.when(F.col("part") == F.col("last"), render.tagged_question(F.col("user"), end)).otherwise(""),
    )
    return told_parts(turns, pieces, keys).withColumn("prompt", prompt).drop("told", "last")


def switch_replay(
    turns: DataFrame,
    order: Order,
    initial: str = fixed.SWITCH_DEFAULT_PERSONA,
    *,
    use_remainder: bool = True,
    pairs: int | None = None,
    end: str = fixed.END_MARK,
) -> DataFrame:
    """Replay with start-of-message persona switches: ``persona`` and the tagged ``prompt``.

    With a number of ``pairs`` there is one prompt a turn. Without, the whole history is told: the
    prompt of a turn is the text of its rows in order of ``part``.
    """
    if pairs is None:
        return switch_told(*switch_store(turns, order, initial, use_remainder=use_remainder, end=end), order.keys, end)
    told = carry_history(_switched(turns, order, initial, use_remainder), order, pairs)
    prompt = render.tagged_prompt(render.persona_prompt(F.col("persona")), F.col("history"), F.col("user"), end)
    return told.withColumn("prompt", prompt).drop("history")
