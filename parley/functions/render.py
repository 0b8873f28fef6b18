"""Texts built from turns, profiles and states."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from parley import fixed
from parley.functions.arrays import let
from parley.functions.text import WORD, normalize_aggressive, normalize_aggressive_each, strip


def _block(mark: str, body: Column, end: str = "") -> Column:
    return F.concat(F.lit(f"{mark}\n"), body, F.lit(f"{end}\n"))


def _or_none(text: Column) -> Column:
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(fixed.NONE_BLOCK))


def valid_turn(user: Column, assistant: Column) -> Column:
    """Both sides there, a reply of 20 characters or more, and not punctuation alone."""
    return (
        (user != "")
        & (F.length(assistant) >= fixed.MIN_REPLY_CHARS)
        & F.concat(user, assistant).rlike(r"[\p{L}\p{N}]")
    )


def _clean_pairs(turns: Column) -> Column:
    """Turns with both sides normalized aggressively."""
    users = normalize_aggressive_each(F.transform(turns, lambda t: t["user"]))
    replies = normalize_aggressive_each(F.transform(turns, lambda t: t["assistant"]))
    return F.zip_with(
        users, replies, lambda u, a: F.struct(u.alias("user"), a.alias("assistant"))
    )


def _system(system: Column) -> Column:
    return normalize_aggressive(
        F.coalesce(F.nullif(system, F.lit("")), F.lit(fixed.CHAT_SYSTEM))
    )


def chat_head(system: Column) -> Column:
    """The system block that a training text begins with."""
    return _block(fixed.SYSTEM_MARK, _system(system))


def chat_body(turns: Column) -> Column:
    """The turns of a training text; those that normalize to nothing on either side are left out."""
    filled = F.filter(_clean_pairs(turns), lambda t: (t["user"] != "") & (t["assistant"] != ""))
    body = F.transform(
        filled,
        lambda t: F.concat(
            _block(fixed.USER_MARK, t["user"]), _block(fixed.ASSISTANT_MARK, t["assistant"])
        ),
    )
    return F.array_join(body, "")


def chat_text(system: Column, turns: Column) -> Column:
    """Training text; turns that normalize to nothing on either side are left out."""
    return F.concat(chat_head(system), chat_body(turns))


def category_text(system: Column, turns: Column) -> Column:
    """Training text of valid turns only, blocks joined by an extra newline; null if none is."""
    good = F.filter(_clean_pairs(turns), lambda t: valid_turn(t["user"], t["assistant"]))
    body = F.transform(
        good,
        lambda t: F.concat(
            F.lit("\n"),
            _block(fixed.USER_MARK, t["user"]),
            F.lit("\n"),
            _block(fixed.ASSISTANT_MARK, t["assistant"]),
        ),
    )
    text = strip(
        F.concat(_block(fixed.SYSTEM_MARK, _system(system)), F.array_join(body, ""))
    )
    return F.when(F.contains(text, F.lit(fixed.ASSISTANT_MARK)), text)


def history_chat(history: Column, end: str = "") -> Column:
    """Marked user / assistant blocks of ARRAY<STRUCT<user, assistant>>."""
    blocks = F.transform(
        history,
        lambda t: F.concat(
            _block(fixed.USER_MARK, t["user"], end), _block(fixed.ASSISTANT_MARK, t["assistant"], end)
        ),
    )
    return F.array_join(blocks, "")


def tagged_prompt(system: Column, history: Column, user: Column, end: str = fixed.END_MARK) -> Column:
    """System, earlier turns and the open user turn; ``end`` closes every block."""
    return F.concat(tagged_opening(system, end), history_chat(history, end), tagged_question(user, end))


def tagged_opening(system: Column, end: str = fixed.END_MARK) -> Column:
    return _block(fixed.SYSTEM_MARK, system, end)


def tagged_question(user: Column, end: str = fixed.END_MARK) -> Column:
    return F.concat(_block(fixed.USER_MARK, user, end), F.lit(f"{fixed.ASSISTANT_MARK}\n"))


def profile_prompt(profile: Mapping[str, Column]) -> Column:
    """System prompt of a character profile; the behaviour line only when there is one."""
    labelled = lambda label, key: F.concat(F.lit(f"{label}: "), profile[key])
    return F.concat_ws(
        "\n",
        F.concat(F.lit('You are "'), profile["name"], F.lit('".')),
        labelled("Role", "role"),
        labelled("Personality", "personality"),
        labelled("Speech style", "speech_style"),
        labelled("Background", "background"),
        labelled("Emotions", "emotions"),
        labelled("Motivations", "motivations"),
        F.concat(
            F.lit("Behavior rules: "), F.nullif(profile[fixed.PROFILE_OPTIONAL], F.lit(""))
        ),
        F.lit(fixed.KEEP_CHARACTER_LINE),
    )


def short_profile_prompt(profile: Mapping[str, Column]) -> Column:
    """System prompt of the six-field profile with a backstory; every line is always there."""
    labelled = lambda label, key: F.concat(F.lit(f"{label}: "), profile[key], F.lit("\n"))
    return F.concat(
        F.lit('You are "'),
        profile["name"],
        F.lit('".\n'),
        labelled("Personality", "personality"),
        labelled("Backstory", "backstory"),
        labelled("Speech style", "speech_style"),
        labelled("Behavior rules", "behavior_rules"),
        labelled("Emotional traits", "emotional_traits"),
        F.lit(fixed.KEEP_CHARACTER_SHORT),
    )


def persona_prompt(persona: Column) -> Column:
    """Rule list for a persona name, with hints for known kinds of persona."""
    name = strip(persona)
    hints = F.array_compact(
        F.array(
            *[
                F.when(F.lower(name).rlike("|".join(words)), F.lit(hint))
                for words, hint in fixed.PERSONA_HINTS
            ]
        )
    )
    hint_line = F.when(
        F.size(hints) > 0, F.concat(F.lit("\nPersona hints: "), F.array_join(hints, " "))
    ).otherwise("")
    rules = "\n".join(fixed.PERSONA_RULES)
    return F.concat(F.lit("You are "), name, F.lit(f".\n{rules}"), hint_line)


def world_block(
    location: Column,
    time: Column,
    current_event: Column,
    story_progress: Column,
    characters: Column | None = None,
    facts: Column | None = None,
) -> Column:
    """World state lines; characters and facts only where given (the short form has neither)."""
    line = lambda label, value: F.concat(F.lit(f"{label}: "), value)
    lines = [line("location", location), line("time", time)]
    if characters is not None:
        present = F.array_join(F.coalesce(characters, F.array().cast("array<string>")), ", ")
        lines.append(line("characters_present", _or_none(present)))
    lines += [line("current_event", current_event), line("story_progress", story_progress)]
    if facts is not None:
        known = F.transform(
            F.map_entries(facts),
            lambda e: F.concat(F.lit("- "), e["key"], F.lit(": "), e["value"]),
        )
        body = F.coalesce(F.array_join(known, "\n"), F.lit(""))
        lines.append(F.concat(F.lit("facts:\n"), _or_none(body)))
    return F.concat_ws("\n", *lines)


def emotion_block(character: Column, emotion: Column) -> Column:
    return F.concat(character, F.lit(": "), emotion)


def memory_block(memories: Column) -> Column:
    """Bullet list of ARRAY<STRING>, ``(none)`` when empty or null."""
    bullets = F.transform(memories, lambda m: F.concat(F.lit("- "), m))
    return _or_none(F.coalesce(F.array_join(bullets, "\n"), F.lit("")))


def memory_prompt(system: Column, memories: Column, user: Column) -> Column:
    """Short prompt with a "Relevant memory" list."""
    return F.concat(
        _block(fixed.SYSTEM_MARK, system),
        F.lit("Relevant memory:\n"),
        memory_block(memories),
        F.lit("\n"),
        _block(fixed.USER_MARK, user),
        F.lit(f"{fixed.ASSISTANT_MARK}\n"),
    )


def _history_lines(history: Column) -> Column:
    """History blocks, each pair followed by an empty line except the last."""
    pairs = F.transform(
        history,
        lambda t: F.concat(
            _block(fixed.USER_MARK, t["user"]), _block(fixed.ASSISTANT_MARK, t["assistant"])
        ),
    )
    return _or_none(F.coalesce(F.array_join(pairs, "\n"), F.lit("")))


def full_prompt(
    profile: Column, emotion: Column, world: Column, memories: Column, history: Column, user: Column
) -> Column:
    """The whole prompt of one turn from its rendered parts."""
    return F.concat(
        F.lit(f"{fixed.SYSTEM_MARK}\n{fixed.CHAT_SYSTEM}\n\nCHARACTER:\n"),
        profile,
        F.lit("\n\nEMOTION STATE:\n"),
        emotion,
        F.lit("\n\nWORLD STATE:\n"),
        world,
        F.lit("\n\nMEMORY:\n"),
        memory_block(memories),
        F.lit("\n\nCHAT HISTORY:\n"),
        _history_lines(history),
        F.lit(f"\n\n{fixed.USER_MARK}\n"),
        user,
        F.lit(f"\n{fixed.ASSISTANT_MARK}\n"),
    )


def store_prompt(
    character: Mapping[str, Column],
    world: Column,
    emotion: Column,
    memories: Column,
    history: Column,
    user: Column,
    layout: str = "line_per_part",
) -> Column:
    """Prompt of the chat-store apps.

    ``line_per_part`` ends every part with a newline of its own, so the system and world parts
    leave two empty lines; ``compact`` leaves one and has no final newline.
    """
    gap = "\n\n" if layout == "line_per_part" else "\n"
    labelled = lambda label, key: F.concat(F.lit(f"{label}: "), character[key], F.lit("\n"))
    return F.concat(
        F.lit(f"{fixed.SYSTEM_MARK}\n{fixed.CHAT_SYSTEM}\n\nCHARACTER:\n"),
        labelled("Name", "name"),
        labelled("Personality", "personality"),
        labelled("World", "world"),
        labelled("Tone", "tone"),
        F.lit("\nEMOTION STATE:\n"),
        emotion,
        F.lit(f"{gap}\nWORLD STATE:\n"),
        world,
        F.lit(f"{gap}\nMEMORY:\n"),
        memory_block(memories),
        F.lit("\n\nCHAT HISTORY:\n"),
        _history_lines(history),
        F.lit(f"\n\n{fixed.USER_MARK}\n"),
        user,
        F.lit(f"\n{fixed.ASSISTANT_MARK}" + ("\n" if layout == "line_per_part" else "")),
    )


def fallback_prompt(user: Column) -> Column:
    """Minimal prompt for a turn whose parts cannot be assembled."""
    return F.concat(
        F.lit(f"{fixed.SYSTEM_MARK}\n{fixed.FALLBACK_SYSTEM}\n{fixed.USER_MARK}\n"),
        user,
        F.lit(f"\n{fixed.ASSISTANT_MARK}\n"),
    )


def last_pieces(text: Column, n: int) -> Column:
    """Text of the last ``n`` tokens: words and single marks, with the blanks between them."""
    pieces = F.regexp_extract_all(
        text, F.lit(rf"\s*(?:[{WORD}]+|[^{WORD}\s])"), F.lit(0)
    )
    return let(
        pieces,
        lambda p: F.when(F.size(p) > n, F.array_join(F.slice(p, -n, n), "")).otherwise(text),
    )


def keep_tail(prompt: Column, max_chars: int = fixed.MAX_CHARS, max_tokens: int | None = None) -> Column:
    """Last ``max_tokens`` tokens, then last ``max_chars`` characters."""
    kept = last_pieces(prompt, max_tokens) if max_tokens is not None else prompt
    return F.right(kept, F.lit(max_chars))


def filled_profile(profile: Mapping[str, Column], names: Sequence[str]) -> Column:
    """True when every named field holds more than white space."""
    return F.forall(
        F.array(*[profile[n] for n in names]),
        lambda v: strip(F.coalesce(v, F.lit(""))) != "",
    )
