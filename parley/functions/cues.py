"""What one turn says about mood, scene and memory. Null means: no cue, keep the old value."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from parley import fixed
from parley.functions.text import WORD, normalize_basic, strip


def _mentions(text: Column, phrases: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(p)) for p in phrases])


def emotion_cue(
    user: Column, assistant: Column, cues: Mapping[str, Sequence[str]] = fixed.EMOTION_CUES
) -> Column:
    """First emotion in priority order with a cue (substring) in either side of the turn."""
    said = F.lower(F.concat_ws(" ", normalize_basic(user), normalize_basic(assistant)))
    chain = F
    for emotion, phrases in cues.items():
        chain = chain.when(_mentions(said, phrases), F.lit(emotion))
    return chain.otherwise(F.lit(None).cast("string"))


def known_emotion(emotion: Column) -> Column:
    return F.when(emotion.isin(fixed.EMOTIONS), emotion).otherwise(fixed.DEFAULT_EMOTION)


def world_cues(user: Column, assistant: Column) -> dict[str, Column]:
    """One nullable column per world field; values are the user's own words, stripped."""
    asked = F.lower(normalize_basic(user))
    answered = F.lower(normalize_basic(F.coalesce(assistant, F.lit(""))))
    words = strip(user)
    event = _mentions(asked, fixed.EVENT_CUES)
    return {
        "location": F.when(_mentions(asked, fixed.LOCATION_CUES), words),
        "time": F.when(_mentions(asked, fixed.TIME_CUES), words),
        "current_event": F.when(event, words),
        "story_progress": F.when(
            _mentions(answered, fixed.CLIFFHANGER_CUES), F.lit("cliffhanger")
        ).when(event, F.lit("in_progress")),
    }


def memory_candidate(user: Column, normalize: bool = True) -> Column:
    """Struct (text, tenths, score) for a message worth remembering, else null.

    Points are counted in integer tenths: two per phrase, one for length over 80, one for
    holding no question mark; three are needed and ten are the most.
    """
    text = normalize_basic(user) if normalize else strip(user)
    said = lambda p: text.rlike(rf"(?iu)(?<![{WORD}]){p}(?![{WORD}])").cast("int") * 2
    points = reduce(lambda a, b: a + b, [said(p) for p in fixed.IMPORTANT_PHRASES])
    points += (F.length(text) > 80).cast("int") + (~F.contains(text, F.lit("?"))).cast("int")
    capped = F.least(points, F.lit(10))
    return F.when(
        (text != "") & (points >= 3),
        F.struct(text.alias("text"), capped.alias("tenths"), (capped / 10.0).alias("score")),
    )
