"""Text normalization and cutting, as Column -> Column functions."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley import fixed

# Java's \w, \s and \b are ASCII-only, so the Unicode classes are spelled out.
WORD = r"\p{L}\p{N}_"
SPACE = r"\p{IsWhite_Space}\x1c-\x1f"

_BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# a run that is not one plain blank already
_SPACE_RUN = f" [{SPACE}]+|[{SPACE}&&[^ ]][{SPACE}]*"
_TAG = "<[^>]+>"
_SYMBOL = rf"[^{WORD}{SPACE}.,!?;:'\"()\-]"
_REPEATED = rf"(?iu)(?<![{WORD}])([{WORD}]++)(?:[{SPACE}]+\1(?![{WORD}])){{2,}}"

# Code points that are starters, do not change under NFKC and never compose with a
# neighbour from the same list. First those below 256, which Java checks in a bit table;
# then Latin letters, basic Greek and Cyrillic letters, dashes and quotes, kana and the
# common Han block.
_LATIN1_STABLE = r"\x00-\x9F¡-§©«-®°±¶·»¿-ÿ"
_NFKC_STABLE = _LATIN1_STABLE + (
    r"Ā-ıĴ-ľŁ-ňŊ-žΑ-ΡΣ-ωЀ-џ"
    r"‐‒-‖‘-‣€ぁ-ゖァ-ヺ一-龥"
)
NEEDS_NFKC = f"[^{_NFKC_STABLE}]"


def needs_nfkc(text: Column) -> Column:
    """True when NFKC may change the text; the cheap test runs first."""
    return text.rlike(f"[^{_LATIN1_STABLE}]") & text.rlike(NEEDS_NFKC)


@F.pandas_udf(T.StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _nfkc_each(lists: pd.Series) -> pd.Series:
    def fold(items):
        return [x if x is None else unicodedata.normalize("NFKC", x) for x in items]

    return lists.map(fold, na_action="ignore")


def nfkc(text: Column) -> Column:
    """NFKC. Only texts holding a character that NFKC may touch travel to Python."""
    return F.coalesce(_nfkc(F.when(needs_nfkc(text), text)), text)


def nfkc_each(texts: Column) -> Column:
    """NFKC of every element of ARRAY<STRING> (Python functions cannot run inside lambdas)."""
    touched = F.exists(texts, needs_nfkc)
    return F.coalesce(_nfkc_each(F.when(touched, texts)), texts)


def strip(text: Column) -> Column:
    """Remove all Unicode white space at both ends (``trim`` removes blanks only)."""
    return F.btrim(text, F.lit(_BLANKS))


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, _SPACE_RUN, " "))


def normalize_basic(text: Column) -> Column:
    return squeeze(nfkc(text))


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, _TAG, " ")


def strip_symbols(text: Column) -> Column:
    return F.regexp_replace(text, _SYMBOL, " ")


def collapse_repeats(text: Column) -> Column:
    """A word said three or more times in a row is kept once."""
    return F.regexp_replace(text, _REPEATED, "$1")


def clean_folded(text: Column) -> Column:
    """The aggressive clean-up for text that is in NFKC already."""
    return squeeze(collapse_repeats(strip_symbols(strip_tags(text))))


def normalize_aggressive(text: Column) -> Column:
    return clean_folded(nfkc(text))


def normalize_aggressive_each(texts: Column) -> Column:
    return F.transform(nfkc_each(texts), clean_folded)


def slug(name: Column, letters: str = "ascii") -> Column:
    """Identifier from a display name.

    ``letters``: ``ascii`` keeps a-z and digits, ``letters`` any letter or decimal digit,
    ``alphanumeric`` also marks and other numbers and has no name for an empty result.
    """
    kept = {
        "ascii": "a-z0-9",
        "letters": r"\p{L}\p{Nd}",
        "alphanumeric": r"\p{L}\p{M}\p{N}",
    }[letters]
    trimmed = F.btrim(F.regexp_replace(F.lower(name), f"[^{kept}]+", "_"), F.lit("_"))
    if letters == "alphanumeric":
        return trimmed
    return F.coalesce(F.nullif(trimmed, F.lit("")), F.lit(fixed.DEFAULT_SLUG))


def cut_at_stop(text: Column, stops: Sequence[str]) -> Column:
    """Text up to the earliest occurrence of any stop sequence."""
    found = [F.nullif(F.instr(text, s), F.lit(0)) for s in stops if s]
    if not found:
        return text
    first = F.least(*found) if len(found) > 1 else found[0]
    return F.when(first.isNull(), text).otherwise(F.substring(text, F.lit(1), first - 1))


def attachment_block(name: Column, content: Column, limit: int = fixed.ATTACHMENT_BYTES) -> Column:
    """``[Attachment: name]`` block from the first ``limit`` bytes; bad bytes become U+FFFD."""
    head = F.make_valid_utf8(F.substring(content, 1, limit).cast("string"))
    return strip(F.concat(F.lit("[Attachment: "), name, F.lit("]\n"), strip(head)))


def attach(message: Column, block: Column) -> Column:
    """Append an attachment block to the message being written."""
    body = F.rtrim(message, F.lit(_BLANKS))
    return F.when(body == "", block).otherwise(F.concat(body, F.lit("\n\n"), block))


def salvage_json(text: Column) -> Column:
    """The outermost ``{...}`` of a model reply, code fences removed; null when there is none."""
    opened = F.regexp_replace(strip(text), rf"(?i)^```(?:json)?[{SPACE}]*", "")
    bare = F.regexp_replace(opened, rf"[{SPACE}]*```$", "")
    return F.nullif(F.regexp_extract(bare, r"(?s)\{.*\}", 0), F.lit(""))


def parse_salvaged(text: Column, schema: T.StructType) -> Column:
    """Struct read from :func:`salvage_json`; null when the text is no JSON object."""
    body = salvage_json(text)
    known = F.try_parse_json(body).isNotNull()
    return F.when(known, F.from_json(body, schema))
