"""Chat records of many shapes -> turns, texts and preference rows.

Works on the superset record schema: a key that a record lacks is null. Everything happens
inside the row, so none of it shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley import fixed
from parley.functions.arrays import first_filled, first_present, let
from parley.functions.text import normalize_aggressive, normalize_basic, strip

MESSAGE = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("role", "from", "content", "value", "text")]
)
_TEXT_KEYS = [
    "system", "instruction", "user", "prompt", "assistant", "response", "output", "input",
    "human", "chosen", "rejected", "act", "text", "role", "src", "tgt", "question", "answer",
    "character", "category",
]
RECORD = T.StructType(
    [T.StructField(k, T.StringType()) for k in _TEXT_KEYS]
    + [T.StructField(k, T.ArrayType(MESSAGE)) for k in ("messages", "conversations")]
)
TURNS = T.ArrayType(
    T.StructType([T.StructField("user", T.StringType()), T.StructField("assistant", T.StringType())])
)


def with_record_keys(df: DataFrame) -> DataFrame:
    """Add every probed key that a source lacks as null."""
    missing = {f.name: F.lit(None).cast(f.dataType) for f in RECORD if f.name not in df.columns}
    return df.withColumns(missing) if missing else df


def one_turn(user: Column, assistant: Column) -> Column:
    return F.array(F.struct(user.alias("user"), assistant.alias("assistant")))


def spoken(messages: Column, role_keys: list[str], text_keys: list[str]) -> Column:
    """Messages as (role, content), trying the given keys in order."""
    return F.transform(
        F.filter(messages, lambda m: m.isNotNull()),
        lambda m: F.struct(
            F.lower(first_filled(*[m[k] for k in role_keys])).alias("role"),
            first_filled(*[m[k] for k in text_keys]).alias("content"),
        ),
    )


def pair_up(messages: Column) -> Column:
    """(user, assistant) turns: an assistant answers the user message right before it.

    Other roles must be ignored between them, so they are dropped first; then "the most recent
    unanswered user message" is simply the element before.
    """
    talk = F.filter(messages, lambda m: m["role"].isin(fixed.USER_ROLES + fixed.ASSISTANT_ROLES))
    answered = let(
        talk,
        lambda s: F.transform(
            s,
            lambda m, i: F.when(
                m["role"].isin(fixed.ASSISTANT_ROLES)
                & F.get(s, i - 1)["role"].isin(fixed.USER_ROLES),
                F.struct(
                    F.get(s, i - 1)["content"].alias("user"), m["content"].alias("assistant")
                ),
            ),
        ),
    )
    return F.filter(answered, lambda p: p.isNotNull())


def turns_of_messages(messages: Column) -> tuple[Column, Column]:
    """(turns, system) of a ``messages`` list; blank messages do not count.

    Without any pair the last reply stands alone behind an empty user text.
    """
    said = F.filter(
        spoken(messages, ["role", "from"], ["content", "value", "text"]),
        lambda m: strip(m["content"]) != "",
    )
    replies = F.filter(said, lambda m: m["role"].isin(fixed.ASSISTANT_ROLES))
    alone = one_turn(F.lit(""), F.coalesce(F.try_element_at(replies, F.lit(-1))["content"], F.lit("")))
    turns = let(pair_up(said), lambda p: F.when(F.size(p) > 0, p).otherwise(alone))
    systems = F.filter(said, lambda m: m["role"] == fixed.SYSTEM_ROLE)
    return turns, F.try_element_at(systems, F.lit(-1))["content"]


def map_chat_record(df: DataFrame, default_system: str = fixed.CHAT_SYSTEM) -> DataFrame:
    """Add ``system`` and ``turns``; ``turns`` stays null for a record of no known shape."""
    df = with_record_keys(df)
    c = F.col
    flat = one_turn(
        first_filled(c("user"), c("prompt")),
        first_filled(c("assistant"), c("response"), c("output")),
    )
    listed, stated = turns_of_messages(c("messages"))
    base = F.coalesce(
        F.nullif(c("system"), F.lit("")), F.nullif(c("instruction"), F.lit("")), F.lit(default_system)
    )
    is_flat = c("user").isNotNull() | c("assistant").isNotNull()
    return df.withColumns(
        {
            "turns": F.when(is_flat, flat).when(c("messages").isNotNull(), listed),
            "system": F.when(is_flat, base).otherwise(F.coalesce(stated, base)),
        }
    )


def conversation_turns(conversations: Column) -> Column:
    """Turns of a ``conversations`` list; here blank messages count."""
    return pair_up(spoken(conversations, ["from", "role"], ["value", "content"]))


def map_category_record(df: DataFrame, default_system: str = fixed.CHAT_SYSTEM) -> DataFrame:
    """Add ``system``, ``turns`` and ``rendered`` by the first branch whose keys are present.

    Order: ``conversations``, ``instruction`` + ``output``, ``act`` + ``prompt``, ``text``.
    """
    df = with_record_keys(df)
    c = F.col
    both = lambda a, b: c(a).isNotNull() & c(b).isNotNull()
    instruct = strip(
        F.concat(c("instruction"), F.lit("\n"), F.coalesce(c("input"), F.lit("")))
    )
    is_list, is_task, is_act = c("conversations").isNotNull(), both("instruction", "output"), both("act", "prompt")
    marked = F.contains(c("text"), F.lit(fixed.USER_MARK)) & F.contains(
        c("text"), F.lit(fixed.ASSISTANT_MARK)
    )
    return df.withColumns(
        {
            "turns": F.when(is_list, conversation_turns(c("conversations")))
            .when(is_task, one_turn(instruct, c("output")))
            .when(is_act, one_turn(F.lit(fixed.INTRODUCE_USER), c("prompt"))),
            "rendered": F.when(~is_list & ~is_task & ~is_act & marked, c("text")),
            "system": F.when(
                ~is_list & ~is_task & is_act, F.concat(F.lit(fixed.ACT_SYSTEM), c("act"))
            ).otherwise(F.coalesce(F.nullif(c("system"), F.lit("")), F.lit(default_system))),
        }
    )


def marker_count(text: Column) -> Column:
    """Occurrences of the assistant marker."""
    width = len(fixed.ASSISTANT_MARK)
    return (
        (F.length(text) - F.length(F.replace(text, F.lit(fixed.ASSISTANT_MARK), F.lit("")))) / width
    ).cast("int")


def rendered_text(text: Column) -> Column:
    return normalize_aggressive(text)


def stage_one_pair() -> tuple[Column, Column]:
    """(user, assistant) of an instruction record: last two messages, else flat keys."""
    c = F.col
    at = lambda i: F.coalesce(F.try_element_at(c("messages"), F.lit(i))["content"], F.lit(""))
    listed = F.coalesce(F.size(c("messages")) >= 2, F.lit(False))
    user = F.when(listed, at(-2)).otherwise(first_filled(c("instruction"), c("prompt"), c("input")))
    reply = F.when(listed, at(-1)).otherwise(first_filled(c("output"), c("response")))
    return user, reply


def stage_two_pair() -> tuple[Column, Column]:
    c = F.col
    return (
        first_filled(c("prompt"), c("human"), c("input")),
        first_filled(c("chosen"), c("response"), c("output")),
    )


def sft_example(user: Column, assistant: Column, system: str = fixed.SFT_SYSTEM) -> Column:
    """Struct (prompt, response, text); null when either side has fewer than two characters."""

    def build(t: Column) -> Column:
        prompt = F.concat(
            F.lit(f"{fixed.SYSTEM_MARK}\n{system}\n{fixed.USER_MARK}\n"),
            t["u"],
            F.lit(f"\n{fixed.ASSISTANT_MARK}\n"),
        )
        long_enough = (F.length(t["u"]) >= fixed.MIN_SFT_CHARS) & (
            F.length(t["a"]) >= fixed.MIN_SFT_CHARS
        )
        return F.when(
            long_enough,
            F.struct(
                prompt.alias("prompt"),
                t["a"].alias("response"),
                F.concat(prompt, t["a"]).alias("text"),
            ),
        )

    both = F.struct(normalize_basic(user).alias("u"), normalize_basic(assistant).alias("a"))
    return let(both, build)


def preference_row() -> Column:
    """Struct (prompt, chosen, rejected), normalized; null unless all three are there."""
    c = F.col
    row = F.struct(
        normalize_basic(first_filled(c("prompt"), c("human"))).alias("prompt"),
        normalize_basic(first_filled(c("chosen"))).alias("chosen"),
        normalize_basic(first_filled(c("rejected"))).alias("rejected"),
    )
    return let(
        row,
        lambda r: F.when((r["prompt"] != "") & (r["chosen"] != "") & (r["rejected"] != ""), r),
    )


def single_message_text(role: Column, text: Column) -> Column:
    content = strip(F.coalesce(text, F.lit("")))
    name = F.lower(F.coalesce(role, F.lit("")))
    return strip(
        F.when(name == "assistant", F.concat(F.lit("Assistant: "), content))
        .when(name == "prompter", F.concat(F.lit("User: "), content))
        .otherwise(content)
    )


def speaker(role: Column) -> Column:
    """Display name of a role in a transcript."""
    name = F.lower(role)
    return (
        F.when(name.isin(fixed.TRANSCRIPT_USER_ROLES), F.lit("User"))
        .when(name.isin(fixed.ASSISTANT_ROLES), F.lit("Assistant"))
        .otherwise(F.concat(F.upper(F.substring(name, 1, 1)), F.substring(name, F.lit(2), F.length(name))))
    )


def transcript_line(role: Column, value: Column) -> Column:
    return strip(F.concat(speaker(role), F.lit(": "), value))


def transcript(messages: Column) -> Column:
    """``User: ...`` / ``Assistant: ...`` lines of a message list, empty values skipped."""
    filled = F.filter(messages, lambda m: first_present(m["value"], m["text"]) != "")
    lines = F.transform(
        filled,
        lambda m: transcript_line(
            F.coalesce(m["from"], m["role"], F.lit("user")), first_present(m["value"], m["text"])
        ),
    )
    return strip(F.array_join(lines, "\n"))


def transcript_record(question_keys: list[str], answer_keys: list[str]) -> Column:
    """Transcript of ``conversations``, else one question and answer from flat keys."""
    pair = F.concat(
        F.lit("User: "),
        first_present(*[F.col(k) for k in question_keys]),
        F.lit("\nAssistant: "),
        first_present(*[F.col(k) for k in answer_keys]),
    )
    listed = F.col("conversations").isNotNull()
    return strip(F.when(listed, transcript(F.col("conversations"))).otherwise(pair))
