"""Queries of conversation replay, prompts and memory."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley import fixed
from parley.catalog.base import CHAT, chat, pairs_sql, query, squeeze_sql, table, texts
from parley.functions import cues, render
from parley.functions.persona import persona_instruction, persona_switch
from parley.functions.vectors import embed
from parley.operators import memory as M
from parley.operators import pairing, replay
from parley.operators import prompts as P
from parley.plans.folds import measure
from parley.plans.once import once
from parley.plans.ranks import number_rows
from parley.session import cut_lineage

NL = "chr(10)"
PAIRS = f"{CHAT}, {pairs_sql('chat', 'p0')}, pairs AS (SELECT *, conv_id % 10 AS user_id FROM p0)"


def _turns(spark, sf):
    """Answered turns of the cue-prefixed chats, and the order for folds over them."""
    messages = chat(spark, sf)
    order = measure(messages, ["conv_id"], "turn")
    return pairing.pair_messages(messages, order=order).drop("user_turn"), order


def _profiles(spark, sf):
    """Five stored profiles; one is the default character and one is asked for in the chats."""
    key, name = F.col("r_regionkey"), F.col("r_name")
    text = lambda word: F.concat(F.lit(f"{word} of "), name)
    return table(spark, sf, "region").select(
        F.when(key == 0, "wizard").when(key == 1, "pirate").otherwise(F.lower(name)).alias("id"),
        F.concat(F.lit("Captain "), name).alias("name"),
        text("guard").alias("role"),
        text("calm").alias("personality"),
        text("voice").alias("speech_style"),
        text("child").alias("background"),
        text("joy").alias("emotions"),
        text("peace").alias("motivations"),
        F.when(key != 1, text("rule")).alias("behavior_rules"),
    )


PROFILES = (
    "profiles AS (SELECT CASE r_regionkey WHEN 0 THEN 'wizard' WHEN 1 THEN 'pirate' ELSE lower(r_name) END AS id, "
    "'Captain ' || r_name AS name, r_name AS r, r_regionkey AS k FROM region)"
)

_T = "trim({}, chr(10) || chr(32))"


def _persona_sql(source: str, text: str, name: str = "heard") -> str:
    """CTEs adding pname, remainder to every row of ``source``."""
    parts, choices = [], {"pname": "", "remainder": ""}
    edge = "(?is)(?:^|[^\\p{L}\\p{N}_])"
    for i, lead in enumerate(fixed.PERSONA_LEADS):
        pattern = f"{edge}({lead}{fixed.PERSONA_ARTICLE}{fixed.PERSONA_NAME}.*)"
        parts.append(f"regexp_extract(t, '{pattern}', 1) AS tail{i}")
        parts.append(f"{_T.format(f'''regexp_extract(t, '{pattern}', 2)''')} AS n{i}")
    raw = ", ".join(parts)
    cuts = []
    split = "(?is)^(.*?)\\s+and\\s+(.*)$"
    for i in range(len(fixed.PERSONA_LEADS)):
        low = f"lower(' ' || n{i} || ' ')"
        marks = "".join(
            f" WHEN strpos({low}, '{m}') > 0 THEN {{}}" for m in fixed.PERSONA_SUFFIXES
        )
        names = [f"trim(left(n{i}, strpos({low}, '{m}')::BIGINT - 1))" for m in fixed.PERSONA_SUFFIXES]
        name_case = "CASE" + marks.format(*names)
        name_case += f" WHEN regexp_matches(n{i}, '{split}') THEN {_T.format(f'''regexp_extract(n{i}, '{split}', 1)''')} ELSE n{i} END"
        rest_case = "CASE" + marks.format(*["''"] * len(names))
        rest_case += f" WHEN regexp_matches(n{i}, '{split}') THEN {_T.format(f'''regexp_extract(n{i}, '{split}', 2)''')} ELSE '' END"
        tail = f"regexp_extract({_T.format(f'tail{i}')}, '(?i)\\s+and\\s+([^\\n]+)$', 1)"
        cuts.append(f"{name_case} AS c{i}, coalesce(nullif({rest_case}, ''), nullif({_T.format(tail)}, ''), 'Begin.') AS m{i}")
    generic = ", ".join(f"'{g}'" for g in fixed.GENERIC_PERSONAS)
    ok = lambda i: f"(tail{i} <> '' AND length(c{i}) >= 2 AND lower(c{i}) NOT IN ({generic}))"
    pick = lambda c: "CASE " + " ".join(
        f"WHEN {ok(i)} THEN {c}{i}" for i in range(len(fixed.PERSONA_LEADS))
    ) + " END"
    return (
        f"{name}_t AS (SELECT *, {_T.format(text)} AS t FROM {source}), "
        f"{name}_raw AS (SELECT *, {raw} FROM {name}_t), "
        f"{name}_cut AS (SELECT *, {', '.join(cuts)} FROM {name}_raw), "
        f"{name} AS (SELECT *, {pick('c')} AS pname, {pick('m')} AS remainder FROM {name}_cut)"
    )


@query(
    "persona_instructions",
    f"WITH {CHAT}, {_persona_sql('chat', 'text')} SELECT conv_id, turn, pname AS name, remainder, "
    "CASE WHEN pname IS NOT NULL THEN t END AS raw FROM heard",
)
def persona_instructions(spark, sf):
    return (
        once(chat(spark, sf), "p", persona_instruction(F.col("text")))
        .select("conv_id", "turn", "p.name", "p.remainder", "p.raw")
    )


@query(
    "persona_instructions_in_documents",
    f"WITH {_persona_sql('documents', 'text')} SELECT doc_id, pname AS name, remainder FROM heard",
)
def persona_instructions_in_documents(spark, sf):
    return (
        once(texts(spark, sf, "documents", "doc_id", "text"), "p", persona_instruction(F.col("text")))
        .select("doc_id", "p.name", "p.remainder")
    )


def _switch_sql(source: str, text: str, name: str = "sw") -> str:
    """CTEs adding persona and rest (the remainder) by the start-of-message rules."""
    leads = "|".join(fixed.SWITCH_LEADS)
    cut = "(?is)^(.*?)(" + "|".join(fixed.SWITCH_SEPARATORS) + ")(.*)$"
    raw = f"trim({_T.format(f'''regexp_extract(t, '(?i)^(?:{leads})([^\\n]+)$', 1)''')}, '.')"
    lead_steps, prev = [], "r0"
    for i, lead in enumerate(fixed.SWITCH_REMAINDER_LEADS, 1):
        lead_steps.append(
            f"{name}_r{i} AS (SELECT *, CASE WHEN starts_with(lower({prev}), '{lead}') THEN "
            f"{_T.format(f'substr({prev}, {len(lead) + 1})')} ELSE {prev} END AS r{i} FROM {name}_r{i - 1})"
        )
        prev = f"r{i}"
    empty = "|".join(fixed.SWITCH_EMPTY_LEADS)
    return (
        f"{name}_t AS (SELECT *, {_T.format(text)} AS t FROM {source}), "
        f"{name}_raw AS (SELECT *, {raw} AS raw FROM {name}_t), "
        f"{name}_r0 AS (SELECT *, CASE WHEN regexp_matches(raw, '{cut}') THEN "
        f"trim(regexp_extract(raw, '{cut}', 1), ' ,.;:-') ELSE raw END AS head, "
        f"CASE WHEN regexp_matches(raw, '{cut}') THEN trim(regexp_extract(raw, '{cut}', 3), ' ,.;:-') ELSE '' END AS r0 "
        f"FROM {name}_raw), {', '.join(lead_steps)}, "
        f"{name} AS (SELECT *, nullif(head, '') AS persona, CASE WHEN head = '' THEN {text} "
        f"WHEN {prev} = '' OR regexp_matches(lower({prev}), '^(?:{empty})') THEN 'Hello.' ELSE {prev} END AS rest FROM {name}_{prev})"
    )


@query(
    "persona_switches",
    f"WITH {CHAT}, {_switch_sql('chat', 'text')} SELECT conv_id, turn, persona, rest AS remainder FROM sw",
)
def persona_switches(spark, sf):
    return (
        once(chat(spark, sf), "s", persona_switch(F.col("text")))
        .select("conv_id", "turn", "s.persona", "s.remainder")
    )


def _emotion_sql(user: str, reply: str) -> str:
    said = f"lower({squeeze_sql(user)} || ' ' || {squeeze_sql(reply)})"
    whens = " ".join(
        f"WHEN regexp_matches({said}, '{'|'.join(words)}') THEN '{emotion}'"
        for emotion, words in fixed.EMOTION_CUES.items()
    )
    return f"CASE {whens} END"


def _world_sql(user: str, reply: str) -> dict[str, str]:
    asked, answered = f"lower({squeeze_sql(user)})", f"lower({squeeze_sql(reply)})"
    has = lambda text, words: f"regexp_matches({text}, '{'|'.join(words)}')"
    words = _T.format(user)
    event = has(asked, fixed.EVENT_CUES)
    return {
        "location": f"CASE WHEN {has(asked, fixed.LOCATION_CUES)} THEN {words} END",
        "time": f"CASE WHEN {has(asked, fixed.TIME_CUES)} THEN {words} END",
        "current_event": f"CASE WHEN {event} THEN {words} END",
        "story_progress": f"CASE WHEN {has(answered, fixed.CLIFFHANGER_CUES)} THEN 'cliffhanger' "
        f"WHEN {event} THEN 'in_progress' END",
    }


@query(
    "emotion_cues",
    f"WITH {PAIRS} SELECT conv_id, turn, {_emotion_sql('user_text', 'reply')} AS cue FROM pairs",
)
def emotion_cues(spark, sf):
    turns, _ = _turns(spark, sf)
    cue = cues.emotion_cue(F.col("user"), F.col("assistant"))
    return turns.select("conv_id", "turn", cue.alias("cue"))


@query(
    "emotion_totals_in_documents",
    f"SELECT source, coalesce({_emotion_sql('text', chr(39) * 2)}, 'neutral') AS emotion, count(*) AS rows "
    "FROM documents GROUP BY 1, 2",
)
def emotion_totals_in_documents(spark, sf):
    cue = cues.known_emotion(cues.emotion_cue(F.col("text"), F.lit("")))
    return (
        texts(spark, sf, "documents", "source", "text")
        .select("source", cue.alias("emotion"))
        .groupBy("source", "emotion")
        .agg(F.count("*").alias("rows"))
    )


@query(
    "world_cues",
    f"WITH {PAIRS} SELECT conv_id, turn, "
    + ", ".join(f"{c} AS {n}" for n, c in _world_sql("user_text", "reply").items())
    + " FROM pairs",
)
def world_cues(spark, sf):
    turns, _ = _turns(spark, sf)
    named = cues.world_cues(F.col("user"), F.col("assistant"))
    return turns.select("conv_id", "turn", *[c.alias(n) for n, c in named.items()])


_UPTO = "OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND {})"
_SLUG = (
    "coalesce(nullif(trim(regexp_replace(regexp_replace(lower(pname), '[^a-z0-9_]+', '_', 'g'), '_+', '_', 'g'), "
    "'_'), ''), 'character')"
)


def _states_sql(end: str, history: int = 12) -> str:
    """CTE chain ending in ``states``: one row per turn, ``end`` closing the frame of the state."""
    world = _world_sql("u", "reply")
    cue_columns = ", ".join(f"{c} AS cue_{n}" for n, c in world.items())
    carried = ", ".join(
        f"coalesce(last_value(cue_{n} IGNORE NULLS) {_UPTO.format(end)}, '{fixed.WORLD_DEFAULTS[n]}') AS {n}"
        for n in world
    )
    block = f"'<|user|>' || {NL} || u || {NL} || '<|assistant|>' || {NL} || reply || {NL}"
    return f"""
    {PAIRS}, {PROFILES}, {_persona_sql('pairs', 'user_text')},
    slugged AS (SELECT *, coalesce(remainder, user_text) AS u,
      CASE WHEN pname IS NOT NULL THEN {_SLUG} END AS slug FROM heard),
    known AS (SELECT s.*, p.name AS known_name, CASE WHEN pname IS NULL THEN NULL WHEN p.id IS NOT NULL THEN slug
      ELSE 'dynamic/' || slug END AS switch_id FROM slugged s LEFT JOIN profiles p ON s.slug = p.id),
    called AS (SELECT *, CASE WHEN pname IS NOT NULL THEN coalesce(known_name,
      first_value(pname) OVER (PARTITION BY conv_id, switch_id ORDER BY turn)) END AS switch_name FROM known),
    voiced AS (SELECT *,
      coalesce(last_value(switch_id IGNORE NULLS) {_UPTO.format('CURRENT ROW')}, 'wizard') AS character_id,
      coalesce(last_value(switch_name IGNORE NULLS) {_UPTO.format('CURRENT ROW')}, 'Captain AFRICA') AS character_name,
      {_emotion_sql('u', 'reply')} AS cue, {cue_columns},
      list({block}) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN {history} PRECEDING AND 1 PRECEDING) AS hist
      FROM called),
    states AS (SELECT conv_id, user_id, turn, u, reply, character_id, character_name, switch_id, switch_name, {carried},
      coalesce(array_to_string(hist, {NL}), '') AS hist_text, coalesce(len(hist), 0) AS hist_len,
      coalesce(last_value(cue IGNORE NULLS) OVER (PARTITION BY conv_id, character_id ORDER BY turn
        ROWS BETWEEN UNBOUNDED PRECEDING AND {end}), 'neutral') AS emotion FROM voiced)"""


AFRICA = "Captain AFRICA"


def _states(spark, sf, before: bool):
    turns, order = _turns(spark, sf)
    return replay.replay_states(
        turns, _profiles(spark, sf), order, initial_name=AFRICA, before=before
    )


_STATE_COLUMNS = [
    "conv_id", "turn", "character_id", "character_name", "emotion", "location", "time",
    "current_event", "story_progress",
]


@query(
    "state_after_turn",
    f"WITH {_states_sql('CURRENT ROW')} SELECT {', '.join(_STATE_COLUMNS)}, u AS user FROM states",
)
def state_after_turn(spark, sf):
    return _states(spark, sf, before=False).select(*_STATE_COLUMNS, "user")


@query(
    "state_before_turn",
    f"WITH {_states_sql('1 PRECEDING')} SELECT {', '.join(_STATE_COLUMNS)} FROM states",
)
def state_before_turn(spark, sf):
    return _states(spark, sf, before=True).select(*_STATE_COLUMNS)


_FACT = "'- gate: ' || place || chr(10) || '- key ' || s_suppkey || ': ' || who"


@query(
    "world_blocks",
    "SELECT s_suppkey, 'location: ' || place || chr(10) || 'time: dusk' || chr(10) || 'characters_present: ' || "
    "CASE WHEN s_suppkey % 3 = 0 THEN '(none)' ELSE who || ', guard' END || chr(10) || 'current_event: none' || chr(10) "
    f"|| 'story_progress: begin' || chr(10) || 'facts:' || chr(10) || CASE WHEN s_suppkey % 2 = 0 THEN {_FACT} ELSE '(none)' "
    "END AS block FROM (SELECT s_suppkey, s_name AS who, n_name AS place FROM supplier JOIN nation "
    "ON s_nationkey = n_nationkey)",
)
def world_blocks(spark, sf):
    """World state with facts and several characters, and without either."""
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    rows = table(spark, sf, "supplier").join(nation, "s_nationkey")
    key = F.concat(F.lit("key "), F.col("s_suppkey").cast("string"))
    facts = F.when(F.col("s_suppkey") % 2 == 0, F.create_map(F.lit("gate"), F.col("n_name"), key, F.col("s_name")))
    there = F.when(F.col("s_suppkey") % 3 != 0, F.array("s_name", F.lit("guard")))
    block = render.world_block(
        F.col("n_name"), F.lit("dusk"), F.lit("none"), F.lit("begin"),
        F.coalesce(there, F.array().cast("array<string>")),
        F.coalesce(facts, F.create_map().cast("map<string,string>")),
    )
    return rows.select("s_suppkey", block.alias("block"))


@query(
    "emotion_carry",
    f"WITH {PAIRS}, c AS (SELECT *, {_emotion_sql('user_text', 'reply')} AS cue FROM pairs) "
    "SELECT conv_id, turn, coalesce(last_value(cue IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn "
    "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'neutral') AS emotion FROM c",
)
def emotion_carry(spark, sf):
    turns, order = _turns(spark, sf)
    one = turns.withColumn("character_id", F.lit("wizard"))
    return replay.carry_emotion(one, order).select("conv_id", "turn", "emotion")


@query(
    "world_carry",
    f"WITH {PAIRS}, c AS (SELECT *, "
    + ", ".join(f"{c} AS cue_{n}" for n, c in _world_sql("user_text", "reply").items())
    + " FROM pairs) SELECT conv_id, turn, "
    + ", ".join(
        f"coalesce(last_value(cue_{n} IGNORE NULLS) {_UPTO.format('CURRENT ROW')}, '{d}') AS {n}"
        for n, d in fixed.WORLD_DEFAULTS.items()
    )
    + " FROM c",
)
def world_carry(spark, sf):
    turns, order = _turns(spark, sf)
    return replay.carry_world(turns, order).select("conv_id", "turn", *fixed.WORLD_DEFAULTS)


@query(
    "persona_usage",
    f"WITH {_states_sql('CURRENT ROW')} SELECT conv_id, switch_id, count(*) AS uses, arg_min(switch_name, turn) AS name "
    "FROM states WHERE starts_with(switch_id, 'dynamic/') GROUP BY conv_id, switch_id",
)
def persona_usage(spark, sf):
    turns, order = _turns(spark, sf)
    switched = replay.resolve_switches(replay.hear_personas(turns), _profiles(spark, sf), order)
    return replay.persona_usage(switched, order)


@query(
    "personas_to_save",
    f"WITH {_states_sql('CURRENT ROW')}, usage AS (SELECT conv_id, substr(switch_id, 9) AS id, count(*) AS uses, "
    "arg_min(switch_name, turn) AS name FROM states WHERE starts_with(switch_id, 'dynamic/') GROUP BY 1, 2), "
    "saved AS (SELECT id FROM usage WHERE conv_id % 5 = 0) "
    "SELECT id, name, name AS role, "
    + ", ".join(f"'{t.replace(chr(39), chr(39) * 2)}' AS {f}" for f, t in fixed.PROFILE_TEMPLATE.items())
    + ", 'Respond like ' || name || '; do not mention being an AI unless asked.' AS behavior_rules FROM (SELECT id, "
    "min(name) AS name FROM usage WHERE uses >= 1 AND id NOT IN (SELECT id FROM saved) GROUP BY id)",
)
def personas_to_save(spark, sf):
    usage = persona_usage(spark, sf)
    # some are saved already: those heard in every fifth conversation
    saved = usage.where(F.col("conv_id") % 5 == 0).select(
        F.substring("switch_id", F.lit(9), F.length("switch_id")).alias("id")
    )
    return replay.personas_to_save(usage, saved, uses=1)


@query(
    "history_windows",
    f"WITH {PAIRS} SELECT conv_id, turn, coalesce(array_to_string(list(user_text || '|' || reply) OVER "
    "(PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), '||'), '') AS history FROM pairs",
)
def history_windows(spark, sf):
    turns, order = _turns(spark, sf)
    told = replay.carry_history(turns, order, 2)
    joined = F.transform("history", lambda h: F.concat_ws("|", h["user"], h["assistant"]))
    return told.select("conv_id", "turn", F.array_join(joined, "||").alias("history"))


@query(
    "recent_pairs",
    f"WITH {CHAT}, last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn "
    f"FROM chat) WHERE rn <= 5), {pairs_sql('last')} SELECT conv_id, turn, user_text AS user, reply AS assistant FROM pairs",
)
def recent_pairs(spark, sf):
    pairs = replay.recent_pairs(chat(spark, sf), "conv_id", "turn", 5)
    return pairs.select("conv_id", "turn", "user", "assistant")


def _persona_prompt_sql(persona: str) -> str:
    rules = f" || {NL} || ".join("'" + r.replace("'", "''") + "'" for r in fixed.PERSONA_RULES)
    hints = ", ".join(
        f"CASE WHEN regexp_matches(lower({persona}), '{'|'.join(words)}') THEN '{hint}' END"
        for words, hint in fixed.PERSONA_HINTS
    )
    joined = f"concat_ws(' ', {hints})"
    return (
        f"'You are ' || {persona} || '.' || {NL} || {rules} || CASE WHEN {joined} = '' THEN '' "
        f"ELSE {NL} || 'Persona hints: ' || {joined} END"
    )


_SAID = f"""
    {PAIRS}, {_switch_sql('pairs', 'user_text')},
    said AS (SELECT conv_id, turn, rest AS u, reply,
      coalesce(last_value(persona IGNORE NULLS) {_UPTO.format('CURRENT ROW')}, '{fixed.SWITCH_DEFAULT_PERSONA}') AS persona
      FROM sw),
    lined AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS no,
      '<|user|>' || {NL} || u || '</s>' || {NL} || '<|assistant|>' || {NL} || reply || '</s>' || {NL} AS line FROM said)"""


@query(
    "switch_history_pieces",
    f"WITH {_SAID} SELECT conv_id, no // {replay.HISTORY_PART} AS part, string_agg(line, '' ORDER BY no) AS told FROM lined GROUP BY ALL",
)
def switch_history_pieces(spark, sf):
    """Whole histories, every line written once."""
    return replay.switch_store(*_turns(spark, sf))[1].select("conv_id", "part", "told")


@query(
    "switch_history_turns",
    f"WITH {_SAID} SELECT conv_id, turn, persona, u AS user, no // {replay.HISTORY_PART} AS last, CAST(coalesce(sum(length(line)) OVER ("
    f"PARTITION BY conv_id, no // {replay.HISTORY_PART} ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS upto FROM lined",
)
def switch_history_turns(spark, sf):
    """What of the pieces every turn's prompt tells."""
    return replay.switch_store(*_turns(spark, sf))[0].select("conv_id", "turn", "persona", "user", "last", "upto")


@query(
    "switch_prompts",
    f"""
    WITH {_SAID},
    parts AS (SELECT *, no // {replay.HISTORY_PART} AS last, unnest(range(0, no // {replay.HISTORY_PART} + 1)) AS part FROM lined),
    told AS (SELECT p.conv_id, p.turn, p.part, string_agg(e.line, '' ORDER BY e.no) AS hist FROM parts p JOIN lined e
      ON e.conv_id = p.conv_id AND e.no // {replay.HISTORY_PART} = p.part AND e.no < p.no GROUP BY p.conv_id, p.turn, p.part)
    SELECT p.conv_id, p.turn, p.persona, p.part, CASE WHEN p.part = 0 THEN '<|system|>' || {NL}
      || {_persona_prompt_sql('p.persona')} || '</s>' || {NL} ELSE '' END || coalesce(hist, '') || CASE WHEN p.part = p.last
      THEN '<|user|>' || {NL} || u || '</s>' || {NL} || '<|assistant|>' || {NL} ELSE '' END AS prompt
    FROM parts p LEFT JOIN told t ON p.conv_id = t.conv_id AND p.turn = t.turn AND p.part = t.part""",
)
def switch_prompts(spark, sf):
    turns, order = _turns(spark, sf)
    return replay.switch_replay(turns, order).select("conv_id", "turn", "persona", "part", "prompt")


_TEMPLATE = {
    "Role": "character_name",
    **{
        label: f"'{fixed.PROFILE_TEMPLATE[f].replace(chr(39), chr(39) * 2)}'"
        for label, f in (
            ("Personality", "personality"), ("Speech style", "speech_style"), ("Background", "background"),
            ("Emotions", "emotions"), ("Motivations", "motivations"),
        )
    },
}
_MADE = (
    f"'You are \"' || character_name || '\".' || {NL} || "
    + f" || {NL} || ".join(f"'{label}: ' || {value}" for label, value in _TEMPLATE.items())
    + f" || {NL} || 'Behavior rules: Respond like ' || character_name || '; do not mention being an AI unless asked.'"
    + f" || {NL} || '{fixed.KEEP_CHARACTER_LINE}'"
)
_STORED = (
    f"'You are \"' || p.name || '\".' || {NL} || 'Role: guard of ' || r || {NL} || 'Personality: calm of ' || r || {NL} || "
    f"'Speech style: voice of ' || r || {NL} || 'Background: child of ' || r || {NL} || 'Emotions: joy of ' || r || {NL} || "
    f"'Motivations: peace of ' || r || {NL} || CASE WHEN k <> 1 THEN 'Behavior rules: rule of ' || r || {NL} ELSE '' END || "
    f"'{fixed.KEEP_CHARACTER_LINE}'"
)
def _prompt_sql(states: str = "states", memory: str = "'(none)'") -> str:
    """CTEs ending in ``whole``: the prompt of every row of ``states``."""
    return f"""
    texts AS (SELECT s.*, CASE WHEN starts_with(character_id, 'dynamic/') THEN {_MADE} ELSE {_STORED} END AS who
      FROM {states} s LEFT JOIN profiles p ON s.character_id = p.id),
    whole AS (SELECT *, '<|system|>' || {NL} || '{fixed.CHAT_SYSTEM}' || {NL} || {NL} || 'CHARACTER:' || {NL} || who
      || {NL} || {NL} || 'EMOTION STATE:' || {NL} || character_id || ': ' || emotion || {NL} || {NL} || 'WORLD STATE:' || {NL}
      || 'location: ' || location || {NL} || 'time: ' || time || {NL} || 'characters_present: ' || character_name || {NL}
      || 'current_event: ' || current_event || {NL} || 'story_progress: ' || story_progress || {NL} || 'facts:' || {NL}
      || '(none)' || {NL} || {NL} || 'MEMORY:' || {NL} || {memory} || {NL} || {NL} || 'CHAT HISTORY:' || {NL}
      || coalesce(nullif(hist_text, ''), '(none)') || {NL} || {NL} || '<|user|>' || {NL} || u || {NL} || '<|assistant|>'
      || {NL} AS prompt FROM texts)"""


_PROMPT = _prompt_sql()


@query(
    "turn_prompts",
    f"WITH {_states_sql('1 PRECEDING')}, {_PROMPT} SELECT conv_id, turn, prompt FROM whole",
)
def turn_prompts(spark, sf):
    turns, order = _turns(spark, sf)
    prompts = P.replay_prompts(turns, _profiles(spark, sf), order, initial_name=AFRICA)
    return prompts.select("conv_id", "turn", "prompt")


_PIECE = "\\s*(?:[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s])"


@query(
    "truncated_prompts",
    f"""WITH {_states_sql('1 PRECEDING')}, {_PROMPT},
    pieces AS (SELECT conv_id, turn, prompt, regexp_extract_all(prompt, '{_PIECE}') AS w FROM whole)
    SELECT conv_id, turn, right(CASE WHEN len(w) > 150 THEN array_to_string(w[len(w) - 149:], '') ELSE prompt END, 400)
      AS prompt FROM pieces""",
)
def truncated_prompts(spark, sf):
    turns, order = _turns(spark, sf)
    states = P.with_profile_prompt(
        replay.replay_states(turns, _profiles(spark, sf), order, initial_name=AFRICA), _profiles(spark, sf)
    )
    return P.assemble(states, max_chars=400, max_tokens=150).select("conv_id", "turn", "prompt")


@query(
    "fallback_prompts",
    f"WITH {_states_sql('1 PRECEDING')} SELECT conv_id, turn, '<|system|>' || {NL} || '{fixed.FALLBACK_SYSTEM}' || {NL} "
    f"|| '<|user|>' || {NL} || u || {NL} || '<|assistant|>' || {NL} AS prompt FROM states WHERE character_id = 'wizard'",
)
def fallback_prompts(spark, sf):
    """Turns whose character nobody knows: the stored default profile is taken away."""
    turns, order = _turns(spark, sf)
    profiles = _profiles(spark, sf).where(F.col("id") != "wizard")
    prompts = P.replay_prompts(turns, profiles, order, initial_name=AFRICA)
    return prompts.where(F.col("character_id") == "wizard").select("conv_id", "turn", "prompt")


_POINTS = (
    "least(10, "
    + " + ".join(
        f"regexp_matches(m, '(?i)(?:^|[^\\p{{L}}\\p{{N}}_]){p}(?:$|[^\\p{{L}}\\p{{N}}_])')::INT * 2"
        for p in fixed.IMPORTANT_PHRASES
    )
    + " + (length(m) > 80)::INT + (strpos(m, '?') = 0)::INT)"
)


def embedded_sql(source: str, name: str) -> str:
    """CTE ``name`` (id, e): vectors of the texts ``t`` of ``source``, as ``embed`` makes them."""
    place = f"CAST('0x' || substr(md5(w), 1, 7) AS BIGINT) % {fixed.MEMORY_DIM}"
    return (
        f"{name}_n AS (SELECT id, b, count(*) AS c FROM (SELECT id, {place} AS b FROM (SELECT id, "
        f"unnest(regexp_extract_all(lower(t), '[\\p{{L}}\\p{{N}}_]+')) AS w FROM {source})) GROUP BY id, b), "
        f"{name}_m AS (SELECT id, map(list(b), list(c)) AS places, sqrt(sum(c * c)) AS size FROM {name}_n GROUP BY id), "
        f"{name} AS (SELECT s.id, list_transform(range({fixed.MEMORY_DIM}), lambda b: "
        f"CAST(coalesce(places[b], 0) / coalesce(size, 1) AS FLOAT)) AS e FROM {source} s LEFT JOIN {name}_m v ON s.id = v.id)"
    )


def _memory_prompts_sql(capacity: int) -> str:
    return f"""
    WITH {_states_sql('1 PRECEDING')},
    said AS (SELECT *, row_number() OVER (ORDER BY turn, conv_id) AS seq FROM states),
    asked AS (SELECT seq AS id, u AS t, user_id FROM said WHERE u <> ''),
    scored AS (SELECT *, {_POINTS} AS points FROM (SELECT seq AS id, user_id, {squeeze_sql('u')} AS m FROM said)),
    kept AS (SELECT id, m AS t, user_id, row_number() OVER (ORDER BY id) AS no FROM scored WHERE m <> '' AND points >= 3),
    held AS (SELECT a.id, count(k.id) AS held FROM asked a LEFT JOIN kept k ON k.id < a.id GROUP BY a.id),
    {embedded_sql('asked', 'qv')}, {embedded_sql('kept', 'mv')},
    gaps AS (SELECT q.id AS query_id, m.id AS mem_id,
      round(list_sum(list_transform(list_zip(q.e, m.e), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) ** 2)), 9) AS gap
      FROM qv q JOIN held h ON q.id = h.id JOIN kept k ON k.id < q.id AND k.no > h.held - {capacity} JOIN mv m ON m.id = k.id),
    near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY gap, mem_id) AS rn FROM gaps)
      WHERE rn <= 12),
    mine AS (SELECT n.query_id, k.t, row_number() OVER (PARTITION BY n.query_id ORDER BY rn) AS place
      FROM near n JOIN kept k ON n.mem_id = k.id JOIN asked a ON n.query_id = a.id AND a.user_id = k.user_id),
    lists AS (SELECT query_id, string_agg('- ' || t, {NL} ORDER BY place) AS bullets FROM mine WHERE place <= 4
      GROUP BY query_id),
    told AS (SELECT s.*, coalesce(bullets, '(none)') AS bullets FROM said s LEFT JOIN lists ON seq = query_id),
    {_prompt_sql('told', 'bullets')} SELECT conv_id, turn, prompt FROM whole"""


def _memory_prompts(spark, sf, capacity: int):
    turns, order = _turns(spark, sf)
    # the order in which all users' turns come in: by turn, then conversation
    numbered = number_rows(turns, [F.col("turn"), F.col("conv_id")], "said_at")
    prompts = P.replay_prompts(
        numbered, _profiles(spark, sf), order, F.col("said_at"), initial_name=AFRICA, capacity=capacity
    )
    return prompts.select("conv_id", "turn", "prompt")


@query("turn_prompts_with_memory", _memory_prompts_sql(fixed.MEMORY_CAPACITY))
def turn_prompts_with_memory(spark, sf):
    return _memory_prompts(spark, sf, fixed.MEMORY_CAPACITY)


SMALL_STORE = 50


@query("turn_prompts_with_small_memory", _memory_prompts_sql(SMALL_STORE))
def turn_prompts_with_small_memory(spark, sf):
    """A store that holds the newest 50 memories at any turn."""
    return _memory_prompts(spark, sf, SMALL_STORE)


def _store_sql(gap: str, end: str) -> str:
    labels = " || ".join(
        f"'{label}: ' || coalesce({col}, '{default}') || {NL}"
        for label, col, default in zip(
            ("Name", "Personality", "World", "Tone"), ("name", "pers", "world", "tone"), fixed.PLACEHOLDER_CHARACTER
        )
    )
    world = f" || {NL} || ".join(f"'{n}: {d}'" for n, d in fixed.WORLD_DEFAULTS.items())
    return f"""
    WITH {PAIRS},
    scored AS (SELECT *, {_POINTS} AS points FROM (SELECT *, {squeeze_sql('user_text')} AS m FROM pairs)),
    best AS (SELECT conv_id, string_agg('- ' || m, {NL} ORDER BY points DESC, turn DESC) AS bullets FROM
      (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY points DESC, turn DESC) AS rn FROM scored
       WHERE m <> '' AND points >= 3) WHERE rn <= 12 GROUP BY conv_id),
    chars AS (SELECT 's' || s_suppkey AS id, s_name AS name, 'calm' AS pers, 'sea' AS world, 'dry' AS tone FROM supplier),
    told AS (SELECT *, list('<|user|>' || {NL} || user_text || {NL} || '<|assistant|>' || {NL} || reply || {NL}) OVER
      (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS hist FROM pairs)
    SELECT t.conv_id, turn, '<|system|>' || {NL} || '{fixed.CHAT_SYSTEM}' || {NL} || {NL} || 'CHARACTER:' || {NL}
      || {labels} || {NL} || 'EMOTION STATE:' || {NL} || 'neutral' || {gap} || {NL} || 'WORLD STATE:' || {NL} || {world}
      || {gap} || {NL} || 'MEMORY:' || {NL} || coalesce(bullets, '(none)') || {NL} || {NL} || 'CHAT HISTORY:' || {NL}
      || coalesce(nullif(array_to_string(hist, {NL}), ''), '(none)') || {NL} || {NL} || '<|user|>' || {NL} || user_text || {NL}
      || '<|assistant|>' || {end} AS prompt
    FROM told t LEFT JOIN best b ON t.conv_id = b.conv_id LEFT JOIN chars c ON c.id = 's' || t.conv_id"""


def _store_prompts(spark, sf, layout):
    turns, order = _turns(spark, sf)
    candidate = cues.memory_candidate(F.col("user"))
    items = once(turns, "m", candidate).where(F.col("m").isNotNull()).select(
        "conv_id", "turn", "m.text", F.col("m.tenths").alias("score")
    )
    best = M.top_memories(items, "conv_id", "score", "turn").groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("rn", "text"))).alias("best")
    )
    memories = best.select("conv_id", F.transform("best", lambda b: b["text"]).alias("memories"))
    told = (
        replay.carry_history(turns, order)
        .join(memories, "conv_id", "left")
        .withColumn("character_id", F.concat(F.lit("s"), F.col("conv_id").cast("string")))
    )
    characters = table(spark, sf, "supplier").select(
        F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"),
        F.col("s_name").alias("name"), F.lit("calm").alias("personality"),
        F.lit("sea").alias("world"), F.lit("dry").alias("tone"),
    )
    return P.store_prompts(told, characters, layout).select("conv_id", "turn", "prompt")


@query("store_prompts", _store_sql(f"{NL} || {NL}", NL))
def store_prompts(spark, sf):
    return _store_prompts(spark, sf, "line_per_part")


@query("store_prompts_compact", _store_sql(NL, "''"))
def store_prompts_compact(spark, sf):
    return _store_prompts(spark, sf, "compact")


@query(
    "memory_candidates",
    f"WITH {PAIRS} SELECT conv_id, turn, m AS text, points / 10.0 AS score FROM "
    f"(SELECT *, {_POINTS} AS points FROM (SELECT *, {squeeze_sql('user_text')} AS m FROM pairs)) "
    "WHERE m <> '' AND points >= 3",
)
def memory_candidates(spark, sf):
    turns, _ = _turns(spark, sf)
    found = once(turns, "m", cues.memory_candidate(F.col("user"))).where(F.col("m").isNotNull())
    return found.select("conv_id", "turn", "m.text", "m.score")


@query(
    "memory_capacity",
    f"WITH {_states_sql('CURRENT ROW')} SELECT seq, user_id, m AS text, character_id || ' ' || (points / 10.0) AS meta FROM "
    f"(SELECT *, {_POINTS} AS points, row_number() OVER (ORDER BY conv_id, turn) AS seq FROM (SELECT *, {squeeze_sql('u')} AS m FROM states)) "
    "WHERE m <> '' AND points >= 3 ORDER BY seq DESC LIMIT 30",
)
def memory_capacity(spark, sf):
    states = number_rows(_states(spark, sf, before=False), [F.col("conv_id"), F.col("turn")], "seq")
    # read for the capacity and for the rows
    memory = cut_lineage(M.remember(states, F.col("seq"), F.col("seq")))
    meta = F.concat_ws(" ", F.col("meta")["character"], F.col("meta")["score"])
    return M.keep_capacity(memory, 30).select("seq", "user_id", "text", meta.alias("meta"))


def _vectors(spark, sf):
    vectors = table(spark, sf, "embeddings")
    memory = vectors.select(
        F.col("vec_id").alias("mem_id"), F.col("label").alias("user_id"),
        F.col("vec_id").alias("seq"), F.col("embedding").alias("vec"),
    )
    return memory.withColumnRenamed("mem_id", "query_id"), memory


def _near_sql(condition: str, fetch: int) -> str:
    return (
        "v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), "
        "d AS (SELECT q.vec_id AS query_id, m.vec_id AS mem_id, q.label AS user_id, m.label AS mem_user, "
        f"list_distance(q.e, m.e) AS distance FROM v q JOIN v m ON {condition}), "
        "r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, mem_id) AS rank FROM d), "
        f"near AS (SELECT * FROM r WHERE rank <= {fetch})"
    )


_MINE = (
    "SELECT query_id, mem_id, place, round(distance, 4) AS distance FROM (SELECT *, row_number() OVER "
    "(PARTITION BY query_id ORDER BY rank) AS place FROM near WHERE mem_user = user_id) WHERE place <= 4"
)


@query(
    "nearest_memories",
    f"WITH {_near_sql('true', 12)} SELECT query_id, mem_id, rank, round(distance, 4) AS distance FROM near",
)
def nearest_memories(spark, sf):
    queries, memory = _vectors(spark, sf)
    near = M.nearest(queries, memory)
    return near.select("query_id", "mem_id", "rank", F.round("distance", 4).alias("distance"))


def _hits(hits):
    return hits.select("query_id", "mem_id", "place", F.round("distance", 4).alias("distance"))


@query("retrieve_own_memories", f"WITH {_near_sql('true', 12)} {_MINE}")
def retrieve_own_memories(spark, sf):
    return _hits(M.retrieve(*_vectors(spark, sf)))


@query("retrieve_earlier_memories", f"WITH {_near_sql('m.vec_id < q.vec_id', 12)} {_MINE}")
def retrieve_earlier_memories(spark, sf):
    return _hits(M.retrieve(*_vectors(spark, sf), earlier_only=True))


@query(
    "retrieve_from_recent_store",
    f"WITH {_near_sql('m.vec_id < q.vec_id AND m.vec_id >= q.vec_id - 100', 12)} {_MINE}",
)
def retrieve_from_recent_store(spark, sf):
    """A store of 100 memories: the older ones are dropped before the lookup."""
    return _hits(M.retrieve(*_vectors(spark, sf), earlier_only=True, capacity=100))


@query("retrieve_own_first", f"WITH {_near_sql('m.label = q.label', 12)} {_MINE}")
def retrieve_own_first(spark, sf):
    return _hits(M.retrieve(*_vectors(spark, sf), own_first=True))


@query(
    "memory_prompts",
    f"WITH {_near_sql('true', 12)}, mine AS ({_MINE}), "
    f"lists AS (SELECT query_id, string_agg('- memory ' || mem_id, {NL} ORDER BY place) AS bullets FROM mine "
    f"GROUP BY query_id) SELECT vec_id, '<|system|>' || {NL} || 'Be kind.' || {NL} || 'Relevant memory:' || {NL} || "
    f"coalesce(bullets, '(none)') || {NL} || '<|user|>' || {NL} || 'query ' || vec_id || {NL} || '<|assistant|>' || {NL} "
    "AS prompt FROM embeddings LEFT JOIN lists ON vec_id = query_id",
)
def memory_prompts(spark, sf):
    queries, memory = _vectors(spark, sf)
    texts = memory.withColumn("text", F.concat(F.lit("memory "), F.col("mem_id").cast("string")))
    recalled = M.recalled_texts(M.retrieve(queries, memory), texts)
    joined = queries.select("query_id").join(recalled, "query_id", "left")
    asked = F.concat(F.lit("query "), F.col("query_id").cast("string"))
    prompt = render.memory_prompt(F.lit("Be kind."), F.col("memories"), asked)
    return joined.select(F.col("query_id").alias("vec_id"), prompt.alias("prompt"))


@query(
    "embed_texts",
    f"WITH src AS (SELECT doc_id AS id, text AS t FROM documents), {embedded_sql('src', 'v')} SELECT id AS doc_id, e AS vec FROM v",
)
def embed_texts(spark, sf):
    return embed(texts(spark, sf, "documents", "doc_id", "text")).select("doc_id", "vec")


@query(
    "rebuild_memory_vectors",
    f"WITH {PAIRS}, src AS (SELECT seq AS id, user_id, m AS t FROM (SELECT *, {_POINTS} AS points FROM (SELECT *, "
    f"row_number() OVER (ORDER BY conv_id, turn) AS seq, {squeeze_sql('user_text')} AS m FROM pairs)) "
    f"WHERE m <> '' AND points >= 3), {embedded_sql('src', 'v')} "
    "SELECT src.id AS mem_id, user_id, t AS text, e AS vec FROM src JOIN v ON src.id = v.id",
)
def rebuild_memory_vectors(spark, sf):
    turns, _ = _turns(spark, sf)
    numbered = number_rows(turns.withColumn("character_id", F.lit("wizard")), [F.col("conv_id"), F.col("turn")], "seq")
    memory = M.remember(numbered, F.col("seq"), F.col("seq"))
    return M.rebuild_vectors(memory).select("mem_id", "user_id", "text", "vec")
