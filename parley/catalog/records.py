"""Queries of record mapping, filters, pairing and rendering."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley import fixed
from parley.catalog.base import (
    CHAT,
    aggressive_sql,
    chat,
    pairs_sql,
    query,
    squeeze_sql,
    table,
)
from parley.functions import records as R
from parley.functions import render
from parley.functions.arrays import first_filled, first_present
from parley.operators import lists, pairing, validate
from parley.operators.sampling import split_rows
from parley.plans.folds import carry, last_rows, measure
from parley.plans.once import once
from parley.session import cut_lineage

NL = "chr(10)"
SYS = fixed.CHAT_SYSTEM.replace("'", "''")
SFT = fixed.SFT_SYSTEM.replace("'", "''")
# the default system prompt holds nothing that the aggressive clean-up changes


def _pairs(spark, sf):
    return pairing.pair_messages(table(spark, sf, "conversations"))


@query(
    "pair_turns",
    f"WITH {pairs_sql('conversations')} SELECT conv_id, user_turn, turn, user_text AS user, reply AS assistant, "
    "row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pair_no FROM pairs",
)
def pair_turns(spark, sf):
    messages = table(spark, sf, "conversations")
    order = measure(messages, ["conv_id"], "turn")
    return pairing.number_pairs(pairing.pair_messages(messages, order=order), order)


SFT_TEXT = (
    f"'<|system|>' || {NL} || '{SFT}' || {NL} || '<|user|>' || {NL} || u || {NL} || '<|assistant|>' || {NL}"
)


@query(
    "sft_split_counts",
    f"""
    WITH {pairs_sql('conversations')},
    clean AS (SELECT conv_id, turn, {squeeze_sql('user_text')} AS u, {squeeze_sql('reply')} AS a FROM pairs),
    good AS (SELECT *, {SFT_TEXT} || a AS text FROM clean
      WHERE length(u) >= 2 AND length(a) >= 20 AND regexp_matches(u || a, '[\\p{{L}}\\p{{N}}]')),
    ranked AS (SELECT *, row_number() OVER (ORDER BY md5('42-' || conv_id || '-' || turn)) AS rn,
      count(*) OVER () AS n FROM good)
    SELECT CASE WHEN rn <= ceil(n * 0.1) THEN 'test' ELSE 'train' END AS split,
      count(*) AS rows, sum(length(text))::BIGINT AS chars FROM ranked GROUP BY 1""",
)
def sft_split_counts(spark, sf):
    """Messages -> pairs -> valid turns -> training text -> exact split -> counts."""
    good = (
        once(_pairs(spark, sf), "sft", R.sft_example(F.col("user"), F.col("assistant")))
        .where(F.col("sft").isNotNull())
        .where(render.valid_turn(F.col("user"), F.col("sft.response")))
        .select("conv_id", "turn", F.length("sft.text").alias("size"))
    )
    # the split looks at its rows several times: the texts are made once, their lengths kept
    return (
        split_rows(cut_lineage(good), 0.1, "conv_id", "turn")
        .groupBy("split")
        .agg(F.count("*").alias("rows"), F.sum("size").alias("chars"))
    )


@query(
    "sft_triples",
    f"""
    WITH {pairs_sql('conversations')},
    clean AS (SELECT conv_id, turn, {squeeze_sql('user_text')} AS u, {squeeze_sql('reply')} AS a FROM pairs)
    SELECT conv_id, turn, {SFT_TEXT} AS prompt, a AS response, {SFT_TEXT} || a AS text FROM clean
    WHERE length(u) >= 2 AND length(a) >= 2""",
)
def sft_triples(spark, sf):
    return (
        once(_pairs(spark, sf), "sft", R.sft_example(F.col("user"), F.col("assistant")))
        .where(F.col("sft").isNotNull())
        .select("conv_id", "turn", "sft.prompt", "sft.response", "sft.text")
    )


@query(
    "column_pruning",
    "SELECT source, count(*) AS rows, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY source",
)
def column_pruning(spark, sf):
    docs = table(spark, sf, "documents").select("source", "n_chars")
    return docs.groupBy("source").agg(F.count("*").alias("rows"), F.sum("n_chars").alias("chars"))


def _flat(spark, sf):
    """Flat records of changing key names, made from pairs."""
    kind = (F.col("conv_id") + F.col("turn")) % 4
    only = lambda *k: lambda c: F.when(kind.isin(*k), F.col(c))
    u, a = "user", "assistant"
    pairs = _pairs(spark, sf)
    return pairs.select(
        "conv_id",
        "turn",
        F.when(kind == 0, F.lit("Be brief.")).when(kind == 1, F.lit("")).alias("system"),
        F.when(kind == 1, F.lit("Answer.")).alias("instruction"),
        F.when(kind == 2, F.lit("")).otherwise(only(0, 1)(u)).alias("user"),
        only(2, 3)(u).alias("prompt"),
        only(0)(a).alias("assistant"),
        only(1, 2)(a).alias("response"),
        only(3)(a).alias("output"),
    )


@query(
    "map_flat_records",
    f"""
    WITH {pairs_sql('conversations')}
    SELECT conv_id, turn,
      CASE (conv_id + turn) % 4 WHEN 0 THEN 'Be brief.' WHEN 1 THEN 'Answer.' ELSE '{SYS}' END AS system,
      CASE WHEN (conv_id + turn) % 4 < 3 THEN user_text END AS user,
      CASE WHEN (conv_id + turn) % 4 < 3 THEN reply END AS assistant
    FROM pairs""",
)
def map_flat_records(spark, sf):
    mapped = R.map_chat_record(_flat(spark, sf))
    first = F.get("turns", F.lit(0))
    return mapped.select(
        "conv_id", "turn", "system", first["user"].alias("user"), first["assistant"].alias("assistant")
    )


@query(
    "first_key_with_value",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority WHEN o_orderstatus <> 'F' THEN "
    "o_orderstatus ELSE '' END AS filled, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority "
    "WHEN o_orderkey % 3 = 1 THEN '' ELSE o_orderstatus END AS present FROM orders",
)
def first_key_with_value(spark, sf):
    third = F.col("o_orderkey") % 3
    a = F.when(third == 0, F.col("o_orderpriority")).when(third == 1, "")
    b = F.col("o_orderstatus")
    return table(spark, sf, "orders").select(
        "o_orderkey",
        first_filled(a, F.when(b != "F", b)).alias("filled"),
        first_present(a, b).alias("present"),
    )


def _message_blocks(spark, sf, role: str, value: str, name: str):
    """Every conversation as block rows with runs of its messages, under the keys that such files have."""
    said = F.when(F.col("role") == "assistant", F.lit("gpt")).otherwise(F.col("role"))
    fields = {f: F.lit(None).cast("string") for f in ("role", "from", "content", "value", "text")}
    fields[role], fields[value] = said, F.col("text")
    item = F.struct(*[c.alias(n) for n, c in fields.items()])
    return lists.cut_blocks(table(spark, sf, "conversations"), "conv_id", "turn", item, name)


@query(
    "map_message_lists",
    f"""
    WITH {pairs_sql('conversations')},
    sys AS (SELECT conv_id, arg_max(text, turn) AS system FROM conversations WHERE role = 'system' GROUP BY conv_id)
    SELECT p.conv_id, row_number() OVER (PARTITION BY p.conv_id ORDER BY turn) - 1 AS place,
      coalesce(system, '{SYS}') AS system, user_text AS user, reply AS assistant
    FROM pairs p LEFT JOIN sys ON p.conv_id = sys.conv_id
    UNION ALL
    SELECT l.conv_id, 0, coalesce(any_value(system), '{SYS}'), '',
      coalesce(arg_max(text, l.turn) FILTER (WHERE role = 'assistant'), '')
    FROM conversations l LEFT JOIN sys ON l.conv_id = sys.conv_id
    WHERE l.conv_id NOT IN (SELECT conv_id FROM pairs) GROUP BY l.conv_id""",
)
def map_message_lists(spark, sf):
    return lists.message_turns(_message_blocks(spark, sf, "role", "content", "messages"), "conv_id")


@query(
    "map_conversation_lists",
    f"WITH {pairs_sql('conversations')} SELECT conv_id, row_number() OVER "
    "(PARTITION BY conv_id ORDER BY turn) - 1 AS place, user_text AS user, reply AS assistant FROM pairs",
)
def map_conversation_lists(spark, sf):
    blocks = _message_blocks(spark, sf, "from", "value", "conversations")
    return lists.conversation_turns(blocks, "conv_id").drop("system")


@query(
    "map_category_records",
    f"""
    WITH {pairs_sql('conversations')},
    kinds AS (SELECT *, (conv_id + turn) % 3 AS kind FROM pairs),
    sides AS (
      SELECT conv_id, turn, kind, 'u' AS side,
        CASE kind WHEN 0 THEN 'Summarize.' || chr(10) || user_text
                  WHEN 1 THEN 'Introduce yourself in-character.' ELSE user_text END AS t FROM kinds
      UNION ALL SELECT conv_id, turn, kind, 'a', reply FROM kinds
      UNION ALL SELECT conv_id, turn, kind, 's', 'Roleplay as: ' || user_text FROM kinds WHERE kind = 1),
    src AS (SELECT conv_id || '-' || turn || '-' || kind || '-' || side AS id, t FROM sides),
    {aggressive_sql('src', 'done')},
    u AS (SELECT regexp_replace(id, '-u$', '') AS id, t FROM done WHERE id LIKE '%u'),
    a AS (SELECT regexp_replace(id, '-a$', '') AS id, t FROM done WHERE id LIKE '%a'),
    s AS (SELECT regexp_replace(id, '-s$', '') AS id, t FROM done WHERE id LIKE '%s')
    SELECT u.id AS record, 'chat' AS category, 1 AS turn_count,
      '<|system|>' || {NL} || coalesce(nullif(s.t, ''), '{SYS}') || {NL} || {NL} || '<|user|>' || {NL} || u.t || {NL}
      || {NL} || '<|assistant|>' || {NL} || a.t AS text
    FROM u JOIN a ON u.id = a.id LEFT JOIN s ON u.id = s.id
    WHERE u.t <> '' AND length(a.t) >= 20 AND regexp_matches(u.t || a.t, '[\\p{{L}}\\p{{N}}]')
      AND NOT u.id LIKE '%-2'
    """,
)
def map_category_records(spark, sf):
    kind = (F.col("conv_id") + F.col("turn")) % 3
    pairs = _pairs(spark, sf).withColumn("kind", kind)
    when = lambda k, c: F.when(F.col("kind") == k, c)
    records = pairs.select(
        F.concat_ws("-", "conv_id", "turn", "kind").alias("record"),
        when(0, F.lit("Summarize.")).alias("instruction"),
        when(0, F.col("user")).alias("input"),
        when(0, F.col("assistant")).alias("output"),
        when(1, F.col("user")).alias("act"),
        when(1, F.col("assistant")).alias("prompt"),
        when(2, F.lit("plain text without markers")).alias("text"),
    )
    mapped = R.map_category_record(records).where(F.col("turns").isNotNull())
    text = render.category_text(F.col("system"), F.col("turns"))
    return mapped.select(
        "record", F.lit("chat").alias("category"), F.size("turns").alias("turn_count"), text.alias("text")
    ).where(F.col("text").isNotNull())


@query(
    "rendered_records",
    f"""
    WITH {pairs_sql('conversations')},
    src AS (SELECT conv_id || '-' || turn AS id, '<|user|>' || {NL} || user_text || {NL} || '<|assistant|>' || {NL}
      || reply AS t FROM pairs WHERE turn % 4 <> 0),
    {aggressive_sql('src', 'done')}
    SELECT id AS record, t AS text, 1 AS turn_count FROM done""",
)
def rendered_records(spark, sf):
    pairs = _pairs(spark, sf)
    marked = F.concat(
        F.lit("<|user|>\n"), "user", F.when(F.col("turn") % 4 == 0, "\n").otherwise("\n<|assistant|>\n"), "assistant"
    )
    mapped = R.map_category_record(
        pairs.select(F.concat_ws("-", "conv_id", "turn").alias("record"), marked.alias("text"))
    ).where(F.col("rendered").isNotNull())
    return mapped.select(
        "record",
        R.rendered_text(F.col("rendered")).alias("text"),
        R.marker_count(F.col("rendered")).alias("turn_count"),
    )


STAGE_SQL = f"""
    WITH {pairs_sql('conversations')},
    mapped AS (SELECT conv_id, turn, {squeeze_sql('user_text')} AS u, {squeeze_sql('reply')} AS a FROM pairs)
    SELECT conv_id, turn, {SFT_TEXT} || a AS text FROM mapped WHERE length(u) >= 2 AND length(a) >= 2"""


@query("stage_one_mapping", STAGE_SQL)
def stage_one_mapping(spark, sf):
    kind = F.col("turn") % 3
    pick = lambda k, c: F.when(kind == k, F.col(c))
    msg = lambda c: F.struct(
        *[(F.col(c) if f == "content" else F.lit(None).cast("string")).alias(f)
          for f in ("role", "from", "content", "value", "text")]
    )
    records = _pairs(spark, sf).select(
        "conv_id", "turn",
        F.when(kind == 0, F.array(msg("user"), msg("assistant"))).alias("messages"),
        pick(1, "user").alias("instruction"), pick(2, "user").alias("prompt"),
        pick(1, "assistant").alias("output"), pick(2, "assistant").alias("response"),
    )
    user, reply = R.stage_one_pair()
    return _texts(R.with_record_keys(records), user, reply)


@query("stage_two_mapping", STAGE_SQL)
def stage_two_mapping(spark, sf):
    kind = F.col("turn") % 3
    pick = lambda k, c: F.when(kind == k, F.col(c))
    records = _pairs(spark, sf).select(
        "conv_id", "turn",
        pick(0, "user").alias("prompt"), pick(1, "user").alias("human"), pick(2, "user").alias("input"),
        pick(0, "assistant").alias("chosen"), pick(1, "assistant").alias("response"),
        pick(2, "assistant").alias("output"),
    )
    user, reply = R.stage_two_pair()
    return _texts(R.with_record_keys(records), user, reply)


def _texts(records, user, reply):
    return (
        once(records, "sft", R.sft_example(user, reply))
        .where(F.col("sft").isNotNull())
        .select("conv_id", "turn", "sft.text")
    )


@query(
    "single_message_texts",
    "SELECT conv_id, turn, trim(CASE role WHEN 'assistant' THEN 'Assistant: ' WHEN 'user' THEN 'User: ' ELSE '' END"
    " || trim(text, chr(10) || chr(32))) AS text FROM conversations "
    "WHERE length(trim(text, chr(10) || chr(32))) >= 9",
)
def single_message_texts(spark, sf):
    role = F.when(F.col("role") == "user", "Prompter").otherwise(F.col("role"))
    rows = table(spark, sf, "conversations").select("conv_id", "turn", role.alias("role"), "text")
    kept = validate.long_texts(rows, n=9)
    mapped = kept.withColumn("text", R.single_message_text(F.col("role"), F.col("text")))
    return validate.mapped_only(mapped).select("conv_id", "turn", "text")


LINE_SQL = (
    "trim(CASE role WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant' ELSE 'System' END || ': ' || text, "
    "chr(10) || chr(32))"
)


@query(
    "transcripts",
    f"SELECT conv_id, turn // 1000 AS part, string_agg({LINE_SQL}, {NL} ORDER BY turn) AS text "
    "FROM conversations WHERE text <> '' GROUP BY conv_id, turn // 1000",
)
def transcripts(spark, sf):
    line = F.when(F.col("text") != "", R.transcript_line(F.col("role"), F.col("text")))
    return pairing.transcripts(table(spark, sf, "conversations"), "conv_id", "turn", line)


@query(
    "transcript_lists",
    f"SELECT conv_id, string_agg({LINE_SQL}, {NL} ORDER BY turn) AS text FROM conversations GROUP BY conv_id",
)
def transcript_lists(spark, sf):
    """Blocks of messages are rendered each by itself; a conversation's parts make its whole transcript."""
    parts = lists.transcript_parts(_message_blocks(spark, sf, "from", "value", "conversations"), "conv_id")
    return lists.joined_parts(parts, "conv_id", "\n")


@query(
    "flat_transcripts",
    f"WITH {pairs_sql('conversations')} SELECT conv_id, turn, trim('User: ' || user_text || {NL} || 'Assistant: ' || reply, "
    "chr(10) || chr(32)) AS text FROM pairs",
)
def flat_transcripts(spark, sf):
    """Question and answer under keys that change from record to record."""
    kind = (F.col("conv_id") + F.col("turn")) % 3
    under = lambda keys, c: [F.when(kind == i, F.col(c)).alias(k) for i, k in enumerate(keys)]
    pairs = _pairs(spark, sf)
    records = R.with_record_keys(
        pairs.select("conv_id", "turn", *under(fixed.QUESTION_KEYS, "user"), *under(fixed.ANSWER_KEYS, "assistant"))
    )
    text = R.transcript_record(fixed.QUESTION_KEYS, fixed.ANSWER_KEYS)
    return records.select("conv_id", "turn", text.alias("text"))


@query(
    "preference_rows",
    f"""
    WITH {pairs_sql('conversations')},
    alts AS (SELECT *, lead(reply) OVER (PARTITION BY conv_id ORDER BY turn) AS other FROM pairs)
    SELECT conv_id, turn, {squeeze_sql('user_text')} AS prompt, {squeeze_sql('reply')} AS chosen,
      {squeeze_sql('other')} AS rejected FROM alts WHERE other IS NOT NULL""",
)
def preference_rows(spark, sf):
    messages = table(spark, sf, "conversations")
    order = measure(messages, ["conv_id"], "turn")
    pairs = pairing.pair_messages(messages, order=order)
    # the rejected reply is the one to the next message
    later = _next_reply(pairs, order)
    even = F.col("turn") % 4 == 1
    records = R.with_record_keys(
        later.select(
            "conv_id", "turn",
            F.when(even, F.col("user")).alias("prompt"), F.when(~even, F.col("user")).alias("human"),
            F.col("assistant").alias("chosen"), F.col("other").alias("rejected"),
        )
    )
    return (
        once(records, "p", R.preference_row())
        .where(F.col("p").isNotNull())
        .select("conv_id", "turn", "p.prompt", "p.chosen", "p.rejected")
    )


def _next_reply(pairs, order):
    turned = pairs.withColumn("back", -F.col("turn"))
    return carry(turned, order.backward("back"), {"other": F.col("assistant")}, before=True).drop("back")


@query(
    "turn_quality",
    f"""
    WITH {CHAT}, {pairs_sql('chat')}
    SELECT conv_id, turn, length(user_text) AS user_chars, length(reply) AS reply_chars FROM pairs
    WHERE user_text <> '' AND length(reply) >= 60 AND regexp_matches(user_text || reply, '[\\p{{L}}\\p{{N}}]')""",
)
def turn_quality(spark, sf):
    pairs = pairing.pair_messages(chat(spark, sf))
    good = render.valid_turn(F.col("user"), F.col("assistant")) & (F.length("assistant") >= 60)
    return pairs.where(good).select(
        "conv_id", "turn", F.length("user").alias("user_chars"), F.length("assistant").alias("reply_chars")
    )


@query(
    "valid_short_replies",
    "SELECT l_orderkey, l_linenumber FROM (SELECT *, CASE WHEN l_quantity < 20 THEN repeat('!', l_quantity::INT) "
    "ELSE repeat('ab ', l_linenumber) || l_returnflag END AS reply FROM lineitem) "
    "WHERE length(reply) >= 20 AND regexp_matches(reply, '[\\p{L}\\p{N}]')",
)
def valid_short_replies(spark, sf):
    reply = F.when(
        F.col("l_quantity") < 20, F.repeat(F.lit("!"), F.col("l_quantity").cast("int"))
    ).otherwise(F.concat(F.repeat(F.lit("ab "), F.col("l_linenumber")), F.col("l_returnflag")))
    return (
        table(spark, sf, "lineitem")
        .where(render.valid_turn(F.lit("?"), reply))
        .select("l_orderkey", "l_linenumber")
    )


@query(
    "minimum_length",
    "SELECT doc_id, length(trim(text, chr(10) || chr(32))) AS chars FROM documents "
    "WHERE length(trim(text, chr(10) || chr(32))) >= 400",
)
def minimum_length(spark, sf):
    kept = validate.long_texts(table(spark, sf, "documents"), n=400)
    return kept.select("doc_id", F.length("text").alias("chars"))


@query(
    "curate_by_score",
    "SELECT d.doc_id, d.source FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id "
    "WHERE coalesce(l.quality, 0) >= 0.8",
)
def curate_by_score(spark, sf):
    labels = table(spark, sf, "labels").select("doc_id", F.col("quality").cast("double").alias("quality_score"))
    logs = table(spark, sf, "documents").select("doc_id", "source").join(labels, "doc_id", "left")
    return validate.curate(logs).select("doc_id", "source")


_PROFILE_SQL = """
    profiles AS (SELECT c_custkey AS id, c_name AS name, c_mktsegment AS role,
      CASE WHEN c_custkey % 5 = 0 THEN '  ' ELSE 'calm' END AS personality,
      CASE WHEN c_acctbal < 0 THEN NULL ELSE 'formal' END AS speech_style, 'north' AS background,
      CASE WHEN c_nationkey = 3 THEN '' ELSE ' even ' END AS emotions, 'help' AS motivations,
      CASE WHEN c_custkey % 2 = 0 THEN ' be kind ' END AS behavior_rules FROM customer)"""
_BLANK = lambda c: f"trim(coalesce({c}, '')) = ''"


def _profiles(spark, sf):
    c = F.col
    return table(spark, sf, "customer").select(
        c("c_custkey").alias("id"),
        c("c_name").alias("name"),
        c("c_mktsegment").alias("role"),
        F.when(c("c_custkey") % 5 == 0, "  ").otherwise("calm").alias("personality"),
        F.when(c("c_acctbal") < 0, None).otherwise("formal").alias("speech_style"),
        F.lit("north").alias("background"),
        F.when(c("c_nationkey") == 3, "").otherwise(" even ").alias("emotions"),
        F.lit("help").alias("motivations"),
        F.when(c("c_custkey") % 2 == 0, " be kind ").alias("behavior_rules"),
    )


@query(
    "profile_missing_fields",
    f"WITH {_PROFILE_SQL} SELECT id, concat_ws(',', "
    + ", ".join(f"CASE WHEN {_BLANK(c)} THEN '{c}' END" for c in fixed.PROFILE_REQUIRED)
    + ") AS missing FROM profiles",
)
def profile_missing_fields(spark, sf):
    return _profiles(spark, sf).select(
        "id", F.array_join(validate.missing_fields(), ",").alias("missing")
    )


@query(
    "profile_prompts",
    f"WITH {_PROFILE_SQL} SELECT id, 'You are \"' || trim(name) || '\".' || {NL} || 'Role: ' || trim(role) || {NL} || "
    f"'Personality: ' || trim(personality) || {NL} || 'Speech style: ' || trim(speech_style) || {NL} || "
    f"'Background: ' || trim(background) || {NL} || 'Emotions: ' || trim(emotions) || {NL} || "
    f"'Motivations: ' || trim(motivations) || {NL} || "
    f"CASE WHEN behavior_rules IS NULL THEN '' ELSE 'Behavior rules: ' || trim(behavior_rules) || {NL} END || "
    f"'{fixed.KEEP_CHARACTER_LINE}' AS prompt FROM profiles WHERE NOT ("
    + " OR ".join(_BLANK(c) for c in fixed.PROFILE_REQUIRED)
    + ")",
)
def profile_prompts(spark, sf):
    valid = validate.valid_profiles(_profiles(spark, sf))
    fields = [*fixed.PROFILE_REQUIRED, fixed.PROFILE_OPTIONAL]
    return valid.select("id", render.profile_prompt({f: F.col(f) for f in fields}).alias("prompt"))


@query(
    "short_profile_prompts",
    f"WITH {_PROFILE_SQL} SELECT id, 'You are \"' || name || '\".' || {NL} || 'Personality: ' || role || {NL} || "
    f"'Backstory: ' || background || {NL} || 'Speech style: ' || motivations || {NL} || 'Behavior rules: ' || name || {NL} "
    f"|| 'Emotional traits: ' || role || {NL} || '{fixed.KEEP_CHARACTER_SHORT}' AS prompt FROM profiles",
)
def short_profile_prompts(spark, sf):
    c = F.col
    fields = {
        "name": c("name"), "personality": c("role"), "backstory": c("background"),
        "speech_style": c("motivations"), "behavior_rules": c("name"), "emotional_traits": c("role"),
    }
    return _profiles(spark, sf).select("id", render.short_profile_prompt(fields).alias("prompt"))


@query(
    "safe_ids",
    """
    WITH ids AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'user/' || page_id WHEN 1 THEN '../' || page_id
      WHEN 2 THEN '/abs/' || page_id WHEN 3 THEN 'a/./' || page_id WHEN 4 THEN ' ' ELSE 'x\\..\\' || page_id END AS id
      FROM pages)
    SELECT page_id, id, trim(replace(trim(id), '\\', '/'), '/') <> '' AND
      len(list_filter(string_split(trim(replace(trim(id), '\\', '/'), '/'), '/'), lambda p: p IN ('.', '..'))) = 0 AS safe
    FROM ids""",
)
def safe_ids(spark, sf):
    n = F.col("page_id").cast("string")
    kind = F.col("page_id") % 6
    built = (
        F.when(kind == 0, F.concat(F.lit("user/"), n))
        .when(kind == 1, F.concat(F.lit("../"), n))
        .when(kind == 2, F.concat(F.lit("/abs/"), n))
        .when(kind == 3, F.concat(F.lit("a/./"), n))
        .when(kind == 4, F.lit(" "))
        .otherwise(F.concat(F.lit("x\\..\\"), n))
    )
    return table(spark, sf, "pages").select(
        "page_id", built.alias("id"), validate.safe_id(built).alias("safe")
    )


@query(
    "decode_store_rows",
    "SELECT event_id, user_id, CASE WHEN event_type IN ('view', 'click') THEN 'user' ELSE 'assistant' END AS role "
    "FROM events WHERE value >= 5",
)
def decode_store_rows(spark, sf):
    kind = F.when(F.col("event_type").isin("view", "click"), "user").otherwise(F.col("event_type"))
    rows = table(spark, sf, "events").select(
        "event_id", "user_id", kind.alias("role"), F.when(F.col("value") >= 5, F.col("value")).alias("content")
    )
    return validate.decode_store_rows(rows, ["event_id", "content"], "role").drop("content")


def _chat_rows(spark, sf, pairs_kept: int):
    messages = chat(spark, sf)
    pairs = pairing.pair_messages(messages.drop("user_id"))
    turns = pairing.gather_turns(pairs, "conv_id", "turn", pairs_kept)
    return turns.join(pairing.last_system(messages, "conv_id", "turn"), "conv_id", "left")


def _rendered_sql(tail: str, kept: str = "true") -> str:
    return f"""
    WITH {CHAT}, {pairs_sql('chat')},
    recent AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM pairs)
      WHERE {kept}),
    sys AS (SELECT conv_id, arg_max(text, turn) AS t FROM chat WHERE role = 'system' GROUP BY conv_id),
    src AS (SELECT conv_id || '/' || turn || '/u' AS id, user_text AS t FROM recent
      UNION ALL SELECT conv_id || '/' || turn || '/a', reply FROM recent
      UNION ALL SELECT conv_id || '//s', t FROM sys),
    {aggressive_sql('src', 'done')},
    parts AS (SELECT split_part(id, '/', 1)::BIGINT AS conv_id, split_part(id, '/', 2) AS turn,
      split_part(id, '/', 3) AS side, t FROM done),
    body AS (SELECT u.conv_id, string_agg('<|user|>' || {NL} || u.t || {NL} || '<|assistant|>' || {NL} || a.t || {NL},
        '' ORDER BY u.turn::BIGINT) AS t
      FROM parts u JOIN parts a ON u.conv_id = a.conv_id AND u.turn = a.turn AND u.side = 'u' AND a.side = 'a'
      WHERE u.t <> '' AND a.t <> '' GROUP BY u.conv_id),
    texts AS (SELECT b.conv_id, '<|system|>' || {NL} || coalesce(s.t, '{SYS}') || {NL} || b.t AS text
      FROM body b LEFT JOIN parts s ON s.conv_id = b.conv_id AND s.side = 's')
    {tail}"""


@query("chat_texts", _rendered_sql("SELECT conv_id, text FROM texts"))
def chat_texts(spark, sf):
    """Turns are rendered in blocks; the blocks of a conversation make its whole text. None without a filled turn."""
    messages = chat(spark, sf)
    order = measure(messages, ["conv_id"], "turn")
    pairs = pairing.pair_messages(messages.drop("user_id"), order=order)
    turns = lists.cut_blocks(pairs, "conv_id", "turn", F.struct("user", "assistant"), "turns", order=order)
    parts = turns.select("conv_id", F.col("block").alias("part"), render.chat_body(F.col("turns")).alias("text"))
    bodies = lists.joined_parts(parts, "conv_id", "").where(F.col("text") != "")
    rows = bodies.join(pairing.last_system(messages, "conv_id", "turn"), "conv_id", "left")
    return rows.select("conv_id", F.concat(render.chat_head(F.col("system")), "text").alias("text"))


CUT = 900


@query(
    "validated_rows",
    _rendered_sql(
        f""", src2 AS (SELECT conv_id AS id, right(text, {CUT}) AS t FROM texts WHERE length(text) > {CUT}),
        {aggressive_sql('src2', 'cut')}
        SELECT conv_id, text, 'kept' AS how FROM texts WHERE length(text) <= {CUT}
        UNION ALL
        SELECT id, '<|system|>' || {NL} || '{SYS}' || {NL} || '<|user|>' || {NL} || '(truncated)' || {NL}
          || '<|assistant|>' || {NL} || t || {NL}, 'cut' FROM cut""",
        "rn <= 3",
    ),
)
def validated_rows(spark, sf):
    valid = validate.validate_rows(_chat_rows(spark, sf, 3), max_turns=3, max_chars=CUT)
    how = F.when(F.get("turns", F.lit(0))["user"] == fixed.TRUNCATED_USER, "cut").otherwise("kept")
    return valid.select("conv_id", "text", how.alias("how"))


@query(
    "last_turns",
    f"WITH {pairs_sql('conversations')} SELECT conv_id, turn FROM (SELECT *, row_number() OVER "
    "(PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM pairs) WHERE rn <= 2",
)
def last_turns(spark, sf):
    return pairing.last_pairs(_pairs(spark, sf), "conv_id", "turn", 2).select("conv_id", "turn")


@query(
    "drop_blank_turns",
    f"""
    WITH {pairs_sql('conversations')}
    SELECT conv_id, turn, trim(user_text, chr(10) || chr(32)) AS user, trim(reply, chr(10) || chr(32)) AS assistant
    FROM pairs WHERE turn % 3 <> 0""",
)
def drop_blank_turns(spark, sf):
    third = F.col("turn") % 3 == 0
    rows = _pairs(spark, sf).select(
        "conv_id", "turn",
        R.one_turn(F.col("user"), F.when(third, " \n").otherwise(F.col("assistant"))).alias("turns"),
    )
    kept = rows.withColumn("turns", validate.filled_turns(F.col("turns"))).where(F.size("turns") > 0)
    first = F.get("turns", F.lit(0))
    return kept.select("conv_id", "turn", first["user"].alias("user"), first["assistant"].alias("assistant"))
