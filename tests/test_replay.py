"""Replay of hand-written sessions, and batch against stream."""

import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from parley import fixed
from parley.operators import prompts as P
from parley.operators import replay, store
from parley.operators.pairing import pair_messages
from parley.plans.folds import Order, measure
from parley.streaming import jobs, sessions

PROFILE = {f: f"{f} of wizard" for f in [*fixed.PROFILE_REQUIRED, fixed.PROFILE_OPTIONAL]}

SCRIPT = [
    # user, assistant
    ("Hi. Stay in character and greet me in one short paragraph.", "Greetings."),
    ("We are in a medieval town. I lost my map. Help me find the inn without breaking character.", "This way."),
    ("Be Iron Man and tell me about the night", "Thank you for asking."),
    ("Remember: my name is Arin and I hate spiders. A spider appears. What do you do?", "To be continued."),
    ("roleplay as a wizard", "Hm."),
    ("be IRON man and go on a quest", None),
]


@pytest.fixture(scope="module")
def profiles(spark):
    row = {"id": "wizard", **PROFILE, "name": "Eldrin"}
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} string" for k in row))


@pytest.fixture(scope="module")
def turns(spark):
    rows = [("s", 1, i, u, a) for i, (u, a) in enumerate(SCRIPT)]
    rows += [("t", 1, 10, "my secret quest", "ok"), ("t", 1, 11, "do you remember?", "yes")]
    return spark.createDataFrame(rows, "session string, user_id int, turn int, user string, assistant string").repartition(4)


EXPECTED = [
    # character, name, emotion after, user text kept
    ("wizard", "Eldrin", "neutral", SCRIPT[0][0]),
    ("wizard", "Eldrin", "fearful", SCRIPT[1][0]),
    ("dynamic/iron_man", "Iron Man", "happy", "tell me about the night"),
    ("dynamic/iron_man", "Iron Man", "angry", SCRIPT[3][0]),
    ("wizard", "Eldrin", "fearful", "Begin."),
    ("dynamic/iron_man", "Iron Man", "angry", "go on a quest"),
]


@pytest.mark.parametrize("block", [None, 2])
def test_states_after_turns(spark, turns, profiles, block):
    order = Order(("session",), "turn", block)
    states = replay.replay_states(turns, profiles, order, initial_name="Eldrin", before=False)
    rows = states.where("session = 's'").orderBy("turn").collect()
    assert [(r["character_id"], r["character_name"], r["emotion"], r["user"]) for r in rows] == EXPECTED
    assert rows[1]["location"] == SCRIPT[1][0] and rows[0]["location"] == "unknown"
    assert rows[2]["time"] == rows[5]["time"] == "tell me about the night"
    assert [r["story_progress"] for r in rows] == ["beginning"] * 3 + ["cliffhanger"] * 2 + ["in_progress"]
    assert rows[5]["current_event"] == "go on a quest"
    assert [len(r["history"]) for r in rows] == [0, 1, 2, 3, 4, 5]
    assert rows[3]["history"][-1]["user"] == "tell me about the night"


def test_usage_and_saving(spark, turns, profiles):
    order = Order(("session",), "turn")
    switched = replay.resolve_switches(replay.hear_personas(turns), profiles, order)
    usage = replay.persona_usage(switched, order)
    assert [(r["session"], r["switch_id"], r["uses"], r["name"]) for r in usage.collect()] == [
        ("s", "dynamic/iron_man", 2, "Iron Man")
    ]
    saved = spark.createDataFrame([("other",)], "id string")
    assert replay.personas_to_save(usage, saved, 2).collect()[0]["id"] == "iron_man"
    assert replay.personas_to_save(usage, saved, 3).isEmpty()
    assert replay.personas_to_save(usage, spark.createDataFrame([("iron_man",)], "id string"), 2).isEmpty()


def test_prompts_of_a_session(spark, turns, profiles):
    order = Order(("session",), "turn")
    seq = F.when(F.col("session") == "t", F.col("turn")).otherwise(F.col("turn") + 100)
    rows = P.replay_prompts(turns, profiles, order, seq, initial_name="Eldrin").collect()
    prompt = {(r["session"], r["turn"]): r["prompt"] for r in rows}
    first = prompt["s", 0]
    assert first.startswith(f'<|system|>\n{fixed.CHAT_SYSTEM}\n\nCHARACTER:\nYou are "Eldrin".\nRole: role of wizard\n')
    assert "\n\nEMOTION STATE:\nwizard: neutral\n\nWORLD STATE:\nlocation: unknown\n" in first
    assert "characters_present: Eldrin\n" in first and "\nfacts:\n(none)\n" in first
    assert first.endswith(f"\n\nCHAT HISTORY:\n(none)\n\n<|user|>\n{SCRIPT[0][0]}\n<|assistant|>\n")
    # both sessions are of one user: the first turn recalls what the other session said
    assert "\nMEMORY:\n- my secret quest\n" in first
    assert "\nMEMORY:\n(none)\n" in prompt["t", 10] and "- my secret quest" in prompt["t", 11]
    third = prompt["s", 2]
    assert 'You are "Iron Man".\nRole: Iron Man\n' in third and "dynamic/iron_man: neutral" in third
    assert f"location: {SCRIPT[1][0]}\ntime: unknown\ncharacters_present: Iron Man\n" in third
    unknown = P.replay_prompts(turns, profiles, order, initial_id="nobody", max_chars=50).collect()
    short = {(r["session"], r["turn"]): r["prompt"] for r in unknown}
    assert short["s", 0] == f"<|system|>\nYou are a helpful roleplay assistant.\n<|user|>\n{SCRIPT[0][0]}\n<|assistant|>\n"
    assert len(short["s", 2]) == 50


@pytest.mark.parametrize("use_remainder", [True, False])
def test_switch_replay(spark, use_remainder):
    rows = [("s", 1, "Be Zed today and wave", "ok"), ("s", 2, "now?", "yes")]
    df = spark.createDataFrame(rows, "session string, turn int, user string, assistant string")
    got = replay.switch_replay(df, measure(df, ["session"], "turn"), use_remainder=use_remainder).orderBy("turn").collect()
    said = "wave" if use_remainder else rows[0][2]
    assert [r["persona"] for r in got] == ["Zed", "Zed"]
    assert got[1]["prompt"].endswith(
        f"</s>\n<|user|>\n{said}</s>\n<|assistant|>\nok</s>\n<|user|>\nnow?</s>\n<|assistant|>\n"
    )
    assert [r["part"] for r in got] == [0, 0]
    bounded = replay.switch_replay(df, Order(("session",), "turn", 1), use_remainder=use_remainder, pairs=12)
    assert [r["prompt"] for r in bounded.orderBy("turn").collect()] == [r["prompt"] for r in got]


@pytest.mark.parametrize("block", [None, 4])
def test_history_parts(spark, block):
    rows = [("s", 2 * i, f"u{i}", f"a{i}") for i in range(11)] + [("t", 5, "x", None)]
    df = spark.createDataFrame(rows, "session string, turn int, user string, assistant string")
    line = F.concat_ws("/", "user", "assistant")
    got = replay.history_parts(df, Order(("session",), "turn", block), line, part=3).orderBy("session", "turn", "part").collect()
    want = []
    for i in range(11):
        for p in range(i // 3 + 1):
            want.append(("s", 2 * i, p, i // 3, "".join(f"u{j}/a{j}" for j in range(3 * p, min(3 * p + 3, i)))))
    want.append(("t", 5, 0, 0, ""))
    assert [(r["session"], r["turn"], r["part"], r["last"], r["told"]) for r in got] == want


@pytest.mark.parametrize("block", [None, 4])
def test_history_store_is_linear(spark, block):
    """Every line stands in one piece; any turn's prompt comes from the pieces, with astral letters too."""
    order = Order(("session",), "turn", block)
    rows = [("s", i, f"u\U0001f600{i}", f"a{i}") for i in range(300)] + [("t", 5, "x", None)]
    df = spark.createDataFrame(rows, "session string, turn int, user string, assistant string")
    turns, pieces = replay.switch_store(df, order)
    told = {(r["session"], r["part"]): r["told"] for r in pieces.collect()}
    assert turns.count() == 301 and set(told) == {("s", p) for p in range(5)} | {("t", 0)}
    lines = [f"<|user|>\n{u}</s>\n<|assistant|>\n{a or ''}</s>\n" for _, _, u, a in rows]
    assert "".join(told["s", p] for p in range(5)) == "".join(lines[:300]) and told["t", 0] == lines[300]
    some = replay.switch_told(turns.where("turn in (0, 63, 64, 200)"), pieces, order.keys)
    prompts = {}
    for r in some.orderBy("turn", "part").collect():
        prompts[r["turn"]] = prompts.get(r["turn"], "") + r["prompt"]
    for turn, prompt in prompts.items():
        assert prompt.endswith("</s>\n" + "".join(lines[:turn]) + f"<|user|>\n{rows[turn][2]}</s>\n<|assistant|>\n")
    assert set(prompts) == {0, 63, 64, 200}


def messages(spark):
    """Chat of five sessions, one of them long, with gaps in the pairing."""
    rows = []
    texts = [u for u, _ in SCRIPT]
    for conv in range(5):
        for turn in range(60 if conv == 0 else 12):
            role = "user" if (turn + turn // 5) % 2 == 0 else "assistant"
            text = texts[(conv + turn) % len(texts)] if role == "user" else ("Great. ", "To be continued", " ", "Liar")[(turn // 2) % 4]
            rows.append((conv, conv % 2, turn, role, text))
    return spark.createDataFrame(rows, "conv_id bigint, user_id bigint, turn bigint, role string, text string")


def test_stream_equals_batch(spark, profiles, tmp_path):
    chat = messages(spark)
    order = Order(("conv_id",), "turn", 8)
    batch = replay.replay_states(
        pair_messages(chat, "conv_id", "turn", order=order).drop("user_turn"), profiles, order, before=False
    )
    source = str(tmp_path / "in")
    for turn in range(0, 60, 10):
        part = chat.where((F.col("turn") >= turn) & (F.col("turn") < turn + 10))
        part.coalesce(1).write.mode("append").parquet(f"{source}/{turn:02d}")
    stream = jobs.read_stream(spark, f"{source}/*", chat.schema, files_per_batch=1)
    followed = sessions.follow_sessions(sessions.pair_stream(stream), profiles)
    for _ in range(2):  # the second start finds nothing new
        jobs.append_to(followed, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    columns = ["conv_id", "turn", "user", "assistant", "character_id", "character_name", "emotion", *fixed.WORLD_DEFAULTS, "history"]
    got = spark.read.schema(followed.schema).parquet(str(tmp_path / "out"))
    rows = lambda df: sorted(map(tuple, df.select(*columns).collect()))
    assert rows(got) == rows(batch)
    assert got.agg(F.max("uses")).first()[0] > 1


def test_long_session_in_frames(spark, profiles, tmp_path):
    """A batch that holds a session in many frames, out of order: the same rows as the batch folds."""
    chat = messages(spark).where("conv_id > 0")
    texts = [u for u, _ in SCRIPT]
    long = spark.range(2_000).select(
        F.lit(9).cast("bigint").alias("conv_id"),
        F.lit(1).cast("bigint").alias("user_id"),
        (F.col("id") * 7).alias("turn"),
        F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
        F.get(F.array(*[F.lit(t) for t in texts]), (F.col("id") % len(texts)).cast("int")).alias("text"),
    )
    chat = chat.unionByName(long)
    order = Order(("conv_id",), "turn", 512)
    batch = replay.replay_states(
        pair_messages(chat, "conv_id", "turn", order=order).drop("user_turn"), profiles, order, before=False
    )
    chat.repartition(4, F.rand(3)).write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "150")
    try:
        stream = jobs.read_stream(spark, str(tmp_path / "in"), chat.schema)
        followed = sessions.follow_sessions(sessions.pair_stream(stream), profiles)
        jobs.append_to(followed, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    columns = ["conv_id", "turn", "user", "assistant", "character_id", "character_name", "emotion", *fixed.WORLD_DEFAULTS, "history"]
    rows = lambda df: sorted(map(tuple, df.select(*columns).collect()))
    got = rows(spark.read.schema(followed.schema).parquet(str(tmp_path / "out")))
    assert got == rows(batch) and len(got) > 900


class Held(dict):
    """A map state in memory, and the most bytes that it held."""

    def updateValue(self, key, value):
        self[key] = value

    def getValue(self, key):
        return self[key]

    def removeKey(self, key):
        del self[key]


def test_frames_come_in_order():
    turns = random.Random(5).sample(range(50_000), 20_000)
    frames = (pd.DataFrame({"turn": turns[i : i + 700], "x": i}) for i in range(0, 20_000, 700))
    held, got = Held(), []
    for frame in sessions.in_order(frames, held):
        assert len(frame) <= sessions.CELL
        got += frame["turn"].tolist()
    assert got == sorted(turns) and not held
    assert list(sessions.in_order(iter([]), held)) == []


def test_stream_of_files_and_views(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.jsonl").write_text(json.dumps({"user": "u", "assistant": "a"}) + "\nnot json\n")
    (source / "b.jsonl").write_text(json.dumps({"user": " ", "assistant": "a"}) + "\n")
    lines = jobs.read_stream(spark, str(source), "value string", "text")
    jobs.append_to(jobs.corpus_texts(lines), str(tmp_path / "texts"), str(tmp_path / "c1")).awaitTermination()
    texts = spark.read.parquet(str(tmp_path / "texts")).collect()
    assert [r["text"] for r in texts] == [f"<|system|>\n{fixed.CHAT_SYSTEM}\n<|user|>\nu\n<|assistant|>\na\n"]

    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "l.json").write_text("\n".join(json.dumps({"user": str(s), "quality_score": s}) for s in (0.5, 0.8, None)))
    kept = jobs.curated_logs(jobs.read_log_stream(spark, str(logs)))
    jobs.append_to(kept, str(tmp_path / "kept"), str(tmp_path / "c2"), "json").awaitTermination()
    assert [r["user"] for r in spark.read.json(str(tmp_path / "kept")).collect()] == ["0.8"]

    from parley.sources.snapshots import load_view

    schema = "id string, title string, at bigint"
    changes = tmp_path / "changes"
    changes.mkdir()
    view = jobs.read_stream(spark, str(changes), schema, "json", files_per_batch=1)
    for i, rows in enumerate([[("a", "1", 1), ("b", "1", 1)], [("a", "2", 3)], [("a", "late", 2), ("c", "1", 4)]]):
        text = "\n".join(json.dumps(dict(zip(("id", "title", "at"), r))) for r in rows)
        (changes / f"{i}.json").write_text(text)
        jobs.keep_view(view, str(tmp_path / "view"), str(tmp_path / "c3"), "id", "at").awaitTermination()
    held = load_view(spark, str(tmp_path / "view"), view.schema).orderBy("id").collect()
    assert [tuple(r) for r in held] == [("a", "2", 3), ("b", "1", 1), ("c", "1", 4)]


def test_unique_ids_against_one_by_one(spark):
    names = ["x", "x 2", "x", "X!", "x_2", "y", "hot", *["hot"] * 40, "x 3", "", "y 2", "y"]
    held = ["x", "hot_3", "hot_7", "character"]
    new = spark.createDataFrame([(i, "", n) for i, n in enumerate(names)], "no bigint, requested string, name string")
    ids = store.unique_ids(new, spark.createDataFrame([(h,) for h in held], "id string"), "requested", "name", "no")
    got = [r["id"] for r in ids.orderBy("no").collect()]
    taken, want = set(held), []
    for n in names:
        base = "_".join(n.lower().replace("!", "").split()) or "character"
        made, i = base, 2
        while made in taken:
            made, i = f"{base}_{i}", i + 1
        taken.add(made)
        want.append(made)
    assert len(set(got)) == len(got) and sorted(got) == sorted(want)
    assert got == want
