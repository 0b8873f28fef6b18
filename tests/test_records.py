import itertools

import pytest
from pyspark.sql import functions as F

from parley import fixed
from parley.functions import records as R
from parley.functions import render
from parley.operators import validate as V

SYSTEM = fixed.CHAT_SYSTEM


def records(spark, rows):
    """Rows of the superset schema from dictionaries."""

    def full(kind, row):
        out = []
        for field in kind.fields:
            value = row.get(field.name)
            if isinstance(value, list):
                value = [None if m is None else full(R.MESSAGE, m) for m in value]
            out.append(value)
        return tuple(out)

    schema = f"i int, {', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in R.RECORD.fields)}"
    return spark.createDataFrame([(i, *full(R.RECORD, r)) for i, r in enumerate(rows)], schema)


def mapped(spark, rows):
    found = R.map_chat_record(records(spark, rows)).orderBy("i").collect()
    return [(r["system"], None if r["turns"] is None else [tuple(t) for t in r["turns"]]) for r in found]


def test_chat_records(spark):
    say = lambda role, text: {"role": role, "content": text}
    rows = [
        {"user": "u", "assistant": "a", "system": "s"},
        {"prompt": "u", "assistant": "a", "instruction": "do"},
        {"user": "", "prompt": "p", "response": "r"},
        {"user": "u", "output": "o"},
        {"prompt": "only a prompt", "output": "o"},
        {"messages": [say("user", "u1"), say("user", "u2"), say("system", "mid"), say("assistant", "a"), say("gpt", "b")]},
        {"messages": [{"from": "HUMAN", "value": "h"}, {"from": "gpt", "text": "g"}, say("user", "tail")]},
        {"messages": [say("assistant", "alone"), say("user", "late")], "system": "s"},
        {"messages": [say("user", "  "), say("assistant", "x"), None]},
        {"messages": [say("system", "one"), say("system", " "), say("system", "two")]},
        {"messages": []},
    ]
    assert mapped(spark, rows) == [
        ("s", [("u", "a")]),
        ("do", [("u", "a")]),
        (SYSTEM, [("p", "r")]),
        (SYSTEM, [("u", "o")]),
        (SYSTEM, None),
        ("mid", [("u2", "a")]),
        (SYSTEM, [("h", "g")]),
        ("s", [("", "alone")]),
        (SYSTEM, [("", "x")]),
        ("two", [("", "")]),
        (SYSTEM, [("", "")]),
    ]


def test_pairing_of_every_short_role_sequence(spark):
    """All sequences of up to five messages of four kinds, against a plain loop."""
    kinds = [("user", "u"), ("user", " "), ("assistant", "a"), ("system", "s")]
    lists, want = [], []
    for n in range(6):
        for combo in itertools.product(kinds, repeat=n):
            said = [(role, text if text == " " else f"{text}{i}") for i, (role, text) in enumerate(combo)]
            lists.append({"messages": [{"role": r, "content": t} for r, t in said]})
            turns, asked, last = [], None, ""
            for role, text in said:
                if not text.strip():
                    continue
                if role == "user":
                    asked = text
                elif role == "assistant":
                    last = text
                    if asked is not None:
                        turns.append((asked, text))
                        asked = None
            want.append(turns or [("", last)])
    assert [t for _, t in mapped(spark, lists)] == want


def test_category_records(spark):
    long = "a reply that is long enough to stay"
    rows = [
        {"conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": long}], "instruction": "x", "output": "y"},
        {"conversations": [{"from": "gpt", "value": long}]},
        {"instruction": "Sum", "input": "", "output": long},
        {"act": "a Poet", "prompt": long},
        {"text": f"<|user|>\nhi\n<|assistant|>\n{long} <|assistant|> again"},
        {"text": "no markers"},
        {"instruction": "Sum", "output": "too short"},
        {"instruction": "?", "output": "!" * 30},
    ]
    df = R.map_category_record(records(spark, rows))
    chat = render.category_text(F.col("system"), F.col("turns"))
    got = df.select(
        "i", chat.alias("chat"), R.rendered_text(F.col("rendered")).alias("text"), R.marker_count(F.col("rendered")).alias("n")
    ).orderBy("i").collect()
    block = lambda system, user: f"<|system|>\n{system}\n\n<|user|>\n{user}\n\n<|assistant|>\n{long}"
    assert [r["chat"] for r in got] == [
        block(SYSTEM, "hi"), None, block(SYSTEM, "Sum"),
        block("Roleplay as: a Poet", "Introduce yourself in-character."), None, None, None, None,
    ]
    # the markers look like tags to the clean-up
    assert got[4]["text"] == f"hi {long} again" and got[4]["n"] == 2
    assert got[5]["text"] is None


def test_stage_pairs(spark):
    say = lambda t: {"role": "user", "content": t}
    rows = [
        {"messages": [say("x"), say("q1"), say("a1")], "instruction": "no"},
        {"messages": [say("single")], "instruction": "q2", "output": "a2"},
        {"prompt": "q3", "response": "a3"},
        {"human": "q4", "chosen": "a4"},
        {"prompt": "q", "output": "a"},
    ]
    df = records(spark, rows)
    pairs = lambda p: [tuple(r) for r in df.orderBy("i").select(*p).collect()]
    assert pairs(R.stage_one_pair()) == [("q1", "a1"), ("q2", "a2"), ("q3", "a3"), ("", ""), ("q", "a")]
    assert pairs(R.stage_two_pair()) == [("", ""), ("", "a2"), ("q3", "a3"), ("q4", "a4"), ("q", "a")]
    sft = df.orderBy("i").select(R.sft_example(*R.stage_one_pair())).collect()
    assert sft[0][0]["response"] == "a1" and sft[3][0] is None and sft[4][0] is None


def test_preference_rows(spark):
    rows = [
        {"prompt": " p\n q ", "chosen": "c", "rejected": "r"},
        {"human": "h", "chosen": "c", "rejected": "r"},
        {"prompt": "p", "chosen": " ", "rejected": "r"},
        {"prompt": "p", "chosen": "c"},
    ]
    got = [r[0] for r in records(spark, rows).orderBy("i").select(R.preference_row()).collect()]
    assert [None if g is None else tuple(g) for g in got] == [("p q", "c", "r"), ("h", "c", "r"), None, None]


def test_transcripts(spark):
    rows = [
        {"conversations": [{"from": "human", "value": "hi"}, {"role": "TOOL", "text": "ok"}, {"value": ""}, {"from": "gpt", "value": " yo "}]},
        {"src": "s", "target": "t", "tgt": "t"},
        {"question": "q", "prompt": "", "answer": "a"},
    ]
    text = R.transcript_record(fixed.SOURCE_SIDE_KEYS, fixed.TARGET_SIDE_KEYS)
    got = [r[0] for r in records(spark, rows).orderBy("i").select(text).collect()]
    assert got == ["User: hi\nTool: ok\nAssistant:  yo", "User: s\nAssistant: t", "User: \nAssistant: a"]


def test_validation(spark):
    turns = [(f"u{i}", f"a{i}") for i in range(13)] + [("blank", " "), (" ", "blank")]
    df = spark.createDataFrame([(1, " s ", turns), (2, "", [("x", "\n")]), (3, "s", [("q" * 50, "r" * 50)])],
                               "i int, system string, turns array<struct<user:string,assistant:string>>")
    rows = {r["i"]: r for r in V.validate_rows(df, max_chars=1000).collect()}
    assert set(rows) == {1, 3}
    assert [t["user"] for t in rows[1]["turns"]] == [f"u{i}" for i in range(1, 13)]
    assert rows[1]["text"].startswith("<|system|>\ns\n<|user|>\nu1\n<|assistant|>\na1\n")
    cut = {r["i"]: r for r in V.validate_rows(df, max_chars=60).collect()}[3]
    assert cut["system"] == SYSTEM and cut["turns"][0]["user"] == "(truncated)"
    whole = rows[3]["text"]
    assert cut["turns"][0]["assistant"] == whole[-60:]
    with pytest.raises(ValueError):
        V.require_rows(V.validate_rows(df.where("i = 2")))


def test_valid_turn_limits(spark):
    df = spark.createDataFrame([("u", "a" * 19), ("u", "a" * 20), ("", "a" * 20), ("?", "!" * 20), ("?", "!_" * 10), ("é", "!" * 20)], "u string, a string")
    got = [r[0] for r in df.select(render.valid_turn(F.col("u"), F.col("a"))).collect()]
    assert got == [False, True, False, False, False, True]


def test_world_and_memory_blocks(spark):
    df = spark.createDataFrame([(["a", "b"], {"k": "v"}, ["m1", "m2"]), ([], {}, []), (None, None, None)],
                               "c array<string>, f map<string,string>, m array<string>")
    block = render.world_block(F.lit("L"), F.lit("T"), F.lit("E"), F.lit("P"), F.col("c"), F.col("f"))
    got = [tuple(r) for r in df.select(block, render.memory_block(F.col("m"))).collect()]
    text = "location: L\ntime: T\ncharacters_present: {}\ncurrent_event: E\nstory_progress: P\nfacts:\n{}"
    assert got == [
        (text.format("a, b", "- k: v"), "- m1\n- m2"),
        (text.format("(none)", "(none)"), "(none)"),
        (text.format("(none)", "(none)"), "(none)"),
    ]
