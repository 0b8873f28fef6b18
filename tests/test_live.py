"""A store kept from changes, against plain dictionaries, whatever the batches and their order."""

import random

import pytest
from pyspark.sql import functions as F

from parley.sources import live

SCHEMA = "kind string, id bigint, session bigint, version bigint, deleted boolean, text string"


def newest():
    return [F.desc("version"), F.desc("id")]


def brute(changes, n):
    buried, sessions, messages = {}, {}, {}
    for kind, key, session, version, deleted, text in changes:
        if kind == "session" and deleted:
            buried[key] = max(version, buried.get(key, -1))
        held = sessions if kind == "session" else messages
        if key not in held or (version, deleted) > (held[key][1], held[key][2]):
            held[key] = (session, version, deleted, text)
    sessions = {k: (s, v, t) for k, (s, v, d, t) in sessions.items() if not d}
    messages = {k: (s, v, t) for k, (s, v, d, t) in messages.items() if not d and v > buried.get(s, -1)}
    recent = {}
    for k, (s, v, t) in sorted(messages.items(), key=lambda m: (-m[1][1], -m[0])):
        if sum(r[0] == s for r in recent.values()) < n:
            recent[k] = (s, v, t)
    return {"sessions": sessions, "messages": messages, "recent": recent}


def some_changes(seed, count=240):
    rng, rows = random.Random(seed), []
    for at in range(count):
        session = rng.choice([0, 0, 1, 2, 3, 4])
        deleted = rng.random() < 0.3
        version = rng.randrange(40)
        if rng.random() < 0.15:
            rows.append(("session", session, session, version, deleted, None if deleted else f"s{at}"))
        else:
            rows.append(("message", session * 100 + rng.randrange(12), session, version, deleted, None if deleted else f"m{at}"))
    # one row of contents per (kind, id, version, deleted): equal versions are decided by a hash
    return list({r[:2] + r[3:5]: r for r in rows}.values())


def held(spark, folder, schema):
    tables = {}
    for name in ("sessions", "messages", "recent"):
        rows = live.load_live(spark, folder, name, schema).collect()
        tables[name] = {r["id"]: (r["session"], r["version"], r["text"]) for r in rows}
        assert len(rows) == len(tables[name])
    return tables


@pytest.fixture
def small_cells(monkeypatch):
    monkeypatch.setattr(live, "CELLS", 3)
    monkeypatch.setattr(live, "SALTS", 2)


def test_store_of_any_order(spark, tmp_path, small_cells):
    changes = some_changes(3)
    for seed in (0, 1):
        rows = changes[:]
        random.Random(seed).shuffle(rows)
        folder, seen = f"{tmp_path}/{seed}", []
        copies = {"feed": {}, "recent_feed": {}}
        batches = 3 - seed
        for number in range(1, batches + 1):
            part = rows[number - 1 :: batches]
            # old changes come again
            batch = spark.createDataFrame([*part, *seen[::17]], SCHEMA)
            for _ in range(2 if number == 2 else 1):
                live.apply_changes(batch, folder, number, newest(), 2)
            seen += part
            want, got = brute(seen, 2), held(spark, folder, batch.schema)
            assert got == want
            for name, copy in copies.items():
                for r in live.load_feed(spark, folder, name, batch.schema, after=number - 1).collect():
                    key = (r["kind"], r["id"])
                    if r["op"] == "put":
                        copy[key] = (r["session"], r["version"], r["text"])
                    else:
                        del copy[key]  # nothing is deleted that was not told of
            assert copies["recent_feed"] == {("message", k): v for k, v in want["recent"].items()}
            whole = {("message", k): v for k, v in want["messages"].items()}
            assert copies["feed"] == whole | {("session", k): v for k, v in want["sessions"].items()}


def test_odd_changes(spark, tmp_path, small_cells):
    folder = str(tmp_path / "odd")
    rows = [
        ("message", None, 1, 1, False, "no id"),
        ("message", 1, None, 1, False, "no session"),
        ("message", 2, 1, None, False, "no version"),
        ("other", 3, 1, 1, False, "no kind"),
        ("message", 4, 1, 1, False, None),
        ("message", 5, 1, 2, False, "x" * 100_000),
        ("message", 5, 1, 2, False, "x" * 100_000),
    ]
    empty = spark.createDataFrame([], SCHEMA)
    live.apply_changes(empty, folder, 1, newest(), 2)
    assert held(spark, folder, empty.schema) == {"sessions": {}, "messages": {}, "recent": {}}
    live.apply_changes(spark.createDataFrame(rows, SCHEMA), folder, 2, newest(), 2)
    kept = {4: (1, 1, None), 5: (1, 2, "x" * 100_000)}
    assert held(spark, folder, empty.schema) == {"sessions": {}, "messages": kept, "recent": kept}
    assert live.load_feed(spark, folder, "feed", empty.schema).count() == 2
    # a batch of nothing changes nothing and tells nothing
    live.apply_changes(empty, folder, 3, newest(), 2)
    assert held(spark, folder, empty.schema)["recent"] == kept
    assert live.load_feed(spark, folder, "feed", empty.schema, after=2).count() == 0
    # all go with their session, also one that comes late, and the cells are left empty
    gone = [("session", 1, 1, 9, True, None), ("message", 6, 1, 3, False, "late")]
    live.apply_changes(spark.createDataFrame(gone, SCHEMA), folder, 4, newest(), 2)
    live.apply_changes(spark.createDataFrame([("message", 7, 1, 9, False, "late")], SCHEMA), folder, 5, newest(), 2)
    assert held(spark, folder, empty.schema) == {"sessions": {}, "messages": {}, "recent": {}}
    assert live.load_feed(spark, folder, "feed", empty.schema, after=3).where("op = 'delete'").count() == 2
