import json
import os

import pytest
from pyspark.sql import functions as F

from parley import fixed
from parley.catalog import sources
from parley.operators.replay import synthesize_profiles
from parley.operators.validate import refuse_rejects, valid_profiles
from parley.sources import files, snapshots, tables


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


FLAT = [{"system": "s", "user": f"u{i}", "assistant": f"a{i}"} for i in range(3)]


def users(rows):
    return sorted(t["user"] for r in rows.collect() for t in r["turns"])


def test_json_lines_and_rejects(spark, tmp_path):
    lines = [json.dumps(FLAT[0]), "", "  ", '{"user": broken', "[1, 2]", '{"other": 1}', json.dumps(FLAT[1]), '"text"']
    path = write(tmp_path / "bad.jsonl", "\n".join(lines))
    rows, rejects = files.load_rows(spark, path)
    assert users(rows) == ["u0", "u1"]
    assert sorted(r["reason"] for r in rejects.collect()) == ["malformed row"] * 3 + [
        "record of no known shape"
    ]
    numbered = files.read_json_lines(spark, path, numbered=True)
    bad = numbered.where(F.col(files.CORRUPT).isNotNull()).select("row_no").collect()
    assert sorted(r[0] for r in bad) == [4, 5, 8]
    mapped = files.map_chat_record(numbered)
    with pytest.raises(Exception, match="invalid row"):
        refuse_rejects(mapped).collect()


def test_line_numbers_over_several_splits(spark, tmp_path):
    for name in ("a", "b"):
        write(tmp_path / f"{name}.jsonl", "\n".join(json.dumps({"user": f"{name}{i}", "assistant": "x"}) for i in range(500)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        rows = files.read_json_lines(spark, str(tmp_path), numbered=True).select("user", "row_no").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(rows) == 1_000 and all(int(r["user"][1:]) + 1 == r["row_no"] for r in rows)


def test_json_documents(spark, tmp_path):
    write(tmp_path / "one/array.json", json.dumps(FLAT[:2]))
    write(tmp_path / "one/data.json", json.dumps({"data": FLAT[2:]}, indent=1))
    assert users(files.load_rows(spark, str(tmp_path / "one"))[0]) == ["u0", "u1", "u2"]
    for name, text in (("object", '{"user": "x"}'), ("scalars", '["x"]'), ("broken", '[{"user": 1')):
        path = write(tmp_path / f"bad_{name}.json", text)
        with pytest.raises(Exception):
            files.read_corpus(spark, path).collect()


def test_delimited(spark, tmp_path):
    write(tmp_path / "f.csv", 'system,user,assistant\ns,"a, ""b""\nc",x\n,u2,\n')
    write(tmp_path / "f.tsv", "user\tassistant\nu3\ty\n")
    csv, _ = files.load_rows(spark, str(tmp_path / "f.csv"))
    rows = csv.orderBy("row_id").collect()
    assert [(r["system"], tuple(r["turns"][0])) for r in rows] == [
        ("s", ('a, "b"\nc', "x")), (fixed.CHAT_SYSTEM, ("u2", "")),
    ]
    assert users(files.load_rows(spark, str(tmp_path / "f.tsv"))[0]) == ["u3"]


def test_headers_differ(spark, tmp_path):
    """Every file by its own header, columns in any order."""
    write(tmp_path / "c/a.csv", "system,user,assistant\ns,u1,a1\n")
    write(tmp_path / "c/b.csv", "assistant,user\na2,u2\na3,u3\n")
    write(tmp_path / "c/empty.csv", "")
    for multi in (True, False):
        rows = files.read_delimited(spark, str(tmp_path / "c"), "csv", multi)
        assert sorted((r["system"] or "", r["user"], r["assistant"]) for r in rows.collect()) == [
            ("", "u2", "a2"), ("", "u3", "a3"), ("s", "u1", "a1"),
        ]


def test_folder_with_a_dot(spark, tmp_path):
    write(tmp_path / "corpus.v2/a.jsonl", json.dumps(FLAT[0]))
    write(tmp_path / "corpus.csv/b.csv", "user,assistant\nu9,a9\n")
    assert users(files.load_rows(spark, str(tmp_path / "corpus.v2"))[0]) == ["u0"]
    assert users(files.load_rows(spark, str(tmp_path / "corpus.csv"))[0]) == ["u9"]


def test_folder_of_all_formats(spark, tmp_path):
    write(tmp_path / "a.JSONL", json.dumps(FLAT[0]) + "\n")
    write(tmp_path / "b.jl", json.dumps({"messages": [{"role": "user", "content": "m"}, {"role": "assistant", "content": "x"}]}))
    write(tmp_path / "c.json", json.dumps(FLAT[1:2]))
    write(tmp_path / "d.csv", "user,assistant\nu9,a9\n")
    write(tmp_path / "notes.txt", "skip me")
    write(tmp_path / "deep/e.jsonl", json.dumps(FLAT[2]))
    rows, rejects = files.load_rows(spark, str(tmp_path))
    assert users(rows) == ["m", "u0", "u1", "u9"] and rejects.isEmpty()
    with pytest.raises(ValueError):
        files.read_corpus(spark, write(tmp_path / "x.parquet", ""))
    (tmp_path / "empty").mkdir()
    with pytest.raises(ValueError):
        files.read_corpus(spark, str(tmp_path / "empty"))
    with pytest.raises(ValueError):
        files.read_corpus(spark, "")


def test_failed_sources_are_reported(spark, tmp_path):
    good = write(tmp_path / "good.jsonl", "\n".join(json.dumps(r) for r in FLAT))
    rows, report = files.load_sources(spark, {"good": good, "gone": str(tmp_path / "none.jsonl")})
    assert rows.count() == 3
    assert sorted((r["source"], r["status"].split(":")[0], r["rows"]) for r in report.collect()) == [
        ("gone", "failed", 0), ("good", "loaded", 3),
    ]
    none, report = files.load_sources(spark, {"gone": str(tmp_path / "none.jsonl")})
    assert none is None and report.count() == 1


PROFILE = "\n".join(f"{f}: some {f}; more: yes" for f in [*fixed.PROFILE_REQUIRED, fixed.PROFILE_OPTIONAL])


def test_profiles(spark, tmp_path):
    write(tmp_path / "profiles/wizard.yaml", PROFILE + "\n\n")
    write(tmp_path / "profiles/user/iron_man.yml", PROFILE.replace("name: some name; more: yes", 'name: "Iron Man"', 1))
    write(tmp_path / "profiles/broken.yaml", "name: x\nrole:\n")
    rows = {r["id"]: r for r in tables.read_profiles(spark, str(tmp_path / "profiles")).collect()}
    assert set(rows) == {"wizard", "user/iron_man", "broken"}
    assert rows["wizard"]["role"] == "some role; more: yes" and rows["user/iron_man"]["name"] == "Iron Man"
    valid = valid_profiles(tables.read_profiles(spark, str(tmp_path / "profiles")))
    assert {r["id"] for r in valid.collect()} == {"wizard", "user/iron_man"}


def test_many_profiles_of_a_file(spark, tmp_path):
    one, two = PROFILE.replace("some name", "A", 1), PROFILE.replace("some name", "B", 1)
    write(tmp_path / "profiles/more/all.yaml", f"---\n{one}\n---\n{two}\n---\nname: x\n---\n\n")
    write(tmp_path / "profiles/single.yml", one)
    read = tables.read_profiles(spark, str(tmp_path / "profiles"), many=True)
    assert {r["id"].split(";")[0] for r in read.collect()} == {"more/all#A", "more/all#B", "more/all#x", "single#A"}
    assert valid_profiles(read).count() == 3


def test_profiles_make_no_file_each(spark, tmp_path, monkeypatch):
    """Files grow with the tasks, not with the suppliers."""
    suppliers = spark.range(700).select(F.col("id").alias("s_suppkey"), F.concat(F.lit("S"), "id").alias("s_name"))
    suppliers.coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    monkeypatch.setattr(sources, "working_folder", lambda spark, name: str(tmp_path / name))
    got = {r["name"]: r["behavior_rules"] for r in sources.read_profiles(spark, str(tmp_path)).collect()}
    assert got == {f"S{i}": "" if i % 2 else f"rule: {i}" for i in range(700)}
    assert len(list((tmp_path / "profiles").glob("*.yaml"))) <= 64


def test_scripts_of_whole_conversations(spark, tmp_path, monkeypatch):
    """A script goes on past 1,000 turns, its places counted through; files grow with the rows, not with the scripts."""
    schema = "conv_id bigint, turn bigint, role string, text string"
    rows = [(k, 2 * t, "user", f'{k} "said"\n{t}') for k in (3, 4) for t in range(1_500)] + [(3, 1, "assistant", "a"), (6, 0, "user", "")]
    spark.createDataFrame(rows, schema).repartition(5).write.parquet(str(tmp_path / "conversations.parquet"))
    monkeypatch.setattr(sources, "working_folder", lambda spark, name: str(tmp_path / name))
    read = sources.turn_scripts(spark, str(tmp_path))
    assert read.columns == ["conv_id", "turn", "user"]
    want = [(k, t + 1, f'{k} "said"\n{t}') for k in (3, 4) for t in range(1_500)] + [(6, 1, "")]
    assert sorted(tuple(r) for r in read.collect()) == want
    assert not [p for p in (tmp_path / "source").iterdir() if p.is_dir()]


def test_many_scripts_of_a_file(spark, tmp_path):
    said = '--- a\n[\n"x"\n,"--- y"]\n--- b\n"u"\n\n{"text": "v"}\n--- c\n'
    path = write(tmp_path / "all.txt", said)
    got = tables.read_turn_scripts(spark, path, many=True).collect()
    assert sorted((r["path"].rsplit("/", 1)[1], r["turn"], r["user"]) for r in got) == [
        ("all.txt#a", 1, "x"), ("all.txt#a", 2, "--- y"), ("all.txt#b", 1, "u"), ("all.txt#b", 2, "v"),
    ]


def test_synthesized_profiles(spark):
    whole = {f: f"v {f}" for f in fixed.PROFILE_REQUIRED}
    replies = [json.dumps(whole), json.dumps({**whole, "role": " "}), "no json", "```json\n" + json.dumps({**whole, "name": ""}) + "\n```"]
    df = spark.createDataFrame([(i, " Zed ", r) for i, r in enumerate(replies)], "i int, name string, reply string")
    got = {r["i"]: r for r in synthesize_profiles(df).collect()}
    assert got[0]["name"] == "v name" and got[0]["behavior_rules"] == "Respond as v name would."
    for i in (1, 2):
        assert got[i]["name"] == got[i]["role"] == "Zed"
        assert got[i]["behavior_rules"] == "Respond like Zed; do not mention being an AI unless asked."
    assert got[3]["name"] == "Zed" and got[3]["role"] == "v role"


def test_turn_scripts_and_run_records(spark, tmp_path):
    one = write(tmp_path / "t.json", '["first", "second"]')
    two = write(tmp_path / "t.jsonl", '"a"\n\n{"user": "b"}\n{"user": "", "text": "c"}\n')
    assert [r["user"] for r in tables.read_turn_scripts(spark, one).orderBy("turn").collect()] == ["first", "second"]
    script = tables.read_turn_scripts(spark, two)
    assert [(r["turn"], r["user"]) for r in script.orderBy("turn").collect()] == [(1, "a"), (2, "b"), (3, "c")]
    with pytest.raises(Exception, match="invalid turn line"):
        tables.read_turn_scripts(spark, write(tmp_path / "bad.jsonl", '{"other": 1}')).collect()
    turns = script.withColumn("assistant", F.upper("user")).withColumn("session", F.lit("s"))
    records = tables.run_records(turns, "session", F.struct(F.lit("wizard").alias("character")), turns_per_record=2)
    out = str(tmp_path / "runs")
    tables.append_json(records, out)
    tables.append_json(records, out)
    back = spark.read.json(out)
    assert back.count() == 4
    rows = back.where("part = 0").first()
    assert rows["meta"]["character"] == "wizard"
    assert [(t["turn"], t["user"], t["assistant"]) for t in rows["turns"]] == [(1, "a", "A"), (2, "b", "B")]


def test_attachments(spark, tmp_path):
    write(tmp_path / "notes.txt", "  body \n")
    row = tables.read_attachments(spark, str(tmp_path)).first()
    assert row["block"] == "[Attachment: notes.txt]\nbody"


def test_logs_round_trip(spark, tmp_path):
    turns = spark.createDataFrame([(1, "wizard", "u", "a")], "user_id int, character_id string, user string, assistant string")
    rows = tables.log_rows(turns, F.lit(0.9), F.lit("2024-01-01 00:00:00").cast("timestamp"))
    tables.append_json(rows, str(tmp_path / "log"))
    back = tables.read_logs(spark, str(tmp_path / "log")).first()
    assert (back["user_id"], back["quality_score"], back["ts"].year) == ("1", 0.9, 2024)


def test_snapshots(spark, tmp_path):
    folder = str(tmp_path / "memory")
    df = spark.createDataFrame([(1, "a", {"k": "v"})], "seq bigint, text string, meta map<string,string>")
    assert snapshots.load_snapshot(spark, folder, df.schema).isEmpty()
    assert snapshots.save_snapshot(df, folder) == 1
    assert snapshots.save_snapshot(df.union(df), folder) == 2
    assert snapshots.load_snapshot(spark, folder, df.schema).count() == 2
    assert snapshots.load_snapshot(spark, folder, df.schema, before=2).count() == 1
    assert snapshots.save_snapshot(df, folder, 2) == 2
    assert snapshots.load_snapshot(spark, folder, df.schema).first()["meta"] == {"k": "v"}
    # an empty version is a version
    assert snapshots.save_snapshot(df.limit(0), folder) == 3
    assert snapshots.load_snapshot(spark, folder, df.schema).isEmpty()
    assert snapshots.versions(spark, folder) == [2, 3]


def test_unreadable_snapshots(spark, tmp_path):
    schema = "seq bigint, text string"
    df = spark.createDataFrame([(1, "a")], schema)
    # a write that never ended is no version
    write(tmp_path / "half/snapshot=1/part-0.parquet", "junk")
    assert snapshots.load_snapshot(spark, str(tmp_path / "half"), df.schema).isEmpty()
    # one that ended and cannot be read is an error, and nothing is written over it
    folder = str(tmp_path / "broken")
    write(tmp_path / "broken/snapshot=1/part-0.parquet", "junk")
    write(tmp_path / "broken/snapshot=1/_SUCCESS", "")
    with pytest.raises(Exception):
        snapshots.load_snapshot(spark, folder, df.schema).collect()
    assert snapshots.load_snapshot_or_empty(spark, folder, df.schema).isEmpty()


def test_views_rewrite_touched_buckets(spark, tmp_path):
    folder, kept = str(tmp_path / "view"), {}
    caches = spark.sparkContext._jsc.getPersistentRDDs().size()
    for number in range(1, 11):
        rows = [(k, number if k % 3 else 10 - number, f"{number}") for k in range(number, 40, number)]
        for k, at, text in rows:
            if k not in kept or at >= kept[k][0]:
                kept[k] = (at, text)
        changes = spark.createDataFrame(rows, "id bigint, at int, text string")
        snapshots.save_view(changes, folder, "id", "at", number, buckets=8)
        if number == 4:  # a repeated batch changes nothing
            snapshots.save_view(changes, folder, "id", "at", number, buckets=8)
    got = {r["id"]: (r["at"], r["text"]) for r in snapshots.load_view(spark, folder, changes.schema).collect()}
    assert got == kept
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == caches
    assert snapshots.versions(spark, f"{folder}/manifest") == [9, 10]
    files = [p for p in (tmp_path / "view/data").rglob("bucket=*")]
    assert len(files) <= 16  # two versions' worth


def test_one_file_a_bucket(spark, tmp_path):
    """Rows of a bucket that lie in many tasks become one file of it."""
    rows = spark.range(4_000).repartition(8).withColumn("bucket", (F.col("id") % 16).cast("int"))
    manifest = snapshots.write_buckets(rows, str(tmp_path), 1, {}, [*range(16)])
    assert sorted(manifest) == [*range(16)]
    assert len(list((tmp_path / "data/snapshot=1").glob("bucket=*/*.parquet"))) == 16
