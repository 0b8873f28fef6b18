"""Long files read in pieces: the same records as the whole file, wherever the pieces are cut."""

import json
import random

import pytest
from pyspark.sql import functions as F

from parley.sources import files

NASTY = ['plain', 'a "quoted" word', 'back\\slash', 'ends with \\', '} ] { [', '","', '\\"}', 'two\nlines', 'é 😀  ', '', '\t', '{"user": "no"}', "]}"]


@pytest.fixture
def tiny_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def records(n, seed=1):
    rng = random.Random(seed)
    pick = lambda: rng.choice(NASTY) + " " * rng.randrange(3) + rng.choice(NASTY)
    out = []
    for i in range(n):
        one = {"system": str(i), "user": pick(), "assistant": pick()}
        if i % 5 == 0:
            one["messages"] = [{"role": "user", "content": pick()}, {"role": "assistant", "content": pick()}]
        if i % 7 == 0:
            one["meta"] = {"deep": [{"x": [1, {}]}, []]}
        out.append(one)
    return out


def rows_of(frame):
    named = frame.select("path", "row_id", "system", "user", "assistant", F.to_json("messages").alias("m"))
    return sorted(map(tuple, named.collect()))


@pytest.mark.parametrize("form", ["list", "ascii", "data_spaced"])
def test_json_document_in_pieces(spark, tmp_path, tiny_splits, form):
    some = records(60)
    body = {
        "list": lambda: json.dumps(some, ensure_ascii=False),
        "spaced": lambda: "\n " + json.dumps(some, indent=2, ensure_ascii=False) + "\n\n",
        "ascii": lambda: json.dumps(some),
        "data": lambda: json.dumps({"data": some}),
        "data_spaced": lambda: " " + json.dumps({"data": some}, indent=1, ensure_ascii=False) + " \n",
    }[form]()
    path = tmp_path / "docs" / "a.json"
    path.parent.mkdir()
    path.write_text(body, encoding="utf-8")
    (path.parent / "small.json").write_text(json.dumps(records(1, 5)))
    want = files.read_json_documents(spark, str(path.parent))
    assert want.count() == 61
    got = files.read_json_documents(spark, str(path.parent), long=1_000)
    assert rows_of(got) == rows_of(want)
    assert spark.read.option("lineSep", "}").text(str(path)).rdd.getNumPartitions() > 4


def test_other_shapes_fall_back_or_fail(spark, tmp_path, tiny_splits):
    some = records(20)
    good = {"more": {"a": [{"b": 1}]}, "data": some, "after": [{"c": 2}]}
    (tmp_path / "x.json").write_text(json.dumps(good))
    (tmp_path / "y.json").write_text("[ \n ]" + " " * 500)
    (tmp_path / "z.json").write_text('{"data" : []}' + " " * 500)
    got = files.read_json_documents(spark, str(tmp_path), long=100)
    assert [r["system"] for r in got.orderBy("row_id").collect()] == [str(i) for i in range(20)]
    text = json.dumps(some)
    for i, bad in enumerate((text[:-1], text[:-30], text.replace("}, {", "}, 5, {", 1), text.replace("}, {", "} {", 1), '{"user": "x"}' + " " * 200)):
        path = tmp_path / f"bad{i}" / "b.json"
        path.parent.mkdir()
        path.write_text(bad)
        with pytest.raises(Exception):
            files.read_json_documents(spark, str(path.parent), long=100).collect()


def csv_text(rows, sep, quote_all):
    def cell(x):
        return '"' + x.replace('"', '""') + '"' if quote_all or any(c in x for c in f'"\n{sep}') or not x else x

    return "".join(sep.join(map(cell, r)) + "\n" for r in rows)


@pytest.mark.parametrize("sep,ending", [(",", "csv"), ("\t", "tsv")])
@pytest.mark.parametrize("quote_all", [True, False])
def test_csv_in_pieces(spark, tmp_path, tiny_splits, sep, ending, quote_all):
    rng = random.Random(3)
    cells = ["plain", 'say "hi"', "two\nlines", "a,b\tc", "", "x", '"', '\n"\n', "5 inch", "\n\n", "z" * 50]
    rows = [[str(i), rng.choice(cells) + "!", rng.choice(cells) + rng.choice(cells)] for i in range(80)]
    for name, some in (("long", rows), ("short", rows[:2])):
        (tmp_path / f"{name}.{ending}").write_text(csv_text([["system", "user", "assistant"], *some], sep, quote_all))
    keys = ["system", "user", "assistant"]
    want = sorted(map(tuple, files.read_delimited(spark, str(tmp_path), ending).select(*keys).collect()))
    assert want == sorted([tuple(r) for r in rows + rows[:2]])
    got = files.read_delimited(spark, str(tmp_path), ending, long=1_000)
    assert sorted(map(tuple, got.select(*keys).collect())) == want
    in_order = got.where(F.col("path").contains("long")).orderBy("row_id").select("system").collect()
    assert [r[0] for r in in_order] == [r[0] for r in rows]


def test_broken_file_spoils_its_own_source_alone(spark, tmp_path):
    """Eight good documents and one broken one beside a good source."""
    for i in range(8):
        (tmp_path / "mixed").mkdir(exist_ok=True)
        (tmp_path / "mixed" / f"{i}.json").write_text(json.dumps(records(5, i)))
    (tmp_path / "mixed" / "9.json").write_text('[{"user": "x", "assistant": ')
    (tmp_path / "mixed" / "8.json").write_text('[{"user": "x"}, 5]')
    (tmp_path / "good.json").write_text(json.dumps(records(30, 77)))
    sources = {"mixed": str(tmp_path / "mixed"), "good": str(tmp_path / "good.json"), "gone": str(tmp_path / "no.jsonl")}
    rows, report = files.load_sources(spark, sources)
    assert rows.count() == 30 and {r["source"] for r in rows.select("source").distinct().collect()} == {"good"}
    found = sorted((r["source"], r["status"].split(":")[0], r["rows"], (r["path"] or "")[-6:], r["reason"] is None) for r in report.collect())
    assert found == [
        ("gone", "failed", 0, "", False), ("good", "loaded", 30, "", True),
        ("mixed", "failed", 0, "8.json", False), ("mixed", "failed", 0, "9.json", False),
    ]
