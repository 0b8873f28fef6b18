"""Long JSON and quoted CSV files read by many tasks.

A byte range of such a file does not tell whether it begins inside a string, or how deep in lists
and objects. Each piece of text (up to a closing brace, or a line) is therefore measured for every
state it might begin in; the pieces' effects are folded over the file in blocks, as other folds
are, and only then are pieces put together to records. Text is read once and kept with its
measures; the folds run on a few numbers per piece.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.plans.folds import Order, carry, total_before
from parley.plans.ranks import rows_before
from parley.plans.sizes import checked_broadcast
from parley.session import settled

#: Files above this many bytes are read in pieces.
LONG = 64 << 20
#: Pieces of a file in one cell of a fold.
CELL = 500_000
_ORDER = Order(("path",), "row_no", CELL, None)

#: What stands before the first record of a list, and of a list under ``data``.
_LIST, _DATA = r"\s*+\[", r"\s*+\{\s*+\"data\"\s*+:\s*+\["


def numbered(pieces: DataFrame) -> DataFrame:
    """Add ``row_no``, the number of a piece in its file from 1; counted per file split first."""
    counts = pieces.groupBy("path", "block").agg(F.count("*").alias("__rows"))
    before = rows_before(counts, ["path"], "block").drop("__rows")
    return pieces.join(checked_broadcast(before), ["path", "block"]).withColumn(
        "row_no", F.col("__before") + F.col("place")
    ).drop("__before")


def _pieces(spark: SparkSession, path: str | list[str], end: str | None, glob: str | None, size: int) -> DataFrame:
    reader = spark.read if glob is None else spark.read.option("pathGlobFilter", glob)
    if end is not None:
        reader = reader.option("lineSep", end)
    found = reader.text(path).where(F.col("_metadata.file_size") > size)
    return found.select(
        "value",
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_size").alias("file_size"),
        F.monotonically_increasing_id().alias("row_id"),
    )


def _placed(pieces: DataFrame, name: str, **measures: Column) -> DataFrame:
    """The pieces with their measures, written once, and the number of each in its file."""
    kept = settled(pieces.select("*", *[c.alias(n) for n, c in measures.items()]), name)
    # a file split is read by one task in order, so its first row id tells the place in it
    first = kept.groupBy("path", "block").agg(F.min("row_id").alias("__first"))
    placed = kept.join(checked_broadcast(first), ["path", "block"])
    return numbered(placed.withColumn("place", F.col("row_id") - F.col("__first") + 1).drop("__first"))


def _count(text: Column, sign: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(sign), F.lit("")))


# -- JSON documents -------------------------------------------------------------------------------


def _bare(text: Column, inside: bool) -> Column:
    """What stands outside strings; escapes are out already."""
    if inside:
        text = F.regexp_replace(text, r'^[^"]*+("|$)', "")
    return F.regexp_replace(text, r'"[^"]*+("|$)', "")


def _depth(text: Column) -> Column:
    return _count(text, "{") + _count(text, "[") - _count(text, "]")


def json_records(
    spark: SparkSession, path: str | list[str], glob: str | None = None, size: int = LONG
) -> tuple[DataFrame, DataFrame]:
    """((path, row_id, text) of every record of the long files, (path) of files of another shape).

    A file is a list of objects, or an object with nothing but such a list under ``data``. Broken
    files count as of another shape.
    """
    clean = F.regexp_replace("value", r"(?s)\\.", "")
    pieces = _placed(
        _pieces(spark, path, "}", glob, size),
        "pieces",
        quotes=_count(clean, '"').cast("bigint"),
        out=_depth(_bare(clean, False)).cast("bigint"),
        inner=_depth(_bare(clean, True)).cast("bigint"),
        bytes=(F.octet_length("value") + 1).cast("bigint"),
        opening=F.substring(F.ltrim("value"), 1, 1),
    )
    narrow = pieces.drop("value", "block", "place", "row_id")
    # the last piece may end with the file and not with a brace
    files = narrow.groupBy("path").agg(
        F.max("row_no").alias("pieces"),
        (F.sum("bytes") == F.max("file_size")).alias("braced"),
        F.min_by("opening", "row_no").alias("opening"),
    )
    files = files.withColumn("base", F.when(F.col("opening") == "{", 2).otherwise(1))
    rows = narrow.drop("opening").join(checked_broadcast(files), "path")
    rows = total_before(rows, _ORDER, "quotes", "__quotes")
    inside = F.col("__quotes") % 2 == 1
    closes = ((F.col("__quotes") + F.col("quotes")) % 2 == 0) & (
        F.col("braced") | (F.col("row_no") < F.col("pieces"))
    )
    rows = rows.withColumns(
        {"closes": closes, "change": F.when(inside, F.col("inner")).otherwise(F.col("out")) - closes.cast("int")}
    )
    rows = total_before(rows, _ORDER, "change", "__depth")
    ends = F.col("closes") & (F.col("__depth") + F.col("change") == F.col("base"))
    rows = total_before(rows.withColumn("ends", ends.cast("int")), _ORDER, "ends", "record")
    cut = rows.select("path", "row_no", "record", "ends", "closes", "base")
    joined = pieces.select("path", "row_no", "value").join(cut, ["path", "row_no"])
    # a brace inside a string or a deeper object is a part of the text, too
    brace = F.when((F.col("row_no") < F.col("__last")) | F.col("__braced"), "}").otherwise("")
    last = files.select("path", F.col("pieces").alias("__last"), F.col("braced").alias("__braced"))
    texts = (
        joined.join(checked_broadcast(last), "path")
        .groupBy("path", "record")
        .agg(
            F.array_join(
                F.transform(
                    F.array_sort(F.collect_list(F.struct("row_no", F.concat("value", brace).alias("text")))), lambda p: p["text"]
                ),
                "",
            ).alias("text"),
            F.max("ends").alias("whole"),
            F.max("base").alias("base"),
        )
    )
    start = F.when(F.col("base") == 2, F.lit(_DATA)).otherwise(F.lit(_LIST))
    head = F.when(F.col("record") == 0, start).otherwise(F.lit(r"\s*+,"))
    tail = F.concat(
        F.when(F.col("record") == 0, start).otherwise(F.lit("")),
        F.when(F.col("base") == 2, F.lit(r"\s*+\]\s*+\}\s*+")).otherwise(F.lit(r"\s*+\]\s*+")),
    )
    body = F.regexp_replace("text", F.concat(F.lit("^"), head, F.lit(r"\s*+")), F.lit(""))
    is_record = F.col("whole") == 1
    fits = F.when(is_record, F.regexp("text", F.concat(F.lit("^"), head, F.lit(r"\s*+\{")))).otherwise(
        F.regexp("text", F.concat(F.lit("^"), tail, F.lit("$")))
    )
    checked = settled(texts.select("path", "record", is_record.alias("is_record"), fits.alias("fits"), body.alias("body")), "records")
    # a file is whole if every part fits and its end is there
    shape = checked.groupBy("path").agg(F.bool_and("fits").alias("fits"), F.bool_or(~F.col("is_record")).alias("ended"))
    other = shape.where(~(F.col("fits") & F.col("ended"))).select("path")
    good = checked.where("is_record").join(checked_broadcast(other), "path", "left_anti")
    return good.select("path", F.col("record").alias("row_id"), F.col("body").alias("text")), other


# -- quoted CSV -----------------------------------------------------------------------------------


def _ends_inside(sep: str, inside: bool) -> Column:
    """Whether a line that begins inside (or outside) quotes ends inside them."""
    s = "\\t" if sep == "\t" else sep
    quoted = r'[^"]*+(?:""[^"]*+)*+'
    field = rf'(?:"{quoted}"[^{s}]*+|(?!")[^{s}]*+)'
    open_after = rf'(?:{field}{s})*+"{quoted}$'
    if not inside:
        return F.regexp("value", F.lit(f"^{open_after}"))
    return F.regexp("value", F.lit(rf'^{quoted}(?:$|"[^{s}]*+{s}{open_after})'))


def csv_records(spark: SparkSession, paths: Sequence[str], sep: str, size: int = LONG) -> DataFrame:
    """(path, row_id, text) of every record after the header of the long files; a record may be several lines."""
    lines = _placed(
        _pieces(spark, list(paths), None, None, size),
        "lines",
        after_out=_ends_inside(sep, False),
        after_in=_ends_inside(sep, True),
    )
    # a line keeps the state, turns it over, or sets it whatever it was
    narrow = lines.select("path", "row_no", "after_out", "after_in")
    turns = (F.col("after_out") & ~F.col("after_in")).cast("int")
    rows = total_before(narrow.withColumn("turns", turns), _ORDER, "turns", "__turns")
    sets = F.when(F.col("after_out") == F.col("after_in"), (F.col("after_out").cast("int") + F.col("__turns")) % 2)
    rows = carry(rows, _ORDER, {"__set": sets}, before=True)
    inside = (F.coalesce("__set", F.lit(0)) + F.col("__turns")) % 2 == 1
    after = F.when(inside, F.col("after_in")).otherwise(F.col("after_out"))
    rows = rows.select("path", "row_no", (~inside).cast("int").alias("begins"), after.alias("goes_on"))
    rows = total_before(rows, _ORDER, "begins", "__begun").withColumn("row_id", F.col("__begun") + F.col("begins"))
    joined = lines.select("path", "row_no", "value").join(rows.drop("__begun"), ["path", "row_no"])
    single = (F.col("begins") == 1) & ~F.col("goes_on")
    parts = joined.where(~single).groupBy("path", "row_id").agg(
        F.array_sort(F.collect_list(F.struct("row_no", "value"))).alias("parts")
    )
    long = parts.select("path", "row_id", F.array_join(F.transform("parts", lambda p: p["value"]), "\n").alias("text"))
    whole = joined.where(single).select("path", "row_id", F.col("value").alias("text"))
    return whole.unionByName(long).where((F.col("row_id") > 1) & (F.col("text") != ""))


def parse_csv(records: DataFrame, columns: Sequence[str], options: dict) -> DataFrame:
    """(columns, path, row_id) of record texts; missing cells are null."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    known = {k: str(v) for k, v in options.items() if k in ("sep", "escape")}
    parsed = records.select("path", "row_id", F.from_csv("text", schema.simpleString()[7:-1].replace(":", " "), known).alias("r"))
    return parsed.select(*[F.col(f"r.`{c}`") for c in columns], "path", "row_id")
