"""Corpus files of every supported format -> one table of records.

All readers give the superset record columns plus ``path`` and ``row_id``; (path, row_id) keeps
the order of the files. A row that cannot be read has its text in ``_corrupt_record``.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.functions.records import RECORD, map_chat_record, with_record_keys
from parley.functions.text import strip
from parley.operators.sampling import concatenate
from parley.operators.validate import split_rejects
from parley.plans.ranks import rows_before
from parley.session import settled
from parley.sources import split

CORRUPT = "_corrupt_record"
# fixed values: supported file name endings
JSON_LINES = ("jsonl", "jl")
JSON_DOCUMENT = ("json",)
DELIMITED = {"csv": ",", "tsv": "\t"}
#: Long JSON files of another shape that are read whole, and files of one read of a CSV folder.
_ODD, _FILES = 1_000, 10_000
ENDINGS = (*JSON_LINES, *JSON_DOCUMENT, *DELIMITED)


def _glob(ending: str) -> str:
    """Glob for one ending in any case."""
    return "*." + "".join(f"[{c.lower()}{c.upper()}]" for c in ending)


def read_lines(spark: SparkSession, path: str, *endings: str, size: bool = False) -> DataFrame:
    """Non-blank lines: value, path, block (start of the file split), row_id and, if asked for, file_size."""
    parts = [
        spark.read.option("pathGlobFilter", _glob(e)).text(path) for e in endings
    ] or [spark.read.text(path)]
    numbered = [
        p.select(
            "value",
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row_id"),
            *([F.col("_metadata.file_size").alias("file_size")] if size else []),
        )
        for p in parts
    ]
    return concatenate(numbered)


def with_line_numbers(lines: DataFrame) -> DataFrame:
    """Add ``row_no``, the line number in its file from 1.

    Lines are counted per file split, so the work per task is one split however long a file is.
    """
    counts = lines.groupBy("path", "block").agg(F.count("*").alias("__rows"))
    before = rows_before(counts, ["path"], "block").drop("__rows")
    inside = Window.partitionBy("path", "block").orderBy("row_id")
    return (
        lines.withColumn("__rn", F.row_number().over(inside))
        .join(before, ["path", "block"])
        .withColumn("row_no", F.col("__before") + F.col("__rn"))
        .drop("__before", "__rn")
    )


def _parsed(value: Column) -> Column:
    schema = T.StructType([*RECORD.fields, T.StructField(CORRUPT, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    return F.from_json(value, schema, options)


def parse_json_lines(lines: DataFrame) -> DataFrame:
    """Records of JSON lines; blank lines go, anything but an object is corrupt."""
    text = strip(F.col("value"))
    kept = [c for c in lines.columns if c not in ("value", "block")]
    rows = lines.where(text != "").select(*kept, "value", _parsed(text).alias("__r"))
    is_object = F.startswith(strip(F.col("value")), F.lit("{"))
    bad = F.when(~is_object | F.col(f"__r.{CORRUPT}").isNotNull(), F.col("value"))
    return rows.select(
        *[F.when(is_object, F.col(f"__r.{f.name}")).alias(f.name) for f in RECORD.fields],
        *kept,
        bad.alias(CORRUPT),
    )


def read_json_lines(spark: SparkSession, path: str, numbered: bool = False) -> DataFrame:
    """``numbered`` adds the line number ``row_no``, which costs a shuffle."""
    lines = read_lines(spark, path, *_matching(spark, path, JSON_LINES))
    return parse_json_lines(with_line_numbers(lines) if numbered else lines)


def read_json_documents(spark: SparkSession, path: str | list[str], long: int = split.LONG) -> DataFrame:
    """Records of JSON files holding an array of objects or ``{"data": [...]}``; else an error.

    Files above ``long`` bytes are cut into records by many tasks. A shorter file, and a long one
    with more beside ``data``, is one row until its records are exploded.
    """
    glob = _glob("json") if isinstance(path, str) and _matching(spark, path, JSON_DOCUMENT) else None
    rows = _whole_documents(spark, path, glob).where(F.col("file_size") <= long)
    parts = [_document_records(rows)]
    sizes = spark.read.format("binaryFile")
    sizes = (sizes if glob is None else sizes.option("pathGlobFilter", glob)).load(path).select("length")
    if sizes.where(F.col("length") > long).limit(1).count():
        texts, other = split.json_records(spark, path, glob, long)
        record = F.from_json("text", RECORD, {"mode": "FAILFAST"}).alias("r")
        parts.append(texts.select(record, "path", "row_id").select("r.*", "path", "row_id"))
        odd = [r["path"] for r in other.limit(_ODD + 1).collect()]
        if len(odd) > _ODD:
            raise ValueError(f"more than {_ODD} long JSON files are no plain lists of records, such as {odd[0]}")
        if odd:
            parts.append(_document_records(_whole_documents(spark, odd, None)))
    return concatenate(parts)


def _whole_documents(spark: SparkSession, path: str | list[str], glob: str | None) -> DataFrame:
    reader = spark.read if glob is None else spark.read.option("pathGlobFilter", glob)
    return reader.text(path, wholetext=True).select(
        strip(F.col("value")).alias("value"),
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_size").alias("file_size"),
    )


def _document_records(whole: DataFrame) -> DataFrame:
    records = T.ArrayType(RECORD)
    listed = F.from_json("value", records, {"mode": "FAILFAST"})
    wrapped = F.from_json(
        "value", T.StructType([T.StructField("data", records)]), {"mode": "FAILFAST"}
    )["data"]
    wrong = F.raise_error(
        F.concat(F.lit("neither a list of records nor an object with such a list under data: "), F.col("path"))
    ).cast(records)
    found = F.when(F.startswith("value", F.lit("[")), listed).when(F.startswith("value", F.lit("{")), wrapped)
    rows = whole.select("path", F.posexplode(F.coalesce(found, wrong)).alias("row_id", "r"))
    checked = F.when(
        F.col("r").isNull(),
        F.raise_error(F.concat(F.lit("a record of the list is no object: "), F.col("path"))).cast(RECORD),
    ).otherwise(F.col("r"))
    return rows.select("path", F.col("row_id").cast("bigint").alias("row_id"), checked.alias("r")).select(
        *[F.col(f"r.{f.name}").alias(f.name) for f in RECORD.fields], "path", "row_id"
    )


def _header_groups(spark: SparkSession, path: str, ending: str) -> list[tuple[list[str], int]]:
    """(files, largest size) in groups of the same header line.

    A file is opened once for its first line. Groups are cut into chunks of ``_FILES`` files on the
    executors; names come to the driver, as they do in any listing of the folder.
    """
    lines = read_lines(spark, path, *_matching(spark, path, (ending,)), size=True).where(F.col("block") == 0)
    heads = lines.groupBy("path").agg(F.min_by("value", "row_id").alias("head"), F.max("file_size").alias("size"))
    chunk = F.pmod(F.xxhash64("path"), F.ceil(F.lit(heads.count()) / _FILES))
    groups = heads.groupBy("head", chunk.alias("chunk")).agg(
        F.array_sort(F.collect_list("path")).alias("paths"), F.max("size").alias("largest")
    )
    return [(r["paths"], r["largest"]) for r in groups.orderBy("head", "chunk").toLocalIterator()]


def read_delimited(
    spark: SparkSession, path: str, ending: str, quoted_newlines: bool = True, long: int = split.LONG
) -> DataFrame:
    """Records of CSV or TSV files, each read by its own header; an empty cell is an empty text.

    With line ends inside quotes a file above ``long`` bytes is first cut into records by many
    tasks; without them (``quoted_newlines=False``) Spark splits it at any line.
    """
    options = {"header": True, "sep": DELIMITED[ending], "multiLine": quoted_newlines, "escape": '"', "inferSchema": False}
    parts = []
    for paths, largest in _header_groups(spark, path, ending):
        rows = spark.read.options(**options).csv(paths)
        columns = rows.columns
        rows = rows.select(
            "*",
            F.col("_metadata.file_path").alias("path"),
            F.monotonically_increasing_id().alias("row_id"),
            F.col("_metadata.file_size").alias("__size"),
        )
        readings = [rows.drop("__size")]
        if quoted_newlines and largest > long:
            cut = split.csv_records(spark, paths, DELIMITED[ending], long)
            readings = [rows.where(F.col("__size") <= long).drop("__size"), split.parse_csv(cut, columns, options)]
        keys = [c for c in columns if c in RECORD.fieldNames()]
        for some in readings:
            parts.append(with_record_keys(some.na.fill("", keys).select(*keys, "path", "row_id")))
    if not parts:  # no file, or only empty ones
        schema = T.StructType([*RECORD.fields, T.StructField("path", T.StringType()), T.StructField("row_id", T.LongType())])
        return spark.createDataFrame([], schema)
    return concatenate(parts)


def _is_folder(spark: SparkSession, path: str) -> bool:
    """Asked of the file system: a folder may have a dot in its name, and a file none."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.exists(place) and files.getFileStatus(place).isDirectory()


def _ending(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[-1].lower() if "." in name else ""


def _matching(spark: SparkSession, path: str, endings: tuple[str, ...]) -> tuple[str, ...]:
    """Endings to filter a folder by; none for a single file, whose path says it all."""
    return endings if _is_folder(spark, path) or _ending(path) not in ENDINGS else ()


def _read_as(spark: SparkSession, path: str, ending: str) -> DataFrame:
    if ending in JSON_LINES:
        return parse_json_lines(read_lines(spark, path, *_matching(spark, path, (ending,))))
    if ending in JSON_DOCUMENT:
        return read_json_documents(spark, path)
    return read_delimited(spark, path, ending)


def folder_endings(spark: SparkSession, path: str) -> list[str]:
    """Supported endings among the files right in a folder (only names are read)."""
    name = F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1))
    files = spark.read.format("binaryFile").load(path).select(name.alias("ending"))
    found = files.where(F.col("ending").isin(*ENDINGS)).distinct().collect()
    return sorted(r["ending"] for r in found)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Records of one file, by its ending, or of all supported files of a folder."""
    if not path:
        raise ValueError("a corpus path is required")
    ending = _ending(path)
    if not _is_folder(spark, path):
        if ending in ENDINGS:
            return concatenate([_read_as(spark, path, ending)])
        if ending:
            raise ValueError(f"no reader for files that end in .{ending}")
    endings = folder_endings(spark, path)
    if not endings:
        raise ValueError(f"no corpus files in folder: {path}")
    return concatenate([_read_as(spark, path, e) for e in endings])


def load_rows(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects): chat rows with ``system`` and ``turns``, and what could not be mapped."""
    return split_rejects(map_chat_record(read_corpus(spark, path)))


def _broken_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, reason) of the JSON documents under a path that hold no list of records."""
    glob = _glob("json") if _matching(spark, path, JSON_DOCUMENT) else None
    whole = _whole_documents(spark, path, glob)
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    records = T.ArrayType(T.VariantType())
    corrupt = T.StructField(CORRUPT, T.StringType())
    wrapped = F.from_json("value", T.StructType([T.StructField("data", records), corrupt]), options)
    in_list = F.from_json(F.concat(F.lit('{"data":'), "value", F.lit("}")), T.StructType([T.StructField("data", records), corrupt]), options)
    found = F.when(F.startswith("value", F.lit("[")), in_list).when(F.startswith("value", F.lit("{")), wrapped)
    is_object = F.forall("r.data", lambda v: F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)))
    reason = (
        F.when(F.col("r").isNull(), "neither a list nor an object")
        .when(F.col(f"r.{CORRUPT}").isNotNull(), "malformed document")
        .when(F.col("r.data").isNull(), "no list of records")
        .when(~is_object, "a record is no object")
    )
    return whole.select("path", found.alias("r")).select("path", reason.alias("reason")).where("reason is not null")


_REPORT = "source string, status string, rows bigint, path string, reason string"


def load_sources(spark: SparkSession, sources: Mapping[str, str]) -> tuple[DataFrame | None, DataFrame]:
    """(records, report) of several sources; one that fails anywhere is reported and left out whole.

    Each source is read to its end and written to the shared folder before it counts, so a file
    that breaks late spoils its own source alone. The report has source, status, rows, path and
    reason: one row for a source that is loaded, and for one that failed a row for every broken
    file that can be named, else one row without a path.
    """
    parts, report = [], []
    for name, path in sources.items():
        try:
            part = settled(read_corpus(spark, path), "staged")
        except Exception as error:  # noqa: BLE001 - any failure skips this source only
            report.append(_failures(spark, name, path, error))
            continue
        parts.append(part.withColumn("source", F.lit(name)))
        report.append(
            part.agg(
                F.lit(name).alias("source"),
                F.lit("loaded").alias("status"),
                F.count("*").alias("rows"),
                F.lit(None).cast("string").alias("path"),
                F.lit(None).cast("string").alias("reason"),
            )
        )
    return (concatenate(parts) if parts else None), concatenate(report)


def _failures(spark: SparkSession, name: str, path: str, error: Exception) -> DataFrame:
    status = f"failed: {type(error).__name__}"
    try:
        broken = settled(_broken_files(spark, path), "broken")
        if not broken.isEmpty():
            return broken.select(
                F.lit(name).alias("source"), F.lit(status).alias("status"), F.lit(0).cast("bigint").alias("rows"), "path", "reason"
            )
    except Exception:  # noqa: BLE001 - the source's own error is the one to report
        pass
    return spark.createDataFrame([(name, status, 0, None, str(error).split("\n")[0][:500])], _REPORT)
