"""Table versions in folders: whole snapshots, and keyed views of which a batch rewrites few buckets.

A version counts once its success marker is there. Finding versions reads names only; a folder
that cannot be listed or a version that cannot be read is an error, never an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.operators.store import upsert

VERSION = "snapshot"
#: Versions kept: the newest and the one before it, which a repeated batch starts from.
KEPT = 2
BUCKETS = 64
BUCKET = "bucket"


def _place(spark: SparkSession, folder: str):
    """(file system, path) of a folder in whatever store its name says."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def versions(spark: SparkSession, folder: str, before: int | None = None) -> list[int]:
    """Numbers of the complete versions, ascending. No folder: no versions."""
    files, path = _place(spark, folder)
    if not files.exists(path):
        return []
    found = []
    for status in files.listStatus(path):
        name = status.getPath().getName()
        number = name.removeprefix(f"{VERSION}=")
        marked = files.exists(spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS"))
        if name != number and number.isdigit() and marked and (before is None or int(number) < before):
            found.append(int(number))
    return sorted(found)


def last_version(spark: SparkSession, folder: str, before: int | None = None) -> int | None:
    found = versions(spark, folder, before)
    return found[-1] if found else None


def _path(folder: str, version: int) -> str:
    return f"{folder.rstrip('/')}/{VERSION}={version}"


def _remove(spark: SparkSession, folder: str) -> None:
    files, path = _place(spark, folder)
    files.delete(path, True)


def save_snapshot(rows: DataFrame, folder: str, version: int | None = None, keep: int = KEPT) -> int:
    """Write a new version of a table next to the old ones and return its number.

    A failed write leaves the older versions untouched. Saving a given version again replaces
    it, so a repeated batch is harmless. Versions older than the ``keep`` newest are removed.
    """
    spark = rows.sparkSession
    if version is None:
        version = (last_version(spark, folder) or 0) + 1
    rows.write.mode("overwrite").parquet(_path(folder, version))
    for old in versions(spark, folder)[:-keep]:
        _remove(spark, _path(folder, old))
    return version


def load_snapshot(
    spark: SparkSession, folder: str, schema: T.StructType, before: int | None = None
) -> DataFrame:
    """The newest version (below ``before``); an empty table only where there is none."""
    version = last_version(spark, folder, before)
    if version is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(_path(folder, version))


def load_snapshot_or_empty(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """As ``load_snapshot``, but a store that cannot be read counts as empty. Do not save over it."""
    try:
        rows = load_snapshot(spark, folder, schema)
        rows.isEmpty()
    except Exception:  # noqa: BLE001 - the tolerant form, by contract
        return spark.createDataFrame([], schema)
    return rows


# -- keyed views ----------------------------------------------------------------------------------


def manifest_of(spark: SparkSession, folder: str, before: int | None = None) -> dict[int, int]:
    """Per bucket the version that wrote it last: at most as many rows as buckets."""
    rows = load_snapshot(spark, f"{folder}/manifest", T._parse_datatype_string("bucket int, written int"), before)
    return {r["bucket"]: r["written"] for r in rows.collect()}


def _bucket_path(folder: str, bucket: int, version: int) -> str:
    return f"{_path(f'{folder}/data', version)}/{BUCKET}={bucket}"


def read_buckets(spark: SparkSession, folder: str, schema: T.StructType, manifest: dict[int, int]) -> DataFrame:
    paths = [_bucket_path(folder, b, v) for b, v in sorted(manifest.items())]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def load_view(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    return read_buckets(spark, folder, schema, manifest_of(spark, folder))


def _buckets_of(spark: SparkSession, folder: str, version: int) -> list[int]:
    """The buckets that hold rows of a version: a bucket whose rows are all gone has no folder."""
    files, path = _place(spark, _path(f"{folder}/data", version))
    if not files.exists(path):
        return []
    names = [status.getPath().getName() for status in files.listStatus(path)]
    return [int(n.removeprefix(f"{BUCKET}=")) for n in names if n.startswith(f"{BUCKET}=")]


def write_buckets(
    rows: DataFrame, folder: str, number: int, manifest: dict[int, int], touched: list[int]
) -> dict[int, int]:
    """Write all rows of the ``touched`` buckets (column ``bucket``) as version ``number``; the others stay.

    Buckets that neither of the two newest versions refers to are removed. Returns the new manifest.
    """
    spark = rows.sparkSession
    # one file a bucket: tasks that hold rows of all buckets would each write a file into every one
    rows.repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(_path(f"{folder}/data", number))
    untouched = {b: v for b, v in manifest.items() if b not in set(touched)}
    manifest = untouched | dict.fromkeys(_buckets_of(spark, folder, number), number)
    listed = spark.createDataFrame(list(manifest.items()), "bucket int, written int")
    save_snapshot(listed.coalesce(1), f"{folder}/manifest", number)
    used = set(manifest.items()) | set(manifest_of(spark, folder, before=number).items())
    for old in versions(spark, f"{folder}/data"):
        there = _buckets_of(spark, folder, old)
        for b in there:
            if (b, old) not in used:
                _remove(spark, _bucket_path(folder, b, old))
        if not any((b, old) in used for b in there) and old != number:
            _remove(spark, _path(f"{folder}/data", old))
    return manifest


def save_view(
    changes: DataFrame, folder: str, key: str, version: str, number: int, buckets: int = BUCKETS
) -> None:
    """Version ``number`` of a view: the buckets of the changed keys are written anew, the others stay.

    The newest row of a key by ``version`` holds, so a late change never replaces a newer row.
    """
    spark, schema = changes.sparkSession, changes.schema
    bucket = F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")
    touched = [r[0] for r in changes.select(bucket.alias("b")).distinct().collect()]  # at most ``buckets``
    manifest = manifest_of(spark, folder, before=number)
    held = read_buckets(spark, folder, schema, {b: manifest[b] for b in touched if b in manifest})
    again = held.join(changes.select(key).distinct(), key, "left_semi")
    rows = upsert(held, changes.unionByName(again), key, version)
    write_buckets(rows.withColumn(BUCKET, bucket), folder, number, manifest, touched)
