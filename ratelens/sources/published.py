"""Published table versions: written once per state of the inputs, then reused (A-3, A-7, E-1 .. E-5).

A version is a stored table, bucketed if asked for, named after an identity of what it
was made from: the input files with their lengths and times of change, the columns
and the buckets. Its data lie in a folder of their own. Once they are written, one small pointer
file that names the folder is created; creating a file happens or fails as a
whole, so a reader sees a whole version or none, and of two writers one wins and
the other drops its copy. Sessions that share the folder find each other's
versions; each enters the table in its catalog. ``drop_published`` removes catalog
entry, data and pointer together.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import delete_path, scratch_path
from .readers import save_table

_KNOWN: dict[str, tuple[str, str, str]] = {}  # table -> (name, pointer, folder)


def _file_system(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def input_identity(df: DataFrame, *more) -> str:
    """Digest of the files ``df`` reads (path, length, time of change), its columns and ``more``.
    Folders are listed, not files, so a table costs one call per folder."""
    spark = df.sparkSession
    files = sorted(df.inputFiles())
    wanted, parts = set(files), []
    for folder in sorted({f.rsplit("/", 1)[0] for f in files}):
        fs, jpath = _file_system(spark, folder)
        for status in fs.listStatus(jpath):
            at = status.getPath().toString()
            if status.isFile() and (at in wanted or at.replace("file:/", "file:///") in wanted):
                parts.append(f"{at}|{status.getLen()}|{status.getModificationTime()}")
    # a file that is not found by its listing still counts, by its path
    parts += [] if len(parts) == len(files) else files
    text = "\n".join([*parts, df.schema.json(), *map(str, more)])
    return hashlib.sha256(text.encode()).hexdigest()[:32]


def _read_pointer(spark: SparkSession, pointer: str) -> str | None:
    fs, jpath = _file_system(spark, pointer)
    if not fs.exists(jpath):
        return None
    stream = fs.open(jpath)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def _write_pointer(spark: SparkSession, pointer: str, folder: str) -> bool:
    """Whether this call created the pointer (False: another writer was first)."""
    fs, jpath = _file_system(spark, pointer)
    try:
        stream = fs.create(jpath, False)
    except Exception:
        if fs.exists(jpath):
            return False
        raise
    try:
        stream.write(bytearray(folder.encode()))
    finally:
        stream.close()
    return True


def _enter(spark: SparkSession, table: str, folder: str, schema, bucket_by: str | None,
           buckets: int | None) -> None:
    """The catalog entry of a version that is already written."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    clustered = f"CLUSTERED BY (`{bucket_by}`) SORTED BY (`{bucket_by}`) INTO {buckets} BUCKETS" if bucket_by else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet {clustered} LOCATION '{folder}'")


def publish(spark: SparkSession, name: str, build: Callable[[], DataFrame], *,
            bucket_by: str | None = None, buckets: int | None = None) -> DataFrame:
    """The current version of table ``name``: ``build()`` gives its rows, and is run only if
    no version of the same inputs is there."""
    df = build()
    table = f"ratelens_{name}_{input_identity(df, name, bucket_by, buckets)}"
    pointer = scratch_path(spark, f"published/{table}.pointer")
    folder = _read_pointer(spark, pointer)
    if folder is None:
        own = scratch_path(spark, f"published/{table}-{uuid.uuid4().hex[:12]}")
        staged = f"{table}_{uuid.uuid4().hex[:12]}"
        rows = df.repartition(buckets, bucket_by) if bucket_by else df
        save_table(rows, staged, path=own, bucket_by=bucket_by, buckets=buckets)
        spark.sql(f"DROP TABLE IF EXISTS {staged}")  # an entry of the write alone; the files stay
        if _write_pointer(spark, pointer, own):
            folder = own
        else:
            delete_path(spark, own)
            folder = _read_pointer(spark, pointer)
    if not spark.catalog.tableExists(table):
        _enter(spark, table, folder, df.schema, bucket_by, buckets)
    _KNOWN[table] = (name, pointer, folder)
    return spark.table(table)


def published_versions(name: str | None = None) -> list[str]:
    """Tables of this process's published versions."""
    return [t for t, (n, _, _) in _KNOWN.items() if name in (None, n)]


def drop_published(spark: SparkSession, name: str | None = None) -> int:
    """Remove the versions this process knows (of one name): pointer, catalog entry and data."""
    found = published_versions(name)
    for table in found:
        _, pointer, folder = _KNOWN.pop(table)
        delete_path(spark, pointer)
        spark.sql(f"DROP TABLE IF EXISTS {table}")
        delete_path(spark, folder)
    return len(found)
