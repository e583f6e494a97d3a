"""Session helpers: one place for the configuration every job relies on.

On a cluster the session normally comes from the platform; ``get_session`` only
fills in settings that are not already present, so cluster-level choices
(shuffle partitions, checkpoint folder, memory) always win.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark import SparkConf, SparkContext
from pyspark.sql import SparkSession

# Settings we want on by default. AQE re-plans joins from runtime sizes,
# coalesces small shuffle partitions and splits skewed join partitions, which
# matters for the patient_nbr fan-out join (one patient can be a hot key).
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # remove checkpoint files once their DataFrames are gone, so iterative
    # jobs do not leave data behind in the shared folder
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(master: str | None = None, app_name: str = "ratelens",
                shuffle_partitions: int | None = None,
                extra: dict[str, str] | None = None) -> SparkSession:
    """Return the active session, creating one with our defaults if needed.

    A session that already runs is returned as it is. For a new one a default
    is set only where the platform (spark-defaults, submit options) has not
    set that key.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(extra or {})
    if shuffle_partitions is not None:
        conf.setdefault("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if "PYSPARK_GATEWAY_PORT" in os.environ:  # submitted: the platform's settings are there
        SparkContext._ensure_initialized()
    context = SparkContext._active_spark_context
    platform = context.getConf() if context is not None else SparkConf()
    for key, value in _DEFAULTS.items():
        if not platform.contains(key):
            conf.setdefault(key, value)
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_FALLBACK_ROOTS: dict[int, str] = {}


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints and written intermediate tables.

    Read from ``spark.checkpoint.dir`` (the cluster's shared folder), else the
    folder already given to ``SparkContext.setCheckpointDir``. When neither is
    set, a one-machine session (``local``, ``local[n]``) gets a scratch folder,
    reused for the life of the context; any other master raises, because a
    folder of one machine is not readable by the others.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        root = _FALLBACK_ROOTS.get(id(sc))
        if root is None:
            if sc.master != "local" and not sc.master.startswith("local["):
                raise RuntimeError(
                    "spark.checkpoint.dir is not set: intermediate tables need a folder "
                    "that the driver and every executor share")
            root = _FALLBACK_ROOTS[id(sc)] = tempfile.mkdtemp(prefix="ratelens-ckpt-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path for a written intermediate table under the shared folder."""
    root = checkpoint_root(spark)
    if "://" in root or root.startswith("file:"):
        return root.rstrip("/") + "/ratelens/" + name
    return os.path.join(root, "ratelens", name)


_WRITTEN: list[str] = []


def new_scratch(spark: SparkSession, kind: str = "materialized") -> str:
    """A fresh scratch path that ``drop_materialized`` will delete."""
    path = scratch_path(spark, f"{kind}/{uuid.uuid4().hex}")
    _WRITTEN.append(path)
    return path


def materialize(df, compression: str | None = None):
    """Write ``df`` as a Parquet table in the shared checkpoint folder and
    return a frame that reads it back (lineage cut).

    Used before iterative work (model fits, cross-validation, several metric
    passes) so repeated passes read the written columns instead of
    recomputing joins, and a lost executor re-reads files instead of
    recomputing from the base tables. Parquet (compressed, column-pruned
    on read) rather than an RDD checkpoint of serialised rows, which would be
    several times larger at scale. The plan runs once, in the layout it has;
    a caller that needs a fixed layout repartitions before the call.
    ``drop_materialized`` removes the tables.
    """
    spark = df.sparkSession
    path = new_scratch(spark)
    writer = df.write.mode("overwrite")
    if compression:
        writer = writer.option("compression", compression)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a written table or folder through Spark's file systems."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def drop_materialized(spark: SparkSession) -> int:
    """Delete the tables written by ``materialize`` in this process."""
    n = 0
    while _WRITTEN:
        delete_path(spark, _WRITTEN.pop())
        n += 1
    return n
