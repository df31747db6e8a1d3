"""Session helpers: builder, shared work folder, shipping of the package, materialised tables."""

from __future__ import annotations

import io
import os
import tempfile
import time
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
_shipped: set[str] = set()
_own_dirs: dict[str, str] = {}


def build(app: str = "lodestrata", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A local session with the settings that the library expects (UTC, ANSI, adaptive execution)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("LODESTRATA_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Where it is unset, a temporary one in local mode; on a cluster an error, as executors would write to their own disks.
    """
    named = spark.conf.get(CHECKPOINT_KEY, None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"{CHECKPOINT_KEY} has to name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="lodestrata-")
    return _own_dirs[app]


def ship(spark: SparkSession) -> None:
    """Give executors this package through Spark's own file server, once for an application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as archive:
        for folder, _, names in os.walk(top):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    archive.write(path, os.path.relpath(path, os.path.dirname(top)))
    path = os.path.join(tempfile.mkdtemp(prefix="lodestrata-"), "lodestrata_package.zip")
    with open(path, "wb") as out:
        out.write(packed.getvalue())
    context.addPyFile(path)
    _shipped.add(context.applicationId)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage and survives lost executors.

    The files go when the application ends, or at once with ``discard``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lodestrata_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a materialised table that nothing reads any more."""
    path = getattr(df, "_lodestrata_path", None)
    if path:
        spark = df.sparkSession
        hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of plans that nothing refers to any more.

    The listeners of a query that has just ended still hold its plan, so the second call follows when they have let go.
    """
    import gc

    for wait in (0.3, 0.0):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(wait)
