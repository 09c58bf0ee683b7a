"""Session settings, and tables staged in the cluster's shared folder."""

import shutil
import tempfile
import time
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
_shipped = set()


def ship_package(spark):
    """Send this package to the executors, whose Python workers import its functions.

    The driver serves the archive to every executor; it is sent once per application.
    """
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = Path(__file__).resolve().parent
        archive = shutil.make_archive(
            f"{tempfile.mkdtemp(prefix='chainwitness-')}/chainwitness", "zip", package.parent, package.name
        )
        context.addPyFile(archive)
        _shipped.add(context.applicationId)
    return spark


def build_session(app="chainwitness", master=None, **conf):
    """A session with the settings this library is tuned for (all may be overridden)."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    }
    settings.update({k.replace("__", "."): str(v) for k, v in conf.items()})
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return ship_package(builder.getOrCreate())


def shared_dir(spark):
    """The folder named by the cluster for checkpoints and staged tables.

    Only a local-mode session, whose executors share the driver's disk, may fall
    back to a temporary folder; a cluster that names no folder is refused.
    """
    named = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="chainwitness-")
    spark.conf.set(CHECKPOINT_DIR, own)
    return own


def new_dir(spark, name):
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name="stage"):
    """Write ``df`` to the shared folder and read it back.

    Used where a costly result feeds several branches of a plan: it is computed
    once, survives the loss of executors and cuts the lineage.
    """
    path = new_dir(df.sparkSession, name)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let_go(spark):
    """Collect the plans that are no longer in use, and so let Spark remove their shuffle files.

    Spark removes the files of a shuffle once the driver has collected the plan that
    made it, so collecting keeps the steps of a long query from adding up on disk. Plans
    have finalizers, hence the second collection.
    """
    system = spark.sparkContext._jvm.System
    system.gc()
    time.sleep(0.2)
    system.gc()


def release(*frames):
    """Delete the staged tables that these DataFrames read; they and what builds on them end with it."""
    for df in frames:
        spark, root = df.sparkSession, shared_dir(df.sparkSession)
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        root = jvm.org.apache.hadoop.fs.Path(root).toUri().getPath()
        for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            if path.toUri().getPath().startswith(root + "/"):
                path.getFileSystem(conf).delete(path, True)


def spread(df: DataFrame):
    """Use all cores for costly per-row work on a scan with few splits.

    A scan with at least as many splits as cores, the normal case on a cluster,
    stays as it is and moves no data.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
