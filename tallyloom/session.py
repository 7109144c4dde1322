"""Session defaults, table access and the shared folder in which lineage is cut."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []


def local_session(cores: int = 8, app: str = "tallyloom", **conf: str) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": str(cores),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    return builder.config(map=settings).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as spark.checkpoint.dir names it.

    Where that setting is missing a temporary folder is made, but only on one machine: each executor of a cluster
    would write to a disk of its own.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tallyloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        named = f"file://{folder}"
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named


def clean(spark: SparkSession) -> None:
    """Deletes the tables that ``written`` has made in this process and the session's checkpoints; results that read them can't be used any more."""
    path, hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
    own = [path(_made.pop()) for _ in range(len(_made))]
    if named := spark.sparkContext.getCheckpointDir():  # the folder that Spark has made for this session below the one it was given
        at = path(named)
        files = at.getFileSystem(hadoop)
        own += [x.getPath() for x in files.listStatus(at)] if files.exists(at) else []
    for at in own:
        at.getFileSystem(hadoop).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut: written to the shared folder, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, *partition_by: str) -> DataFrame:
    """The same rows as a table in the shared folder."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tallyloom-{uuid.uuid4().hex}"
    _made.append(path)
    writer = df.write.mode("error")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
