"""Session helpers: building a session, loading the tables of a directory, cutting lineage safely."""

from __future__ import annotations

import atexit
import io
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tallyforge", cpus: int | None = None, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; clusters pass their own."""
    cpus = cpus or os.cpu_count() or 4
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", os.environ.get("TALLYFORGE_DRIVER_MEMORY", "8g"))
    )
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder the cluster shares.

    The folder is the session's ``spark.checkpoint.dir``. Where that is unset, a session on one machine, as in tests, takes a
    temporary folder that is removed at its end; on a cluster, whose machines would not share it, that is an error.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or _folder_of_tests(sc.master))
    return df.checkpoint(eager=True)


def _folder_of_tests(master: str) -> str:
    if not master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
    where = tempfile.mkdtemp(prefix="tallyforge-checkpoint-")
    atexit.register(shutil.rmtree, where, ignore_errors=True)
    return where


def checkpoint_bytes(df: DataFrame) -> int:
    """Size of the files of a checkpointed DataFrame."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._jdf.queryExecution().analyzed().rdd().getCheckpointFile().get())
    return path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).getContentSummary(path).getLength()


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder below the one the cluster shares for checkpoints."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or _folder_of_tests(sc.master))
    return f"{sc._jsc.sc().getCheckpointDir().get()}/{what}-{uuid.uuid4().hex}"


def release(*dfs: DataFrame) -> None:
    """Remove the files of checkpointed DataFrames that nothing will read any more. Those handed out with a result are left to
    Spark, which removes them with spark.cleaner.referenceTracking.cleanCheckpoints."""
    for df in dfs:
        at = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
        if at.isDefined():
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(at.get())
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, wherever they run. Once for each Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_tallyforge_shipped", False):
        return
    root = Path(__file__).resolve().parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent).as_posix())
    at = Path(tempfile.mkdtemp(prefix="tallyforge-"), "tallyforge.zip")  # read by the driver alone, which serves it
    at.write_bytes(packed.getvalue())
    sc.addPyFile(str(at))
    sc._tallyforge_shipped = True


def arrow_map(df: DataFrame, run, schema: str) -> DataFrame:
    """mapInArrow, with this package at hand in the workers."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)
