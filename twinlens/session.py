"""Session defaults, durable cut points and input parallelism."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AT_ONCE = 4  # independent jobs that one step hands to Spark together


def build_session(cores: str = "*", app: str = "twinlens", shuffle_partitions: int = 8) -> SparkSession:
    """Local session for tests and the bench; clusters bring their own settings."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


_LOCAL_FOLDERS: dict[str, str] = {}
_STEPS: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``).

    Only a local session that names none gets a temporary one, removed at exit: on a
    cluster every machine would write to its own disk.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[app] = tempfile.mkdtemp(prefix="twinlens-")
        atexit.register(shutil.rmtree, _LOCAL_FOLDERS[app], ignore_errors=True)
    return _LOCAL_FOLDERS[app]


def new_folder(spark: SparkSession, label: str) -> str:
    path = f"{shared_folder(spark).rstrip('/')}/twinlens-{label}-{uuid.uuid4().hex}"
    _STEPS.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def remove_steps(spark: SparkSession) -> int:
    """Delete the folders of all durable steps of this session, once its results are written elsewhere."""
    paths = _STEPS.pop(spark.sparkContext.applicationId, [])
    jvm = spark.sparkContext._jvm
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    return len(paths)


def durable(df: DataFrame) -> DataFrame:
    """Write once to the shared folder and read back.

    Cuts the lineage, so a lost executor never triggers recomputation, and keeps
    later readers columnar: they still prune columns and push filters down.
    """
    spark = df.sparkSession
    path = new_folder(spark, "step")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def durable_parts(df: DataFrame, part: Column) -> tuple[DataFrame, DataFrame]:
    """Rows where ``part`` is false, and where it is true, as :func:`durable` frames of one pass over ``df``."""
    spark = df.sparkSession
    path = new_folder(spark, "step")
    marked = df.withColumn("__part", part)
    marked.write.partitionBy("__part").parquet(path)
    both = spark.read.schema(marked.schema).parquet(path)
    return both.where(~F.col("__part")).drop("__part"), both.where("__part").drop("__part")


def spread(df: DataFrame) -> DataFrame:
    """Use all cores on a source with fewer splits than cores (one small file).

    Only for frames that are a scan, mapped row by row at most; large sources have more splits than
    cores and are returned as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def side_by_side(spark: SparkSession, work: list[Callable]) -> list:
    """Results of independent steps, in order; a step's many short jobs fill the cores that another's leave idle.

    The first error is raised once the steps that run have ended.
    """
    if len(work) < 2:
        return [step() for step in work]
    with ThreadPoolExecutor(AT_ONCE) as pool:
        waiting = [pool.submit(inheritable_thread_target(spark)(step)) for step in work]
        try:
            return [step.result() for step in waiting]
        except BaseException:
            for step in waiting:
                step.cancel()
            raise
