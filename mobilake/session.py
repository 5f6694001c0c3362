"""Session factory and the shared working folder.

The engine never relies on the session time zone: wall-clock values are
``timestamp_ntz`` and zones are explicit arguments, so the same plan gives the
same rows on a UTC cluster and on a Madrid laptop.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

BROADCAST_LIMIT_BYTES = 64 << 20


def build_session(app: str = "mobilake", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with adaptive execution, skew handling and string partition keys."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.sources.partitionColumnTypeInference.enabled", "false")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


def qualified(spark: SparkSession, path: str) -> str:
    """A path with its scheme; one without belongs to the cluster's default file system, not to a machine."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    full = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return f"file://{full[5:]}" if full.startswith("file:/") and not full.startswith("file://") else full


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; on one machine (tests) a temporary one where unset."""
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not d:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = f"file://{tempfile.mkdtemp(prefix='mobilake-')}"
        atexit.register(shutil.rmtree, d[7:], ignore_errors=True)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return qualified(spark, d.rstrip("/"))


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, in a folder of this application."""
    return f"{shared_dir(spark)}/mobilake/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def clear_work(spark: SparkSession) -> None:
    """Remove the tables this application has cut; results that still read them must be written before."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/mobilake/{spark.sparkContext.applicationId}")
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage through a Parquet table in the shared folder; read back whole.

    Unlike localCheckpoint the copy survives the loss of executors. The schema
    is given on reading, so an empty table reads back as an empty table.
    """
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
