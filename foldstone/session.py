"""Sessions, the shared scratch folder, and joins against sides of a checked size."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of at most so many rows and bytes, as written, may be broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 16 << 20


def local_session(app: str = "foldstone", cores: int | str = 8, **conf: str) -> SparkSession:
    """A single-machine session as tests and the benchmark use it."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for name, value in conf.items():
        builder = builder.config(name.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor can read: ``spark.checkpoint.dir`` where the cluster names one.

    Only where it is unset (a local session, as in tests) a temporary folder is made, once a session.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return qualified(spark, named)
    own = spark.conf.get("foldstone.shared.dir", None)
    if not own:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        own = "file://" + tempfile.mkdtemp(prefix="foldstone-")
        _delete_on_exit(spark, own)
        spark.conf.set("foldstone.shared.dir", own)
    return own


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme, that of the default file system where it has none: workers see the same place as Spark."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return str(p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p)).rstrip("/")


def _delete_on_exit(spark: SparkSession, path: str) -> None:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the session's JVM ends."""
    path = f"{shared_dir(spark)}/foldstone-{os.getpid()}-{uuid.uuid4().hex[:12]}/{name}"
    _delete_on_exit(spark, path.rsplit("/", 1)[0])
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage, and survives lost executors."""
    return _written(df, name)[0]


def _written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def broadcast_if_small(df: DataFrame, name: str, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """Write ``df``, count what was written, and hint a broadcast only if that is within ``rows`` rows and ``size`` bytes.

    Beyond the limits the join is an ordinary shuffle join, which adaptive execution splits on skew.
    """
    written, path = _written(df, name)
    p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    held = p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).getContentSummary(p).getLength()
    return F.broadcast(written) if held <= size and written.count() <= rows else written


def spread(df: DataFrame, least: int = 1_000_000, parts: int = 0) -> DataFrame:
    """Before costly work on each row: give every core a part of an input that is too small to be split by files.

    An input of more than ``least`` bytes a core keeps the partitions of its scan, or gets ``parts`` a core.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size < cores * least:
        return df.repartition(cores)
    return df.repartition(cores * parts) if parts else df
