"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "churnspark") -> SparkSession:
    """A local session for tests and benchmarks (UI off, AQE on, UTC)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_FALLBACK: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster-wide folder for written tables and checkpoints.

    Read from ``spark.checkpoint.dir`` (or the context's checkpoint folder).  Only when
    the session has neither *and runs in local mode* (tests, benchmarks) a scratch folder
    is created once per application and registered with ``setCheckpointDir``
    (``spark.checkpoint.dir`` is a core setting and cannot be changed on a running
    session).  On a cluster an unset folder is an error: a machine-local folder would
    scatter the written tables over executor disks that die with the executors.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach (HDFS/S3/ABFS); "
                               "derived tables and row-number tables are written there")
        app = spark.sparkContext.applicationId
        if app not in _FALLBACK:
            _FALLBACK[app] = tempfile.mkdtemp(prefix="churnspark-")
            spark.sparkContext.setCheckpointDir(_FALLBACK[app])
        d = _FALLBACK[app]
    return d.rstrip("/")


def table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tables/{name}"
