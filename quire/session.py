"""Session helpers: the shared checkpoint folder and sensible local defaults."""

from __future__ import annotations

from pyspark.sql import SparkSession


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The cluster's shared checkpoint folder (``spark.checkpoint.dir``), if any."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    return spark.conf.get("spark.checkpoint.dir", None)


def require_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder, made the context's checkpoint dir; raises
    when the cluster names none (no machine-local fallback in library code)."""
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    d = checkpoint_dir(spark)
    if not d:
        raise ValueError("set spark.checkpoint.dir to a shared folder")
    spark.sparkContext.setCheckpointDir(d)
    return spark.sparkContext.getCheckpointDir()


def ensure_checkpoint_dir(spark: SparkSession, fallback: str) -> str:
    """Use the session's checkpoint folder; set ``fallback`` only where none is set
    (local runs and tests)."""
    current = checkpoint_dir(spark)
    if current:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(current)
        return spark.sparkContext.getCheckpointDir() or current
    spark.sparkContext.setCheckpointDir(fallback)
    return spark.sparkContext.getCheckpointDir()


def local_session(
    cpus: int | str = "*", app: str = "quire", shuffle_partitions: int | None = None, extra: dict | None = None
) -> SparkSession:
    """A local session tuned for this engine (AQE on, no UI).

    ``spark.sql.requireAllClusterKeysForCoPartition=false`` lets joins on
    ``(file_id, sequence_no)`` use tables bucketed by ``file_id`` as they are.
    """
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.requireAllClusterKeysForCoPartition", "false")
    )
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s
