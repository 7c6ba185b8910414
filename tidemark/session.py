"""SparkSession helpers.

On a cluster the session is built by the platform; ``configure`` only applies
the SQL settings the library relies on. ``local_session`` is for tests and the
benchmark.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# Settings the operators assume (UTC so timestamp_ntz <-> date conversions and
# oracle comparisons agree; AQE for runtime broadcast/skew/coalesce decisions).
SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    for k, v in SQL_SETTINGS.items():
        spark.conf.set(k, v)
    return spark


def cluster_settings(total_cores: int) -> dict[str, str]:
    """Settings for a large cluster (e.g. 1000 executors over ~100 TB).

    Shuffles start with many partitions (8 per core, at least 2000) and AQE
    coalesces them toward ~128 MB each, so the largest shuffle never puts more
    than a partition's worth into one task's memory (spill stays rare) while
    small shuffles do not create tiny tasks. Scans split files at 256 MB.
    Skewed partitions above 256 MB and 5x the median are split. Only
    inputs AQE measures below 64 MB are broadcast.
    """
    mb = 1 << 20
    return {
        "spark.sql.shuffle.partitions": str(max(2000, 8 * total_cores)),
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(128 * mb),
        "spark.sql.files.maxPartitionBytes": str(256 * mb),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(256 * mb),
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.autoBroadcastJoinThreshold": str(64 * mb),
        "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 * mb),
    }


def configure_cluster(spark: SparkSession, total_cores: int) -> SparkSession:
    configure(spark)
    for k, v in cluster_settings(total_cores).items():
        spark.conf.set(k, v)
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  driver_memory: str = "16g", app: str = "tidemark") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", driver_memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in SQL_SETTINGS.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def checkpoint_base(spark: SparkSession) -> str:
    """The cluster's shared folder: ``spark.checkpoint.dir``, else the folder
    set on the SparkContext. With neither, a scratch folder on a local master
    (tests); elsewhere an error, since executors don't share local folders."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    sc = spark.sparkContext
    held = sc._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    base = tempfile.mkdtemp(prefix="tidemark-ckpt-")
    spark.conf.set("spark.checkpoint.dir", base)
    sc.setCheckpointDir(base)
    return base


def shared_dir(spark: SparkSession, *parts: str) -> str:
    """A folder under the shared checkpoint folder (a path or a URI)."""
    return "/".join([checkpoint_base(spark), *parts])
