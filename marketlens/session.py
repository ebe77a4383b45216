"""Session construction and the checkpoint folder.

On a cluster the checkpoint folder is shared storage named by the cluster in
``spark.checkpoint.dir``; this module only reads it. A folder of our own is
created only for a local master (tests, laptop runs) when nothing is set.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Defaults sized for local[8]; a cluster run overrides them through its own conf.
LOCAL_CONF = {
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # delete rank checkpoints once their data is no longer referenced
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(master: str | None = None, app_name: str = "marketlens", **conf: str) -> SparkSession:
    """Local session for tests and the bench; cluster jobs get theirs from spark-submit."""
    master = master or f"local[{os.environ.get('BENCH_CPUS', '8')}]"
    builder = SparkSession.builder.master(master).appName(app_name)
    for key, value in {**LOCAL_CONF, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, setting a local one only when unset on a local master."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set; point it at shared storage for this cluster")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="marketlens-ckpt-"))
    return sc.getCheckpointDir()


def cluster_conf(input_bytes: int, total_cores: int, target_partition_bytes: int = 256 << 20) -> dict[str, str]:
    """Settings for a large cluster, sized from the input volume and the core count.

    Shuffle partitions start at max(input / 256 MB, 3 x cores), so no reducer must
    hold more than a few hundred MB (spill-free on a few GB per core); AQE then coalesces small partitions and splits
    skewed ones (a partition 5x the median and above 512 MB is split, on both sort-merge and
    shuffled-hash joins). Files are read in 256 MB splits. Broadcasts stay under 64 MB: the only
    explicit broadcasts are one-row aggregates and rank offsets (one row per partition).
    """
    partitions = max(input_bytes // target_partition_bytes, 3 * total_cores, 200)
    return {
        "spark.sql.shuffle.partitions": str(int(partitions)),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(512 << 20),
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.autoBroadcastJoinThreshold": str(64 << 20),
        "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 << 20),
        "spark.sql.ansi.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
