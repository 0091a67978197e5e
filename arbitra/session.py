"""Session helpers: local sessions for tests, the shared scratch folder, bounded dimensions."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Dimensions made from driver-side configuration (policies, topics, gates, prices) are the
# only tables that carry a broadcast hint; this bound is what makes the hint safe.
MAX_DIM_ROWS = 50_000


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "arbitra") -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        # Call-site capture makes every column expression a few milliseconds slower to build.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach: the session's checkpoint folder.

    That is what ``setCheckpointDir`` named, or else ``spark.checkpoint.dir``.  Only a local session
    without either gets a temporary folder.
    """
    current = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return spark.sparkContext.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage: write the rows to the shared folder once and read them back.

    A written table outlives lost executors, keeps column pruning, and tells the planner its
    size.
    """
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dimension(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A broadcast-hinted table of configuration rows, refused above ``MAX_DIM_ROWS``."""
    if len(rows) > MAX_DIM_ROWS:
        raise ValueError(f"{len(rows)} configuration rows; write them to a table instead")
    return F.broadcast(spark.createDataFrame(list(rows), schema).coalesce(1))


def spread(scan: DataFrame, key: str) -> DataFrame:
    """Give a scan of few splits to all cores before work that is heavy per row.

    A scan that already has a split per core, which is every large one, is left as it is and
    costs no shuffle.  Meant for plain scans: their number of splits is known without a job.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    splits = scan._jdf.queryExecution().toRdd().getNumPartitions()
    return scan if splits >= cores else scan.repartition(cores, key)
