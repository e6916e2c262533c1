"""Session defaults and the one helper that cuts lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: largest (date) cross-section, in rows, that is ranked inside one window task
MAX_GROUP_ROWS = "quantspark.maxGroupRows"
DEFAULT_MAX_GROUP_ROWS = 2_000_000
#: largest side, in rows, that is broadcast; a size check precedes every use
MAX_BROADCAST_ROWS = "quantspark.maxBroadcastRows"
DEFAULT_MAX_BROADCAST_ROWS = 1_000_000
#: rows of a table of known size that one window task holds (one symbol or section at least)
TASK_ROWS = "quantspark.taskRows"
DEFAULT_TASK_ROWS = 128_000
#: pairs of one join key that one task makes; a hotter key is spread over several
PAIRS_PER_TASK = "quantspark.pairsPerTask"
DEFAULT_PAIRS_PER_TASK = 5_000_000


def build_session(master: str = "local[8]", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the local bench; a cluster supplies its own."""
    builder = SparkSession.builder.master(master)
    if master.startswith("local") and not master.startswith("local-cluster"):  # one machine: any folder is shared
        builder = builder.config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="quantspark-ckpt-"))
    spark = (
        builder
        .appName("quantspark")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def int_conf(spark: SparkSession, key: str, default: int) -> int:
    return int(spark.conf.get(key, str(default)))


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which driver and executors share.

    A session that names none gets a folder of our own only where one machine runs everything.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", "")
    if sc.getCheckpointDir() is None:
        if not named and not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="quantspark-ckpt-"))
    return named or sc.getCheckpointDir()


def new_folder(spark: SparkSession) -> str:
    """The name of a folder of one run under the shared folder."""
    return f"{shared_root(spark).rstrip('/')}/quantspark-{uuid.uuid4().hex}"


def drop_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder that this library wrote, wherever it lies; a missing one is no error."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` written to a folder of its own and read again, for results with several readers."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fits(df: DataFrame, limit: int) -> bool:
    """True when ``df`` has at most ``limit`` rows; reads no more than that."""
    return df.limit(limit + 1).count() <= limit
