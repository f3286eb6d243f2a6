"""Session settings and the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: a side of a join is broadcast only up to this many rows and bytes of text
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20

# Fixed value: hides 32-byte keys, as binary or as hex text, in plans and in the UI.
KEY_REDACTION = r"(?i)(0x|X')?[0-9a-f]{64}'?"


def local_session(cpus: str = "*", shuffle_partitions: int = 8, memory: str = "16g",
                  app: str = "veilspark") -> SparkSession:
    """Session for tests and benchmarks on one machine."""
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName(app)
             .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
             .config("spark.sql.adaptive.enabled", "true")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.driver.memory", memory)
             .config("spark.ui.enabled", "false")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def hide_keys(spark: SparkSession) -> None:
    """Keep keys out of explain output, unless the session has its own rule."""
    if spark.conf.get("spark.sql.redaction.string.regex", None) is None:
        spark.conf.set("spark.sql.redaction.string.regex", KEY_REDACTION)


_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir.

    Only a local session that names none gets a temporary folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    if context.applicationId not in _own_dirs:
        _own_dirs[context.applicationId] = tempfile.mkdtemp(prefix="veilspark-")
    return _own_dirs[context.applicationId]


def checkpoint(df: DataFrame) -> DataFrame:
    """Write a result once to the shared folder, to be read several times."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path for one job's files in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame) -> DataFrame:
    """Rebalance a source only if it has fewer partitions than there are cores.

    A few small files would otherwise leave cores idle; a large input already
    has plenty of partitions and is left alone, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
