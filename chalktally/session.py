"""Session settings every job relies on, and the shared working folder."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

# Days are UTC days. AQE splits hot keys in joins of a fact table to a
# dimension, also where that costs one more exchange further up.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # State of streams on disk with a copy in the checkpoint, not in memory.
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    # Commits write what changed instead of whole files.
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # State is mostly text.
    "spark.sql.streaming.stateStore.compression.codec": "zstd",
    "spark.sql.streaming.stateStore.rocksdb.compression": "zstd",
    "spark.sql.streaming.stateStore.rocksdb.blockSizeKB": "32",
    # A join of streams has one store a task, not four; each sets 4 MB of disk aside.
    "spark.sql.streaming.join.stateFormatVersion": "3",
}
# Shuffle files go when a write or a micro-batch of a stream ends, not when the driver
# happens to collect its garbage. For plans that run once.
CLEANED = ("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings to a session that somebody else created."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting that holds for what begins here; a stream keeps those of its start."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def local(app: str, cores: int = 8, **extra: str) -> SparkSession:
    """A local session for tests and measurements."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.driver.memory", "12g")
    )
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see, named by ``spark.checkpoint.dir``. Only a
    session whose executors run inside the driver (tests, measurements) may do
    without the setting and gets a temporary one."""
    current = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not current:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder all executors share")
        current = tempfile.mkdtemp(prefix="chalktally-")
        spark.conf.set("spark.checkpoint.dir", current)
    return current.rstrip("/")


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder in the shared one, for tables a job writes and reads back."""
    return f"{shared_folder(spark)}/{purpose}-{uuid.uuid4().hex}"


def stored(df: DataFrame, purpose: str, by: list[str] | None = None) -> DataFrame:
    """``df`` written to a new folder, in folders by some columns if named, and read
    back: computed once, and still there if executors are lost."""
    path = work_dir(df.sparkSession, purpose)
    writer = df.write.partitionBy(*by) if by else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)
