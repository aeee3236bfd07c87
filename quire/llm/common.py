"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders of this driver's written tables, by the checkpoint folder that they are in.
_FOLDERS: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the input tables, by whatever file system ``sf_dir`` names."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the session names; a temporary one only where none is set (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = current.get() if current.isDefined() else tempfile.mkdtemp(prefix="quire-checkpoint-")
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(named)
    return named


#: Seconds between two releases at least.
RELEASE_EVERY = 2.0
_released = 0.0


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps that nothing refers to any more.

    It learns of them from the driver's garbage collector, which may otherwise not run for long.
    """
    global _released
    if time.monotonic() - _released >= RELEASE_EVERY:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        _released = time.monotonic()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint; lost executors re-read it from shared storage."""
    checkpoint_dir(df.sparkSession)
    release(df.sparkSession)
    return df.checkpoint(eager=True)


def _removed(spark: SparkSession, folder: str) -> None:
    """Delete what this driver has written, if its session still stands."""
    try:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001  the session has ended before
        pass


def written(df: DataFrame, codec: str | None = None) -> DataFrame:
    """The rows as a compressed table in the shared folder, read again; it goes when the driver ends."""
    spark = df.sparkSession
    base = checkpoint_dir(spark)
    if base not in _FOLDERS:
        _FOLDERS[base] = f"{base}/quire-{uuid.uuid4().hex}"
        atexit.register(_removed, spark, _FOLDERS[base])
    path = f"{_FOLDERS[base]}/{uuid.uuid4().hex}"
    release(spark)
    df.write.parquet(path, compression=codec)
    table = spark.read.schema(df.schema).parquet(path)
    table._written = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete what ``written`` has returned, once nothing is to be read of it."""
    for table in tables:
        _removed(table.sparkSession, table._written)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def vocabulary_path(name: str) -> str:
    """Where the installed public vocabulary file is; used only as a default of path parameters."""
    import public_tokenizers

    return public_tokenizers.path(name)


def sampled(df: DataFrame, rows: int, *names: str) -> list:
    """About ``rows`` rows of a table that has been written, the same ones each time; all of a smaller table.

    The tasks decide by a threshold on a hash, so what reaches the driver does not grow with their number.
    """
    share = rows / max(1, df.count())
    drawn = df.select(*names)
    if share < 1:
        drawn = drawn.where(F.pmod(F.xxhash64(*names), F.lit(1 << 30)) < int(share * (1 << 30)))
    return drawn.collect()
