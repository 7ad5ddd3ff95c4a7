"""Shared-folder staging for the training-data operators.

Every table or file an operator needs twice is written to the folder that the
cluster names in ``spark.checkpoint.dir``: any executor can read it again after
another one is lost, and it cuts the lineage. Nothing here touches a local
folder unless the setting is missing, which is the case in tests only.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """URI of the folder that the driver and all executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="loomline-")
    return _OWN[app]


def workspace(spark: SparkSession, what: str) -> str:
    """A new folder name below the shared root; removed when the driver ends."""
    path = f"{shared_root(spark)}/loomline/{what}-{uuid.uuid4().hex[:12]}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # the JVM may be gone before us; the folder is then left to the cluster's own cleaning
        return


def remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def staged(df: DataFrame, what: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again."""
    spark = df.sparkSession
    path = workspace(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unsent(df: DataFrame) -> DataFrame:
    """``df`` for a join that sorts both sides and broadcasts neither.

    Spark sizes a table by its compressed files and by what an explode read, not by
    what it put out, and would send tables of many times the threshold through the driver.
    """
    return df.hint("merge")


def files(uri: str):
    """(filesystem, path) of a shared folder for code that runs in Python workers."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def crc_mod(column: str, n: int) -> Column:
    """crc32 of a column's text, modulo n."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def crc_text(value: object) -> int:
    return zlib.crc32(str(value).encode())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(sizes, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive (begin, end) ranges whose sizes sum to at most ``most`` (one item at least)."""
    begin, held = 0, 0
    for i, n in enumerate(sizes):
        if i > begin and held + n > most:
            yield begin, i
            begin, held = i, 0
        held += n
    if begin < len(sizes):
        yield begin, len(sizes)


def small_batches(spark: SparkSession, rows: int = 1000, megabytes: int = 16) -> None:
    """Bounds what one Arrow batch of long texts holds in a Python worker; a setting of the session, as the work begins after the caller has returned."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(megabytes << 20))
