"""Session-level helpers: checkpoint folder, table access, size-checked broadcasts."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows and bytes (as stored) that a side may have to be broadcast; beyond either a shuffled join is planned.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a data directory (a file or a folder of parquet files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder in ``spark.checkpoint.dir``.  Where that is unset, a local session (tests) takes
    a temporary folder; on a cluster it is an error, as no such folder is shared."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = os.path.join(tempfile.gettempdir(), "colloquy-checkpoints")
    sc.setCheckpointDir(folder)


def _store(df: DataFrame) -> tuple[DataFrame, object, object]:
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    sc = spark.sparkContext
    path = f"{sc._jsc.sc().getCheckpointDir().get()}/tables/{uuid.uuid4().hex}"
    place = sc._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(sc._jsc.hadoopConfiguration())
    system.deleteOnExit(place)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), system, place


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage with a table written to the shared checkpoint folder, and read it back.

    The table survives lost executors, is columnar and compressed, and later stages read only the
    columns they need.  It is removed when the driver's JVM ends.
    """
    return _store(df)[0]


def bounded(df: DataFrame, most: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """``df``, computed once into the shared folder, with a broadcast hint if it has at most ``most``
    rows and ``size`` bytes there; else without, so that a shuffled join with skew handling is
    planned.  Rows are counted from the files' footers."""
    kept, system, place = _store(df)
    small = system.getContentSummary(place).getLength() <= size and kept.count() <= most
    return F.broadcast(kept) if small else kept
