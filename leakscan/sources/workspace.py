"""Where intermediate tables go: the folder the cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_DIR = "spark.checkpoint.dir"
STORED_CODEC = "zstd"  # of tables with many hashes: in hex they take half of what they do by default


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one only where none is set
    and the session runs in this process alone."""
    configured = spark.conf.get(_DIR, None) or spark.sparkContext.getConf().get(_DIR)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {_DIR} to a folder every executor can reach")
    context = spark.sparkContext
    if not getattr(context, "_leakscan_dir", None):
        context._leakscan_dir = tempfile.mkdtemp(prefix="leakscan-")
    return context._leakscan_dir


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_written: list[str] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete, at the end, the intermediate tables that are written inside.

    For whole jobs: write or collect the results before leaving.
    """
    before = len(_written)
    try:
        yield
    finally:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        while len(_written) > before:
            path = jvm.org.apache.hadoop.fs.Path(_written.pop())
            path.getFileSystem(conf).delete(path, True)


def materialise(df: DataFrame, name: str = "stage", codec: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage: later steps neither repeat the work nor lose it with an
    executor. The table stays until the enclosing ``scratch`` ends.
    """
    path = fresh_path(df.sparkSession, name)
    _written.append(path)
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)
