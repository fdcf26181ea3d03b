"""Tables written to the folder that the cluster shares: a cut in the lineage that outlives lost executors."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def shared_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a new local one on a local master; on any other it raises,
    as executors would write to disks that the others cannot read."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[\d*, ]+\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="scratch-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_folder(spark: SparkSession, tag: str) -> str:
    """A path below the shared folder that nothing uses yet; it goes when the session's Python ends."""
    path = f"{shared_root(spark)}/tables/{tag}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def written(df: DataFrame, tag: str = "t", codec: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder, read back."""
    path = new_folder(df.sparkSession, tag)
    df.write.parquet(path, compression=codec)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables made by written() that nothing reads any more."""
    for df in tables:
        _made.remove((df.sparkSession, df._scratch))
        _delete(df.sparkSession, df._scratch)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            _delete(spark, path)
        except Exception:  # the JVM may have ended before Python
            return
