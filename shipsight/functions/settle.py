"""Written intermediate tables: cut the lineage where a frame feeds several branches.

The folder is the cluster's `spark.checkpoint.dir` (shared storage), so a lost executor re-reads files instead of
recomputing, and every branch starts from a plain scan. Where it is unset, a temporary folder is used on a local
master only; on a cluster that folder would be another one for each machine, so an unset folder is an error there.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, tempfile.TemporaryDirectory] = {}


def shared_dir(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if sc.applicationId not in _LOCAL:
        _LOCAL[sc.applicationId] = tempfile.TemporaryDirectory(prefix="shipsight-", ignore_cleanup_errors=True)
    return _LOCAL[sc.applicationId].name


def new_path(spark: SparkSession, name: str = "settled") -> str:
    """A path of its own in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Spark's switch for deleting a query's shuffle files at its end; otherwise they wait for a collection in the driver.
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def _shuffles_cleaned_up(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_CLEAN_UP)
    spark.conf.set(_CLEAN_UP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEAN_UP, before)


def settle(df: DataFrame, buckets: tuple[int, str] | None = None) -> DataFrame:
    """Write the frame once and continue from the files; `buckets` (number, column) spares a later join on it the shuffle.

    Once written, its shuffle files are of no more use and are deleted at once, so that a chain of writes needs the disk of
    its largest step only.
    """
    spark = df.sparkSession
    path = new_path(spark)
    if buckets is None:
        with _shuffles_cleaned_up(spark):
            df.write.parquet(path)
        out = spark.read.schema(df.schema).parquet(path)
    else:
        name = "settled_" + path.rsplit("-", 1)[-1]
        with _shuffles_cleaned_up(spark):
            df.write.bucketBy(*buckets).option("path", path).format("parquet").saveAsTable(name)
        out = spark.table(name)
    out.settled_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a settled frame that no later step reads any more."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.settled_at)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
