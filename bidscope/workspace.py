"""Where multi-job operators keep their intermediate tables.

Executors and driver share only the folder named by ``spark.checkpoint.dir`` (and the inputs), so lineage is cut by
writing Parquet there.  A folder of our own is used only where that setting is absent and Spark runs in one process, as in
local tests; on a cluster without the setting writing is refused.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_root: str | None = None
_written: set[str] = set()


def work_root(spark: SparkSession) -> str:
    """The shared folder of this session; a temporary one only if the session names none and has no executors elsewhere."""
    global _own_root
    root = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        _own_root = _own_root or tempfile.mkdtemp(prefix="bidscope-")
        root = f"file://{_own_root}"
    return root.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that nothing else uses."""
    return f"{work_root(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and return a scan of it.

    A lost executor then costs a re-read, never a recomputation of what came before.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    _written.add(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.__dict__["_bidscope_path"] = path
    return table


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    _written.discard(path)


def discard(table: DataFrame) -> None:
    """Delete a table that ``materialize`` gave and that nothing will read again."""
    path = table.__dict__.get("_bidscope_path")
    if path in _written:
        _delete(table.sparkSession, path)


def written() -> set[str]:
    """Paths of the intermediate tables that exist now."""
    return set(_written)


def discard_since(spark: SparkSession, before: set[str], *but: DataFrame) -> None:
    """Delete the intermediate tables written after ``before`` was taken, except those of ``but``."""
    kept = {t.__dict__.get("_bidscope_path") for t in but}
    for path in _written - before - kept:
        _delete(spark, path)


def clean(spark: SparkSession) -> None:
    """Delete all intermediate tables of this process; for when the results that read them are written."""
    for path in list(_written):
        _delete(spark, path)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of each finished job; operators of several jobs then hold one job's at a time."""
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
