"""Session helpers shared by the operators: input tables, the shared folder, tables cut off from their lineage."""

from __future__ import annotations

import atexit
import itertools
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read only through Spark's readers (the path may be in any Hadoop file system)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows in an Arrow batch at most: texts can be long, and a Python worker holds a batch or two.
BATCH_ROWS = 1000


def short_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batch size to ``BATCH_ROWS``; a lower setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Only where the setting is absent a folder is chosen here: below the warehouse on a cluster,
    ``/tmp/checkpoints`` in local mode, where driver and executors are one process.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.split("[")[0] == "local":
        return "file:///tmp/checkpoints"
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"


#: Session, path, thread and number of the tables in the shared folder.
_WRITTEN: list[tuple[SparkSession, str, int, int]] = []
_NUMBERS = itertools.count()


def scratch_path(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder; it is removed when the driver ends."""
    path = f"{shared_dir(spark)}/scratch-{what}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path, threading.get_ident(), next(_NUMBERS)))
    return path


def _remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None or spark.sparkContext._jsc.sc().isStopped():
        return
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _remove_scratch() -> None:
    for spark, path, *_ in _WRITTEN:
        _remove(spark, path)


def here() -> int:
    """A place in the order in which tables are made, for ``release``."""
    return next(_NUMBERS)


def release(since: int, *kept: DataFrame) -> None:
    """Removes the tables that this thread has made since then, but for those that ``kept`` read: what was made of the others is a table by now."""
    files = [f for df in kept for f in df.inputFiles()]
    own = [x for x in _WRITTEN if x[3] > since and x[2] == threading.get_ident()]
    for x in own:
        if not any(x[1].rsplit("/", 1)[-1] in f for f in files):
            _remove(*x[:2])
            _WRITTEN.remove(x)


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, lineage cut, safe against lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, what)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Ids that a broadcast side may hold at most (a long hash relation of about 16 MB); more are joined by a shuffle.
BROADCAST_IDS = 400_000


def semi_by_id(df: DataFrame, ids: DataFrame, key: str, limit: int = BROADCAST_IDS) -> DataFrame:
    """Rows of ``df`` whose ``key`` is in ``ids``: broadcast when the counted ids stay under ``limit``, else shuffled."""
    few = ids.count() <= limit
    return df.join(F.broadcast(ids) if few else ids.hint("merge"), key, "left_semi")
