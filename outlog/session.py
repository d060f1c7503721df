"""Session helpers: building a session for local runs and finding the shared work folder.

On a cluster the session is built by the platform and ``spark.checkpoint.dir`` names a
folder every executor can reach.  Everything here reads that setting; only when it is unset
(unit tests, a laptop) do we create a scratch folder of our own.
"""

from __future__ import annotations

import contextlib
import functools
import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

# Settings every outlog session wants.  Timestamps are compared across engines, so the
# session time zone is pinned to UTC; AQE coalesces tiny shuffles and splits skewed ones.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "outlog",
                  driver_memory: str = "16g", extra: dict | None = None) -> SparkSession:
    """A local session for tests and benchmarks (never used on a cluster)."""
    builder = (SparkSession.builder.master(f"local[{cpus}]").appName(app)
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", driver_memory))
    for k, v in {**DEFAULT_CONF, **(extra or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    work_dir(spark)
    return spark


def work_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    Read from ``spark.checkpoint.dir``.  Only a local session (tests) may leave it unset and gets
    a scratch folder; a cluster session must name one.
    """
    conf = spark.sparkContext.getConf()
    d = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="outlog-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared work folder (never a machine-local folder on a cluster)."""
    base = work_dir(spark).rstrip("/")
    path = f"{base}/{name}-{uuid.uuid4().hex[:12]}"
    if _scopes:
        _scopes[-1].append(path)
    return path


_scopes: list[list[str]] = []      # scratch folders made inside running ``drops_scratch`` steps
_kept: list[str] = []              # those that the results of finished steps read


def _drop_unread(spark: SparkSession, paths: list[str], files: list[str]) -> list[str]:
    """Delete the folders that none of the files lies in; the others."""
    left = [p for p in paths if any(os.path.basename(p) in f for f in files)]
    for p in set(paths) - set(left):
        drop_path(spark, p)
    return left


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder through Spark's file systems (a missing one is no error)."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def drops_scratch(step: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A step ``(spark, ...) -> DataFrame`` that leaves no scratch behind but what its result reads.

    Folders of ``scratch_path`` that the step made and its result does not read are deleted when it
    returns; those the result reads go when the next such step starts on other data.  So a step's
    result has to be written before the next step is called, as in a chain of written stages.
    """
    @functools.wraps(step)
    def run(spark: SparkSession, *args, **kwargs) -> DataFrame:
        read = [f for a in args if isinstance(a, DataFrame) for f in a.inputFiles()]
        _kept[:] = _drop_unread(spark, _kept, read)
        made: list[str] = []
        _scopes.append(made)
        try:
            out = step(spark, *args, **kwargs)
        finally:
            _scopes.pop()
        _kept.extend(_drop_unread(spark, made, out.inputFiles()))
        return out

    return run


def drop_finished_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of an SQL execution when that ends (results are written tables)."""
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession):
    """``drop_finished_shuffles`` for the jobs of a block; the setting is put back after it."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` as a Parquet table in the shared work folder and read it back.

    The result depends on nothing but the written files, so it survives executor loss
    (unlike a local checkpoint) and its plan stays small across iterations (SOM epochs,
    the pointer-doubling walk).  One write job, versus compute-then-write for
    ``DataFrame.checkpoint``.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "cut")
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


# Parquet options for tables of long rows: a reader takes a row group at once
LONG_ROWS = {"parquet.block.size": str(8 << 20), "parquet.page.size.row.check.min": "1"}


def cut_over(df: DataFrame, old: str | None, **options: str) -> tuple[DataFrame, str]:
    """``cut_lineage`` of a step of a loop, and its folder; the folder of the step before is deleted once ``df`` is written."""
    spark = df.sparkSession
    path = scratch_path(spark, "cut")
    df.write.mode("overwrite").options(**options).parquet(path)
    if old:
        drop_path(spark, old)
    return spark.read.parquet(path), path


def broadcast_if_small(df: DataFrame, row_bytes: int = 256, max_bytes: int | None = None) -> DataFrame:
    """Mark ``df`` for broadcast only when its counted size fits the budget.

    The count is an action, so pass a checkpointed or cheap DataFrame.  Above the budget
    the DataFrame is returned as is and the join stays a shuffle join.
    """
    from pyspark.sql import functions as F

    from .config import BROADCAST_MAX_BYTES

    limit = BROADCAST_MAX_BYTES if max_bytes is None else max_bytes
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def sf_path(sf_dir: str, table: str) -> str:
    return os.path.join(sf_dir, f"{table}.parquet")


def read_table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(sf_path(sf_dir, table))
