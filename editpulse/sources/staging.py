"""Tables written between two stages."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"
_staged: list[str] = []  # tables of the session that no job owns
_owned: ContextVar[list[str] | None] = ContextVar("owned", default=None)


def staging_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables, as named by the cluster.

    A machine-local folder is chosen only for a local master without the setting.
    """
    root = spark.conf.get(CHECKPOINT_SETTING, None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_SETTING} to a folder all executors can reach")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="editpulse-"))
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The result has no lineage to recompute when an executor is lost, and readers get
    column pruning and filter pushdown on it; a small one is broadcast by its file size.
    Inside ``job_tables`` the table goes with the job, else ``drop_staged`` deletes it.
    """
    spark = df.sparkSession
    path = f"{staging_root(spark)}/editpulse-{name}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    owned = _owned.get()
    (_staged if owned is None else owned).append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def named_table(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """Expose ``df`` to SQL under ``name`` for the length of a block.

    The table is staged once, so several statements can read it without recomputing it.
    """
    staged = stage(df, name)
    staged.createOrReplaceTempView(name)
    try:
        yield staged
    finally:
        staged.sparkSession.catalog.dropTempView(name)


@contextmanager
def job_tables(spark: SparkSession) -> Iterator[None]:
    """Own the tables staged inside the block by this thread and delete them, and no others, at its end.

    A job writes its results inside the block; frames that still read its tables end with it.
    """
    owned: list[str] = []
    token = _owned.set(owned)
    try:
        yield
    finally:
        _owned.reset(token)
        _delete(spark, owned)


def drop_staged(spark: SparkSession) -> None:
    """Delete the tables that this session has staged outside of jobs; call it when their results are written."""
    _delete(spark, _staged)


def _delete(spark: SparkSession, paths: list[str]) -> None:
    jvm = spark._jvm
    while paths:
        path = jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
