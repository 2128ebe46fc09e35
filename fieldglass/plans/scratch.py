"""Shared folder for written intermediates.

Intermediates that cut lineage go to the folder the cluster names in
``spark.checkpoint.dir``.  Only where that setting is absent and the master is
local (tests, a laptop) a temporary folder of this process is used; a cluster
without it is refused, for its executors share no local folder.
"""

from __future__ import annotations

import atexit
import math
import shutil
import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_PASSING: ContextVar[tuple[list[str], ...]] = ContextVar("fieldglass_passing", default=())
_OWN: dict[str, str] = {}
_USED: set[str] = set()
_ONCE: dict[tuple[str, str, str], tuple[str, StructType]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder for this application."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if "root" not in _OWN:
            _OWN["root"] = tempfile.mkdtemp(prefix="fieldglass-")
            atexit.register(shutil.rmtree, _OWN["root"], ignore_errors=True)
        root = "file://" + _OWN["root"]
    path = f"{root.rstrip('/')}/fieldglass-{app}"
    if path not in _USED:
        _USED.add(path)
        atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a written table."""
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended already; its owner clears the folder
        pass


@contextmanager
def passing(spark: SparkSession):
    """Tables staged inside are deleted at the end, but for lasting ones."""
    mine: list[str] = []
    token = _PASSING.set((*_PASSING.get(), mine))
    try:
        yield
    finally:
        _PASSING.reset(token)
        for path in mine:
            remove(spark, path)


#: Spark's setting that deletes an execution's shuffle files at its end; without it they stay until the driver's garbage is collected.
SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def swept(spark: SparkSession):
    """What is written inside leaves no shuffle files: whoever reads on reads the written table."""
    before = spark.conf.get(SWEEP, None)
    spark.conf.set(SWEEP, "true")
    try:
        yield
    finally:
        spark.conf.unset(SWEEP) if before is None else spark.conf.set(SWEEP, before)


def _written(df: DataFrame, label: str, by: list[str] | None) -> str:
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    with swept(df.sparkSession):
        (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return path


def stage(df: DataFrame, label: str, by: list[str] | None = None, lasting: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here.

    ``by``: columns to lay the files out by; ``lasting``: the table passes with
    the block around the innermost ``passing`` block, without one at the session's end.
    """
    schema = df.schema
    path = _written(df, label, by)
    blocks = _PASSING.get()[:-1] if lasting else _PASSING.get()
    if blocks:
        blocks[-1].append(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def _there(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def once(spark: SparkSession, key: str, build: Callable[[], DataFrame], label: str) -> DataFrame:
    """A staged table that is written once for each application and key; whoever asks again reads it.

    For what is worked out of tables that do not change while the application runs.
    """
    full = (spark.sparkContext.applicationId, label, key)
    if full not in _ONCE or not _there(spark, _ONCE[full][0]):
        df = build()
        _ONCE[full] = (_written(df, label, None), df.schema)
    path, schema = _ONCE[full]
    return spark.read.schema(schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows of a task in ``tasks``, about.
TASK_ROWS = 500_000


def tasks(counted: DataFrame) -> int:
    """Over how many tasks to deal work that grows with the rows of ``counted``, so that what a task sorts doesn't grow.

    counted: a read table, so that its rows are told by its files' footers.
    """
    return max(counted.sparkSession.sparkContext.defaultParallelism, math.ceil(counted.count() / TASK_ROWS))


#: Spark's settings of how many tasks a shuffle feeds and a table's files are read by.
DEALING = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.files.minPartitionNum")


@contextmanager
def dealing(spark: SparkSession, n: int):
    """What is written inside is shuffled over ``n`` tasks, and read by about as many: small files would else fill few tasks."""
    before = {k: spark.conf.get(k, None) for k in DEALING}
    for k, v in zip(DEALING, (str(n), "false", str(n)), strict=True):
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
