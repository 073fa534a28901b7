"""Tables between the steps of a plan, in the folder that all executors share.

Results that are read more than once, or that end a loop's step, are written
as Parquet below the folder that the cluster names in ``spark.checkpoint.dir``.
They survive the loss of executors and cut lineage. A plan that needs such
tables is run by :func:`settled`, which writes its result and deletes them.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_OPEN = threading.local()


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only in local mode where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    key = spark.sparkContext.applicationId
    if key not in _LOCAL:
        _LOCAL[key] = "file://" + tempfile.mkdtemp(prefix="glossator-")
    return _LOCAL[key]


def own_folder(spark: SparkSession) -> str:
    """The application's part of the shared folder."""
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _scopes() -> list[list[str]]:
    if not hasattr(_OPEN, "scopes"):
        _OPEN.scopes = []
    return _OPEN.scopes


def _write(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{own_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    again = spark.read.schema(df.schema).parquet(path)
    again._stored_path = path
    return again, path


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet and read again: computed once, without lineage."""
    again, path = _write(df, label)
    if _scopes():
        _scopes()[-1].append(path)
    return again


def forget(*tables: DataFrame) -> None:
    """Delete tables made by :func:`stored` that no later plan reads."""
    for table in tables:
        if path := getattr(table, "_stored_path", None):
            _delete(table.sparkSession, path)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables stored inside are deleted at the end; nothing that is still lazy may read them after it."""
    held: list[str] = []
    _scopes().append(held)
    try:
        yield
    finally:
        _scopes().pop()
        for path in held:
            _delete(spark, path)


def settled(spark: SparkSession, label: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The result of ``make`` as a stored table; the tables that it stored on the way are deleted."""
    with scope(spark):
        again, path = _write(make(), label)
    if _scopes():
        _scopes()[-1].append(path)
    return again


def clean(spark: SparkSession) -> None:
    """Delete everything that the application has stored, results too."""
    _delete(spark, own_folder(spark))
