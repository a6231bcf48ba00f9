"""Tables in the folder that the driver and all executors share: `spark.checkpoint.dir`.

Writing a table there and reading it back cuts lineage and survives lost executors.  A folder of this machine takes its
place only where the session names none and runs on this machine alone, as in tests.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import DataFrame, SparkSession

_scopes: list[dict[str, str]] = []


@cache
def _own_dir() -> str:
    return f"file://{tempfile.mkdtemp(prefix='lodestone-')}"


def shared_dir(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (named or _own_dir()).rstrip("/")


def place(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    path = f"{shared_dir(spark)}/lodestone/{name}-{uuid.uuid4().hex}"
    for scope in _scopes[-1:]:
        scope[path] = name
    return path


def store(df: DataFrame, name: str, codec: str = "zstd", group: int = 0) -> DataFrame:
    """Write df as a table in the shared folder and read it back.

    group: bytes of a row group, looked at after every row; for tables of few and large rows, which a writer and a
    reader would else hold by the hundred.
    """
    path = place(df.sparkSession, name)
    sizes = {"parquet.block.size": group, "parquet.page.size.row.check.min": 1} if group else {}
    df.write.option("compression", codec).options(**sizes).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def stored(spark: SparkSession, path: str) -> bool:
    """Whether a table at path was written to its end."""
    return exists(spark, f"{path}/_SUCCESS")


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at path, made and written there first if it isn't there whole."""
    if not stored(spark, path):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scope(spark: SparkSession, *keep: str) -> Iterator[None]:
    """At the end, remove what was stored inside under other names than `keep`; those go to the scope around it."""
    _scopes.append({})
    try:
        yield
    finally:
        for path, name in _scopes.pop().items():
            if name in keep:
                for outer in _scopes[-1:]:
                    outer[path] = name
            else:
                remove(spark, path)
