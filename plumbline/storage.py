"""Tables written to the folder that driver and executors share.

``spark.checkpoint.dir`` names that folder on a cluster.  Iterative operators
cut their lineage by writing a Parquet table there and reading it again, so a
lost executor costs a re-read and never a recomputation of earlier rounds.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_KEY = "spark.checkpoint.dir"
_open = threading.local()


@lru_cache(maxsize=1)
def _own_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="plumbline-")


def shared_dir(spark: SparkSession) -> str:
    """Folder from ``spark.checkpoint.dir``; a temporary one of this process only where the setting is absent and the master is local."""
    found = spark.conf.get(_KEY, None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{_KEY} must name a folder that all executors share")
        found = _own_dir()
    return found.rstrip("/")


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Remove, at the end of the block, the tables that were written in it.

    Operators open one for what only they read and hand the tables that their
    result reads to the block around it.  So a caller who works up a result
    inside a block of its own leaves nothing behind; without such a block the
    tables that the result reads stay until they are removed by path.
    """
    stack = _open.__dict__.setdefault("stack", [])
    stack.append([])
    try:
        yield
    finally:
        for path in stack.pop():
            remove(spark, path)


def fresh_path(spark: SparkSession, tag: str, hand_on: bool = False) -> str:
    """A path under the shared folder that nothing has used yet; it belongs to the innermost open ``scope``, or with ``hand_on`` to the one around that."""
    path = f"{shared_dir(spark)}/plumbline/{tag}-{uuid.uuid4().hex}"
    owners = _open.__dict__.get("stack", [])[:-1 if hand_on else None]
    if owners:
        owners[-1].append(path)
    return path


def materialise(df: DataFrame, tag: str, hand_on: bool = False) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and return it as read from there; the path is owned as in ``fresh_path``."""
    path = fresh_path(df.sparkSession, tag, hand_on)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_order(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """All rows of a key in one task, by ``key`` and ``order``, for what folds a stream of them.

    They are dealt by a hash of the key: dealing by the key itself is left out
    behind a join on it, and that join's parts may then be read where they lie
    or split, so that one key's rows come in several places.
    """
    return rows.repartition(F.xxhash64(key)).sortWithinPartitions(key, *order)


def remove(spark: SparkSession, path: str) -> None:
    """Delete what ``fresh_path`` named, through Hadoop's file system."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def table_bytes(spark: SparkSession, path: str) -> int:
    """Bytes that a written table takes, for size checks before a broadcast."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return int(fs.getContentSummary(target).getLength())


#: Hadoop's names of stores, and Arrow's names of the same.
_SCHEMES = {"s3a": "s3", "s3n": "s3", "wasbs": "abfss", "wasb": "abfs"}


def arrow_files(uri: str):
    """Arrow's file system of a URI (by Hadoop's or Arrow's scheme) or of a local path, and the path in it; usable in tasks."""
    from pyarrow import fs

    scheme, _, rest = uri.partition("://")
    if not rest:
        return fs.LocalFileSystem(), uri.removeprefix("file:")
    return fs.FileSystem.from_uri(f"{_SCHEMES.get(scheme, scheme)}://{rest}")
