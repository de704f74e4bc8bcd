"""Intermediate tables in the folder that every executor shares.

``stage`` cuts lineage by writing a Parquet table and reading it back, so a lost
executor costs at most the tasks it was running: what it had produced is in the
shared folder.  The folder is ``spark.checkpoint.dir``; only where that is unset
does a session get a folder of its own.
"""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A staged table is broadcast only while its compressed files and its rows stay under both bounds.
BROADCAST_BYTES, BROADCAST_ROWS = 4 << 20, 500_000

_roots: dict[str, str] = {}


class _Passing(threading.local):
    """Tables staged by this thread since each ``stage_only`` that is still running."""

    def __init__(self):
        self.open: list[list[DataFrame]] = []


_passing = _Passing()


def _folder() -> str:
    """A temporary folder that goes with this process."""
    path = tempfile.mkdtemp(prefix="lodestar-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables of this application; it is deleted when the driver ends.

    On a cluster ``spark.checkpoint.dir`` must name it, as executors don't share a folder of their own.
    """
    app = spark.sparkContext.applicationId
    if app not in _roots:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            master = spark.sparkContext.master
            if not master.startswith("local") or master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            shared = f"file://{_folder()}"
        _roots[app] = f"{shared.rstrip('/')}/lodestar-{app}"
        atexit.register(_delete, *_hadoop_path(spark, _roots[app]))
    return _roots[app]


def _delete(path, fs) -> None:
    with contextlib.suppress(Exception):  # the JVM may have gone before
        fs.delete(path, True)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back."""
    path = f"{root(df.sparkSession)}/{label}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_path = path  # noqa: SLF001
    if _passing.open:
        _passing.open[-1].append(out)
    return out


def stage_only(make: Callable[[], DataFrame], label: str) -> DataFrame:
    """Stage what ``make`` returns, and delete the tables that were staged on the way to it."""
    _passing.open.append([])
    try:
        df = make()
    finally:
        passing = _passing.open.pop()
    out = stage(df, label)
    for table in passing:
        drop(table)
    return out


def _hadoop_path(spark: SparkSession, path: str):
    jvm = spark._jvm  # noqa: SLF001
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())  # noqa: SLF001


def staged_bytes(df: DataFrame) -> int:
    """Size of the files of a table that ``stage`` returned."""
    p, fs = _hadoop_path(df.sparkSession, df._staged_path)  # noqa: SLF001
    return fs.getContentSummary(p).getLength()


def drop(df: DataFrame) -> None:
    """Delete a staged table that no remaining plan reads."""
    p, fs = _hadoop_path(df.sparkSession, df._staged_path)  # noqa: SLF001
    fs.delete(p, True)


def clear(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application; results that are still read from them must be written first."""
    p, fs = _hadoop_path(spark, root(spark))
    fs.delete(p, True)


def sized(staged: DataFrame) -> DataFrame:
    """The staged table with a broadcast hint while it is within the bounds; larger ones get none, and the join shuffles."""
    small = staged_bytes(staged) <= BROADCAST_BYTES and staged.count() <= BROADCAST_ROWS
    return F.broadcast(staged) if small else staged
