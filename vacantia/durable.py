"""Cutting lineage through the folder that driver and executors share.

A long plan that is reused is written as Parquet to ``spark.checkpoint.dir`` and read
back: a lost executor then costs only the tasks it was running.  The folder belongs to
the cluster; a local session without one gets a temporary one, and on a cluster without
one ``persist`` refuses, as executors would write to disks that others don't see.

``drop`` deletes tables that no plan still to be run reads, so an operator holds no more
of them than its next step needs.  ``settled`` runs a whole operator and leaves its
result only, and what is still there when the process ends is deleted then.
"""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import threading
import uuid
import weakref
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_live: dict[str, Callable[[], object]] = {}
_within = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a temporary one for a local session without it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that driver and executors share (master: {master})")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="vacantia-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return "file://" + _own[0]


def persist(df: DataFrame, codec: str = "zstd", partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder, in folders by ``partition_by``, and return it as read back."""
    spark = df.sparkSession
    path = new_folder(spark)
    for made in getattr(_within, "made", ()):
        made.append(path)
    df.write.option("compression", codec).parquet(path, partitionBy=partition_by)
    back = spark.read.schema(df.schema).parquet(path)
    _paths[back] = path
    return back


def new_folder(spark: SparkSession) -> str:
    """A new folder in the shared one for tables that a caller lays out; deleted when the process ends."""
    path = f"{shared_dir(spark)}/vacantia-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    _live[path] = lambda: files.delete(place, True)
    return path


def _delete(path: str) -> None:
    if delete := _live.pop(path, None):
        delete()


def drop(*tables: DataFrame) -> None:
    """Delete tables that ``persist`` has written; other DataFrames are left alone."""
    for t in tables:
        if path := _paths.pop(t, None):
            _delete(path)


def settled(make: Callable[[], DataFrame]) -> DataFrame:
    """The result of ``make``, written; every other table that it wrote on its way is deleted."""
    outer = getattr(_within, "made", ())
    made: list[str] = []
    _within.made = (*outer, made)
    kept = None
    try:
        result = persist(make())
        kept = _paths[result]
    finally:
        _within.made = outer
        for path in made:
            if path != kept:
                _delete(path)
    return result


def sweep() -> None:
    """Delete all tables of this process; no result that is not yet written may rest on them."""
    for path in list(_live):
        with contextlib.suppress(Exception):  # at the end of a process its JVM may have gone first
            _delete(path)


atexit.register(sweep)
