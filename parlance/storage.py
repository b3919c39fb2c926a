"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import threading
import time
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir.

    Where it is unset, a temporary folder serves a local master; any other master is refused,
    since a machine-local folder would lose data there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not getattr(shared_dir, "own", None):
        shared_dir.own = tempfile.mkdtemp(prefix="parlance-")
    return f"file://{shared_dir.own}"


def _files(spark: SparkSession, path: str):
    """The Hadoop path and its file system."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete(path: str) -> None:
    """Remove a table that `materialize` wrote."""
    spark = _written.pop(path, None)
    if spark is None or spark.sparkContext._jsc is None:
        return
    at, files = _files(spark, path)
    files.delete(at, True)


class Lease:
    """This driver's folder among the shared ones, and a file in it that a thread writes anew every few minutes for as long as the driver lives."""

    RENEW_MINUTES = 10

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.path, self.ended = spark, f"{folder}/parlance/{uuid.uuid4().hex}", threading.Event()
        self.renew()
        threading.Thread(target=self._keep, daemon=True).start()

    def renew(self) -> None:
        at, files = _files(self.spark, f"{self.path}/lease")
        files.create(at, True).close()

    def _keep(self) -> None:
        while not self.ended.wait(60 * self.RENEW_MINUTES):
            try:
                self.renew()
            except Exception:  # noqa: BLE001 - the store may be away for a while, and the session may have ended
                if self.spark.sparkContext._jsc is None:
                    return

    def end(self) -> None:
        self.ended.set()
        if self.spark.sparkContext._jsc is not None:
            at, files = _files(self.spark, self.path)
            files.delete(at, True)


_leases: dict[str, Lease] = {}


def _delete_all() -> None:
    for lease in list(_leases.values()):
        try:
            lease.end()
        except Exception:  # noqa: BLE001 - the session may have ended before
            return


atexit.register(_delete_all)


#: Hours after which a lease that its driver has not renewed is over.
LEASE_HOURS = 3


def sweep(spark: SparkSession, hours: float = LEASE_HOURS) -> int:
    """Delete the folders of drivers whose leases are older than so many hours; gives how many. What a living driver made stays, however old, as it renews its lease."""
    at, files = _files(spark, f"{shared_dir(spark)}/parlance")
    if not files.exists(at):
        return 0
    own, gone = {lease.path.rpartition("/")[2] for lease in _leases.values()}, 0
    for folder in [f.getPath() for f in files.listStatus(at)]:
        lease = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder, "lease")
        held = files.getFileStatus(lease if files.exists(lease) else folder).getModificationTime()
        if folder.getName() not in own and held < (time.time() - hours * 3600) * 1000:
            files.delete(folder, True)
            gone += 1
    return gone


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in this driver's part of the shared folder, which is taken away when the driver ends, or, where it is killed, by the next one once its lease is over."""
    folder = shared_dir(spark)
    if folder not in _leases or _leases[folder].spark.sparkContext._jsc is None:
        _leases[folder] = Lease(spark, folder)
        sweep(spark)
    path = f"{_leases[folder].path}/{name}-{uuid.uuid4().hex}"
    _written[path] = spark
    return path


def materialize(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write df as Parquet to the shared folder and read it again: computed once, lineage cut,
    and any lost executor can be replaced. Returns the table and its path, for `delete`."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


@contextlib.contextmanager
def passing() -> Iterator[set[str]]:
    """Tables that are made inside are deleted at its end, but for the paths that are put into the set it gives: for what a stage needs only until its result is written."""
    before, kept = set(_written), set()
    yield kept
    for path in set(_written) - before - kept:
        delete(path)
