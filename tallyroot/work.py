"""Intermediate tables that cut a plan's lineage and survive the loss of executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import time
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session.

    Where it is unset, a local session gets a temporary folder of its own; on a cluster
    that is an error, because a machine-local folder would not be seen by the others.
    """
    conf = spark.sparkContext.getConf()
    folder = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = conf.get("spark.master", "")
    if not master.startswith("local[") and master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="tallyroot-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    folder = "file://" + own
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


#: Folders of applications that ended without deleting them go after so many days.
KEPT_DAYS = 7
_folders: dict[str, str] = {}
_shipped: set[str] = set()


def _delete(context, path: str) -> None:
    jvm = context._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(at, True)


def application_folder(spark: SparkSession) -> str:
    """This application's folder below the shared one, deleted when Python ends; old ones of others are swept once."""
    context = spark.sparkContext
    name = context.applicationId
    if name not in _folders:
        shared = shared_folder(spark)
        _folders[name] = f"{shared}/tallyroot-{name}"
        jvm = context._jvm
        at = jvm.org.apache.hadoop.fs.Path(shared)
        files = at.getFileSystem(context._jsc.hadoopConfiguration())
        if files.exists(at):
            old = (time.time() - KEPT_DAYS * 86400) * 1000
            for f in files.listStatus(at):
                if f.getPath().getName().startswith("tallyroot-") and f.isDirectory() and f.getModificationTime() < old:
                    files.delete(f.getPath(), True)

        def clean():
            try:
                _delete(context, _folders[name])
            except Exception:  # the JVM is gone: a later application sweeps the folder
                pass

        atexit.register(clean)
    return _folders[name]


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once per application, so that their Python can import it."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    local = tempfile.mkdtemp(prefix="tallyroot-")
    atexit.register(shutil.rmtree, local, ignore_errors=True)
    path = os.path.join(local, "tallyroot.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(here):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.join("tallyroot", os.path.relpath(full, here)))
    context.addPyFile(path)
    _shipped.add(context.applicationId)


class Workspace:
    """Tables of one operator run, below the shared folder.

    `keep` writes a table as parquet and reads it back, so that later steps start from
    files instead of a long plan; `drop` removes tables that are no longer needed. What results
    still read is removed when the application ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark = spark
        self.root = f"{application_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        self._kept: list[tuple[DataFrame, str]] = []
        self._names: dict[str, str] = {}

    def keep(self, df: DataFrame) -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n}"
        df.write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        self._kept.append((back, path))
        return back

    def keep_bucketed(self, df: DataFrame, key: str) -> DataFrame:
        """The same in buckets by `key`, as many as the session has shuffle partitions: joins on the key do not move it any more."""
        self._n += 1
        path, name = f"{self.root}/{self._n}", f"tallyroot_{uuid.uuid4().hex}"
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        df.repartition(buckets, key).write.format("parquet").bucketBy(buckets, key).option("path", path).saveAsTable(name)
        back = self.spark.table(name)
        self._kept.append((back, path))
        self._names[path] = name
        return back

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark.sparkContext._jvm
        for frame, path in [x for x in self._kept if any(x[0] is t for t in tables)]:
            if path in self._names:
                self.spark.sql(f"DROP TABLE IF EXISTS {self._names.pop(path)}")
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
            self._kept = [x for x in self._kept if x[0] is not frame]
