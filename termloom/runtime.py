"""What plans need of a cluster: the package in Python workers, and the shared folder for what is written between steps."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

PACKAGE = os.path.dirname(os.path.abspath(__file__))
SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send the package's sources to the executors, once for each application.

    Workers that can import the package anyway find the same code. A package that is
    itself imported from an archive was shipped by whoever made the archive.
    """
    context = spark.sparkContext
    if context.applicationId in SHIPPED or not os.path.isdir(PACKAGE):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="termloom-"), "termloom.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, names in os.walk(PACKAGE):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.relpath(full, os.path.dirname(PACKAGE)))
    context.addPyFile(path)
    SHIPPED.add(context.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir, or has been set on its context.

    Without one, only a session in one process (local) may use a folder of its own: on a
    cluster the executors would not see it, so there it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        before = spark.sparkContext._jsc.sc().getCheckpointDir()
        if before.isDefined():
            named = before.get()
        elif spark.sparkContext.master.split("[")[0] == "local":
            named = tempfile.mkdtemp(prefix="termloom-")
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def work_folder(spark: SparkSession) -> str:
    """Where this application writes between steps; clear_work() deletes it."""
    return f"{shared_folder(spark)}/termloom/{spark.sparkContext.applicationId}"


def work_path(spark: SparkSession) -> str:
    return f"{work_folder(spark)}/{uuid.uuid4().hex}"


def located(spark: SparkSession, path: str):
    """(the store that a path names, the path in it)."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    store, where = located(spark, path)
    return store.exists(where)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a file or folder, if it is there."""
    store, where = located(spark, path)
    store.delete(where, True)


def clear_work(spark: SparkSession) -> None:
    """Delete all that this application has written between steps. DataFrames that read it are of no use afterwards."""
    delete(spark, work_folder(spark))
