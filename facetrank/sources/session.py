"""Session helpers: importability on Python workers, and durable cut points for long lineages."""

from __future__ import annotations

import gc
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_OWN: set[str] = set()
ROOT = str(Path(__file__).resolve().parents[2])


def prepare(spark: SparkSession) -> SparkSession:
    """Put the library's folder on the Python path of the workers started from here on.

    On a cluster the library is installed on every node (or shipped with ``--py-files``); a folder that is absent
    there is harmless.
    """
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Where it is unset and everything runs on one machine, it is a temporary folder there; a cluster must name one.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        current = sc._jsc.sc().getCheckpointDir()
        folder = current.get() if current.isDefined() else None
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="facetrank-")
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def _own_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder, which goes when the driver ends."""
    folder = f"{shared_folder(spark)}/facetrank/{spark.sparkContext.applicationId}"
    if folder not in _OWN:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _OWN.add(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This ends the lineage: a lost executor costs only the tasks that read the files again, and no stage before it is
    run twice. Column pruning works on what is read back. Files go by :func:`drop`, or when the application ends.
    """
    spark = df.sparkSession
    path = f"{_own_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._facetrank_cut = path
    return out


def drop(*frames: DataFrame) -> None:
    """Delete the files of tables that :func:`cut` has returned and that nothing will read again.

    Whatever is derived from them must have been written by then.
    """
    for frame in frames:
        spark, place = frame.sparkSession, frame.__dict__.pop("_facetrank_cut", None)
        if place:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def sweep(spark: SparkSession) -> None:
    """Collect the driver's garbage, so that Spark deletes the shuffle files of plans that are no longer held."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def clear(spark: SparkSession) -> None:
    """Delete what :func:`cut` has left in a local shared folder (used by tests)."""
    folder = shared_folder(spark)
    if folder.startswith("file://"):
        shutil.rmtree(folder.removeprefix("file://") + "/facetrank", ignore_errors=True)
        _OWN.clear()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
