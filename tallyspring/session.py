"""Session helpers shared by all operators."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as ``spark.checkpoint.dir`` names it.

    Only where the setting is absent and all runs on one machine (tests, a laptop) a folder of its own is used; on a cluster
    that is an error, as a folder of one machine is lost with it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = os.path.join(tempfile.gettempdir(), "tallyspring-checkpoints")
        spark.conf.set("spark.checkpoint.dir", folder)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/tallyspring-{spark.sparkContext.applicationId}"


def _hadoop(spark: SparkSession, folder: str) -> tuple:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Unlike a cache this survives the loss of an executor and cuts the lineage; unlike
    ``checkpoint()`` it stays columnar, so a reader that needs two columns reads two. What was
    written goes when the application ends, or with ``release``.
    """
    spark = df.sparkSession
    folder = _own_folder(spark)
    fs, path = _hadoop(spark, folder)
    fs.deleteOnExit(path)
    name = f"{folder}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(name)
    return spark.read.schema(df.schema).parquet(name)


def release(spark: SparkSession) -> None:
    """Delete all that ``materialize`` wrote in this application; results that still read it must have been used."""
    fs, path = _hadoop(spark, _own_folder(spark))
    fs.delete(path, True)


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, however the session was started.

    Its folder goes on the workers' path (one machine, or a shared file system), and once per
    session the package itself goes along as a zip (executors elsewhere).
    """
    sc = spark.sparkContext
    here = Path(__file__).resolve().parent
    known = sc.environment.get("PYTHONPATH", "")
    if str(here.parent) not in known.split(os.pathsep):
        sc.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [str(here.parent), known]))
    if getattr(sc, "_tallyspring_shipped", False) or not here.is_dir():
        return
    folder = Path(tempfile.mkdtemp(prefix="tallyspring-"))
    with zipfile.ZipFile(folder / "tallyspring.zip", "w") as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, p.relative_to(here.parent))
    sc.addPyFile(str(folder / "tallyspring.zip"))
    sc._tallyspring_shipped = True
