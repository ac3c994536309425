"""Where intermediate files go, and how workers get this package."""

from __future__ import annotations

import atexit
import os
import tempfile
import threading
import uuid
import zipfile
from pathlib import Path

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only sessions on one machine may be without: they get a
    temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


#: Folders written by this process, by session and thread; deleted when their tables aren't needed any more or at its end.
_folders: dict[str, tuple[SparkSession, int]] = {}


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of our own in the shared folder."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _folders[path] = spark, threading.get_ident()
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage, and survives lost executors."""
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def own_folders() -> set[str]:
    """The folders of this thread."""
    return {path for path, (_, thread) in list(_folders.items()) if thread == threading.get_ident()}


def delete(path: str) -> None:
    """Delete a folder that ``new_folder`` has given."""
    if found := _folders.pop(path, None):
        spark, _ = found
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _at_exit() -> None:
    if SparkContext._active_spark_context is not None:
        for path in list(_folders):
            delete(path)


def ship(spark: SparkSession) -> None:
    """Gives this package to Python workers that couldn't import it: those of sessions started elsewhere than in its folder and
    without it in PYTHONPATH. Once for each context."""
    root = Path(__file__).resolve().parents[2]
    known = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    sc = spark.sparkContext
    if getattr(sc, "_stratafit_shipped", False) or str(root) in known or not (root / "stratafit").is_dir():
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="stratafit-"), "stratafit.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted((root / "stratafit").rglob("*.py")):
            z.write(path, path.relative_to(root))
    sc.addPyFile(archive)
    sc._stratafit_shipped = True
