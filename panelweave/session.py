"""Session construction and the few settings the library depends on."""

from __future__ import annotations

import atexit
import os
import shutil
import sys
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "panelweave", master: str | None = None, **conf: str) -> SparkSession:
    """Session with adaptive execution, UTC and Arrow; ``conf`` overrides any key (``.`` written as ``__``)."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    settings |= {k.replace("__", "."): v for k, v in conf.items()}
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    spark = builder.config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: What this process writes is in one folder of its own.
RUN = uuid.uuid4().hex


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset and all runs on one machine (tests), a temporary folder that
    goes with the process; on a cluster that is an error, as executors would write
    to their own disks.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = os.environ.get("PANELWEAVE_SHARED")
        if not folder:
            folder = os.environ["PANELWEAVE_SHARED"] = tempfile.mkdtemp(prefix="panelweave-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder.rstrip("/")


def _deleter(spark: SparkSession, folder: str) -> Callable[[], None]:
    """What deletes a folder on whatever file system it is, even when the session has been stopped."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return lambda: files.delete(path, True)


def _forget(delete: Callable[[], None]) -> None:
    try:
        delete()
    except Exception as error:  # the process ends: tell, and let the others be deleted too
        print(f"intermediate tables stay: {error}", file=sys.stderr)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder. What this process has written there goes when it ends, on any file system."""
    folder = f"{shared_dir(spark)}/panelweave-{RUN}"
    if folder not in _known:
        _known.add(folder)
        atexit.register(_forget, _deleter(spark, folder))
    return f"{folder}/{uuid.uuid4().hex}/{name}"


_known: set[str] = set()


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` once to the shared folder and read it back.

    The table survives lost executors, and later stages restart from it. Unlike
    ``checkpoint()`` it is columnar, compressed and computed exactly once.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    schema = df.schema
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._panelweave_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what :func:`materialise` wrote for ``df``, when nothing that is still to be computed rests on it."""
    _deleter(df.sparkSession, df._panelweave_path)()


def clear_shared(spark: SparkSession) -> None:
    """Delete all that this process has written by ``materialise``. Only when no result that rests on it is still to be computed."""
    _deleter(spark, f"{shared_dir(spark)}/panelweave-{RUN}")()


def importable(spark: SparkSession) -> None:
    """Let Python workers import the package from where the driver has it (a no-op where it is installed)."""
    root = str(Path(__file__).resolve().parents[1])
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep)
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, by Spark's own reader so that any file system works."""
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions of the session: the one width knob that every wide operator follows."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
