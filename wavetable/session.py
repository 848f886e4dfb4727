"""Session settings and lineage cutting shared by tests, bench and pipelines."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "20000",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(app: str = "wavetable", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the settings the operators are tuned for.

    On a cluster leave ``master`` unset and let spark-submit decide; the number of
    shuffle partitions is left to the cluster as well, adaptive execution merges small ones.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers wherever they run, once per application."""
    context = spark.sparkContext
    if getattr(context, "_wavetable_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="wavetable-package-"), "wavetable.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("wavetable", os.path.relpath(full, root)))
    context.addPyFile(target)
    context._wavetable_shipped = True


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder every executor sees: below ``spark.checkpoint.dir``, or temporary where that is unset.

    What lies in it lasts as long as the application; ``release_folders`` deletes it before.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        _only_local(spark)
        folder = tempfile.mkdtemp(prefix=f"wavetable-{name}-")
    else:
        folder = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not _folders:
        atexit.register(release_folders)
    _folders.append((folder, spark._jvm, spark._jsc.hadoopConfiguration()))
    return folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back, so that each later use reads the columns it needs.

    Cuts the lineage as ``cut_lineage`` does, but works the rows out once and keeps them in columns.
    """
    folder = f"{shared_folder(df.sparkSession, name)}/rows"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


_folders: list[tuple] = []


def release_folders() -> None:
    """Delete the folders that ``shared_folder`` gave out; results that still read them must have been written elsewhere."""
    while _folders:
        folder, jvm, settings = _folders.pop()
        try:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(settings).delete(path, True)
        except Exception:  # noqa: BLE001  the JVM may be gone at the end of the process
            return


def _only_local(spark: SparkSession) -> None:
    """A temporary folder serves only where driver and executors are one process."""
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder, so that a lost executor costs no recompute.

    The folder is the one the cluster names in ``spark.checkpoint.dir``. Only where that is
    unset, as in local tests, a temporary folder is used.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if folder is None and context.getCheckpointDir() is None:
        _only_local(spark)
        context.setCheckpointDir(tempfile.mkdtemp(prefix="wavetable-checkpoint-"))
    elif folder is not None and context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return df.checkpoint()
