"""Session helpers: shipping the package and finding the shared folder."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once an application.

    The archive lies in the shared folder; executors need no shared installation.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    path = sc._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/mergeloom-{uuid.uuid4().hex}.zip")
    out = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path)
    out.write(data.getvalue())
    out.close()
    sc.addPyFile(path.toString())
    _drop_at_exit(sc, path.toString())
    _SHIPPED.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it.

    Only where ``spark.checkpoint.dir`` is unset (a local session, as in tests)
    is one made and set.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc._conf.get("spark.checkpoint.dir")
    if named:
        if not sc._jsc.sc().getCheckpointDir().isDefined():
            sc.setCheckpointDir(named)
        return _qualified(sc, named)
    at = sc._jsc.sc().getCheckpointDir()
    if at.isDefined():
        return _qualified(sc, at.get())
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="mergeloom-checkpoints-")
    sc.setCheckpointDir(made)
    return _qualified(sc, made)


def _qualified(sc, folder: str) -> str:
    """With the scheme of the file system that Hadoop would take for it."""
    path = sc._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(path).toString()


def _drop_at_exit(sc, path: str) -> None:
    path = sc._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(path)


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: cuts lineage, survives lost executors.

    Results may still read the tables, so they go when the driver's JVM ends.
    """
    path = f"{shared_dir(spark).rstrip('/')}/mergeloom-{uuid.uuid4().hex}-{name}"
    df.write.parquet(path)
    _drop_at_exit(spark.sparkContext, path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """A scan of few splits, dealt over all cores; scans that have enough are left alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def parallelism(spark: SparkSession) -> int:
    """Tasks that run at once: what a pool's number of threads would be."""
    return spark.sparkContext.defaultParallelism
