"""Session, shipping and lineage helpers shared by every operator."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent.parent


def build_session(app: str = "lexweave", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the plans are written for; a cluster passes its own master and sizes."""
    os.environ["PYTHONPATH"] = os.pathsep.join(dict.fromkeys([str(ROOT), *filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep))]))
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for k, v in (base | {k.replace("__", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make the package importable in Python workers.

    Nothing is done where the JVM was started with the repository on PYTHONPATH; else the package goes out once
    per application as a zip, served by the driver.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    env = sc._jvm.System.getenv("PYTHONPATH") or ""
    if str(ROOT) in (str(Path(p).resolve()) for p in env.split(os.pathsep) if p):
        return
    out = Path(tempfile.mkdtemp(prefix="lexweave-")) / "lexweave.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted((ROOT / "lexweave").rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
    sc.addPyFile(str(out))


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; one of our own only where the session names none and runs locally."""
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d:
        return d.rstrip("/")
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder all machines share")
        sc.setCheckpointDir(Path(tempfile.mkdtemp(prefix="lexweave-")).as_uri())
    return sc.getCheckpointDir().rstrip("/")


_written: list[str] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new name in the shared folder; what is written there is deleted by release() or clear_written()."""
    path = f"{shared_dir(spark)}/lexweave/{label}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def delete_at_exit(spark: SparkSession, path: str) -> None:
    """Delete what stands at a path when the application ends, if nothing has deleted it before."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)


#: Spark deletes the shuffle files of a query as soon as it has ended; else they stay until the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write a frame to the shared folder and read it again: cuts lineage, survives lost executors, prunes columns.

    Nothing else reads the shuffle files of the write, so they are deleted with its end.
    """
    path = scratch_path(df.sparkSession, label)
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)
    delete_at_exit(df.sparkSession, path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._lexweave_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    if path in _written:
        _written.remove(path)


def release(*frames: DataFrame) -> None:
    """Delete what materialize() wrote, once nothing reads it any more."""
    for df in frames:
        if path := getattr(df, "_lexweave_path", None):
            _delete(df.sparkSession, path)


def clear_written(spark: SparkSession) -> None:
    """Delete all that is left of this session's written tables, once its results have been consumed."""
    for path in list(_written):
        _delete(spark, path)
