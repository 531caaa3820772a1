"""Session helpers: a local session for tests and benches, and the checkpoint folder rule."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "concord") -> SparkSession:
    """A local[*] session tuned for tests and the bench (UI off, AQE on, UTC)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.python.worker.reuse", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ensure_importable(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, taking it from the session.

    On a cluster the folder must be shared storage named by ``spark.checkpoint.dir``;
    we never invent a machine-local one there.  Only a local-mode session without a
    setting (tests, the bench) gets a fresh scratch folder of its own.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = sc.getConf().get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir()
    if sc.master.startswith("local"):
        scratch = tempfile.mkdtemp(prefix="concord-ckpt-", dir=os.environ.get("CONCORD_SCRATCH", "/tmp"))
        sc.setCheckpointDir(scratch)
        return sc.getCheckpointDir()
    raise RuntimeError(
        "spark.checkpoint.dir is not set; the ADMM loop cuts lineage with reliable "
        "checkpoints, so point it at shared storage (HDFS, S3, ...)"
    )


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name for intermediate tables under ``spark.checkpoint.dir`` (only a
    local session without that setting gets a folder of its own)."""
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None) or ensure_checkpoint_dir(spark)
    return f"{base}/{name}-{uuid.uuid4().hex}"


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder written by this library, through Spark's file system layer."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


_SHIPPED: set[str] = set()


def ensure_importable(spark: SparkSession) -> None:
    """Ship this package to the Python workers once per SparkContext.

    Grouped-map functions defined in this package are pickled by reference, so the
    workers must be able to import ``concord``.  Installed clusters already can; this
    zips the source next to the driver and adds it with ``addPyFile`` otherwise.
    """
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    import shutil

    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    out_dir = tempfile.mkdtemp(prefix="concord-pkg-", dir=os.environ.get("CONCORD_SCRATCH", None))
    archive = shutil.make_archive(os.path.join(out_dir, "concord"), "zip",
                                  root_dir=os.path.dirname(pkg_dir), base_dir="concord")
    sc.addPyFile(archive)
    _SHIPPED.add(key)
