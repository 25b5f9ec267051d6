"""Session helpers: a local session for tests and benches, and the shared
folder used to cut lineage (``spark.checkpoint.dir``)."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "tallyfs") -> SparkSession:
    """A local session configured like a small cluster (AQE on, skew join on).

    On a real cluster the caller's session is used as is; this helper is for
    tests and ``bench.py`` only.
    """
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared folder for lineage cuts.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session
    (tests, bench) without it gets a fresh temporary folder; on a cluster a
    machine-local folder would not be shared, so its absence is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get(CHECKPOINT_CONF, None) \
        or sc.getConf().get(CHECKPOINT_CONF, None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return sc.getCheckpointDir() or current
    if not sc.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder all executors share")
    local = tempfile.mkdtemp(prefix="tallyfs-ckpt-")
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir() or local


_SCRATCH: list[str] = []  # folders made by this process


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique sub-folder of the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/{name}-{uuid.uuid4().hex[:12]}"
    _SCRATCH.append(path)
    return path


def clean_scratch(spark: SparkSession) -> int:
    """Delete the scratch folders this process made; returns how many there
    were. Only when no result that still reads them is needed any more."""
    jvm, n = spark.sparkContext._jvm, 0
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while _SCRATCH:
        path = jvm.org.apache.hadoop.fs.Path(_SCRATCH.pop())
        n += bool(path.getFileSystem(conf).delete(path, True))
    return n


def _strip_scheme(path: str) -> str:
    return path[len("file:"):] if path.startswith("file:") else path


def local_fs_path(path: str) -> str:
    """Drop a ``file:`` scheme so Python code on executors can open it."""
    return os.path.normpath(_strip_scheme(path))


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``tallyfs`` importable in executor Python workers.

    Functions passed to ``mapInPandas`` / ``applyInPandas`` are unpickled
    there by module name, so the package is zipped once per process and
    handed to ``SparkContext.addPyFile`` (what ``--py-files`` does); Spark
    distributes it to every executor.
    """
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    import zipfile

    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="tallyfs-pkg-"), "tallyfs.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as zf:
        for base, _dirs, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(base, f)
                    zf.write(full, os.path.relpath(full, os.path.dirname(pkg_dir)))
    sc.addPyFile(out)
    _SHIPPED.add(key)
