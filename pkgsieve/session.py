"""Spark session helpers.

Cluster settings are read from the session; local defaults are only filled
in where a setting is unset (tests, bench).
"""
from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

LOCAL_DEFAULTS = {
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.memory": "16g",
}


def local_session(cpus: int | str = "*", app: str = "pkgsieve", **extra: str) -> SparkSession:
    """A local session for tests and the bench (never used on a cluster)."""
    b = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for k, v in {**LOCAL_DEFAULTS, **extra}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster that setting names a shared folder and is used as is; without
    it the executors would write to their own disks, so that is an error.  A
    local master (tests) gets a fresh scratch folder.
    """
    sc = spark.sparkContext
    cur = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if not cur:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        cur = tempfile.mkdtemp(prefix="pkgsieve-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(cur)
    return sc.getCheckpointDir()


_SHIPPED: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Make ``pkgsieve`` importable in Python workers (mapInArrow,
    applyInPandasWithState): zip the package once per application and
    register it with ``addPyFile``, which distributes it to every executor."""
    import hashlib
    import zipfile

    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    files = []
    for d, _, names in os.walk(pkg):
        if "__pycache__" in d:
            continue
        files += [os.path.join(d, n) for n in sorted(names) if n.endswith((".py", ".yml"))]
    digest = hashlib.sha1("".join(f + str(os.path.getmtime(f)) for f in files).encode()).hexdigest()[:12]
    ckpt = ensure_checkpoint_dir(spark)
    local = ckpt[len("file:"):] if ckpt.startswith("file:") else ckpt
    base = local if "://" not in local else tempfile.mkdtemp(prefix="pkgsieve-code-")
    os.makedirs(os.path.join(base, "pyfiles"), exist_ok=True)
    path = os.path.join(base, "pyfiles", f"pkgsieve-{digest}.zip")
    if not os.path.exists(path):
        tmp = path + f".{os.getpid()}.tmp"
        with zipfile.ZipFile(tmp, "w", zipfile.ZIP_DEFLATED) as z:
            for f in files:
                z.write(f, os.path.relpath(f, root))
        os.replace(tmp, path)
    sc.addPyFile(path)
    _SHIPPED.add(app)
