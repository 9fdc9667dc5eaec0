"""Session construction and the shared scratch location.

On a cluster the session is built by the platform; we only *read* its
settings.  ``local_session`` is for tests, the bench and ad-hoc runs.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings that make the plans behave the same on local[*] and on a cluster:
# AQE re-plans joins (size-checked broadcast), coalesces small shuffle
# partitions and splits skewed sort-merge-join partitions at runtime.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # stream state (open check-outs per tool) off the JVM heap
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "fleetkit") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("FLEETKIT_DRIVER_MEMORY", "8g"))
    )
    for k, v in SCALE_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder.

    The folder is read from ``spark.checkpoint.dir``.  Only when it is unset
    (local runs, tests) do we create one — under the system temp folder, which
    is acceptable only because local mode has a single machine.  Any other
    master without the setting is an error.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        d = tempfile.mkdtemp(prefix="fleetkit-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d


def shared_path(spark: SparkSession, name: str, unique: bool = True) -> str:
    """A path inside the shared checkpoint folder (never a machine-local dir
    on a cluster).  ``unique`` appends a random suffix so runs never collide."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    suffix = f"-{uuid.uuid4().hex[:12]}" if unique else ""
    return f"{base}/fleetkit/{name}{suffix}"


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``fleetkit`` importable in Python workers (what ``--py-files``
    does): the package is zipped in memory, written into the shared
    checkpoint folder through the Hadoop FileSystem API and added with
    ``addPyFile`` once per application.  Needed by operators whose Python
    functions run on executors (isolation forest, stateful sessions)."""
    import io
    import zipfile

    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(d, n)
                    z.write(full, os.path.join("fleetkit", os.path.relpath(full, root)))
    target = shared_path(spark, "pyfiles") + "/fleetkit.zip"
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(target)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(buf.getvalue()))
    out.close()
    sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)
