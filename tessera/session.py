"""Session helpers: the shared folder, and code for the executors."""

from __future__ import annotations

import atexit
import hashlib
import io
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

#: Bytes of one Arrow batch to or from a Python worker: bounds its memory for texts of any length
BATCH_BYTES = 8 << 20
_SHIPPED: set[str] = set()
_TABLES: list = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; only where that is unset and everything
    runs on one machine (tests) a temporary one, which is then also set on the context."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that the driver and the executors of {master} share")
        named = tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def share_file(spark: SparkSession, name: str, data: bytes) -> str:
    """Writes small ``data`` into the shared folder under a name made unique by its digest, and
    returns the full path; the same data are written once."""
    path = f"{shared_dir(spark)}/{hashlib.sha256(data).hexdigest()[:16]}/{name}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        out = fs.create(at, True)
        out.write(data)
        out.close()
    return fs.makeQualified(at).toString()


def scratch_path(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder; what is written there goes when the driver ends."""
    path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    _TABLES.append((jvm.org.apache.hadoop.fs.Path(path), spark.sparkContext._jsc.hadoopConfiguration()))
    return path


def saved(df: DataFrame) -> DataFrame:
    """``df`` written as a table into the shared folder and read from there: its lineage is cut, and
    lost executors take nothing of it with them. The tables go when the driver ends."""
    spark = df.sparkSession
    path = scratch_path(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _sweep() -> None:
    for at, conf in _TABLES:
        try:
            at.getFileSystem(conf).delete(at, True)
        except Exception:  # the JVM may be gone  # noqa: BLE001
            return


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once for each application, and bounds
    the Arrow batches to ``BATCH_BYTES``."""
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(limit).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(limit, str(BATCH_BYTES))
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root, buffer = os.path.dirname(os.path.abspath(__file__)), io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for d, _, names in sorted(os.walk(root)):
            for n in sorted(names):
                if n.endswith(".py"):
                    with open(os.path.join(d, n)) as f:
                        z.writestr(zipfile.ZipInfo(os.path.relpath(os.path.join(d, n), os.path.dirname(root))), f.read())
    spark.sparkContext.addPyFile(share_file(spark, "tessera_package.zip", buffer.getvalue()))
    _SHIPPED.add(app)
