"""Sessions: local ones for tests, and this package on the executors."""

from __future__ import annotations

import functools
import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_shipped: set[str] = set()
#: Arrow batches handed to Python hold about so many bytes, whatever the rows'
#: length; a longer row stands alone.
BATCH_BYTES = 8_000_000


def ship(spark: SparkSession) -> None:
    """Sends the package's sources to the session's Python workers, once.

    Not needed where they can import it already (installed, or on PYTHONPATH
    when the session began).
    """
    context = spark.sparkContext
    if context.applicationId in _shipped or ROOT in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(os.path.join(ROOT, "siltstone")):
            for f in sorted(files):
                if f.endswith(".py"):
                    path = os.path.join(folder, f)
                    z.write(path, os.path.relpath(path, ROOT))
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        shared_dir(spark)  # refuses a cluster
    if root:  # the folder that all machines share
        name = context._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/siltstone-{context.applicationId}.zip")
        out = name.getFileSystem(context._jsc.hadoopConfiguration()).create(name, True)
        out.write(held.getvalue())
        out.close()
        path = name.toString()
    else:
        path = os.path.join(tempfile.mkdtemp(prefix="siltstone-"), "siltstone.zip")
        with open(path, "wb") as f:
            f.write(held.getvalue())
    context.addPyFile(path)
    _shipped.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder in the cluster's checkpoint directory.

    The setting is read from the session.  Only where it is unset and all runs
    on this machine, as in tests, is a folder of this machine used; a cluster
    without the setting is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "siltstone-checkpoints")
    return f"{root.rstrip('/')}/siltstone-{uuid.uuid4().hex}"


def lasting_dir(spark: SparkSession) -> str:
    """The same, deleted when the application ends."""
    path = shared_dir(spark)
    name = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    name.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(name)
    return path


def tuned(spark: SparkSession) -> SparkSession:
    """Bounds the bytes of an Arrow batch, unless the session has its own bound."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key, str(2**31 - 1))) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
    return spark


def spread(rows: DataFrame) -> DataFrame:
    """A table in fewer pieces than there are cores, dealt out to all of them.

    For work on texts, which costs far more than moving them.  Tables in as
    many pieces or more, all large ones, stay as they are.  What Python gets of
    the texts is bounded too.
    """
    cores = tuned(rows.sparkSession).sparkContext.defaultParallelism
    return rows if rows._jdf.queryExecution().toRdd().getNumPartitions() >= cores else rows.repartition(cores)


def with_package(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(run)
    def wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return run(spark, sf_dir)

    return wrapped


def local(cores: str = "8", name: str = "siltstone", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
    } | conf
    for k, v in settings.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
