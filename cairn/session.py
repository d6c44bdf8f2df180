"""Session defaults, and sending this package to the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

#: Settings that a job of this library wants on a cluster; a caller may override each.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # State with timers, which the nonce guard keeps, needs this store.
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # Rows of documents are long: smaller Arrow batches bound the memory of a Python worker.
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
}

_sent: set[str] = set()


def build(name: str = "cairn", **settings: str) -> SparkSession:
    """A session whose executors know this package."""
    builder = SparkSession.builder.appName(name)
    for key, value in (DEFAULTS | settings).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Sends the package's sources to the executors, once an application, so that Python workers can import it anywhere."""
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    _sent.add(context.applicationId)
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="spark-ship-"), "cairn_sources.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    context.addPyFile(path)
