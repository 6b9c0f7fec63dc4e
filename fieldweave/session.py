"""Session set-up: settings that suit the engine, and the package itself for executors that do not have it installed."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Settings for scale. AQE re-plans partitions and skewed joins at run time; Arrow feeds the few Python kernels; UTC fixes what timestamps mean.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.filterPushdown": "true",
}

#: Arrow batches by bytes as well as rows: whole texts are long, and a batch is held by the JVM and by Python at once.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}

_SHIPPED: set[str] = set()


def session(name: str = "fieldweave", **more: str) -> SparkSession:
    return ship(SparkSession.builder.appName(name).config(map=SETTINGS | more).getOrCreate())


def ship(spark: SparkSession) -> SparkSession:
    """Give the executors' Python this package, once per application. Spark serves the archive from the driver, so no shared folder is needed."""
    sc = spark.sparkContext
    for name, value in BATCHES.items():
        if spark.conf.isModifiable(name):
            spark.conf.set(name, value)
    if sc.applicationId not in _SHIPPED:
        _SHIPPED.add(sc.applicationId)
        root = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="fieldweave-")) / "fieldweave.zip"
        with zipfile.ZipFile(target, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, f"{root.name}/{p.relative_to(root)}")
        sc.addPyFile(str(target))
    return spark
