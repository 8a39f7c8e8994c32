"""Session defaults. Cluster sizing stays with the cluster."""

from __future__ import annotations

import pathlib
import tempfile
import zipfile

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Recording a Python call site for each of hundreds of columns slows plan building.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def builder(app: str = "trackloom") -> SparkSession.Builder:
    made = SparkSession.builder.appName(app)
    for key, value in SETTINGS.items():
        made = made.config(key, value)
    return made


def local(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """Small session for tests and benches."""
    return (builder().master(f"local[{cores}]")
            .config("spark.sql.shuffle.partitions", str(partitions))
            .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
            .config("spark.driver.memory", memory)
            .config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false")
            .config("spark.log.level", "ERROR")
            .getOrCreate())


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per Spark application."""
    context = spark.sparkContext
    if getattr(context, "_trackloom_shipped", False):
        return
    root = pathlib.Path(__file__).resolve().parent
    archive = pathlib.Path(tempfile.mkdtemp(prefix="trackloom-")) / "trackloom.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, pathlib.Path(root.name) / source.relative_to(root))
    context.addPyFile(str(archive))
    context._trackloom_shipped = True
