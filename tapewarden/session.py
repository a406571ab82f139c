"""Session defaults for local runs; a cluster brings its own configuration."""

from __future__ import annotations

import shutil
import sys
import tempfile
from pathlib import Path

from pyspark import cloudpickle
from pyspark.sql import SparkSession


def local_session(name: str = "tapewarden", cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application; not needed where it is installed."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    # the archive only has to outlive this call: the driver copies it before serving it
    target = Path(tempfile.mkdtemp(prefix=f"{package.name}-")) / package.name
    sc.addPyFile(shutil.make_archive(str(target), "zip", package.parent, package.name))
    # the streaming state runner starts without the workers' path, so functions travel by value as well
    cloudpickle.register_pickle_by_value(sys.modules[__package__])
    _shipped.add(sc.applicationId)
