"""A local session for tests and the bench; on a cluster the session comes from outside."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

from rankmill.operators.storage import SPREAD


def local_session(name: str = "rankmill", cores: int | str = "*", memory: str = "6g", shuffle_partitions: int = 8) -> SparkSession:
    conf = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.driver.memory": memory,
        "spark.driver.bindAddress": "127.0.0.1",
        "spark.driver.host": "127.0.0.1",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        SPREAD: str(os.cpu_count() if cores == "*" else cores),  # the test tables are single files
    }
    spark = SparkSession.builder.master(f"local[{cores}]").appName(name).config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the package to the executors, once per application, so that workers can import it wherever they start."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    name = os.path.join(tempfile.mkdtemp(prefix="rankmill-"), "rankmill.zip")
    with zipfile.ZipFile(name, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(os.path.join(root, "rankmill")):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(name)  # the driver serves it to the executors
    _shipped.add(sc.applicationId)
