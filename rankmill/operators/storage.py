"""Tables shared by all executors: the durable cut points of a long plan.

Lineage is cut only through files in the folder that the session names in
``spark.checkpoint.dir``; losing an executor then costs a re-read, never the data.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Only a session on one machine may leave it unset and gets a folder of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    set_before = spark.sparkContext._jsc.sc().getCheckpointDir()
    if set_before.isDefined():
        return set_before.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="rankmill-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def own_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_dir(spark)}/rankmill-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{own_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def clean(spark: SparkSession) -> None:
    """Remove every table that this application's operators wrote to the shared folder. Results that are still lazy can't be read afterwards."""
    path = spark._jvm.org.apache.hadoop.fs.Path(own_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, tag: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of what was written."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Session setting: partitions that ``spread`` makes. Unset on a cluster.
SPREAD = "spark.rankmill.spread"


def spread(df: DataFrame) -> DataFrame:
    """``df`` over as many partitions as the session asks for in SPREAD, before costly work per row; as it is where that is unset.

    For tables of a single file on one machine, whose scan is one task. The plan depends on
    the setting alone, never on the input's size.
    """
    wanted = df.sparkSession.conf.get(SPREAD, None)
    return df if wanted is None or df.isStreaming else df.repartition(int(wanted))
