"""Session settings the engine relies on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

REQUIRED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def local_session(cores: int | str = 8, app: str = "palimpsa") -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    settings = dict(REQUIRED)
    settings["spark.sql.shuffle.partitions"] = "8"
    settings["spark.driver.memory"] = "8g"
    settings["spark.ui.enabled"] = "false"
    settings["spark.python.sql.dataFrameDebugging.enabled"] = "false"
    settings["spark.driver.extraJavaOptions"] = "-Xss8m"
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_fallback: list[str] = []


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster; a temporary one only on a single machine where none is set."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _fallback:
        _fallback.append(tempfile.mkdtemp(prefix="palimpsa-checkpoint-"))
    return _fallback[0]


def written(frame: DataFrame, name: str) -> DataFrame:
    """A step as files of the shared folder, read back: what is drawn or numbered in it is fixed from here on."""
    path = f"{checkpoint_dir(frame.sparkSession).rstrip('/')}/palimpsa-{name}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    jvm = frame.sparkSession.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(frame.sparkSession.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
