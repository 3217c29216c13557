"""Session settings and lineage cutting."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# AQE splits hot join keys at run time, which the lookup joins rely on.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # the first n rows per key are cut below the shuffle for every n
    "spark.sql.optimizer.windowGroupLimitThreshold": "2147483647",
    # rows of long texts go to Python workers in batches bounded by bytes, not by rows alone
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
    "spark.sql.session.timeZone": "UTC",
}
# shuffle files go when the action that wrote them ends, not when the driver happens to collect garbage
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app: str = "reeltide", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> SparkSession:
    """Apply the settings the operators count on to a session made elsewhere."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and staged tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session may fall back to a temporary folder.
    """
    conf = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    path = tempfile.mkdtemp(prefix="spark-ckpt-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def staging_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives lost executors and keeps iterative plans short. What was shuffled for it is deleted."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    kept = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # a plan of its own, as only it may lose its files
    finally:
        spark.conf.set(CLEANUP, kept)


def release(df: DataFrame) -> None:
    """Delete the checkpoint of a frame of :func:`cut_lineage` that nothing reads any more."""
    path = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if path.isDefined():
        folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path.get())
        folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)
