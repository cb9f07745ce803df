"""Sessions and the shared scratch folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(app: str = "fieldlead", cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "6g") -> SparkSession:
    """A local session for tests, the bench and the command line. Clusters bring their own."""
    spark = (
        SparkSession.builder.appName(app)
        .master(f"local[{cores}]")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares for checkpoints and tables of passage.

    It is the one in ``spark.checkpoint.dir``. Where that setting is absent, a session on one machine
    (tests) gets a temporary folder; on a cluster that is an error, as executors share no such folder.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get(CHECKPOINT_CONF, None) or context.getConf().get(CHECKPOINT_CONF, None)
        if not folder and not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError(f"{CHECKPOINT_CONF} must name a folder that the cluster shares")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="fieldlead-"))
    return context._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
