"""Session settings every job relies on."""

from __future__ import annotations

import re
import tempfile

import turnloom
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

# Settings that change results, so jobs pin them.
PINNED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.variant.allowDuplicateKeys": "true",  # the last of two equal keys wins
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Pin the runtime settings; safe to call on a session someone else created."""
    for key, value in PINNED.items():
        spark.conf.set(key, value)
    # Tasks carry the package's functions with them, so workers need no installed copy.
    cloudpickle.register_pickle_by_value(turnloom)
    return spark


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder; survives the loss of executors."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(df.sparkSession) + "/checkpoints")
    return df.checkpoint()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach.

    A cluster names it in ``spark.checkpoint.dir``; without it a job on a cluster stops here. Only a local session, whose
    tasks all run on this machine, gets a fresh local folder, which is remembered in the session.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="run-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")
