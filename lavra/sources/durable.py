"""Cutting lineage so that a lost executor costs a re-read, not a re-run.

``spark.checkpoint.dir`` names the folder that all executors share. Only a
session whose executors are threads of this process may go without it (tests, a
notebook): there a folder of this machine is shared by all.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; without one, a folder of this machine in a local session, an error on a cluster."""
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="spark-lavra-")
    context.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """``df`` as reliably stored rows, without the plan that made them."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
