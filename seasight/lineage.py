"""Cutting the lineage of tables that loops build up."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def keep(df: DataFrame) -> DataFrame:
    """``df``, computed once and kept in ``spark.checkpoint.dir``, so that it survives the loss of executors.

    Where that is unset, a temporary folder does on a single machine; on a cluster it is an error.
    """
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        path = sc.getConf().get("spark.checkpoint.dir")
        if not path and sc.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="seasight-"))
    return df.checkpoint()
