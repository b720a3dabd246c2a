"""Intermediate tables that several later steps read."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def staged(df: DataFrame) -> DataFrame:
    """``df`` computed once, in the folder that ``spark.checkpoint.dir`` names.

    Where it is unset a temporary folder will do only if driver and executors are one process, as in tests.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or "file://" + tempfile.mkdtemp(prefix="quay-"))
    return df.checkpoint()
