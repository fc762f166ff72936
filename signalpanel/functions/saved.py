"""Frames written to the shared checkpoint folder, so that a plan that goes on from them is short and a lost executor costs a reread."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def saved(df: DataFrame) -> DataFrame:
    """The rows of df; the folder is the one that the cluster names, a local one only where none is set, as in tests."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="study-"))
    return df.checkpoint(eager=True)
