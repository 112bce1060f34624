"""Cuts a plan where what precedes it is read more than once."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder of the session and read back.

    The folder is the one in ``spark.checkpoint.dir``; where that is unset and all runs on one machine, as in tests,
    a temporary folder is used, and elsewhere an error raised.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp"))
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
