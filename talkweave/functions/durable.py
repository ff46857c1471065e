"""Cutting lineage where every executor can read it again."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, Row


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` written once to the folder of checkpoints, so that later jobs read it instead of making it anew.

    The folder is the one the session names in spark.checkpoint.dir.  Where none is named a temporary
    folder is used in local mode, as in tests; on a cluster that is an error, as a folder of one
    machine is lost with it.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="talkweave"))
    return df.checkpoint()


def small(df: DataFrame, bound: int) -> list[Row]:
    """The rows of a table that is small by its nature; an error if it has more than `bound` rows."""
    rows = df.limit(bound + 1).collect()
    if len(rows) > bound:
        raise ValueError(f"a table taken to the driver has more than {bound} rows")
    return rows


def once(udf):
    """A user-defined function that is not computed again for each filter and column that uses its result.

    A filter on the result would otherwise be moved below it with a call of its own.
    """
    return udf.asNondeterministic()
