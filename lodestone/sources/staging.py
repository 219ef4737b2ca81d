"""Intermediate tables that later steps read instead of computing them again."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def staged(df: DataFrame) -> DataFrame:
    """``df`` computed once into the session's shared checkpoint folder (a temporary one only on one machine that names none).

    Rule programs are long: a plan that repeats one several times takes longer to optimise than to run.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            named = tempfile.mkdtemp(prefix="lodestone-stage-")
        spark.sparkContext.setCheckpointDir(named)
    return df.checkpoint(eager=True)
