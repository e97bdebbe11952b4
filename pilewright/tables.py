"""Small helpers shared by all operators: table access, free column names, checkpoints."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, base: str) -> str:
    """``base``, with underscores before it until no column of ``df`` has that name (any case)."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name = "_" + name
    return name


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared ``spark.checkpoint.dir``; a local folder only in local mode, where it is unset.

    On a cluster without that setting this raises: a machine-local folder would be lost with its machine.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set")
        shared = os.path.join(tempfile.gettempdir(), f"pilewright-checkpoints-{os.getuid()}")
    sc.setCheckpointDir(shared)


#: Estimates of a plan's size of more bits than this stand for none: Spark multiplies them at every join.
ESTIMATE_BITS = 62


def checkpointed(df: DataFrame, eager: bool = True) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint.

    Spark keeps the estimated size of what was checkpointed. In a loop of joins over checkpoints the product of the estimates has
    three times as many digits after every turn, until the number alone fills the driver; an estimate beyond any table
    is therefore dropped with the lineage.
    """
    ensure_checkpoint_dir(df.sparkSession)
    out = df.checkpoint(eager=eager)
    plan = out._jdf.queryExecution().optimizedPlan()
    if plan.stats().sizeInBytes().bit_length() <= ESTIMATE_BITS:
        return out
    session = out.sparkSession
    return DataFrame(session._jsparkSession.internalCreateDataFrame(out._jdf.logicalPlan().rdd(), out._jdf.schema(), False), session)
