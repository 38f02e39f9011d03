"""Where tables between steps go: the folder that the cluster shares."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

KEY = "spark.checkpoint.dir"


def root(spark: SparkSession) -> str:
    """The cluster's shared folder, as the session names it.

    Where none is named, a session in one process (tests, a laptop) gets a folder of its own; on a
    cluster that is an error, as no folder of one machine is seen by all.
    """
    sc = spark.sparkContext
    found = sc.getConf().get(KEY) or spark.conf.get(KEY, None)
    if not found:
        own = sc._jsc.sc().getCheckpointDir()
        if own.isDefined():
            found = own.get()
        elif sc.master.split("[")[0] == "local":
            found = f"file:///tmp/tierflow-{os.getuid()}-{sc.applicationId}"
            sc.setCheckpointDir(found)
        else:
            raise RuntimeError(f"{KEY} must name a folder that the driver and all executors share")
    return found.rstrip("/")
