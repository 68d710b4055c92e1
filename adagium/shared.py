"""Tables in the folder that the driver and all executors share, to cut a plan where it is used again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where it is unset, a session that runs in this one process (``local[...]``)
    gets a folder of its own; any other session has no folder that all its
    executors see, so this raises.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        import atexit
        import shutil
        import tempfile

        _OWN[app] = tempfile.mkdtemp(prefix="adagium-")
        atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
    return f"file://{_OWN[app]}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write the rows as Parquet to the shared folder and read them again."""
    path = f"{shared_dir(df.sparkSession)}/adagium-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
