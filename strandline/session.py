"""Session helpers: table access and lineage cuts in the shared checkpoint folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: The folder of this process below each checkpoint folder; removed at its end.
_RUN = f"strandline-{uuid.uuid4().hex}"
_USED: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_root(spark: SparkSession) -> str:
    """This process's folder in the one that spark.checkpoint.dir names; a temporary one where that is unset in local mode.

    On a cluster the setting is needed: executors on other hosts would write to a folder of their own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all hosts share")
        root = tempfile.mkdtemp(prefix="strandline-checkpoint-")
        spark.sparkContext.setCheckpointDir(root)
    path = f"{root.rstrip('/')}/{_RUN}"
    if path not in _USED:
        _USED.add(path)
        atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    except Exception:  # the session has ended before: what it wrote stays in the run's checkpoint folder
        pass


def materialize(df: DataFrame, tag: str = "stage") -> DataFrame:
    """Write ``df`` once as Parquet under the shared checkpoint folder and read it back.

    It cuts the lineage as ``checkpoint()`` does, but columnar and compressed. The files survive the loss of any
    executor, and go when the process ends.
    """
    path = f"{checkpoint_root(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
