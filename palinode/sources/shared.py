"""Reading of named tables and intermediate tables that survive the loss of an executor."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_WRITTEN: list[str] = []


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of ``folder``, a parquet file or a folder of them."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out over all cores if it is read in fewer pieces than there are cores, such as one file of one row group.

    Work on long texts costs far more than moving them then; a table of many pieces is left as it is and nothing is shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. Where the session names none an own one serves a local master; on a cluster,
    where each executor would write to its own disk, that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[[\d*, ]+\])?", master):
        raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
    key = spark.sparkContext.applicationId
    if key not in _OWN:
        _OWN[key] = tempfile.mkdtemp(prefix="palinode-")
    return _OWN[key]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone already
        pass


def forget(spark: SparkSession) -> int:
    """Remove the intermediate tables written so far and tell how many; results that were not read yet can't be read after."""
    gone = len(_WRITTEN)
    while _WRITTEN:
        _remove(spark, _WRITTEN.pop())
    return gone


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` into the shared folder and read it back: the lineage is cut and the rows outlive any executor.

    With ``by``, a column of few values, a reader that asks for some of them reads only theirs."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/palinode-{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    if not _WRITTEN:
        atexit.register(forget, spark)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)
