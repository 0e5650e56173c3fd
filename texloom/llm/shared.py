"""Places and helpers that all operators of this subpackage share."""

from __future__ import annotations

import contextlib
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors and the driver share.

    It is what the cluster names in spark.checkpoint.dir. Only where that is
    unset and the master is local does it make one of its own, as in tests.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="texloom-shared-")
    with contextlib.suppress(Exception):
        spark.conf.set("spark.checkpoint.dir", made)
    return made


#: Rows of an Arrow batch. Spark's own default bounds rows, not bytes, and holds each batch several times; texts are long.
BATCH_ROWS = 1000
#: Tables of the shared folder that are still there.
_written: dict[str, SparkSession] = {}


def small_batches(df: DataFrame) -> DataFrame:
    """df. Its session hands Python batches of at most ``BATCH_ROWS`` rows from now on, unless it has a setting of its own."""
    key, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    if conf.get(key) == "10000":
        conf.set(key, str(BATCH_ROWS))
    return df


def new_path(spark: SparkSession, what: str) -> str:
    """A fresh path for a table in the shared folder."""
    return f"{shared_dir(spark)}/texloom-{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame, what: str) -> DataFrame:
    """df, written once as Parquet to the shared folder and read back.

    This cuts the lineage: later steps survive the loss of any executor, since
    what they read isn't kept by executors. Shuffles that nothing refers to any
    more are let go of then.
    """
    spark, schema = df.sparkSession, df.schema
    path = new_path(spark, what)
    df.write.parquet(path)
    _written[path] = spark
    del df
    gc.collect()
    spark._jvm.System.gc()
    return spark.read.schema(schema).parquet(path)


def drop(table: DataFrame) -> None:
    """Deletes what ``cut`` wrote, when nothing reads it any more."""
    for file in table.inputFiles()[:1]:
        path = next((p for p in _written if f"/{p.rpartition('/')[2]}/" in file), None)
        if path:
            spark = _written.pop(path)
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def free_name(df: DataFrame, base: str) -> str:
    """A column name that df doesn't have, in any case."""
    taken = {c.lower() for c in df.columns}
    return next(x for k in range(len(taken) + 1) if (x := f"{base}{k or ''}").lower() not in taken)
