"""Shared helpers of the training-data operators: the shared work folder, materialised tables, sizes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark's own switch: the shuffle files of a query go when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Spark's bound of the bytes that go to a Python worker at once, and the one that these operators run under unless the session sets another.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 6 << 20
#: Used only where the session names no ``spark.checkpoint.dir`` and runs in one process, as in local tests.
_own: list[str] = []


def work_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.  A local one only for a local session that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not (spark.conf.get("spark.master", "") + "[").startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="llm-work-"))
    return _own[0]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: cuts lineage, survives lost executors.

    The write's own shuffle files are removed when it has ended; nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if spark.conf.get(BATCH) == "67108864b":  # Spark's own default; left set, because the operators' last steps run when their results are written
        spark.conf.set(BATCH, str(BATCH_BYTES))
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.work_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete the files of materialized ``tables`` that no later step reads."""
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(df.work_path)
        path.getFileSystem(conf).delete(path, True)


def partitions(spark: SparkSession) -> int:
    """The number of shuffle partitions that the session asks for; it is sized to the input by the caller."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def broadcast_if(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """``df`` marked for broadcast when its counted ``rows`` are at most ``limit``; else as it is, for a shuffle join."""
    return F.broadcast(df) if rows <= limit else df


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id (long) and the text of ``docs``, null texts as empty, whatever other columns there are."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
