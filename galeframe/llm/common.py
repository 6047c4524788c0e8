"""Reading tables, shared storage and columns that every operator of the subpackage uses."""

from __future__ import annotations

import re
import tempfile
import uuid
import zlib

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, through Spark's reader only."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset
    (tests on a local master) a folder of this machine is used.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            named = tempfile.mkdtemp(prefix="spark-checkpoints-")
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder; a lost executor loses none of it."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def counted(df: DataFrame, **aggregates) -> tuple[DataFrame, dict]:
    """``df`` settled, and aggregates of its rows, observed by the tasks that settle it: no further pass."""
    seen = Observation()
    return settled(df.observe(seen, *(value.alias(name) for name, value in aggregates.items()))), seen.get


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again."""
    path = f"{shared_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


#: Rows of ids that are broadcast at most, about 32 MB as a hash table of a task; more are shuffled.
MOST_IDS = 1_000_000
#: Rows, and bytes, of texts that are handed to Python at once.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches, so that the memory of a Python worker is bounded by :data:`BATCH_BYTES`, not by 10,000 texts."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        now = re.match("[0-9]+$", spark.conf.get(name) or "")
        if now is None or not 0 < int(now[0]) <= most:
            spark.conf.set(name, str(most))


def own_columns(df: DataFrame):
    """All columns of ``df``, whatever their names."""
    return [F.col(f"`{c}`") for c in df.columns]


def fresh_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = "_" + name
    return name


def without_keys(docs: DataFrame, key, gone: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose ``key`` (an expression) is not in the one column of ``gone``, with the columns of ``docs``.

    Only keys move while there are at most :data:`MOST_IDS` of them, counted;
    beyond, both sides are shuffled. A null key is in no set, so its row stays.
    """
    name = fresh_name(docs, "gone_key")
    gone = settled(gone.toDF(name).distinct())
    if gone.count() <= MOST_IDS:
        gone = F.broadcast(gone)
    return docs.join(gone, key == F.col(name), "left_anti").select(own_columns(docs))


def fold(id_column, n: int):
    """crc32 of the id as text, modulo ``n``; -1 for a null id."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % n, F.lit(-1)).cast("int")


def fold_of(value, n: int) -> int:
    """The same as :func:`fold`, for one Python value."""
    return -1 if value is None else zlib.crc32(str(int(value)).encode()) % n
