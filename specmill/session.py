"""Session helpers: local sessions for tests, frames written once to the shared folder, checked broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The most bytes of rows that a side of a join may have to be broadcast. The driver holds several times as much for each: the
#: rows as they are collected, the hash table of about twice their bytes, and its blocks; and several at once.
MAX_BROADCAST_BYTES = 8 << 20
_SCOPES: list[list[str]] = []


def local_session(cores: int | str = 8, memory: str = "8g", shuffle_partitions: int = 8) -> SparkSession:
    """A local session as used by the tests and the bench."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("specmill")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the checkpoint folder set already, or the one named in
    spark.checkpoint.dir. Only a local session without either gets a temporary folder; on a cluster that is an error."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = os.path.join(tempfile.gettempdir(), "specmill-checkpoints")
    sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Write a frame once, as compressed Parquet in the shared folder, and read it from there.

    This cuts its lineage, lets later reads take only the columns they need, and survives lost executors. Names of
    columns don't matter: they are put back after reading. The files are removed when the application ends, or with
    the scope of frames_removed()."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/frame-{uuid.uuid4().hex}"
    plain = [f"c{i}" for i in range(len(df.columns))]
    df.toDF(*plain).write.option("compression", "zstd").parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    for scope in _SCOPES[-1:]:
        scope.append(path)
    schema = T.StructType([T.StructField(p, f.dataType, True) for p, f in zip(plain, df.schema.fields)])
    return spark.read.schema(schema).parquet(path).toDF(*df.columns)


@contextmanager
def frames_removed(spark: SparkSession) -> Iterator[None]:
    """Remove the frames that cut() writes within this scope at its end; for jobs that run for long, as streams do."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def broadcast_if_small(df: DataFrame, max_rows: int, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Mark a written frame for broadcast only if it has at most max_rows rows and max_bytes bytes.

    Beyond either bound the frame is returned unmarked, so that the join shuffles. The frame should have been
    cut() before, because its rows and the lengths of its texts are read here. Nested columns aren't measured, so
    frames with such are never marked."""
    if any(isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType)) for f in df.schema):
        return df
    texts = [F.coalesce(F.octet_length(c), F.lit(0)) for c, f in zip(df.columns, df.schema.fields) if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    width = sum(texts, F.lit(16 * (len(df.columns) + 1)))
    rows, size = df.select(F.count("*"), F.coalesce(F.sum(width.cast("long")), F.lit(0))).first()
    return F.broadcast(df) if rows <= max_rows and size <= max_bytes else df


def broadcast_or_merge(df: DataFrame, max_rows: int, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """As broadcast_if_small, but beyond either bound the join is a merge join.

    The planner takes a written frame, and what is made of it, to be as small as its compressed file, so it broadcasts
    unmarked ones that are many times as large as its threshold."""
    small = broadcast_if_small(df, max_rows, max_bytes)
    return df.hint("merge") if small is df else small
