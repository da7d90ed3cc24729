"""Stored intermediate tables: what several queries read is written once and read again.

Tables are Parquet in the folder that spark.checkpoint.dir names, which the driver and all executors
share. A stored table also cuts the plan that made it, and outlives lost executors.
"""

from __future__ import annotations

import atexit
import hashlib
import shutil
import tempfile
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder, in local mode only."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not getattr(spark.sparkContext, "_gristmill_folder", None):
        path = tempfile.mkdtemp(prefix="gristmill-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        spark.sparkContext._gristmill_folder = f"file://{path}"
    return spark.sparkContext._gristmill_folder


def place(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared folder; what is written there goes when the program ends."""
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    if not hasattr(spark.sparkContext, "_gristmill_stored"):
        spark.sparkContext._gristmill_stored = []
        atexit.register(_dropped, spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._gristmill_stored)
    spark.sparkContext._gristmill_stored.append(path)
    return path


def stored(df: DataFrame) -> DataFrame:
    """df written out and read again."""
    path = place(df.sparkSession, "stored")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _dropped(jvm, conf, paths: list[str]) -> None:
    """Delete tables of an ended program; where its JVM is gone already, they stay."""
    for path in paths:
        try:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)
        except (Py4JError, OSError):
            return


#: Up to so many input files are asked for their sizes and times one by one; of more, their folders are asked.
ASKED = 256


def version(df: DataFrame) -> tuple:
    """The files under df with their sizes and times, so that a changed input is not taken for the same.

    Of more than ASKED files, their names count, and each folder's time, total size and number of files.
    """
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession._jsc.hadoopConfiguration()
    names, found = sorted(df.inputFiles()), []
    many = len(names) > ASKED
    for name in sorted({x.rpartition("/")[0] for x in names}) if many else names:
        path = jvm.org.apache.hadoop.fs.Path(name)
        system = path.getFileSystem(conf)
        status = system.getFileStatus(path)
        found.append((name, system.getContentSummary(path).getLength() if many else status.getLen(), status.getModificationTime()))
    return tuple(found), hashlib.sha256("\n".join(names).encode()).hexdigest()


def once(inputs: list[DataFrame], name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table of that name over these inputs' files: built and stored at first, read afterwards."""
    context = inputs[0].sparkSession.sparkContext
    if not hasattr(context, "_gristmill_tables"):
        context._gristmill_tables = {}
    key = name, tuple(version(df) for df in inputs)
    if key not in context._gristmill_tables:
        context._gristmill_tables[key] = stored(build())
    return context._gristmill_tables[key]


#: A table of at most this many small rows is broadcast; beyond it Spark shuffles both sides.
FEW_ROWS = 500_000


def few(table: DataFrame, most: int = FEW_ROWS) -> DataFrame:
    """The table, marked for broadcast where a count shows that it is small."""
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table


def numbered(rows: DataFrame, *order: Column, name: str = "ord") -> DataFrame:
    """rows numbered from 1 in an order: ranges are sorted apart and their counts, one a range, added up."""
    ranges = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_range", F.spark_partition_id())
    ranges, at, before = stored(ranges), 0, []
    for x in ranges.groupBy("_range").count().orderBy("_range").collect():
        before.append((x["_range"], at))
        at += x["count"]
    table = rows.sparkSession.createDataFrame(before, "_range int, _before long")
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) + F.col("_before")
    return ranges.join(F.broadcast(table), "_range").withColumn(name, place).drop("_range", "_before")
