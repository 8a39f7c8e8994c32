"""Small helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.plans.scratch import materialize, new_path
from trackloom.session import ship

__all__ = ["keyed", "discard", "materialize", "new_path", "partition_id", "ship", "whole"]

ROW = "_row"


def keyed(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns and a row number that tells repeated rows apart. Rows of one read keep their
    number when a lost task runs again; write the frame before using the number in two branches."""
    return df.select(*columns).withColumn(ROW, F.monotonically_increasing_id())


def partition_id() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def whole(df: DataFrame) -> Column:
    """All columns in one, so that none clashes with an operator's own."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_doc")


def discard(written: DataFrame) -> None:
    """Delete the files of a frame that `materialize` made; nothing may read it, or what it was read into, any more."""
    spark = written.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in written.inputFiles()}:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
