"""Parquet tables by path.  Reading a footer to learn the schema is a job of its own; a file that has not changed keeps its."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_SCHEMAS: dict[tuple[str, int, int], StructType] = {}


def parquet(spark: SparkSession, path: str) -> DataFrame:
    """The table at a path.  Its schema is read once for each size and time of change of the file or folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    status = p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p)
    key = (path, status.getLen(), status.getModificationTime())
    if key not in _SCHEMAS:
        _SCHEMAS[key] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[key]).parquet(path)
