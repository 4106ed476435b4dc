"""NDJSON: one flat JSON object per line.

A line is a record if it is an object with at least one entry that is null or a scalar; other lines are broken.  Nested
values read as null, blank lines are skipped, and the missing keys of a record are told from nulls by `__keys`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import types as K
from ..plans.query import POS
from ..plans.schema import TableSchema, check_name


def lines(spark: SparkSession, path: str) -> DataFrame:
    """value and POS, the order of lines; POS grows along the file without being consecutive."""
    df = spark.read.text(path)
    return df.withColumn(POS, F.monotonically_increasing_id()).where(F.trim("value") != "")


def _variant() -> Column:
    return F.try_parse_json("value")


def split(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records with value, __keys and POS; broken lines with value and POS)."""
    df = raw.withColumn("__keys", F.json_object_keys("value"))
    good = F.coalesce(F.size("__keys") > 0, F.lit(False)) & _variant().isNotNull()
    return df.where(good), df.where(~good).drop("__keys")


def check_names(records: DataFrame) -> None:
    """The keys of the first record must be names that a column can have: others were put there by foreign hands."""
    first = records.orderBy(POS).select("__keys").first()
    for name in first["__keys"] if first else ():
        check_name(name)


def typed(records: DataFrame, schema: TableSchema) -> DataFrame:
    """Columns of the schema in stored form, __keys and POS.

    A value of another type than its column's becomes null and its column is listed in __odd: a typed column cannot keep
    what does not belong to it.  Integers widen to floats.
    """
    v = _variant()
    cols, odd = [], []
    for c, kind in schema.columns.items():
        path = f"$['{c}']"
        found = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
        want = {"int": ["BIGINT"], "float": ["BIGINT", "DOUBLE", "DECIMAL"], "bool": ["BOOLEAN"]}.get(_json_kind(kind), ["STRING"])
        right = F.lit(False)
        for w in want:
            right = right | F.startswith(found, F.lit(w))
        value = F.try_variant_get(v, path, K.spark_type(kind).simpleString())
        cols.append(F.when(right, value).alias(c))
        odd.append(F.when(found.isNotNull() & (found != "VOID") & ~F.coalesce(right, F.lit(False)), F.lit(c)))
    return records.select(*cols, "__keys", F.filter(F.array(*odd), lambda x: x.isNotNull()).alias("__odd"), POS)


def _json_kind(kind: str) -> str:
    base = K.base_of(kind)
    return "int" if base in ("year", "month", "day") else base


def filled(df: DataFrame, schema: TableSchema) -> DataFrame:
    """Missing keys take their column's default; a null that is there stays null."""
    cols = []
    for c, kind in schema.columns.items():
        has, value = K.default_of(kind)
        missing = ~F.array_contains("__keys", c)
        cols.append((F.when(missing, F.lit(value).cast(K.spark_type(kind))).otherwise(F.col(c)) if has and value is not None else F.col(c)).alias(c))
    return df.select(*cols, POS)


def exported(df: DataFrame, schema: TableSchema) -> DataFrame:
    """`value`: one JSON object per row, keys in schema order, nulls written out."""
    return df.orderBy(POS).select(F.to_json(F.struct(*schema.columns), {"ignoreNullFields": "false"}).alias("value"))


def key_order_differs(records: DataFrame, schema: TableSchema) -> DataFrame:
    return records.where(F.col("__keys") != F.array(*[F.lit(c) for c in schema.columns]))
