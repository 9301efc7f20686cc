"""Reading transactions: CSV files, named tables, SQL text, other databases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salesprism.sources.schema import RAW_SCHEMA

BAD_RECORD = "_corrupt_record"


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType = RAW_SCHEMA, multi_line: bool = False,
) -> DataFrame:
    """Raw CSV as text columns, matched to the header by name; inference reads no data.

    The columns of ``schema`` come first, in its order and null where the file
    lacks them; further columns of the file follow. Broken records keep their
    text in ``_corrupt_record``. ``multi_line`` allows line breaks inside
    quotes; such a file cannot be split among tasks. All files under ``path``
    share one header.
    """
    header = csv_schema(spark, path, multi_line)
    found = {f.name.strip().lower(): f.name for f in reversed(header.fields)}
    full = T.StructType(header.fields + [T.StructField(BAD_RECORD, T.StringType())])
    rows = (
        _csv(spark, multi_line)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", BAD_RECORD)
        .schema(full)
        .csv(path)
    )

    def named(field: T.StructField) -> Column:
        own = found.get(field.name.lower())
        value = F.col(f"`{own}`") if own else F.lit(None)
        return value.cast(field.dataType).alias(field.name)

    used = {found.get(f.name.lower()) for f in schema.fields}
    more = [F.col(f"`{f.name}`") for f in header.fields if f.name not in used]
    return rows.select(*map(named, schema.fields), *more, BAD_RECORD)


def _csv(spark: SparkSession, multi_line: bool) -> DataFrameReader:
    return spark.read.options(header=True, quote='"', escape='"', multiLine=multi_line)


def csv_schema(spark: SparkSession, path: str, multi_line: bool = False) -> T.StructType:
    """The header of a CSV file as an all-text schema."""
    return _csv(spark, multi_line).option("inferSchema", False).csv(path).schema


def read_table(spark: SparkSession, source: str) -> DataFrame:
    """A table name, or a SQL text starting with SELECT or WITH."""
    word = source.lstrip().split(None, 1)[0].lower()
    return spark.sql(source) if word in ("select", "with") else spark.table(source)


def read_database(
    spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int, **options: str
) -> DataFrame:
    """An outside database table, read in ``parts`` ranges of a numeric key."""
    return (
        spark.read.format("jdbc")
        .options(url=url, dbtable=table, partitionColumn=key, lowerBound=str(low),
                 upperBound=str(high), numPartitions=str(parts), **options)
        .load()
    )


def preview(df: DataFrame, rows: int = 100, order: Sequence[str] = ()) -> DataFrame:
    """The first rows a person looks at: by ``order``, so that they are the same each time, or any at all."""
    return df.orderBy(*order).limit(rows) if order else df.limit(rows)


def shape(df: DataFrame) -> DataFrame:
    """Row and column count as one row."""
    return df.agg(F.count(F.lit(1)).alias("rows")).withColumn("columns", F.lit(len(df.columns)))
