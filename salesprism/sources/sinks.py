"""Writing tables, summaries, reports and text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def write_transactions(
    df: DataFrame,
    path: str,
    partition_by: str = "order_year",
    cluster_by: Sequence[str] = ("category",),
    max_rows_per_file: int = 20_000_000,
) -> str:
    """Replace the transactions table at ``path``.

    One folder per year for partition pruning; rows sorted by the usual filter
    columns inside each file so that row groups can be skipped. Tasks write
    where they stand: no shuffle gathers a year into one place.
    """
    order = [partition_by, *[c for c in cluster_by if c in df.columns]]
    (
        df.sortWithinPartitions(*order)
        .write.mode("overwrite")
        .option("maxRecordsPerFile", max_rows_per_file)
        .partitionBy(partition_by)
        .parquet(path)
    )
    return path


def write_csv(
    df: DataFrame, path: str, single_file: bool = False, compression: str = "none",
    max_rows_per_file: int | None = None,
) -> str:
    """One folder of CSV files. ``single_file`` is for tables bounded by a limit.

    Outer spaces are part of the text and are kept. A compressed file cannot
    be split among tasks that read it, so ``max_rows_per_file`` bounds it.
    """
    out = (df.coalesce(1) if single_file else df).write
    if max_rows_per_file:
        out = out.option("maxRecordsPerFile", max_rows_per_file)
    (
        out.mode("overwrite").option("header", True).option("compression", compression)
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
        .option("quote", '"').option("escape", '"').csv(path)
    )
    return path


def write_report(tables: Mapping[str, DataFrame], folder: str, fmt: str = "parquet") -> dict[str, int]:
    """Each non-empty table in its own sub-folder; returns the rows of those written.

    A table is computed once: its rows are counted as they are written, in the
    last stage of the job, where each row counts once even if tasks are run
    again. The folder of a table that turned out empty is removed.
    """
    written = {}
    for name, table in tables.items():
        path, seen = f"{folder}/{name}", Observation()
        counted = table.observe(seen, F.count(F.lit(1)).alias("rows"))
        counted.write.mode("overwrite").format(fmt).option("header", True).save(path)
        if rows := seen.get["rows"]:
            written[name] = rows
        else:
            _remove(table.sparkSession, path)
    return written


def _remove(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def write_lines(insights: DataFrame, path: str, title: str | None = None) -> str:
    """Insight sentences as text in rule order; a handful of rows, so one file."""
    lines = insights.select("rule", "text")
    if title is not None:
        head = insights.sparkSession.range(1).select(F.lit(0).alias("rule"), F.lit(title).alias("text"))
        lines = head.unionByName(lines)
    lines = lines.repartition(1).sortWithinPartitions("rule").select(F.col("text").alias("value"))
    lines.write.mode("overwrite").text(path)
    return path
