"""Keeping a table partitioned by year in step with a folder of input files, rewriting touched years only.

A manifest beside the table holds, for each input file, its size, its time
of change and the years it has rows of. A refresh compares it with the
folder. Years of changed, new or vanished files are touched; they are read
again from the files that have them, and only their folders are replaced.
The manifest is written last, as a new version: a refresh that broke off is
simply done again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

YEAR = "order_year"
MANIFEST = "path string, length long, modified timestamp, years array<int>"
Reader = Callable[[SparkSession, list[str]], DataFrame]


def _folder(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def _versions(spark: SparkSession, table: str) -> list[int]:
    fs, place = _folder(spark, f"{table}.manifest")
    if not fs.exists(place):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(place)]
    done = [n for n in names if fs.exists(_folder(spark, f"{table}.manifest/{n}/_SUCCESS")[1])]
    return sorted(int(n[2:]) for n in done)


def read_manifest(spark: SparkSession, table: str) -> DataFrame:
    """The last whole manifest of a table; empty if there is none."""
    known = _versions(spark, table)
    if not known:
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(f"{table}.manifest/v={known[-1]}")


def listed(spark: SparkSession, inputs: str) -> DataFrame:
    """(path, name, length, modified) of the files in a folder; their content is not read.

    ``name`` is the path as rows of the file carry it, which spells odd letters in another way.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(inputs)
    return files.select("path", F.col("_metadata.file_path").alias("name"), "length", F.col("modificationTime").alias("modified"))


def changes(spark: SparkSession, inputs: str, table: str) -> DataFrame:
    """Each file of the folder or the manifest: path, years before, whether it is there now, and whether it is as it was."""
    before = read_manifest(spark, table).withColumnsRenamed({"length": "_length", "modified": "_modified"})
    both = listed(spark, inputs).join(before, "path", "full_outer")
    same = (F.col("length") == F.col("_length")) & (F.col("modified") == F.col("_modified"))
    return both.select(
        "path", "name", "length", "modified", F.col("years").alias("years_before"), F.col("length").isNotNull().alias("there"),
        F.coalesce(same, F.lit(False)).alias("same"))


NO_YEAR = -1


def refresh(spark: SparkSession, read: Reader, inputs: str, table: str) -> list[int]:
    """Bring ``table`` in step with the files under ``inputs``; returns the years rewritten.

    ``read(spark, paths)`` gives the rows of input files, with ``order_year``
    and one row per input row. Rows without a year go to the folder of none.
    The driver holds one row per input file.
    """
    seen = changes(spark, inputs, table).collect()
    fresh = [r.path for r in seen if r.there and not r.same]
    years = {r.path: set(r.years_before or ()) for r in seen if r.there and r.same}
    touched = set().union(*(r.years_before or () for r in seen if not r.same), set())
    if fresh:
        paths = {r.name: r.path for r in seen if r.there}
        rows = read(spark, fresh).select(F.col("_metadata.file_path").alias("name"), F.coalesce(YEAR, F.lit(NO_YEAR)).cast("int").alias(YEAR))
        for r in rows.groupBy("name").agg(F.collect_set(YEAR).alias("years")).collect():
            years[paths[r.name]] = set(r.years)
            touched |= set(r.years)
    for path in fresh:
        years.setdefault(path, set())
    if touched:
        _rewrite(spark, read, sorted(p for p, own in years.items() if own & touched), sorted(touched), table)
    if not all(r.same for r in seen):
        sizes = {r.path: (r.length, r.modified) for r in seen if r.there}
        version = (_versions(spark, table) or [0])[-1] + 1
        kept = [(p, *sizes[p], sorted(own)) for p, own in sorted(years.items())]
        spark.createDataFrame(kept, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{table}.manifest/v={version}")
    return sorted(touched)


def _rewrite(spark: SparkSession, read: Reader, paths: list[str], years: list[int], table: str) -> None:
    """Replace the folders of ``years`` by the rows of ``paths``; a year without rows loses its folder."""
    left = set()
    if paths:
        own = F.coalesce(YEAR, F.lit(NO_YEAR)).isin(years)
        rows = read(spark, paths).where(own)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(YEAR).parquet(table)
        left = {NO_YEAR if r[0] is None else r[0] for r in rows.select(YEAR).distinct().collect()}
    for year in set(years) - left:
        name = "__HIVE_DEFAULT_PARTITION__" if year == NO_YEAR else year
        fs, place = _folder(spark, f"{table}/{YEAR}={name}")
        fs.delete(place, True)
