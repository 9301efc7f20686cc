"""What queries keep on disk: shuffle files, moved columns, raw text."""

import glob
import os
import shutil

from pyspark.sql import functions as F

from salesprism.plans import catalog
from salesprism.session import new_path, shared_folder, shuffles_dropped
from salesprism.sources import layout, readers, sinks, tables
from tests.conftest import SMALL


def shuffle_files(spark):
    """Shuffle files that Spark holds at present."""
    found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f for f in found.mkString("\n").split("\n") if os.path.basename(f).startswith("shuffle_")}


def left(spark, label):
    return set(glob.glob(f"{shared_folder(spark).removeprefix('file://')}/salesprism/{label}-*"))


def bytes_of(path):
    return sum(os.path.getsize(f) for f in glob.glob(f"{path}/**/part-*", recursive=True))


def test_rejects_compress_raw_text_in_files_of_bounded_rows(spark, t, monkeypatch):
    monkeypatch.setattr(catalog, "RAW_ROWS", 700)
    seen = left(spark, "raw-csv"), left(spark, "rejects")
    catalog.rejects(t).collect()
    (raw,), (split,) = left(spark, "raw-csv") - seen[0], left(spark, "rejects") - seen[1]
    files = glob.glob(f"{raw}/part-*")
    assert len(files) > t.count() / 700 and all(f.endswith(".csv.gz") for f in files)
    plain = sinks.write_csv(catalog.dirty_transactions(t), new_path(spark, "plain-csv").removeprefix("file://"))
    assert bytes_of(raw) < 0.4 * bytes_of(plain)
    assert all(f.endswith(".zstd.parquet") for f in glob.glob(f"{split}/*/part-*"))


def test_compressed_csv_keeps_every_row(spark, tmp_path):
    rows = [(None if i % 7 == 0 else f" ₹{i}", '"a,b"' if i % 2 else "") for i in range(25)]
    df = spark.createDataFrame(rows, "a string, b string").coalesce(1)
    path = sinks.write_csv(df, str(tmp_path / "csv"), compression="gzip", max_rows_per_file=10)
    assert len(glob.glob(f"{path}/*.csv.gz")) == 3
    same = sinks.write_csv(df, str(tmp_path / "plain"))
    back, plain = (sorted(map(tuple, readers.read_csv(spark, p, df.schema).collect()), key=repr) for p in (path, same))
    assert back == plain and len(back) == 25 and [os.path.splitext(f)[1] for f in glob.glob(f"{same}/part-*")] == [".csv"]


def test_writes_leave_no_shuffle_files(spark, tmp_path):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, setting = shuffle_files(spark), spark.conf.get(name)
    folder = str(tmp_path / "tables")
    shutil.copytree(SMALL, folder)
    t = tables.stored_transactions(spark, folder)
    assert shuffle_files(spark) <= before
    layout.write_clustered(t.withColumn("city", F.col("customer_city")), new_path(spark, "clustered"), 4)
    assert shuffle_files(spark) <= before
    assert spark.conf.get(name) == setting
    spark.conf.set(name, "true")
    with shuffles_dropped(spark):
        pass
    assert spark.conf.get(name) == "true"
    spark.conf.set(name, setting)


def test_clustered_write_moves_few_columns(spark, t, monkeypatch):
    moved, kind = [], type(t)

    def repartition(self, *a, f=kind.repartitionByRange):
        moved.extend(self.columns)
        return f(self, *a)

    monkeypatch.setattr(kind, "repartitionByRange", repartition)
    seen = left(spark, "clustered")
    catalog.clustered_lookup(t).collect()
    follow = {"original_price_inr", "customer_city", "city", "order_month", "festival_name", "is_festival_sale"}
    texts = {c for c, kind in t.dtypes if kind == "string"}
    assert set(moved) == set(t.columns) - follow - texts | {"_place", "_texts"}
    (path,) = left(spark, "clustered") - seen
    stored = spark.read.schema(t.schema).parquet(path)
    assert sorted(map(repr, stored.select(t.columns).collect())) == sorted(map(repr, t.collect()))


def test_packed_texts_come_back(spark):
    values = [None, "", "a", "\u0001", "\u0002", "\u0002n", "\u0002a", "\u0002x61", "x\u0001y\u0002bz\u0001", "é₹𝒳\u0000", "\u0002\u0002a\u0001b", " "]
    rows = [(a, b, c) for a in values for b in values for c in values[:3]]
    df = spark.createDataFrame(rows, "a string, b string, c string").selectExpr(
        "*", "cast(unhex(if(a = 'a', 'FF41E2', '61')) as string) as bad")
    packed = df.select("*", layout.pack_texts(df.columns).alias("packed"))
    back = packed.select(*[F.col(c).eqNullSafe(v).alias(c) for c, v in layout.unpack_texts("packed", df.columns).items()])
    assert back.where("a AND b AND c AND bad").count() == len(rows)


def test_clustered_table_of_numbers_or_with_texts_as_folders(spark):
    numbers = spark.createDataFrame([(1990 + i % 2, i % 5, i) for i in range(100)], "order_year int, k long, customer_id long")
    path = layout.write_clustered(numbers, new_path(spark, "clustered"), 2, cluster_by=("k",), bloom=())
    assert sorted(spark.read.schema(numbers.schema).parquet(path).select(numbers.columns).collect()) == sorted(numbers.collect())
    named = spark.createDataFrame([("abc"[i % 3], str(i % 5), i) for i in range(100)], "folder string, k string, n long")
    path = layout.write_clustered(named, new_path(spark, "clustered"), 2, cluster_by=("k",), bloom=(), partition_by="folder")
    assert sorted(spark.read.schema(named.schema).parquet(path).select(named.columns).collect()) == sorted(named.collect())


def test_range_rank_counts_borders_at_or_below(spark):
    for borders in ([], [3], [3, 5], [3, 5, 5, 9], list(range(0, 63)), list(range(0, 64))):
        df = spark.createDataFrame([(i,) for i in [None, *range(-1, 70)]], "v long")
        found = df.select("v", layout.range_rank("v", borders).alias("rank")).collect()
        assert [r["rank"] for r in found] == [0 if r.v is None else sum(b <= r.v for b in borders) for r in found]
