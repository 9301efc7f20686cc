"""Stored layouts for fast access: clustering by a space-filling curve with Bloom filters, and buckets by a key."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesprism.session import shuffles_dropped

RANK_BITS = 6
SAMPLE = 4096  # distinct values of a column that its range ranks are made of
ROW_GROUP_BYTES = 16 << 20
CLUSTER_BY = ("category", "city", "customer_id")
BLOOM = ("customer_id", "product_id")
PART_ROWS = 500_000  # rows of a file or bucket, about


def parts(df: DataFrame, least: int, rows: int = PART_ROWS) -> int:
    """Files or buckets for ``df``: ``least`` for a small table, more as it grows, so that none outgrows a task.

    Counting a stored table reads the footers of its files only.
    """
    return max(least, -(-df.count() // rows))


def range_borders(df: DataFrame, columns: Sequence[str], bits: int = RANK_BITS, sample: int = SAMPLE) -> dict[str, list]:
    """Borders that deal the rows of each column into 2**bits ranges of about equal weight, at most.

    A sketch per column: the ``sample`` distinct values with the least hashes,
    each with its number of rows. A sample of values, not of rows, so that a
    value with a third of all rows takes one range and leaves the others to
    the rest. Its size is bounded; with fewer values than that it is exact.
    """
    borders = {}
    for c in columns:
        counted = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("rows"))
        least = counted.orderBy(F.xxhash64(c), c).limit(sample).collect()
        rows, picked, passed = sorted((r[0], r[1]) for r in least), [], 0
        step = sum(n for _, n in rows) / (1 << bits)
        for value, n in rows:
            if passed >= step * (len(picked) + 1) and len(picked) < (1 << bits) - 1:
                picked.append(value)
            passed += n
        borders[c] = picked
    return borders


def range_rank(column: str, borders: Sequence) -> Column:
    """Number of borders, which are in order, at or below the value, by halves; null ranks with the least."""
    if not borders:
        return F.lit(0)
    known = F.array(*[F.lit(b) for b in borders])
    steps = F.array(*[F.lit(1 << bit) for bit in reversed(range(len(borders).bit_length()))])
    below = F.aggregate(steps, F.lit(0), lambda at, step: F.when(
        F.get(known, at + step - 1) <= F.col(column), at + step).otherwise(at))
    return F.when(F.col(column).isNull(), 0).otherwise(below)


def curve(ranks: Sequence[Column], bits: int = RANK_BITS) -> Column:
    """Place on a Z curve: the bits of all ranks interleaved, the highest bits of all ranks first."""
    return reduce(Column.bitwiseOR, [
        F.shiftleft(F.shiftright(rank, bit).bitwiseAND(F.lit(1)).cast("long"), bit * len(ranks) + i)
        for bit in range(bits) for i, rank in enumerate(ranks)])


_BREAK, _MARK = "\u0001", "\u0002"


def pack_texts(columns: Sequence[str]) -> Column:
    """The texts of ``columns`` as one; nulls, breaks, marks and bytes that are no UTF-8 are marked.

    A row of a shuffle keeps at least 16 bytes for every text, which hardly
    compress; packed, short texts cost little more than their letters.
    """
    def one(c: str) -> Column:
        plain = F.replace(F.replace(c, F.lit(_MARK), F.lit(_MARK + "b")), F.lit(_BREAK), F.lit(_MARK + "a"))
        return F.when(F.col(c).isNull(), _MARK + "n").when(F.is_valid_utf8(c), plain).otherwise(F.concat(F.lit(_MARK + "x"), F.hex(c)))

    return F.concat_ws(_BREAK, *map(one, columns))


def unpack_texts(packed: str, columns: Sequence[str]) -> dict[str, Column]:
    """The texts that ``pack_texts`` put into the column ``packed``, by name."""
    def one(i: int) -> Column:
        text = F.split_part(packed, F.lit(_BREAK), F.lit(i))
        plain = F.replace(F.replace(text, F.lit(_MARK + "a"), F.lit(_BREAK)), F.lit(_MARK + "b"), F.lit(_MARK))
        return F.when(text == _MARK + "n", None).when(
            text.startswith(_MARK + "x"), F.unhex(F.substr(text, F.lit(3))).cast("string")).otherwise(plain)

    return {c: one(i) for i, c in enumerate(columns, 1)}


def write_clustered(
    df: DataFrame, path: str, files: int, cluster_by: Sequence[str] = CLUSTER_BY, bloom: Sequence[str] = BLOOM,
    partition_by: str = "order_year", row_group_bytes: int = ROW_GROUP_BYTES, follows: Mapping[str, Column] | None = None,
) -> str:
    """Replace the table at ``path``: one folder per year, rows on a curve over ``cluster_by``.

    Rows that are near in any of the columns lie near each other, so the
    least and greatest values of a row group rule it out for a filter on any
    of them, and the Bloom filters of ``bloom`` do so for single keys. Files
    are ranges of the curve; rows of one place on it, which may be very many,
    are dealt by a hash of the row. Columns that ``follows`` works out from
    the others are not moved but worked out again where the rows are written;
    texts move packed.
    """
    follows = dict(follows or {})
    texts = [c for c, kind in df.dtypes if kind == "string" and c not in (*follows, partition_by)]
    plain = [c for c in df.columns if c not in (*follows, *texts, partition_by)]
    with shuffles_dropped(df.sparkSession):
        borders = range_borders(df, cluster_by)
        place = curve([range_rank(c, borders[c]) for c in cluster_by])
        out = (
            df.select(partition_by, *plain, pack_texts(texts).alias("_texts"), place.alias("_place"))
            .repartitionByRange(files, partition_by, "_place", F.xxhash64("_texts", *plain))
            .withColumns(unpack_texts("_texts", texts)).withColumns(follows).select(*df.columns, "_place")
            .sortWithinPartitions(partition_by, "_place", *cluster_by)
            .drop("_place")
            .write.mode("overwrite").option("parquet.block.size", row_group_bytes).option("compression", "zstd")
        )
        for c in bloom:
            out = out.option(f"parquet.bloom.filter.enabled#{c}", "true").option(f"parquet.bloom.filter.adaptive.enabled#{c}", "true")
        out.partitionBy(partition_by).parquet(path)
    return path


def save_bucketed(df: DataFrame, name: str, path: str, buckets: int, key: str = "customer_id") -> DataFrame:
    """Replace the catalog table ``name``, stored at ``path`` in buckets sorted by ``key``; returns it.

    Groups, joins and windows on ``key`` then need no shuffle: the one at
    writing time, which puts a bucket in a task and so a bucket in a file,
    serves all of them. Rows of one key stay together, so a key with a large
    share of all rows makes its bucket as large; queries that cannot bear
    that read the clustered table.
    """
    (
        df.repartition(buckets, key).write.mode("overwrite").option("path", path)
        .bucketBy(buckets, key).sortBy(key).format("parquet").saveAsTable(name)
    )
    return df.sparkSession.table(name)
