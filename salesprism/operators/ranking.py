"""Global ranks, quantiles, bins and scaling that hold at any row count.

A window without a partition key sorts everything in one task, and a window
over a hot key sorts that key in one task. The ranks here come from a
distributed sort instead: Spark's range partitioning splits the data on the
whole sort key, each row gets its position inside its partition, and the
few per-partition counts are broadcast back as offsets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salesprism.session import stage

SLOT_BITS = 33  # monotonically_increasing_id keeps the row position in its low 33 bits


def _sorted_slots(df: DataFrame, order_by: Sequence[Column | str], label: str) -> DataFrame:
    """Sort globally, number rows inside each partition, and store that layout."""
    slot = F.monotonically_increasing_id()
    placed = df.orderBy(*order_by).withColumn("_slot", slot)
    return stage(placed, label).withColumns({
        "_part": F.shiftright("_slot", SLOT_BITS),
        "_pos": F.col("_slot").bitwiseAND((1 << SLOT_BITS) - 1),
    }).drop("_slot")


def global_row_number(
    df: DataFrame, order_by: Sequence[Column | str], name: str = "rn", total: str = "n"
) -> DataFrame:
    """Add the row number over a total order, and the row count.

    ``order_by`` should end in a unique column so that the order is total.
    The window below runs over one row per sort partition.
    """
    rows = _sorted_slots(df, order_by, "sorted")
    parts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = parts.select(
        "_part",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"),
        F.sum("_rows").over(everything).alias(total),
    )
    return (
        rows.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + F.col("_pos") + 1)
        .drop("_part", "_pos", "_offset")
    )


def rank_within(
    df: DataFrame, keys: Sequence[str], order_by: Sequence[Column | str], name: str = "order_rank"
) -> DataFrame:
    """Row number inside each key, also when one key holds most of the rows.

    Sorted by key and order, a key is a run of neighbouring rows. A row's rank
    is its distance to the start of the run in its partition, plus the rows the
    key has in earlier partitions. Only keys that cross a partition border have
    any, at most one per border, so that side is broadcast.
    """
    rows = _sorted_slots(df, [*keys, *order_by], "runs")
    runs = rows.groupBy("_part", *keys).agg(F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    per_part = Window.partitionBy("_part")
    edges = runs.withColumns({
        "_lead": F.min("_first").over(per_part), "_tail": F.max("_first").over(per_part),
    }).where((F.col("_first") == F.col("_lead")) | (F.col("_first") == F.col("_tail")))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        edges.withColumn("_carry", F.sum("_rows").over(earlier))
        .where("_carry > 0").select("_part", "_carry", *keys)
    )
    in_part = Window.partitionBy("_part").orderBy("_pos")
    same = [F.col(k).eqNullSafe(F.lag(k).over(in_part)) for k in keys]
    unchanged = same[0]
    for s in same[1:]:
        unchanged = unchanged & s
    starts = rows.withColumn("_new", F.when(F.col("_pos") == 0, True).otherwise(~unchanged))
    begun = starts.withColumn(
        "_start", F.max(F.when(F.col("_new"), F.col("_pos"))).over(
            in_part.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    )
    return (
        begun.join(F.broadcast(carried), ["_part", *keys], "left")
        .withColumn(name, F.col("_pos") - F.col("_start") + 1 + F.coalesce(F.col("_carry"), F.lit(0)))
        .drop("_part", "_pos", "_new", "_start", "_carry")
    )


def rank_quintile(rn: Column, n: Column, bins: int = 5) -> Column:
    """Equal-count bin of rank ``rn`` of ``n``: quantile edges over the ranks, right-closed.

    Not ``ntile``: for 7 rows the bins hold 2, 1, 1, 1, 2. Whole-number
    arithmetic, so no digits are lost at large ``n``.
    """
    span = F.greatest(n - 1, F.lit(1))
    ahead = F.lit(bins) * (rn - 1) + span - 1
    return F.greatest(F.lit(1), ((ahead - ahead % span) / span).cast("int"))


def rank_score(
    df: DataFrame, value: str, tie: str, name: str, bins: int = 5, reverse: bool = False
) -> DataFrame:
    """Add the rank-first quintile of ``value``; ties go by ``tie``."""
    ranked = global_row_number(df, [F.asc_nulls_last(value), tie], "_rn", "_n")
    score = rank_quintile(F.col("_rn"), F.col("_n"), bins)
    return ranked.withColumn(name, (F.lit(bins + 1) - score) if reverse else score).drop("_rn", "_n")


def exact_quantiles(
    df: DataFrame, value: str, probs: Sequence[float], accuracy: int = 20_000, small: int = 50_000
) -> DataFrame:
    """Exact linear-interpolation quantiles as one row ``(n, q ARRAY<DOUBLE>)``.

    Pass one brackets each quantile with a mergeable sketch. Pass two counts
    rows per distinct value inside the brackets and only per gap outside them,
    then reads the order statistics off the running count. Exactness does not
    rest on the sketch: a position outside its bracket fails the query. The
    running count covers only values inside the brackets (all values when
    there are at most ``small`` rows).
    """
    x = df.select(F.col(value).cast("double").alias("x")).where("x IS NOT NULL AND NOT isnan(x)")
    slack, k = 2.0 / accuracy, len(probs)
    points = [max(p - slack, 0.0) for p in probs] + [min(p + slack, 1.0) for p in probs]
    sketch = x.agg(F.struct(
        F.count("x").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"),
        F.percentile_approx("x", points, accuracy).alias("cuts")).alias("s"))
    tagged = x.withColumn("s", sketch.scalar())

    few = F.col("s.n") <= small
    inside, below = F.lit(False), F.lit(float("-inf"))
    for i in range(k):
        lo = F.when(few, F.col("s.lo")).otherwise(F.col("s.cuts")[i])
        hi = F.when(few, F.col("s.hi")).otherwise(F.col("s.cuts")[k + i])
        inside = inside | F.col("x").between(lo, hi)
        below = F.greatest(below, F.when(hi < F.col("x"), hi))
    counts = (
        tagged.withColumn("gap", ~inside)
        .select("gap", F.when(F.col("gap"), below).otherwise(F.col("x")).alias("v"))
        .groupBy("v", "gap").agg(F.count(F.lit(1)).alias("c"))
    )
    upto = Window.orderBy("v", "gap").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.orderBy("v", "gap").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    running = counts.select("v", "gap", F.sum("c").over(upto).alias("cum"), F.sum("c").over(everything).alias("n"))

    def at(position: Column) -> Column:
        return F.min(F.when(F.col("cum") > position, F.struct("v", "gap")))

    picks, names = [], []
    for i, p in enumerate(probs):
        pos = (F.col("n") - 1) * F.lit(float(p))
        picks += [at(F.floor(pos)).alias(f"a{i}"), at(F.ceil(pos)).alias(f"b{i}")]
        names.append((f"a{i}", f"b{i}", p))
    found = running.agg(F.max("n").alias("n"), *picks)

    def quantile(a: str, b: str, p: float) -> Column:
        pos = (F.col("n") - 1) * F.lit(float(p))
        value_ = F.col(a)["v"] + (F.col(b)["v"] - F.col(a)["v"]) * (pos - F.floor(pos))
        missed = F.col(a)["gap"] | F.col(b)["gap"]
        return F.when(missed, F.raise_error(F.lit("quantile outside its bracket: raise accuracy"))).otherwise(value_)

    return found.select("n", F.array(*[quantile(*t) for t in names]).alias("q"))


def value_quintile(df: DataFrame, value: str, name: str, bins: int = 5, reverse: bool = False) -> DataFrame:
    """Add the equal-count bin by value: interpolated edges, right-closed, lowest included."""
    probs = [k / bins for k in range(1, bins)]
    edges = exact_quantiles(df, value, probs).select("q").scalar()
    above = sum(((F.col(value) > F.col("_edges")[k]).cast("int") for k in range(bins - 1)), F.lit(1))
    score = (F.lit(bins + 1) - above) if reverse else above
    return df.withColumn("_edges", edges).withColumn(name, score).drop("_edges")


def extent(df: DataFrame, *values: str) -> Column:
    """Global ``{value}_min`` and ``{value}_max`` as one struct.

    Attach it with ``withColumn`` and read its fields from there: each mention
    of a scalar subquery is planned anew.
    """
    parts = []
    for v in values:
        parts += [F.min(v).alias(f"{v}_min"), F.max(v).alias(f"{v}_max")]
    return df.agg(F.struct(*parts).alias("e")).scalar()


def equal_width_bin(df: DataFrame, value: str, bins: int = 20, name: str = "bin", span: Column | None = None) -> DataFrame:
    """Add the equal-width bin over the global range: right-closed, minimum included.

    ``width_bucket`` is left-closed, so the bin is computed directly.
    """
    low, high = F.col("_span")[f"{value}_min"].cast("double"), F.col("_span")[f"{value}_max"].cast("double")
    raw = F.ceil((F.col(value) - low) / ((high - low) / bins))
    bin_ = F.when(high == low, F.lit(1)).otherwise(F.least(F.greatest(raw, F.lit(1)), F.lit(bins)))
    spanned = df.withColumn("_span", extent(df, value) if span is None else span)
    return spanned.withColumn(name, F.when(F.col(value).isNotNull(), bin_).cast("int")).drop("_span")


def minmax(value: Column, low: Column, high: Column) -> Column:
    """Scale to [0, 1]; a constant column becomes 0.5."""
    return F.when(high == low, F.lit(0.5)).otherwise((value - low) / F.nullif(high - low, F.lit(0.0)))


def last_per(df: DataFrame, keys: Sequence[str], order_by: Sequence[str], take: str, name: str) -> DataFrame:
    """The value of ``take`` on each key's last row, as a combinable aggregate."""
    return df.groupBy(*keys).agg(F.max_by(take, F.struct(*order_by)).alias(name))
