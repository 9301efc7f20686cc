"""Market basket: frequent item sets, pairs and association rules.

Rare items are dropped before baskets are put together. An item must be in
``min_support`` of all baskets to stay, so at most (mean basket size /
min_support) items do, and no basket holds more than those whatever its
number of rows. Equal baskets are then merged into one weighted pattern, so
pairs are made per distinct pattern and never per order.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesprism.session import stage


def distinct_items(df: DataFrame, basket: str = "transaction_id", item: str = "product_id") -> DataFrame:
    """One row per basket and item."""
    return df.select(basket, item).where(F.col(item).isNotNull() & F.col(basket).isNotNull()).distinct()


def basket_count(df: DataFrame, basket: str, item: str) -> Column:
    """How many baskets have any item, as a scalar."""
    return df.where(F.col(item).isNotNull()).agg(F.count_distinct(basket).alias("n")).scalar()


def frequent_baskets(df: DataFrame, basket: str, item: str, min_support: float) -> DataFrame:
    """Each basket as the sorted array of its frequent items."""
    pairs = distinct_items(df, basket, item)
    n = basket_count(df, basket, item)
    frequent = pairs.groupBy(item).agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") >= n * min_support).select(item)
    # at most (mean basket size / min_support) rows, so it can be broadcast whatever the data's size
    return (
        pairs.join(F.broadcast(frequent), item, "left_semi")
        .groupBy(basket).agg(F.sort_array(F.collect_list(F.col(item).cast("string"))).alias("items"))
    )


def patterns(df: DataFrame, basket: str, item: str, min_support: float) -> DataFrame:
    """Distinct frequent-item baskets with the number of baskets of each."""
    return frequent_baskets(df, basket, item, min_support).groupBy("items").agg(F.count(F.lit(1)).alias("baskets"))


def item_pairs(df: DataFrame, basket: str = "transaction_id", item: str = "product_id",
               min_support: float = 0.01) -> DataFrame:
    """Item pairs found together in at least ``min_support`` of the baskets."""
    n = basket_count(df, basket, item)
    first = patterns(df, basket, item, min_support).select("items", "baskets", F.posexplode("items").alias("_i", "item_a"))
    second = first.select(
        "item_a", "baskets", F.explode(F.slice("items", F.col("_i") + 2, F.size("items"))).alias("item_b"))
    return (
        second.groupBy("item_a", "item_b").agg(F.sum("baskets").alias("baskets"))
        .withColumn("support", F.col("baskets") / n)
        .where(F.col("baskets") >= n * min_support)
    )


def item_sets(df: DataFrame, basket: str = "transaction_id", item: str = "product_id",
              min_support: float = 0.01) -> DataFrame:
    """Frequent item sets of every size: ``(items ARRAY<STRING>, freq, support)``."""
    n = basket_count(df, basket, item)
    baskets = stage(frequent_baskets(df, basket, item, min_support), "baskets")
    # FPGrowth measures support among the baskets it is given; all frequent
    # sets are inside them, so the floor is re-applied on the full count.
    kept = baskets.agg(F.count(F.lit(1)).alias("k")).select("k").first()["k"]
    total_baskets = df.sparkSession.range(1).select(n.alias("n")).first()["n"]
    if kept == 0:
        return baskets.select("items", F.lit(0).cast("bigint").alias("freq"), F.lit(0.0).alias("support")).limit(0)
    floor = min(1.0, min_support * total_baskets / kept)
    model = FPGrowth(itemsCol="items", minSupport=floor * (1 - 1e-9), minConfidence=1.0).fit(baskets)
    return (
        model.freqItemsets.select(F.sort_array("items").alias("items"), "freq")
        .where(F.col("freq") >= min_support * total_baskets)
        .withColumn("support", F.col("freq") / F.lit(total_baskets))
    )


def rules(sets: DataFrame, min_confidence: float = 0.3) -> DataFrame:
    """Rules between any two parts of a frequent set, with confidence, lift, leverage and conviction.

    Both sides may have several items. Consequents grow level by level: for
    one set, moving an item from the antecedent to the consequent can only
    lower the confidence, so a consequent is tried only if it is one that
    passed, with one more item that passed alone. A level is at most the
    rules that passed times the items of a set; sets without strong rules end
    after one.
    """
    sets = stage(sets, "item-sets")
    known = sets.select(F.col("items").alias("antecedent"), F.col("support").alias("antecedent_support"))

    def passing(tried: DataFrame) -> DataFrame:
        split = tried.withColumn("antecedent", F.array_except("items", "consequent")).join(known, "antecedent")
        strong = split.withColumn("confidence", F.col("support") / F.col("antecedent_support"))
        return stage(strong.where(F.col("confidence") >= min_confidence), "rules")

    several = sets.where(F.size("items") > 1).select("items", "support")
    level = passing(several.withColumn("_x", F.explode("items")).withColumn("consequent", F.array("_x")).drop("_x"))
    alone = level.groupBy("items").agg(F.sort_array(F.collect_list(F.col("consequent")[0])).alias("_alone"))
    found = None
    while not level.isEmpty():
        found = level if found is None else found.unionByName(level)
        more = F.filter("_alone", lambda x: x > F.element_at("consequent", -1))
        longer = level.where(F.size("consequent") < F.size("items") - 1).select("items", "support", "consequent").join(alone, "items")
        level = passing(longer.select("items", "support", "consequent", F.explode(more).alias("_x")).select(
            "items", "support", F.concat("consequent", F.array("_x")).alias("consequent")))
    right = sets.select(F.col("items").alias("consequent"), F.col("support").alias("consequent_support"))
    table = (level if found is None else found).join(right, "consequent")
    return table.where(F.col("confidence") >= min_confidence).select(
        "antecedent", "consequent", "antecedent_support", "consequent_support", "support", "confidence",
        (F.col("confidence") / F.col("consequent_support")).alias("lift"),
        (F.col("support") - F.col("antecedent_support") * F.col("consequent_support")).alias("leverage"),
        F.when(F.col("confidence") >= 1.0, F.lit(float("inf")))
        .otherwise((1 - F.col("consequent_support")) / F.nullif(1 - F.col("confidence"), F.lit(0.0))).alias("conviction"),
    )


def top_rules(table: DataFrame, k: int = 10) -> DataFrame:
    return table.orderBy(F.desc("lift"), "antecedent", "consequent").limit(k)
