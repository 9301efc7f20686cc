"""SpotSigs fingerprints: content words that follow common-word anchors, compared through pruned Jaccard. SQL only.

At each anchor a signature is the anchor with the next ``CHAIN`` content
words (words that are no anchors). A text's fingerprint set is its distinct
signatures as 64-bit hashes. A text without a full chain (no anchors of its
language are known, say) is signed by its runs of ``CHAIN`` consecutive words,
and one of fewer words by the text as a whole, so equal texts always agree.
The fingerprint string is the set's size, a colon, and a digest of the sorted
set.

Two sets can reach a similarity of t only if the smaller has at least t
times the larger's size: sets are partitioned by size for joins, and pairs
whose sizes rule t out are not intersected.

Null and empty texts have an empty set; two empty sets have likeness 1 (equal
texts), an empty and another one 0. Rows are ordered by id, a null id counting
as the largest long, and ties by a hash of the text; other columns are not
carried.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Very common words of English, French, German and Spanish.
ANCHORS = (
    "a an and are as at be by for from in is it of on or that the this to was were which with "
    "au aux ce de des du elle en est et il la le les ou par pas pour que qui sur un une "
    "das dem den der die ein eine es ist mit nicht sie und von zu "
    "con del el los las no para por se su y"
).split()
CHAIN = 3
RANGE_ROWS = 1500  # rows of one id range, in the mean
MOST_RANGES = 8192  # beyond 12 million rows the ranges grow; each is sorted with spilling
LAST = 2 ** 63 - 1  # the place of rows without id


def word_list(text: Column) -> Column:
    """Words of a text with A-Z folded, without punctuation and digits; null has none."""
    low = F.lower(F.coalesce(text.cast("string"), F.lit("")))
    return F.array_remove(F.split(low, r"[^\p{L}\p{M}]+"), "")


def with_signatures(rows: DataFrame, text: str, out: str) -> DataFrame:
    """The rows with a column ``out``: the sorted distinct signature hashes of column ``text``.

    The k-th anchor (from 0) at word i has i - k content words before it, so
    its chain starts at that place among the content words. Each step is a
    projection of its own, so that nothing is computed once per word again.
    """
    longest = max(map(len, ANCHORS))
    names = rows.columns

    def anchor(w: Column) -> Column:
        return (F.octet_length(w) <= longest) & w.isin(*ANCHORS)

    rows = rows.select(*names, word_list(F.col(text)).alias("_tokens"))
    rows = rows.select(
        *names, "_tokens", F.filter("_tokens", lambda w: ~anchor(w)).alias("_content"),
        F.filter(F.transform("_tokens", lambda w, i: F.when(anchor(w), F.struct(w.alias("w"), i.alias("i")))),
                 lambda m: m.isNotNull()).alias("_spots"))
    content = F.col("_content")
    chains = F.transform("_spots", lambda m, k: F.when(
        m["i"] - k + CHAIN <= F.size(content),
        F.xxhash64(m["w"], *(F.get(content, m["i"] - k + j) for j in range(CHAIN)))))
    rows = rows.select(*names, "_tokens", F.array_distinct(F.array_compact(chains)).alias("_hashes"))
    # a run or a whole text is never taken for a chain: the marker is one more value
    tokens = F.col("_tokens")
    runs = F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(tokens) - CHAIN), lambda i: F.xxhash64(
        F.lit("run"), *(F.get(tokens, i + j) for j in range(CHAIN)), F.lit(CHAIN))))
    whole = F.when(F.octet_length(text) > 0, F.array(F.xxhash64(text, F.lit("whole")))).otherwise(
        F.array().cast("array<bigint>"))
    return rows.select(*names, F.when(F.size("_hashes") > 0, F.array_sort("_hashes")).when(
        F.size(tokens) >= CHAIN, F.array_sort(runs)).otherwise(whole).alias(out))


def fingerprint(signatures: Column) -> Column:
    """Size and digest of a set."""
    return F.concat_ws(":", F.size(signatures), F.sha2(F.array_join(F.transform(signatures, lambda s: s.cast("string")), ","), 256))


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard similarity of two sets; 0 where their sizes alone keep it below ``least``."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    common = F.size(F.array_intersect(a, b))
    return (
        F.when(large == 0, 1.0)
        .when((small == 0) | (small < least * large), 0.0)
        .otherwise(common / (F.size(a) + F.size(b) - common)))


def _ranges(rows: DataFrame) -> DataFrame:
    """The rows with ``_cell``: their range in the order of (_key, _tie), ranges being about equally full.

    A range begins at a quantile of the keys. A key that fills several ranges
    (many rows without id, say) is dealt over them by its ties, which are
    hashes.
    """
    ranges = min(MOST_RANGES, max(1, rows.count() // RANGE_ROWS))
    if ranges == 1:
        return rows.withColumn("_cell", F.lit(0))
    shares = [i / ranges for i in range(1, ranges)]
    bounds = rows.agg(F.percentile_approx("_key", shares, max(10_000, 4 * ranges))).first()[0]
    width = math.isqrt(ranges)

    def literal(values: list[int]) -> Column:
        """One literal array, whatever its length."""
        return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")

    def before(inside) -> Column:
        """How many bounds fulfil ``inside``, as the first ones do: counted in the one block where it ends."""
        blocks = F.size(F.filter(literal(bounds[::width]), inside))
        block = F.slice(literal(bounds), (F.greatest(blocks, F.lit(1)) - 1) * width + 1, width)
        return F.greatest(blocks - 1, F.lit(0)) * width + F.size(F.filter(block, inside))

    key = F.col("_key")
    rows = rows.withColumns({"_upto": before(lambda b: b <= key), "_below": before(lambda b: b < key)})
    filled = F.col("_upto") - F.col("_below")
    share = F.floor((F.col("_tie") / F.lit(2.0 ** 64) + 0.5) * filled)
    cell = F.when(filled < 2, F.col("_upto")).otherwise(F.col("_below") + 1 + F.least(share, filled - 1))
    return rows.withColumn("_cell", cell.cast("int")).drop("_upto", "_below")


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, signatures and both of the next row (``next``) in ascending id order; the first follows the last.

    Rows are dealt into ranges of ids; only texts travel there and are signed
    on arrival. The first text of each range goes to the range before it as
    well, so that its last row finds it there. At most ``MOST_RANGES`` keys reach the driver.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = _ranges(docs.select(
        F.col(id_col).alias("doc_id"), text.alias("text"), F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("_key"),
        F.xxhash64(text).alias("_tie")))
    firsts = sorted(rows.groupBy("_cell").agg(F.min(F.struct("_key", "_tie")).alias("f")).select("_cell", "f.*").collect())
    heads = [(key, tie, firsts[i - 1][0]) for i, (_, key, tie) in enumerate(firsts)]
    told = rows.sparkSession.createDataFrame(heads, "_key long, _tie long, _before int")  # one row per range
    guests = rows.join(F.broadcast(told), ["_key", "_tie"]).groupBy("_before").agg(F.min("text").alias("text"))
    rows = rows.withColumn("_guest", F.lit(False)).unionByName(
        guests.select("text", F.col("_before").alias("_cell"), F.lit(True).alias("_guest")), allowMissingColumns=True)
    order = Window.partitionBy("_cell").orderBy("_guest", "_key", "_tie", "text")
    rows = with_signatures(rows.repartition("_cell"), "text", "signatures")
    rows = rows.withColumn("next", F.lead(F.struct("text", "signatures")).over(order))
    return rows.where(~F.col("_guest")).select("doc_id", "text", "signatures", "next")


def edited(text: Column, following: Column) -> Column:
    """The last half of the code points (rounded down) replaced by as many first ones of the following text, or all."""
    half = F.floor(F.char_length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - half), F.substring(following, F.lit(1), half))


def compare_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and its edited text, and the likeness to the edited and the next text."""
    rows = with_next(docs, id_col, text_col).select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"), "signatures",
        edited(F.col("text"), F.col("next.text")).alias("_edited"), F.col("next.signatures").alias("next_signatures"))
    rows = with_signatures(rows, "_edited", "edited_signatures").withColumn("edited_sha256", F.sha2("_edited", 256))
    own, new, other = F.col("signatures"), F.col("edited_signatures"), F.col("next_signatures")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint(own).alias("fingerprint"),
        fingerprint(new).alias("edited_fingerprint"), likeness(own, new).alias("near_edited"),
        likeness(own, other).alias("near_next"))


def similar_pairs(a: DataFrame, b: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b, likeness) of rows (id, signatures) that reach ``least``, each side's ids unique.

    Sets are partitioned by size on a geometric scale of ``1 / least``: only a
    set's own partition and the next can hold a partner. Inside, pairs meet on
    a signature of the prefix that any partner must share.
    """
    step = math.log(1 / least)

    def part(sets: Column) -> Column:
        return F.floor(F.log(F.size(sets)) / step)

    def prefixed(df: DataFrame, name: str, shifts: tuple[int, ...]) -> DataFrame:
        size = F.size("signatures")
        prefix = F.slice("signatures", 1, (size - F.ceil(size * least) + 1).cast("int"))
        spread = df.where(size > 0).select(F.col("id").alias(name), F.explode(prefix).alias("_sig"), part(F.col("signatures")).alias("_p"))
        return spread.select(name, "_sig", F.explode(F.array(*(F.col("_p") + s for s in shifts))).alias("_part"))

    pairs = prefixed(a, "a", (0,)).join(prefixed(b, "b", (-1, 0, 1)), ["_sig", "_part"]).select("a", "b").distinct()
    sets_a = a.select(F.col("id").alias("a"), F.col("signatures").alias("_sa"))
    sets_b = b.select(F.col("id").alias("b"), F.col("signatures").alias("_sb"))
    scored = pairs.join(sets_a, "a").join(sets_b, "b").select("a", "b", likeness(F.col("_sa"), F.col("_sb"), least).alias("likeness"))
    return scored.where(F.col("likeness") >= least)
