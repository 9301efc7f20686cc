"""Near-duplicate groups with SuperMinHash, banding, exact verification and union-find by joins.

1. Each text becomes a set of 64-bit shingle hashes and a SuperMinHash
   signature: every element visits the slots in the order of a random
   permutation, and its j-th visit offers j plus a fraction, so the slots of
   one element are correlated and the estimate varies less. Once every slot
   holds less than j, no later visit can matter: that is the early stop.
2. Texts with equal sets are one class, so copies cost one signature row.
3. Bands of the signature give buckets. Each class of a bucket is compared
   with the bucket's centre: the class that shares buckets with most others.
   The original of a crowd of near copies is such a class, so one round links
   nearly all of them.
4. A pair is a link if its full sets pass the exact integer test. Classes of
   buckets that still hold several components are joined by an exact
   prefix filter: shingles in order of frequency, those within one component
   first; two sets alike enough share one among the rarest of each. Classes
   of one component, or without rare shingles in common, are never paired.
5. Components come from alternating large-star and small-star joins.

With ``BANDS`` x ``ROWS`` a pair at the threshold of 0.85 is a candidate with
probability 1 - 2e-6 (at 0.8: 1 - 7e-5). Nothing but counts reaches the driver.

Null and empty texts, and texts without words, have an empty set, no links,
and are their own component. Rows that repeat an id are one node if their
texts are equal; a null id is a node like any other and smaller than none.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesprism.llm.words import Hasher, blocks, mixed, raw_bytes, spaced
from salesprism.session import stage

BANDS, ROWS = 28, 6
SLOTS = BANDS * ROWS
BLOCK = 1 << 15  # elements whose permutations are held at once
SALTS = 32  # parts among which the pairs of one class are dealt
TEXT_BYTES = 1 << 20  # texts whose sets are made at once
HASHED = 1 << 18  # bytes of them hashed at once
PAIRS = 256  # pairs of sets looked at together
LEVEL_BITS = 8
MIX = np.uint64(0x9E3779B97F4A7C15)


class Shingler:
    """Sets of shingle hashes, sorted; words are parted by ASCII white space, A-Z folded. Keeps no words."""

    def __init__(self, width: int):
        self.width, self.hasher = width, Hasher(spaced(), HASHED)

    def sets_of(self, texts: pa.StringArray) -> list[np.ndarray]:
        raw, begins = raw_bytes(texts)
        first, code = self.hasher.words(raw, begins)
        edges = np.searchsorted(first, begins)
        return [self._set(code[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]

    def _set(self, found: np.ndarray) -> np.ndarray:
        if not len(found):
            return np.empty(0, np.uint64)
        width = min(self.width, len(found))
        count = len(found) - width + 1
        out = np.full(count, width, np.uint64)
        for i in range(width):
            out = mixed(out * MIX + found[i:i + count])
        return np.unique(out)


def signatures(sets: Sequence[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash of each set, as (sets, slots); an empty set keeps the largest value in every slot."""
    out = np.full((len(sets), slots), np.iinfo(np.uint64).max, np.uint64)
    begin = 0
    while begin < len(sets):
        end, load = begin + 1, len(sets[begin])
        while end < len(sets) and load + len(sets[end]) <= BLOCK:
            load += len(sets[end])
            end += 1
        row = np.repeat(np.arange(begin, end), [len(s) for s in sets[begin:end]])
        items = np.concatenate(sets[begin:end])
        for at in range(0, len(items), BLOCK):
            _visit(out, items[at:at + BLOCK], row[at:at + BLOCK])
        begin = end
    return out


def _visit(out: np.ndarray, items: np.ndarray, row: np.ndarray) -> None:
    slots = out.shape[1]
    order = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.uint32), (len(items), 1))
    for level in range(slots):
        chance = mixed(items + np.array([2 * level + 1], np.uint64) * MIX)
        pick = level + (mixed(chance + MIX) % np.uint64(slots - level)).astype(np.int64)
        each = np.arange(len(items))
        slot = order[each, pick]
        order[each, pick] = order[:, level]
        value = (np.uint64(level) << np.uint64(64 - LEVEL_BITS)) | (chance >> np.uint64(LEVEL_BITS))
        np.minimum.at(out.reshape(-1), row * slots + slot, value)
        # a row is settled when the next level's least value beats no slot
        rows = np.unique(row)
        unsettled = rows[out[rows].max(axis=1) >= np.uint64(level + 1) << np.uint64(64 - LEVEL_BITS)]
        if len(unsettled) == 0 or level + 1 == slots:
            return
        if len(unsettled) < len(rows):
            stay = np.isin(row, unsettled)
            items, row, order = items[stay], row[stay], order[stay]


def bands_of(signature: np.ndarray) -> np.ndarray:
    """One 64-bit hash per band, as (sets, bands)."""
    out = np.zeros((len(signature), BANDS), np.uint64)
    for band in range(BANDS):
        value = np.full(len(signature), band + 1, np.uint64)
        for i in range(ROWS):
            value = mixed(value * MIX + signature[:, band * ROWS + i])
        out[:, band] = value
    return out


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_hash"), text.alias("text"))


def describe(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """Per row: _id, _hash (of the text), _n (set size), _key (digest of the set, null if empty), _bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for batch in batches:
            for begin, end in blocks(batch.column("text"), TEXT_BYTES):
                part = batch.slice(begin, end - begin)
                sets = shingler.sets_of(part.column("text"))
                bands = bands_of(signatures(sets)).astype(np.int64)
                keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([
                    part.column("_id"), part.column("_hash"), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()),
                    pa.FixedSizeListArray.from_arrays(pa.array(bands.reshape(-1)), BANDS).cast(pa.list_(pa.int64())),
                ], ["_id", "_hash", "_n", "_key", "_bands"])

    rows = _texts(docs, id_col, text_col)
    return rows.mapInArrow(run, f"_id {rows.schema['_id'].dataType.simpleString()}, _hash long, _n long, _key binary, _bands array<long>")


def class_sets(keyed: DataFrame, width: int) -> DataFrame:
    """(_key, _set) of rows (_key, text): the shingle hashes of each class, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for batch in batches:
            for begin, end in blocks(batch.column("text"), TEXT_BYTES):
                part = batch.slice(begin, end - begin)
                sets = [x.astype(np.int64) for x in shingler.sets_of(part.column("text"))]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
                flat = np.concatenate(sets) if sets else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("_key"), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))], ["_key", "_set"])

    return keyed.select("_key", "text").mapInArrow(run, "_key binary, _set array<long>")


def verified(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) whose full sets are alike enough.

    The sets of a side are dealt by (class, salt), so a class with many pairs
    is spread over tasks and is repeated only where it has pairs.
    """
    dealt = pairs.withColumn("_salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
    left = dealt.select("a", "_salt").distinct().join(sets.select(F.col("_key").alias("a"), F.col("_set").alias("_sa")), "a")
    right = dealt.join(sets.select(F.col("_key").alias("b"), F.col("_set").alias("_sb")), "b")
    both = right.join(left, ["a", "_salt"])
    common = F.size(F.array_intersect("_sa", "_sb"))
    return both.where(100 * common >= threshold * (F.size("_sa") + F.size("_sb") - common)).select("a", "b")


def alike_across(residual: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Pairs (a, b) of classes of different roots that may be alike enough: every such pair that is, and few others.

    ``residual`` holds (_key, _n, _root). Shingles that stand in one root only
    come first in the order, the others by the number of classes that have
    them. Of a set of n, two sets that share t hundredths share one of the
    first n - ceil(t * n / 100) + 1, and the places of the first one shared
    bound what can follow.
    """
    each = residual.join(sets, "_key").select("_key", "_n", "_root", F.explode("_set").alias("_token"))
    across = each.groupBy("_token").agg(
        F.count(F.lit(1)).alias("_df"), F.min("_root").alias("_low"), F.max("_root").alias("_high"),
    ).where(F.col("_low") != F.col("_high")).select("_token", "_df")
    ranked = each.join(across, "_token").groupBy("_key", "_n", "_root").agg(
        F.sort_array(F.collect_list(F.struct("_df", "_token"))).alias("_shared"))
    ahead = F.col("_n") - F.size("_shared")  # shingles that no other root has
    prefix = F.col("_n") - F.ceil(F.lit(threshold) * F.col("_n") / 100) + 1
    heads = ranked.withColumns({"_ahead": ahead, "_take": (prefix - ahead).cast("int")}).where(F.col("_take") > 0)
    posts = stage(heads.select("_key", "_n", "_root", "_ahead", F.posexplode(F.slice("_shared", F.lit(1), F.col("_take"))).alias("_i", "_t")).select(
        "_key", "_n", "_root", (F.col("_ahead") + F.col("_i")).alias("_at"), F.col("_t._token").alias("_token")), "minhash-prefixes")
    # a token that is in the prefixes of one root only pairs nothing
    live = posts.groupBy("_token").agg(F.min("_root").alias("_low"), F.max("_root").alias("_high")).where(
        F.col("_low") != F.col("_high")).select("_token")
    left = posts.join(live, "_token", "left_semi")
    right = left.select("_token", *[F.col(c).alias(f"{c}b") for c in ("_key", "_n", "_root", "_at")])
    both = F.col("_n") + F.col("_nb")
    rest = 1 + F.least(F.col("_n") - F.col("_at") - 1, F.col("_nb") - F.col("_atb") - 1)
    on = (
        (left["_token"] == right["_token"]) & (F.col("_root") < F.col("_rootb"))
        & (100 * F.least("_n", "_nb") >= threshold * F.greatest("_n", "_nb")) & ((100 + threshold) * rest >= threshold * both))
    return left.join(right, on).select(F.col("_key").alias("a"), F.col("_keyb").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b): large-star and small-star by turns, until nothing moves."""
    edges = stage(links.select("a", "b").where(F.col("a") != F.col("b")).distinct(), "minhash-links")
    state = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where(F.col("a") != F.col("b")).distinct()
        # now every row leads from a node to a smaller one
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(small, "a")
        edges = stage(
            joined.select(F.col("b").alias("a"), F.col("m").alias("b")).where(F.col("a") != F.col("b"))
            .union(small.select("a", F.col("m").alias("b"))).distinct(), "minhash-links")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = tuple(now)


def _grouped(docs: DataFrame, width: int, threshold: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): each row's _id, _hash, _n, _key; each class's _key, _root of its component and _least id."""
    rows = stage(describe(docs, id_col, text_col, width), "minhash-rows")
    filled = rows.where(F.col("_key").isNotNull())
    classes = filled.groupBy("_key").agg(
        F.first("_n").alias("_n"), F.min("_id").alias("_least"), F.first("_bands").alias("_bands"))
    buckets = classes.select("_key", "_n", F.posexplode("_bands").alias("_band", "_bucket"))
    crowded = buckets.groupBy("_band", "_bucket").agg(F.count(F.lit(1)).alias("_many")).where(F.col("_many") > 1)
    members = stage(buckets.join(crowded, ["_band", "_bucket"]), "minhash-members")
    shared = members.groupBy("_key").agg(F.sum("_many").alias("_score"))
    scored = members.join(shared, "_key")
    centres = scored.groupBy("_band", "_bucket").agg(F.max(F.struct("_score", "_key", "_n")).alias("_centre"))
    near = 100 * F.least("_n", "_centre._n") >= threshold * F.greatest("_n", "_centre._n")
    pairs = members.join(centres, ["_band", "_bucket"]).where((F.col("_key") != F.col("_centre._key")) & near).select(
        F.col("_centre._key").alias("a"), F.col("_key").alias("b")).distinct()
    wanted = members.select("_key").distinct()
    sample = rows.join(wanted, "_key", "left_semi").groupBy("_key").agg(
        F.min(F.struct("_id", "_hash")).alias("_one")).select("_key", F.col("_one._id").alias("_i"), F.col("_one._hash").alias("_h"))
    # one text of each class, found by id and text so that null and repeated ids do no harm
    keyed = _texts(docs, id_col, text_col).join(
        sample, (F.col("_hash") == F.col("_h")) & F.col("_id").eqNullSafe(F.col("_i"))).dropDuplicates(["_key"])
    sets = stage(class_sets(keyed, width), "minhash-sets")
    links = stage(verified(pairs, sets, threshold), "minhash-star")
    roots = components(links)
    placed = members.join(roots, members["_key"] == roots["node"], "left").select(
        "_key", "_n", "_band", "_bucket", F.coalesce("root", "_key").alias("_root"))
    split = placed.groupBy("_band", "_bucket").agg(
        F.min("_root").alias("_low"), F.max("_root").alias("_high")).where(F.col("_low") != F.col("_high"))
    residual = stage(placed.join(split.select("_band", "_bucket"), ["_band", "_bucket"], "left_semi").select(
        "_key", "_n", "_root").distinct(), "minhash-residual")
    more = verified(alike_across(residual, sets, threshold), sets, threshold)
    joined = components(links.union(more))
    group = classes.select("_key", "_least").join(joined, F.col("_key") == F.col("node"), "left").select(
        "_key", "_least", F.coalesce("root", "_key").alias("_root"))
    return rows, group


def near_duplicates(
    docs: DataFrame, width: int = 5, threshold: int = 80, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest id of its group), kept (its id is that one).

    ``threshold`` is in hundredths of the Jaccard similarity of word shingles.
    Other columns are not carried.
    """
    rows, group = _grouped(docs, width, threshold, id_col, text_col)
    smallest = group.groupBy("_root").agg(F.min("_least").alias("_smallest"), F.count(F.lit(1)).alias("_classes"))
    # a component of one class needs no join to name it
    named = group.join(smallest.where(F.col("_classes") > 1), "_root").select("_key", "_smallest")
    own = group.select("_key", "_least").join(named, "_key", "left").select(
        "_key", F.coalesce("_smallest", "_least").alias("_component"))
    # copies of one text may be a third of all rows: they are dealt by salt, their class repeated per salt
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("_id"), F.lit(SALTS)))
    copies = salted.where(F.col("_key").isNotNull()).select("_key", "_salt").distinct().join(own, "_key")
    component = F.coalesce("_component", "_id")
    return salted.drop("_bands", "_hash").join(copies, ["_key", "_salt"], "left").select(
        F.col("_id").alias("doc_id"), F.col("_n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(component.eqNullSafe(F.col("_id")), F.lit(False)).alias("kept"))


def one_of_each(docs: DataFrame, width: int = 5, threshold: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents without the near copies: one row of each group stays, all its columns with it.

    The row with the least id stays (an id before none, then by a hash of the
    text), once if it is repeated. Rows are told apart by id and text, so a
    text is not lost because its id also belongs to another. Rows without
    words stay, all of them.
    """
    rows, group = _grouped(docs, width, threshold, id_col, text_col)
    salted = rows.where(F.col("_key").isNotNull()).select(
        "_id", "_hash", "_key", F.pmod(F.xxhash64("_id", "_hash"), F.lit(SALTS)).alias("_salt"))
    distinct = salted.groupBy("_id", "_hash", "_key", "_salt").agg(F.count(F.lit(1)).alias("_times"))
    place = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_hash").alias("hash"))
    copies = salted.select("_key", "_salt").distinct().join(group.select("_key", "_root"), "_key")
    rooted = stage(distinct.join(copies, ["_key", "_salt"]).select("_id", "_hash", "_times", "_root"), "minhash-rooted")
    several = rooted.groupBy("_root").agg(F.min(place).alias("_first"), F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > 1)
    # rows that go, and rows that stay once of several times; all others stay as they are
    gone = rooted.join(several, "_root").where(place != F.col("_first")).select("_id", "_hash", F.lit(True).alias("_gone"))
    again = rooted.where(F.col("_times") > 1).select("_id", "_hash", F.lit(False).alias("_gone"))
    marked = stage(gone.unionByName(again).groupBy("_id", "_hash").agg(F.max("_gone").alias("_gone")), "minhash-marked")
    whole = docs.select(F.struct("*").alias("_row"))  # so that no column of the documents can clash
    text = F.xxhash64(F.col(f"_row.{text_col}").cast("string"))
    found = whole.join(marked, (text == F.col("_hash")) & F.col(f"_row.{id_col}").eqNullSafe(F.col("_id")), "left")
    single = found.where(F.col("_gone").isNull()).select("_row.*")
    repeated = found.where(~F.col("_gone")).dropDuplicates(["_hash", "_id"]).select("_row.*")
    return single.unionByName(repeated)
