"""Mixing overlapping sources to target weights by a min-cost flow.

Documents are aggregated by the set of sources they belong to (the
membership pattern). A flow routes each pattern's tokens to its sources'
quotas; using a pattern's tokens the first time is free, each repetition
costs more than the last, so nothing is repeated while fresh tokens could
fill the quota. Each pattern's flow is then realised by documents: whole
passes over all of them, and for the rest the documents first in a seeded
order, up to the first that no longer fits. What is still missing is filled
by sizes: for each copy number, fewest repetitions first, as many documents
of each size as fit, largest first, chosen in the seeded order. The smallest
copy left is added if that comes nearer. So a source of one pattern misses its
target by at most half of the smallest copy it did not use.

Only one row per pattern reaches the driver, and their number is checked
(``MOST_PATTERNS``): the mixture is a specification, not data. A source that
holds most rows is never sorted in one task: its cut in the seeded order is
found digit by digit with grouped sums, and the fill sees only counts by size.

A null source is a source of its own, last in order. Null sizes count as 0;
documents without size are never taken. Null and repeated ids are kept; a
place in the order comes from the id and a tie (a hash of the text, say), so
only rows that agree in both share one, and the fill takes them one by one.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salesprism.session import stage

MOST_PATTERNS = 50_000
REPEATS = 3  # times a document may be used
SEED = "mix-1"
HASH_DIGITS = 15  # hexadecimal digits of the seeded order
STEP = 3  # digits settled by each round
ROUNDS = 3
SALTS = 64


def words(text: Column) -> Column:
    """Number of words, parted by ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def quotas(sizes: Sequence[int], weights: Sequence[int], total: int) -> list[float]:
    """Shares of ``total`` by weight; a share stops at ``REPEATS`` times its source, the excess goes to the others."""
    capped: set[int] = set()
    while True:
        rest = total - sum(REPEATS * sizes[i] for i in capped)
        weight = sum(w for i, w in enumerate(weights) if i not in capped)
        over = {i for i in range(len(sizes)) if i not in capped and rest * weights[i] > REPEATS * sizes[i] * weight}
        if not over:
            return [float(REPEATS * s) if i in capped else rest * weights[i] / weight
                    for i, s in enumerate(sizes)]
        capped |= over


def min_cost_flow(
    patterns: Sequence[tuple[tuple[int, ...], int]], quota: Sequence[float], repeats: int = REPEATS
) -> list[float]:
    """Tokens taken of each pattern, given as (its sources, its tokens).

    Successive cheapest augmenting paths. Only the arcs into patterns cost
    anything, the k-th use of a token more than the one before, so the paths
    of one repetition level are exhausted before the next level opens.
    """
    need = list(quota)
    sent: list[dict[int, float]] = [{s: 0.0 for s in sources} for sources, _ in patterns]
    users: dict[int, list[int]] = {}
    for p, (sources, _) in enumerate(patterns):
        for s in sources:
            users.setdefault(s, []).append(p)
    taken = [0.0] * len(patterns)
    for _ in range(repeats):
        for p, (_, tokens) in enumerate(patterns):
            left = float(tokens)
            while left > 0:
                path = _path(p, sent, users, need)
                if path is None:
                    break
                amount = min([left, need[path[-1][1]], *(sent[q][s] for q, s in _returned(path))])
                for q, s in path:
                    sent[q][s] += amount
                for q, s in _returned(path):
                    sent[q][s] -= amount
                need[path[-1][1]] -= amount
                left -= amount
            taken[p] += tokens - left
    return taken


def _returned(path: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Arcs whose flow a path takes back: the next pattern gives up its share of this source."""
    return [(q, s) for (_, s), (q, _) in zip(path, path[1:], strict=False)]


def _path(start: int, sent, users, need) -> list[tuple[int, int]] | None:
    """Shortest chain of (pattern, source) arcs from a pattern to a source that still needs tokens."""
    came: dict[int, tuple[int, int] | None] = {start: None}
    seen: set[int] = set()
    queue = deque([start])
    while queue:
        p = queue.popleft()
        for s in sent[p]:
            if s in seen:
                continue
            seen.add(s)
            if need[s] > 1e-9:
                path, at = [(p, s)], came[p]
                while at is not None:
                    path.append(at)
                    at = came[at[0]]
                return path[::-1]
            for q in users[s]:
                if q not in came and sent[q][s] > 1e-9:
                    came[q] = (p, s)
                    queue.append(q)
    return None


def mix(
    docs: DataFrame, members: Column, size: Column, id_col: str = "doc_id", seed: str = SEED,
    carry: Column | None = None, tie: Column | None = None,
) -> DataFrame:
    """Rows with their sources, the first source's size and target, and the copies taken.

    ``members`` is the array of a row's sources. Sources in code point order,
    null last, weigh 1, 2, 3, 1, 2, 3, ... and share all tokens.
    ``tie`` parts rows of one id in the seeded order.
    Returns doc_id, size, members, source_size, target, copies; and ``carry``, if given.
    """
    name = (F.coalesce(c.cast("string"), F.lit("")) for c in (F.col(id_col), F.lit("") if tie is None else tie))
    place = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), *name)), 1, HASH_DIGITS), 16, 10).cast("long")
    more = {} if carry is None else {"_carry": carry}
    rows = stage(docs.select(
        F.col(id_col).alias("_id"), F.coalesce(size, F.lit(0)).cast("long").alias("_size"),
        F.array_sort(F.array_distinct(members)).alias("_members"), place.alias("_place"),
        F.monotonically_increasing_id().alias("_row"),  # written once, so it does not change
        *(c.alias(n) for n, c in more.items())), "mix-rows")
    found = rows.groupBy("_members").agg(F.sum("_size").alias("tokens")).limit(MOST_PATTERNS + 1).collect()
    if len(found) > MOST_PATTERNS:
        raise ValueError(f"over {MOST_PATTERNS} membership patterns: a mixture needs fewer, coarser sources")
    spark = rows.sparkSession
    names = sorted({m for r in found for m in r[0]}, key=lambda m: (m is None, m or ""))
    number = {m: i for i, m in enumerate(names)}
    patterns = [(tuple(number[m] for m in r[0]), r[1]) for r in found]
    sizes = [0] * len(names)
    for sources, tokens in patterns:
        for s in sources:
            sizes[s] += tokens
    target = quotas(sizes, [1 + i % 3 for i in range(len(names))], sum(t for _, t in patterns)) if names else []
    taken = min_cost_flow(patterns, target)
    plan_rows = []
    for r, (sources, tokens), amount in zip(found, patterns, taken, strict=True):
        full = min(REPEATS, int(amount // tokens)) if tokens else 0
        first = sources[0] if sources else None
        plan_rows.append((
            r[0], full, float(amount - full * tokens),
            sizes[first] if sources else None, target[first] if sources else None))
    schema = f"_members {rows.schema['_members'].dataType.simpleString()}, _full int, _rest double, " \
             "_source_size bigint, _target double"
    plan = spark.createDataFrame(plan_rows, schema)  # at most MOST_PATTERNS rows
    key = F.to_json(F.struct("_members"), {"ignoreNullFields": "false"}).alias("_pattern")
    plan = plan.select(key, "_full", "_rest", "_source_size", "_target")
    keyed = rows.select("*", key)
    cut = plan.select("_pattern", "_full", "_rest").join(_cuts(keyed, plan), "_pattern", "left").select(
        "_pattern", "_full", "_cut", (F.col("_rest") - F.coalesce(F.col("_before"), F.lit(0))).alias("_lack"))
    extra = _fill(keyed, cut)
    chosen = keyed.join(F.broadcast(plan), "_pattern").join(
        F.broadcast(cut.select("_pattern", "_cut")), "_pattern", "left").join(extra, "_row", "left")
    copies = F.col("_full") + _sure().cast("int") + F.coalesce(F.col("_extra"), F.lit(0))
    return chosen.select(
        F.col("_id").alias("doc_id"), F.col("_size").alias("size"), F.col("_members").alias("members"),
        F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), copies.cast("int").alias("copies"),
        *(F.col(n).alias("carry") for n in more))


def _sure() -> Column:
    """Whether a document lies before the cut."""
    return F.coalesce(F.col("_place") < F.col("_cut"), F.lit(False)) & (F.col("_size") > 0)


def _fill(rows: DataFrame, cut: DataFrame) -> DataFrame:
    """Copies beyond the cut: (_row, _extra).

    A pattern's counts by copy number and size are folded in order; a size
    takes ``missing / size`` copies at most, so a chosen (copy number, size)
    needs no more than that many documents, the first in the seeded order.
    Since ever less is missing, a second copy is chosen only of sizes whose
    first copies all were. A fold holds one entry per copy number and distinct
    size below twice what is missing, whatever the number of documents.
    """
    fits = rows.join(F.broadcast(cut), "_pattern").where(
        (F.col("_size") > 0) & (F.col("_size") < 2 * F.col("_lack")))
    used = F.col("_full") + _sure().cast("int")
    fits = stage(
        fits.where(used < REPEATS).select(
            "_pattern", "_size", "_place", "_row", F.explode(F.sequence(used + 1, F.lit(REPEATS))).alias("_copy")),
        "mix-fits")
    counts = fits.groupBy("_pattern", "_copy", "_size").agg(F.count(F.lit(1)).alias("_n"))
    entry = F.struct("_copy", (-F.col("_size")).alias("_order"), "_n")
    none = F.array().cast("array<struct<_copy:int,_size:bigint,_take:bigint>>")

    def one(size: Column, copy: Column) -> Column:
        return F.struct(size.alias("_size"), copy.alias("_copy"))

    def step(state: Column, e: Column) -> Column:
        fit = F.least(e["_n"], F.floor(state["lack"] / -e["_order"])).cast("bigint")
        took = F.struct(e["_copy"].alias("_copy"), (-e["_order"]).alias("_size"), fit.alias("_take"))
        return F.struct(
            (state["lack"] + fit * e["_order"]).alias("lack"),
            F.when(fit > 0, F.concat(state["took"], F.array(took))).otherwise(state["took"]).alias("took"),
            F.least(state["spare"], F.when(fit < e["_n"], one(-e["_order"], e["_copy"]))).alias("spare"))

    def finish(state: Column) -> Column:
        spare = F.struct(state["spare"]["_copy"].alias("_copy"), state["spare"]["_size"].alias("_size"), F.lit(1).cast("bigint").alias("_take"))
        nearer = F.coalesce(state["spare"]["_size"] < 2 * state["lack"], F.lit(False))
        return F.when(nearer, F.concat(state["took"], F.array(spare))).otherwise(state["took"])

    folded = counts.groupBy("_pattern").agg(F.array_sort(F.collect_list(entry)).alias("_entries")).join(
        F.broadcast(cut.select("_pattern", "_lack")), "_pattern")
    start = F.struct(
        F.col("_lack").cast("double").alias("lack"), none.alias("took"),
        F.lit(None).cast("struct<_size:bigint,_copy:int>").alias("spare"))
    took = folded.select("_pattern", F.explode(F.aggregate("_entries", start, step, finish)).alias("t")).groupBy(
        "_pattern", "t._copy", "t._size").agg(F.sum("t._take").alias("_take"))
    wanted = fits.join(took, ["_pattern", "_copy", "_size"])
    # the first of each salt, then of all: a size that a third of all rows have is never sorted in one task
    group = ["_pattern", "_copy", "_size"]
    salt = F.pmod(F.xxhash64("_row"), F.lit(SALTS))
    for keys in ([*group, salt], group):
        first = F.row_number().over(Window.partitionBy(*keys).orderBy("_place", "_row"))
        wanted = wanted.withColumn("_rank", first).where(F.col("_rank") <= F.col("_take"))
    return stage(wanted.groupBy("_row").agg(F.count(F.lit(1)).alias("_extra")), "mix-extra")


def _cuts(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """For each pattern, the place of the first document that no longer fits the rest, and the tokens before it.

    Each round sums tokens by the next ``STEP`` digits of the place, inside the
    cell that the round before has settled on; a last window orders the few
    rows that share all settled digits. Patterns whose rows all fit get a cut
    past the last place.
    """
    end = 16 ** HASH_DIGITS
    state = plan.select("_pattern", "_rest", F.lit(0).cast("bigint").alias("_cell"), F.lit(0).cast("bigint").alias("_before"))
    shift = 4 * HASH_DIGITS
    order = Window.partitionBy("_pattern").orderBy("_next").rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def advance(shift_old: int, shift_new: int, state: DataFrame) -> DataFrame:
        inside = rows.join(F.broadcast(state), "_pattern").where(F.shiftright("_place", shift_old) == F.col("_cell"))
        sums = (
            inside.groupBy("_pattern", "_rest", "_before", F.shiftright("_place", shift_new).alias("_next"))
            .agg(F.sum("_size").alias("_sum"))
            .withColumn("_upto", F.col("_before") + F.sum("_sum").over(order))
        )
        over = F.when(F.col("_upto") > F.col("_rest"), F.struct("_next", (F.col("_upto") - F.col("_sum")).alias("b")))
        found = sums.groupBy("_pattern", "_rest").agg(F.min(over).alias("_at"), F.max("_upto").alias("_all"))
        return stage(found.select(
            "_pattern", "_rest", F.coalesce(F.col("_at._next"), F.lit(end >> shift_new)).alias("_cell"),
            F.coalesce(F.col("_at.b"), F.col("_all")).alias("_before")), "mix-cut")

    for _ in range(ROUNDS):
        state = advance(shift, shift - 4 * STEP, state)
        shift -= 4 * STEP
    past = state.where(F.col("_cell") >= (end >> shift)).select("_pattern", F.lit(end).alias("_cut"), "_before")
    settled = advance(shift, 0, state.where(F.col("_cell") < (end >> shift)))
    return past.union(settled.select("_pattern", F.col("_cell").alias("_cut"), "_before"))
