"""Building blocks that keep hot keys out of single tasks.

A key may hold a third of all rows. Everything here either pre-aggregates on the map
side or splits a key into bounded pieces; each shortcut is taken only behind a measured
size, and the general way beside it gives the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from tidegauge.runtime import cut

GROUP_LIMIT = 2_000_000       # rows of one key that one task may sort
VALUE_LIMIT = 50_000          # values of one key that one in-memory percentile may hold
SKETCH = 10_000               # accuracy of the sketches that narrow the search for a quantile
PIVOTS = 1_000                # values that a sketch proposes; a bracket narrows to three of their gaps
LOOKUP_ROWS = 500_000         # broadcast bounds, both are checked
LOOKUP_BYTES = 64 * 1024 * 1024
CHUNK_ROWS = 1_000_000

_ROW_INDEX_MASK = (1 << 33) - 1


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the most frequent key: one partially aggregated count, one number to the driver."""
    return df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0


def _broadcastable(lookup: DataFrame, rows: int, size: int) -> bool:
    """Whether the lookup's row count and bytes, both measured, stay within the bounds."""
    width = F.lit(16 * (len(lookup.columns) + 1))
    for name, kind in lookup.dtypes:
        if kind == "string":
            width = width + F.coalesce(F.octet_length(name), F.lit(0))
        elif kind.startswith(("array", "map", "struct")):
            width = width + F.coalesce(F.octet_length(F.to_json(F.struct(name))), F.lit(0))
    seen = lookup.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(width), F.lit(0)).alias("b")).first()
    return seen["n"] <= rows and seen["b"] <= size


def attach(left: DataFrame, lookup: DataFrame, on: Sequence[str], how: str = "inner",
           rows: int = LOOKUP_ROWS, size: int = LOOKUP_BYTES, share: int = GROUP_LIMIT,
           fixed: bool = False) -> DataFrame:
    """Join a per-key lookup (unique on `on`) to a large, possibly skewed side.

    The lookup is materialised once and measured. Within the bound it is broadcast and
    the large side does not move; beyond it the join is a shuffle in which every key with
    more than `share` rows is spread over as many salts as it has shares. `fixed` says that the
    lookup is materialised already.
    """
    lookup = lookup if fixed else cut(lookup)
    if _broadcastable(lookup, rows, size):
        return left.join(F.broadcast(lookup), list(on), how)
    counts = cut(left.groupBy(*on).agg(F.count(F.lit(1)).alias("_rows")))
    total = counts.agg(F.sum("_rows")).first()[0] or 0
    # At most LOOKUP_ROWS keys can exceed this share of all rows, so the hot keys can be broadcast.
    share = max(share, total // LOOKUP_ROWS + 1)
    hot = F.broadcast(counts.filter(F.col("_rows") > share).select(
        *on, F.ceil(F.col("_rows") / share).cast("bigint").alias("_salts")))
    salts = F.coalesce("_salts", F.lit(1).cast("bigint"))
    spread = (left.withColumn("_mix", F.xxhash64(*left.columns)).join(hot, list(on), "left")
              .withColumn("_salt", F.pmod("_mix", salts)).drop("_mix", "_salts"))
    copies = (lookup.join(hot, list(on), "left")
              .withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), salts - 1))).drop("_salts"))
    return spread.join(copies, [*on, "_salt"], how).drop("_salt")


def range_segments(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Sort globally and fix each row's segment (`_seg`) and index in it (`_idx`).

    Range partitioning splits even a single hot key as long as `order` tells its rows
    apart. The result is materialised: segment borders come from a sample, and both
    later reads must see the same ones.
    """
    return cut(
        df.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("_seg", F.spark_partition_id())
        .withColumn("_idx", F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_INDEX_MASK)))
    )


def segment_starts(segments: DataFrame, weight: Column) -> DataFrame:
    """Running total of `weight` before each segment: one row per shuffle partition."""
    before = Window.orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    totals = segments.groupBy("_seg").agg(F.sum(weight).alias("_weight"))
    return totals.select("_seg", F.coalesce(F.sum("_weight").over(before), F.lit(0)).alias("_start"))


def ordered_positions(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Add `_pos`, the row's 0-based position in the global order, without a global window."""
    segments = range_segments(df, order)
    starts = segment_starts(segments, F.lit(1))
    return (segments.join(F.broadcast(starts), "_seg")
            .withColumn("_pos", F.col("_start") + F.col("_idx"))
            .drop("_seg", "_idx", "_start"))


def preceding_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], rows: int,
                   columns: dict[str, Callable[[WindowSpec], Column]],
                   group_limit: int = GROUP_LIMIT, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Add columns computed over the `rows` rows before each row of its key.

    When every key is small enough for one task this is a plain window. Otherwise rows
    are numbered globally and cut into chunks of equal length; the last `rows` rows of
    a chunk are copied to the next one as context. A chunk then holds every frame it needs.
    """
    if largest_group(df, keys) <= group_limit:
        frame = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-rows, -1)
        return df.withColumns({name: make(frame) for name, make in columns.items()})
    chunk_rows = max(chunk_rows, rows)
    chunk = F.floor(F.col("_pos") / chunk_rows)
    tail = F.col("_pos") % chunk_rows >= chunk_rows - rows
    placed = ordered_positions(df, [*keys, *order]).withColumn(
        "_home", F.explode(F.when(tail, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    ).withColumn("_chunk", chunk + F.col("_home"))
    frame = Window.partitionBy("_chunk", *keys).orderBy("_pos").rowsBetween(-rows, -1)
    return (placed.withColumns({name: make(frame) for name, make in columns.items()})
            .filter(F.col("_home") == 0).drop("_pos", "_home", "_chunk"))


def _coded(keys: Sequence[str]) -> dict[str, Column]:
    """Columns that join null keys too: a text and a flag for each key."""
    codes = {f"_k{i}": F.coalesce(F.col(k).cast("string"), F.lit("")) for i, k in enumerate(keys)}
    return codes | {f"_z{i}": F.col(k).isNull() for i, k in enumerate(keys)}


def _most_values(rows: DataFrame, keys: Sequence[str]) -> int:
    """About how many different values the key with the most of them has: sketches of fixed size merge, no value moves."""
    return rows.groupBy(*keys).agg(F.approx_count_distinct("_v").alias("_values")).agg(F.max("_values")).first()[0] or 0


def _ranked_quantiles(tally: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], names: Sequence[str]) -> DataFrame:
    """Built-in percentile over few different values of each key, weighted by their counts."""
    found = tally.groupBy(*keys).agg(F.percentile(value, F.array(*[F.lit(float(p)) for p in probs]), F.col("_n")).alias("_q"))
    return found.select(*keys, *[F.col("_q")[i].alias(name) for i, name in enumerate(names)])


def grouped_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float],
                      names: Sequence[str], group_limit: int = VALUE_LIMIT, weight: str | None = None,
                      accuracy: int = SKETCH) -> DataFrame:
    """Exact quantiles per key with linear interpolation; a null key is a key like others. Null and NaN values don't count.

    `weight` names a column that says how many rows a row stands for.

    Keys of at most `group_limit` rows, or about as many different values, use the built-in percentile over values counted on
    the map side. With a larger key, each wanted rank is searched for in a bracket of values, for all keys at once: a mergeable sketch of the
    values inside the bracket proposes a narrower one, a second aggregate counts the rows below and inside, and the part that
    holds the rank becomes the bracket. A round narrows a bracket about `accuracy` / 2 times, so two or three are enough for any
    input. At last only the brackets' values are counted one by one. Nothing but brackets is ever stored.
    """
    number = F.col(weight).cast("bigint") if weight else F.lit(1).cast("bigint")
    rows = df.filter(F.col(value).isNotNull() & ~F.isnan(value)).select(
        *keys, F.col(value).cast("double").alias("_v"), number.alias("_w"))
    if largest_group(rows, keys) <= group_limit or _most_values(rows, keys) <= group_limit:
        tally = rows.groupBy(*keys, F.col("_v").alias(value)).agg(F.sum("_w").alias("_n"))
        return _ranked_quantiles(tally, keys, value, probs, names)

    codes = _coded(keys)
    rows = rows.withColumns(codes)
    many = range(len(probs))
    exact = [(F.col("_total") - 1) * F.lit(float(p)) for p in probs]
    ends = rows.groupBy(*codes).agg(
        *[F.first(k).alias(k) for k in keys], F.sum("_w").alias("_total"), F.min("_v").alias("_min"), F.max("_v").alias("_max")).select(
        *codes, *keys, "_total", *[F.col(f"_{end}").alias(f"{name}{i}") for i in many for end, name in (("min", "_lo"), ("max", "_hi"))])
    state = _counted(rows, cut(ends), list(codes), keys, many)
    wide = reduce(or_, [F.col(f"_inner{i}") > group_limit for i in many])
    while state.agg(F.bool_or(wide)).first()[0]:
        ends = _narrowed(rows, state, list(codes), keys, exact, group_limit, accuracy)
        state = _counted(rows, ends, list(codes), keys, many)

    # Few rows are left between the ends of each bracket; values are counted, which folds ties.
    left = attach(rows, state.drop(*keys), list(codes), fixed=True)
    picks = left.select(*codes, "_v", "_w", F.inline(F.filter(F.array(*[
        F.struct(F.lit(i).alias("_i"), _inside(i).alias("_is")) for i in many]), lambda e: e["_is"])))
    tally = picks.groupBy(*codes, "_i", "_v").agg(F.sum("_w").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*codes, "_i").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    placed = attach(tally.withColumn("_upto", upto), state.drop(*keys), list(codes), fixed=True)
    results = []
    for i, rank in enumerate(exact):
        start = F.col(f"_below{i}") + F.col("_upto") - F.col("_n")
        at = [F.max(F.when((F.col("_i") == i) & (start <= r) & (r < start + F.col("_n")), F.col("_v"))) for r in (F.floor(rank), F.ceil(rank))]
        results.append((at[0] + F.when(at[0] == at[1], 0.0).otherwise((at[1] - at[0]) * F.max(rank - F.floor(rank)))).alias(names[i]))
    found = placed.groupBy(*codes).agg(*results)
    return state.select(*codes, *keys).join(found, list(codes)).select(*keys, *names)


def _inside(i: int) -> Column:
    return (F.col("_v") >= F.col(f"_lo{i}")) & (F.col("_v") <= F.col(f"_hi{i}"))


def _weight(which: Column) -> Column:
    return F.sum(F.when(which, F.col("_w")).otherwise(0))


def _counted(rows: DataFrame, ends: DataFrame, codes: list[str], keys: Sequence[str], many: range) -> DataFrame:
    """Brackets with the rows below them, at their lower end, and strictly between their ends."""
    value = F.col("_v")
    counted = attach(rows, ends.drop(*keys), codes, fixed=True).groupBy(*codes).agg(*[c for i in many for c in (
        _weight(value < F.col(f"_lo{i}")).alias(f"_below{i}"), _weight(value == F.col(f"_lo{i}")).alias(f"_at{i}"),
        _weight((value > F.col(f"_lo{i}")) & (value < F.col(f"_hi{i}"))).alias(f"_inner{i}"))])
    return cut(ends.join(counted, codes))


def _narrowed(rows: DataFrame, state: DataFrame, codes: list[str], keys: Sequence[str], exact: Sequence[Column],
              limit: int, accuracy: int) -> DataFrame:
    """Ends of narrower brackets for those with more than `limit` rows between their ends.

    The sketch sees what lies strictly between the ends, so that a value that many rows share does not hide the others. Its
    pivots on both sides of where the rank should be are the new ends; a count then says whether they are.
    """
    value, many = F.col("_v"), range(len(exact))
    steps = F.array(*[F.lit(s / PIVOTS) for s in range(PIVOTS + 1)])
    joined = attach(rows, state.drop(*keys), codes, fixed=True)
    sketches = joined.groupBy(*codes).agg(*[F.percentile_approx(
        F.when((value > F.col(f"_lo{i}")) & (value < F.col(f"_hi{i}")) & (F.col(f"_inner{i}") > limit), value), steps, F.lit(accuracy)).alias(f"_s{i}")
        for i in many])
    proposed = []
    for i, rank in enumerate(exact):
        place = F.floor(F.try_divide(rank - F.col(f"_below{i}") - F.col(f"_at{i}"), F.col(f"_inner{i}")) * PIVOTS)
        low = F.when(place >= 1, F.get(f"_s{i}", F.least(place, F.lit(PIVOTS)).cast("int") - 1))
        high = F.when(place <= PIVOTS - 2, F.get(f"_s{i}", F.greatest(place, F.lit(-1)).cast("int") + 2))
        proposed += [F.coalesce(low, F.col(f"_lo{i}")).alias(f"_a{i}"), F.coalesce(high, F.col(f"_hi{i}")).alias(f"_b{i}")]
    proposal = cut(state.join(sketches, codes).select(*state.columns, *proposed))
    counted = attach(rows, proposal.drop(*keys), codes, fixed=True).groupBy(*codes).agg(*[c for i in many for c in (
        _weight(value < F.col(f"_a{i}")).alias(f"_x{i}"), _weight(value <= F.col(f"_b{i}")).alias(f"_y{i}"),
        F.max(F.when(_inside(i) & (value < F.col(f"_a{i}")), value)).alias(f"_u{i}"),
        F.min(F.when(_inside(i) & (value > F.col(f"_b{i}")), value)).alias(f"_o{i}"))])
    ends = []
    for i, rank in enumerate(exact):
        first, last = F.floor(rank), F.ceil(rank)
        left, right = first < F.col(f"_x{i}"), last >= F.col(f"_y{i}")
        # A neighbour of the rank outside the proposal is the value next to it, or lies with the other one on that side.
        low = (F.when(left & (last < F.col(f"_x{i}")), F.col(f"_lo{i}")).when(left, F.col(f"_u{i}"))
               .when(right & (first >= F.col(f"_y{i}")), F.col(f"_o{i}")).otherwise(F.col(f"_a{i}")))
        high = (F.when(right & (first >= F.col(f"_y{i}")), F.col(f"_hi{i}")).when(right, F.col(f"_o{i}"))
                .when(left & (last < F.col(f"_x{i}")), F.col(f"_u{i}")).otherwise(F.col(f"_b{i}")))
        kept = F.col(f"_inner{i}") <= limit
        ends += [F.when(kept, F.col(f"_lo{i}")).otherwise(low).alias(f"_lo{i}"), F.when(kept, F.col(f"_hi{i}")).otherwise(high).alias(f"_hi{i}")]
    return cut(proposal.join(counted, codes).select(*codes, *keys, "_total", *ends))
