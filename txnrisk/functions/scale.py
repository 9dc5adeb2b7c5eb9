"""Building blocks that keep one task from having to hold a whole group.

* ``salted_join``   equi-join in which single keys of the left side may hold a
  large share of all rows
* ``small_join``    lookup join that broadcasts only behind a row-count check
* ``global_index``  dense row numbers over a total order
* ``running_sums``  running sums over a total order, optionally per group
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from txnrisk.session import checkpoint

HOT_ROWS_CONF = "spark.txnrisk.hotKeyRows"
HOT_ROWS_DEFAULT = 1_000_000
BROADCAST_ROWS_CONF = "spark.txnrisk.broadcastRows"
BROADCAST_ROWS_DEFAULT = 200_000


def hot_rows(spark: SparkSession) -> int:
    """Rows of one key that one task may take before the key is split."""
    return int(spark.conf.get(HOT_ROWS_CONF, str(HOT_ROWS_DEFAULT)))


def broadcast_rows(spark: SparkSession) -> int:
    """Largest row count that a lookup table may have to be broadcast."""
    return int(spark.conf.get(BROADCAST_ROWS_CONF, str(BROADCAST_ROWS_DEFAULT)))


def stack(parts: Sequence[DataFrame]) -> DataFrame:
    """Union by name of one or more tables."""
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def _match(left: str, right: str, keys: Sequence[str], null_safe: bool) -> Column:
    cond = F.lit(True)
    for k in keys:
        a, b = F.col(f"{left}.{k}"), F.col(f"{right}.{k}")
        cond = cond & (a.eqNullSafe(b) if null_safe else a == b)
    return cond


def salted_join(
    big: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    spread: str | Sequence[str],
    weight: str,
    how: str = "left",
    null_safe: bool = False,
    rows: int | None = None,
    stored: bool = False,
) -> DataFrame:
    """Join ``big`` to ``small`` on ``on``; ``small`` has one row per key.

    ``small[weight]`` is the number of rows of ``big`` with that key (an upper
    bound will do). A key above ``spark.txnrisk.hotKeyRows`` is split: its rows
    are spread over several salts by a hash of ``spread`` and its row of
    ``small`` is repeated once per salt. The hash makes a retried task place its
    rows as before.

    ``small`` is checkpointed, unless ``stored`` says that it comes straight from
    a checkpoint or a table, and asked once for its largest weight. Without a hot
    key the join is a plain one and Catalyst picks the strategy; so it is, without
    asking, when the caller knows that ``big`` has at most hotKeyRows ``rows``.
    The broadcast list of hot keys has at most (rows of big / hotKeyRows) rows,
    because each of them accounts for more than hotKeyRows rows.
    """
    limit = hot_rows(big.sparkSession)
    spread = [spread] if isinstance(spread, str) else list(spread)
    keys = list(on)
    added = [c for c in small.columns if c not in keys and c != weight]
    plain = rows is not None and rows <= limit
    if not plain:
        small = small if stored else checkpoint(small)
        plain = (small.agg(F.max(weight)).first()[0] or 0) <= limit
    if plain:
        return big.alias("l").join(
            small.alias("r"), _match("l", "r", keys, null_safe), how
        ).select("l.*", *[F.col(f"r.{c}") for c in added])
    salts = F.greatest(F.lit(1), F.ceil(F.coalesce(F.col(weight), F.lit(0)) / F.lit(limit))).cast("int")
    hot = small.filter(F.col(weight) > limit).select(*keys, salts.alias("_salts"))
    left = (
        big.alias("b")
        .join(F.broadcast(hot).alias("h"), _match("b", "h", keys, null_safe), "left")
        .select("b.*", F.coalesce("h._salts", F.lit(1)).alias("_n"))
        .withColumn("_salt", F.pmod(F.xxhash64(*spread), F.col("_n")).cast("int"))
        .drop("_n")
    )
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    joined = left.alias("l").join(
        right.alias("r"),
        _match("l", "r", keys, null_safe) & (F.col("l._salt") == F.col("r._salt")),
        how,
    )
    kept = [F.col(f"l.{c}") for c in big.columns]
    return joined.select(*kept, *[F.col(f"r.{c}") for c in added])


def counted_keys(big: DataFrame, small: DataFrame, on: Sequence[str], weight: str) -> DataFrame:
    """Every key of ``big`` with its row count and the columns of ``small``, if any.

    Prepares ``small`` for ``salted_join`` when it does not know the row counts.
    """
    counts = big.groupBy(*on).agg(F.count(F.lit(1)).alias(weight))
    return counts.join(small, list(on), "left")


def small_join(
    big: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    spread: str | Sequence[str],
    weight: str,
    null_safe: bool = False,
) -> DataFrame:
    """Left join to a lookup table that is usually tiny but has no proven size.

    ``small`` must be cheap to count (a checkpoint or a written table). Up to
    ``spark.txnrisk.broadcastRows`` rows it is broadcast, beyond that the join
    is a salted shuffle join.
    """
    limit = broadcast_rows(big.sparkSession)
    if small.limit(limit + 1).count() > limit:
        return salted_join(big, small, on, spread, weight, null_safe=null_safe, stored=True)
    added = [c for c in small.columns if c not in on and c != weight]
    joined = big.alias("l").join(
        F.broadcast(small).alias("r"), _match("l", "r", on, null_safe), "left"
    )
    return joined.select("l.*", *[F.col(f"r.{c}") for c in added])


def global_index(df: DataFrame, order: Sequence[str | Column], out: str = "idx") -> DataFrame:
    """Dense numbers 0, 1, ... in the given total order, without a one-task window.

    Range partitions are sorted and numbered locally, then shifted by the number
    of rows in the partitions before them. The checkpoint fixes the partitioning,
    so that counts and local numbers belong to the same layout. The broadcast
    offset table has one row per partition.
    """
    low = (1 << 33) - 1  # monotonically_increasing_id keeps the row in the low 33 bits
    numbered = checkpoint(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_id", F.monotonically_increasing_id())
    )
    part = F.shiftright("_id", 33)
    row = F.col("_id").bitwiseAND(F.lit(low))
    sizes = numbered.groupBy(part.alias("_part")).agg((F.max(row) + 1).alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_off"))
    return (
        numbered.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(out, F.col("_off") + row)
        .drop("_part", "_off", "_id")
    )


def running_sums(
    df: DataFrame,
    key: str,
    sums: Sequence[str],
    by: Sequence[str] = (),
    descending: bool = True,
    levels: int | None = None,
) -> DataFrame:
    """Add ``cum_<c>``: sum of ``c`` over this and all preceding keys of the group.

    ``df`` has one row per (by, key). It is read three times (cuts, totals, rows),
    so it is checkpointed first: what it was computed from is read once. Keys are cut
    into 2^levels ranges at approximate quantiles; without ``levels`` as many as
    keep a range at an eighth of hotKeyRows, and 128 at least, even if a single
    group or none is given. Wherever the cuts fall, the
    sums are exact: each range adds the totals of the ranges before it.
    """
    by = list(by)
    df = checkpoint(df)
    if levels is None:
        levels = max(7, math.ceil(math.log2(max(1, 8 * df.count() / hot_rows(df.sparkSession)))))
    ranges = 1 << levels
    cuts = df.agg(
        F.percentile_approx(key, [i / ranges for i in range(1, ranges)], max(10_000, 16 * ranges)).alias("cuts")
    ).scalar()
    # number of cuts below the key, by bisection
    ranged = df.withColumn("_cuts", cuts).withColumn("_range", F.lit(0))
    for level in reversed(range(levels)):
        step = 1 << level
        below = F.element_at("_cuts", F.col("_range") + step) < F.col(key)
        ranged = ranged.withColumn("_range", F.col("_range") + F.when(below, step).otherwise(0))
    if descending:
        ranged = ranged.withColumn("_range", -F.col("_range"))
    ranged = ranged.drop("_cuts")
    totals = ranged.groupBy(*by, "_range").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    # at most 2^levels rows per group
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = totals.select(
        *by, "_range",
        *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_s_{c}") for c in sums],
    )
    order = F.col(key).desc() if descending else F.col(key).asc()
    upto = (
        Window.partitionBy(*by, "_range").orderBy(order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    joined = ranged.alias("a").join(
        shifts.alias("s"), _match("a", "s", [*by, "_range"], null_safe=True)
    ).select("a.*", *[f"s._s_{c}" for c in sums])
    return joined.select(
        *df.columns,
        *[(F.sum(c).over(upto) + F.col(f"_s_{c}")).alias(f"cum_{c}") for c in sums],
    )
