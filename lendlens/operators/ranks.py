"""Numbering, running totals and per-key picks that never gather a group in one task.

``row_number`` or ``sum`` over a window keyed by a class, a year or nothing at all puts a whole
class in one task. The functions here give the same answers from range- or bucket-partitioned data:
each task numbers only its own slice and a small table of slice sizes supplies the offsets.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from lendlens.shared import settle

#: Rows of an equal-width slice, about.
SLICE_ROWS = 100_000
_THIN, _PER_SLICE = 256, 32  # keys of which one is sampled; sampled keys of a slice, at most about


def match_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Equi-join on same-named keys where null equals null; the right-hand keys are dropped."""
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    cond = reduce(and_, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys])
    return left.join(renamed, cond, how).drop(*[f"__r_{k}" for k in keys])


def key_splitters(df: DataFrame, keys: Sequence[Column], slices: int, thin: int = _THIN) -> DataFrame:
    """One row with ``cuts``: at most ``slices - 1`` rising keys (structs of ``keys``) that cut ``df`` about evenly.

    The sketch is mergeable: one key in ``thin`` by hash takes part, and each of ``slices`` times :data:`_PER_SLICE`
    hash buckets keeps the key with the smallest hash, so its size does not grow with the data. Keys
    that repeat count once; a part that no sampled key cuts holds some ``thin`` keys only.
    """
    key = F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)])
    hashed = df.select(key.alias("key")).withColumn("h", F.xxhash64("key"))
    own = F.pmod(F.shiftright("h", 20), F.lit(slices * _PER_SLICE))
    kept = hashed.filter(F.pmod("h", F.lit(thin)) == 0).groupBy(own.alias("own")).agg(F.min_by("key", "h").alias("key"))
    ordered = kept.agg(F.sort_array(F.collect_list("key")).alias("keys"))
    step = F.greatest(F.lit(1), F.ceil(F.size("keys") / F.lit(slices)))
    return ordered.select(F.filter("keys", lambda k, i: (i > 0) & (i % step == 0)).alias("cuts"))


def slice_of(key: Column, cuts: Column, slices: int) -> Column:
    """How many of ``cuts`` (rising, fewer than ``slices``) are at or below ``key``, by bisection."""
    strides = [1 << i for i in reversed(range(max(1, slices).bit_length()))]
    return F.aggregate(
        F.array(*[F.lit(w) for w in strides]),
        F.lit(0),
        lambda at, w: F.when(F.get(cuts, at + w - 1) <= key, at + w).otherwise(at),
    )


def row_numbers(
    df: DataFrame, order: Sequence[str | Column], groups: Sequence[str] = (), name: str = "rn", total: str | None = None
) -> DataFrame:
    """Dense 1..n numbers in ``order`` (which must be total), restarting per group.

    ``order`` holds columns that rise, nulls first; :func:`descending` turns a number round. ``total``
    names a further column with the group's row count, which the numbering knows anyway. Rows equal in
    group and order are numbered in any order; an empty frame gives no rows.

    Only the splitters of a sketch are written. Rows are shuffled once, by group and slice; slices are
    numbered by themselves and shifted by the row counts of the group's earlier slices. A hot group spans many slices,
    and so does a tie on the leading key, as all columns of the order set them. ``df`` is read for
    the sketch, for the counts (both read group and order only) and for the rows; the last two are one
    reading where group and order are all its columns. It has to give the same rows each time.
    """
    keys = [F.col(g) for g in groups] + [F.col(o) if isinstance(o, str) else o for o in order]
    slices = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = settle(key_splitters(df, keys, slices)).scalar()
    # as one struct, null group values compare equal under a plain equi-join
    group = F.struct(*[F.col(g).alias(f"g{i}") for i, g in enumerate(groups)]) if groups else F.lit(0)
    key = F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)])
    placed = df.withColumns({"__group": group, "__key": key, "__cuts": cuts})
    placed = placed.withColumn("__slice", slice_of(F.col("__key"), F.col("__cuts"), slices)).drop("__cuts", "__key")
    local = placed.withColumn(
        "__at", F.row_number().over(W.partitionBy("__group", "__slice").orderBy(*keys[len(groups) :])).cast("bigint")
    )
    tallies = local.groupBy("__group", "__slice").agg(F.max("__at").alias("__n"))
    # a row per slice and group: a group has at most one for each slice in these windows
    whole = W.partitionBy("__group")
    earlier = whole.orderBy("__slice").rowsBetween(W.unboundedPreceding, -1)
    shifts = tallies.select(
        "__group",
        "__slice",
        F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"),
        *([F.sum("__n").over(whole).alias("__rows")] if total else []),
    )
    # the window leaves the rows partitioned and sorted by these, so this join does not move them
    numbered = local.join(shifts, ["__group", "__slice"])
    counted = [F.col("__rows").alias(total)] if total else []
    return numbered.select(*df.columns, (F.col("__at") + F.col("__before")).alias(name), *counted)


def row_ids(df: DataFrame, name: str = "row_id") -> DataFrame:
    """``df`` with a number that no two rows share, in no order and with gaps; nothing is shuffled.

    The numbers hold within one pass: settle the frame before it is read more than once.
    """
    return df.withColumn(name, F.monotonically_increasing_id())


def running_totals(
    df: DataFrame, order: Sequence[str | Column], sums: Mapping[str, str], groups: Sequence[str] = ()
) -> DataFrame:
    """Running and overall sums within each group, in ``order``.

    ``sums`` maps an output name to a numeric column; ``<name>`` is the running sum including the
    row and ``<name>_total`` the sum of the group. Pre-aggregate equal order values first, so that
    a score or amount shared by a third of all rows is one row here.
    """
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    placed = settle(
        df.repartitionByRange(*[F.col(g) for g in groups], *order).withColumn("__part", F.spark_partition_id())
    )
    # as one struct, null group values compare equal under a plain equi-join
    group = F.struct(*[F.col(g).alias(f"g{i}") for i, g in enumerate(groups)]) if groups else F.lit(0)
    placed = placed.withColumn("__group", group)
    tallies = placed.groupBy("__part", "__group").agg(*[F.sum(c).alias(f"__s_{n}") for n, c in sums.items()])
    whole = W.partitionBy("__group")
    earlier = whole.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    bases = tallies.select(
        "__part",
        "__group",
        *[F.coalesce(F.sum(f"__s_{n}").over(earlier), F.lit(0)).alias(f"__b_{n}") for n in sums],
        *[F.sum(f"__s_{n}").over(whole).alias(f"{n}_total") for n in sums],
    )
    within = W.partitionBy("__part", "__group").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    local = placed.select("*", *[F.sum(c).over(within).alias(f"__l_{n}") for n, c in sums.items()])
    # the window leaves the rows hash-partitioned by (slice, group), so this join does not move them
    joined = local.join(bases, ["__part", "__group"])
    return joined.select(
        *df.columns,
        *[(F.col(f"__l_{n}") + F.col(f"__b_{n}")).alias(n) for n in sums],
        *[f"{n}_total" for n in sums],
    )


def value_bucket(value: Column, span: tuple[float, float], buckets: int) -> Column:
    """Equal-width bucket of a number, never falling as it rises in Spark's order: null, numbers, NaN.

    Numbers outside of ``span`` are in the first or last bucket, so the span decides the balance only.
    """
    value, (lo, hi) = value.cast("double"), span
    place = F.floor((value - lo) / (hi - lo) * buckets)
    inside = F.greatest(F.lit(0), F.least(F.lit(buckets - 1), place.cast("int")))
    return F.when(value.isNull(), -1).when(F.isnan(value), buckets).when(value >= hi, buckets - 1).when(value <= lo, 0).otherwise(inside)


def bucket_totals(
    df: DataFrame,
    value: str,
    sums: Mapping[str, str],
    groups: Sequence[str] = (),
    descending: bool = False,
    span: tuple[float, float] = (0.0, 1.0),
    buckets: int = 4096,
) -> DataFrame:
    """:func:`running_totals` in the order of one number that is spread over ``span``, such as a score.

    Equal-width buckets are the slices: one shuffle by (group, bucket), totals inside a bucket, and an offset
    per bucket. Nothing is sampled or written. Pre-aggregate equal values, so that a bucket's rows
    are its distinct values.
    """
    group = F.struct(*[F.col(g).alias(f"g{i}") for i, g in enumerate(groups)]) if groups else F.lit(0)
    number = value_bucket(F.col(value), span, buckets)
    placed = df.withColumn("__group", group).withColumn("__bucket", -number if descending else number)
    order = F.col(value).desc() if descending else F.col(value)
    within = W.partitionBy("__group", "__bucket").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy("__group")
    earlier = whole.orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)  # a row per bucket
    tallies = placed.groupBy("__group", "__bucket").agg(*[F.sum(c).alias(f"__s_{n}") for n, c in sums.items()])
    bases = tallies.select(
        "__group",
        "__bucket",
        *[F.coalesce(F.sum(f"__s_{n}").over(earlier), F.lit(0)).alias(f"__b_{n}") for n in sums],
        *[F.sum(f"__s_{n}").over(whole).alias(f"{n}_total") for n in sums],
    )
    local = placed.select("*", *[F.sum(c).over(within).alias(f"__l_{n}") for n, c in sums.items()])
    joined = local.join(bases, ["__group", "__bucket"])
    return joined.select(
        *df.columns,
        *[(F.col(f"__l_{n}") + F.col(f"__b_{n}")).alias(n) for n in sums],
        *[f"{n}_total" for n in sums],
    )


def best_row(df: DataFrame, keys: Sequence[str], order: Sequence[Column] = ()) -> DataFrame:
    """The row of each key that sorts first by ``order``, then has fewer nulls, then smaller values.

    A mergeable ``min`` of structs: map tasks reduce a key to one candidate before the shuffle, so a
    key holding a third of the rows costs no more than any other. Nulls in ``order`` sort first, as in
    ``min``; wrap a column with :func:`descending` to prefer large values and put nulls last. Remaining
    columns are compared in their order in ``df``, nulls last.
    """
    rest = [c for c in df.columns if c not in keys]
    blanks = sum((F.col(c).isNull().cast("int") for c in rest), F.lit(0))
    ranked = F.struct(
        *[o.alias(f"o{i}") for i, o in enumerate(order)],
        blanks.alias("blanks"),
        *[x for i, c in enumerate(rest) for x in (F.col(c).isNull().alias(f"n{i}"), F.col(c).alias(f"v{i}"))],
    )
    best = df.groupBy(*keys).agg(F.min(ranked).alias("__best"))
    return best.select(*keys, *[F.col(f"__best.v{i}").alias(c) for i, c in enumerate(rest)])


def descending(column: str | Column) -> Column:
    """Order key for :func:`best_row` that prefers large numbers and puts nulls last."""
    c = F.col(column) if isinstance(column, str) else column
    return F.struct(c.isNull().alias("missing"), (-c).alias("negated"))


def top_k(df: DataFrame, order: Sequence[Column], k: int, where: Column | None = None) -> DataFrame:
    """First ``k`` rows by ``order``; each task keeps only ``k`` rows (TakeOrderedAndProject)."""
    kept = df if where is None else df.filter(where)
    return kept.orderBy(*order).limit(k)


def seeded_key(id_column: str, seed: int = 42, span: int = 1 << 31) -> Column:
    """Repeatable pseudo-random integer in [0, span) that depends only on the row's id."""
    return F.pmod(F.xxhash64(F.col(id_column), F.lit(seed)), F.lit(span))


def hex_key(id_column: str) -> Column:
    """Leading 32 bits of a hexadecimal hash id: even over [0, 2**32) and in the order of the id.

    Any other id fails the job, as it would put all such rows into one slice.
    """
    hexadecimal = F.col(id_column).rlike("^[0-9a-fA-F]{8}")
    return F.when(hexadecimal | F.col(id_column).isNull(), F.conv(F.substring(id_column, 1, 8), 16, 10).cast("bigint")).otherwise(
        F.raise_error(F.concat(F.lit("not a hexadecimal id: "), F.col(id_column))).cast("bigint")
    )


def rank_by_key(
    df: DataFrame,
    key: Column,
    tiebreak: str,
    span: int,
    groups: Sequence[str] = (),
    name: str = "rn",
    buckets: int | None = None,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Dense rank by a key that is spread evenly over [0, span), for random orders and hashed ids.

    An even key needs no sampled range bounds: equal-width buckets of the key are the slices. One
    narrow counting pass plus one shuffle by (group, bucket); nothing is written except the counts.
    ``counted`` is a cheaper frame with the same rows to count instead of ``df``. Without ``buckets``
    there is a slice per :data:`SLICE_ROWS` rows, at least one per shuffle partition.
    """
    if buckets is None:
        buckets = slices_for((df if counted is None else counted).count(), df.sparkSession)
    keyed = df.withColumn("__key", key).withColumn("__bucket", _bucket(span, buckets))
    to_count = keyed if counted is None else counted.withColumn("__key", key).withColumn("__bucket", _bucket(span, buckets))
    offsets = settle(_bucket_counts(to_count, groups).drop("__n", "__total"))
    slices = W.partitionBy(*groups, "__bucket").orderBy("__key", tiebreak)
    numbered = match_on(
        keyed.withColumn("__local", F.row_number().over(slices)), offsets, [*groups, "__bucket"], "inner"
    )
    return numbered.select(*df.columns, (F.col("__local") + F.col("__before")).alias(name))


def slices_for(rows: int, spark: SparkSession) -> int:
    """Slices for so many rows."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // SLICE_ROWS))


def _bucket(span: int, buckets: int) -> Column:
    return F.floor(F.col("__key").cast("double") * (buckets / span)).cast("int")


def _bucket_counts(keyed: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Rows per (group, bucket) with the rows in earlier buckets and in the whole group."""
    counts = keyed.groupBy(*groups, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    whole = W.partitionBy(*(groups or [F.lit(0)]))
    earlier = whole.orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    return counts.select(
        *groups,
        "__bucket",
        "__n",
        F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"),
        F.sum("__n").over(whole).alias("__total"),
    )


def _slot_widths(span: int, buckets: int) -> list[int]:
    """Widths of ever finer key slots down to 1; each is about 1/``buckets`` of the one before and divides it."""
    widths = [max(1, -(-span // buckets))]
    while widths[-1] > 1:
        widths.append(-(-widths[-1] // buckets))
    for i in range(len(widths) - 2, -1, -1):
        widths[i] = -(-widths[i] // widths[i + 1]) * widths[i + 1]
    return widths


def key_cutoffs(
    df: DataFrame,
    key: Column,
    tiebreak: str,
    span: int,
    quota: Column,
    groups: Sequence[str] = (),
    quotas: DataFrame | None = None,
    buckets: int = 4096,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Last (key, tiebreak) that belongs to the first ``quota`` rows of each group.

    Only the group columns, the id and the key are read. Rows are counted in equal-width slots of the
    key; the slot where a group's quota is reached is its edge. Edges are split and counted again
    until each holds at most ``slice_rows`` rows (or a single key), and only they are ranked then. ``quota``
    may use ``total`` (the group's row count) and any column of ``quotas`` (one row per group).
    Columns: groups, ``keep_all``, ``cut_key``, ``cut_id``.
    """
    buckets = max(2, buckets)
    narrow = df.select(*groups, F.col(tiebreak).alias("__id"), key.cast("bigint").alias("__key"))
    slots = lambda rows, width: rows.withColumn("__bucket", F.expr(f"__key div {width}L * {width}L"))
    width, *finer = _slot_widths(span, buckets)
    counts = _bucket_counts(slots(narrow, width), groups).withColumnRenamed("__total", "total")
    if quotas is not None:
        counts = match_on(counts, quotas, list(groups), "inner")
    counts = counts.withColumn("__quota", F.floor(quota).cast("bigint"))
    upto = F.col("__before") + F.col("__n")
    # one row per group: the slot where its quota is reached, or its last slot
    reached = (F.col("__before") < F.col("__quota")) & (upto >= F.least("__quota", "total"))
    limits = settle(
        counts.filter(reached).select(
            *groups,
            "__bucket",
            "__n",
            (F.col("__quota") >= F.col("total")).alias("keep_all"),
            (F.col("__quota") - F.col("__before")).alias("__need"),
        )
    )
    edges = limits.filter(~F.col("keep_all")).drop("keep_all")
    within = lambda: match_on(slots(narrow, width), edges.select(*groups, "__bucket", "__need"), [*groups, "__bucket"], "inner")
    while finer and (edges.agg(F.max("__n")).first()[0] or 0) > slice_rows:
        inside, width = within().drop("__bucket"), finer.pop(0)
        counts = _bucket_counts(slots(inside, width), [*groups, "__need"]).filter(
            (F.col("__before") < F.col("__need")) & (upto >= F.col("__need"))
        )
        edges = settle(counts.select(*groups, "__bucket", "__n", (F.col("__need") - F.col("__before")).alias("__need")))
    slices = W.partitionBy(*groups, "__bucket").orderBy("__key", "__id")
    partial = (
        within()
        .withColumn("__rank", F.row_number().over(slices))
        .filter(F.col("__rank") == F.col("__need"))
        .select(*groups, F.lit(False).alias("keep_all"), F.col("__key").alias("cut_key"), F.col("__id").alias("cut_id"))
    )
    everything = limits.filter("keep_all").select(
        *groups,
        "keep_all",
        F.lit(None).cast("bigint").alias("cut_key"),
        F.lit(None).cast(df.schema[tiebreak].dataType).alias("cut_id"),
    )
    return settle(partial.unionByName(everything))


def within_cutoff(key: Column, tiebreak: str) -> Column:
    """True for rows at or before the cutoff attached by a join with :func:`key_cutoffs`."""
    return F.coalesce(
        F.col("keep_all")
        | (key < F.col("cut_key"))
        | ((key == F.col("cut_key")) & (F.col(tiebreak) <= F.col("cut_id"))),
        F.lit(False),
    )


def ntile(df: DataFrame, order: Sequence[Column], buckets: int, name: str) -> DataFrame:
    """SQL ``ntile`` over the whole frame (earlier tiles take the remainder), without one big task; order as in :func:`row_numbers`."""
    numbered = row_numbers(df, order, name="__rn", total="__rows_all")
    rows = F.col("__rows_all")
    base, extra = F.floor(rows / buckets), rows % buckets
    z = F.col("__rn") - 1
    big = extra * (base + 1)
    tile = F.when(z < big, F.floor(z / (base + 1)) + 1).otherwise(extra + F.floor((z - big) / base) + 1)
    return numbered.select(*df.columns, tile.cast("int").alias(name))


def prior_history(df: DataFrame, entity: Sequence[str], period: str, sums: Mapping[str, str]) -> DataFrame:
    """Sums over all earlier periods of an entity, from one row per (entity, period)."""
    before = W.partitionBy(*entity).orderBy(period).rowsBetween(W.unboundedPreceding, -1)
    return df.select("*", *[F.sum(c).over(before).alias(n) for n, c in sums.items()])
