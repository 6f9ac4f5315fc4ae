"""Exact interpolated quantiles for any mix of groupings.

``percentile`` merges a value-to-count map per group in one task, which is right for small groups and wrong
for a hot or global one. Rows are counted per group first: groups of up to :data:`SMALL_GROUP` rows take the
built-in, larger ones are refined by histograms (see ``selection``), which moves counts instead of values.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from lendlens.operators.ranks import running_totals
from lendlens.operators.selection import cells
from lendlens.shared import settle

#: Rows of a group, times the columns asked for, that one task may hold as maps of values: about 100 MB.
SMALL_GROUP = 1_000_000


def quantiles_of_counts(counted: DataFrame, groups: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """(groups, value, n) to (groups, q0, q1, …) by linear interpolation between neighbours."""
    return _interpolated(running_totals(counted, ["value"], {"upto": "n"}, groups), groups, probs)


def _interpolated(totals: DataFrame, groups: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """Quantiles from (groups, value, n, upto, upto_total); only the values at the wanted positions have to be there."""
    target = lambda p: F.lit(float(p)) * (F.col("upto_total") - 1)
    covers = lambda pos: (F.col("upto") > pos) & (F.col("upto") - F.col("n") <= pos)
    ends = [(F.floor(target(p)), F.ceil(target(p))) for p in probs]
    # almost no value is at a wanted position: drop the rest before grouping
    near = totals.filter(reduce(or_, [covers(pos) for pair in ends for pos in pair]))
    aggs = []
    for i, (p, (below, above)) in enumerate(zip(probs, ends)):
        aggs += [
            F.max(F.when(covers(below), F.col("value"))).alias(f"lo{i}"),
            F.max(F.when(covers(above), F.col("value"))).alias(f"hi{i}"),
            F.max(target(p) - below).alias(f"f{i}"),
        ]
    # weighted ends, as the built-in percentile does it
    between = lambda i: F.col(f"lo{i}") * (1 - F.col(f"f{i}")) + F.col(f"hi{i}") * F.col(f"f{i}")
    return near.groupBy(*groups).agg(*aggs).select(
        *groups,
        *[
            F.when(F.col(f"lo{i}") == F.col(f"hi{i}"), F.col(f"lo{i}")).otherwise(between(i)).alias(f"q{i}")
            for i in range(len(probs))
        ],
    )


def long_values(df: DataFrame, keep: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One (keep…, column_id, value) row per non-null value; the id is the column's position."""
    pairs = F.array(
        *[F.struct(F.lit(i).alias("column_id"), F.col(c).cast("double").alias("value")) for i, c in enumerate(columns)]
    )
    return (
        df.select(*keep, F.explode(pairs).alias("__p"))
        .select(*keep, "__p.column_id", "__p.value")
        .filter(F.col("value").isNotNull())
    )


def column_name(columns: Sequence[str]) -> Column:
    """Name for a ``column_id``."""
    return F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("column_id") + 1).alias("column_name")


def _exact(df: DataFrame, keys: Sequence[str], columns: Sequence[str], probs: Sequence[float], hot: DataFrame | None) -> DataFrame:
    """(``__g``, column_id, q0, q1, …) of the columns; ``__g`` is a struct of the keys, so null is a group of its own.

    ``hot`` has the ``__g`` of the large groups, None if there are none.
    """
    group = F.struct(*[F.col(k).alias(k) for k in keys]) if keys else F.struct(F.lit(0).alias("all"))
    rows = df.select(group.alias("__g"), *[F.col(c).cast("double").alias(f"__c{i}") for i, c in enumerate(columns)])
    each = [F.percentile(f"__c{i}", [float(p) for p in probs]).alias(f"__q{i}") for i in range(len(columns))]
    small = rows if hot is None else rows.join(hot, "__g", "left_anti")
    found = small.groupBy("__g").agg(*each)
    pairs = F.array(*[F.struct(F.lit(i).alias("column_id"), F.col(f"__q{i}").alias("q")) for i in range(len(columns))])
    found = found.select("__g", F.explode(pairs).alias("p")).filter("p.q IS NOT NULL")
    found = found.select("__g", "p.column_id", *[F.col("p.q")[i].alias(f"q{i}") for i in range(len(probs))])
    if hot is not None:
        large = long_values(rows.join(hot, "__g", "left_semi"), ["__g"], [f"__c{i}" for i in range(len(columns))])
        found = found.unionByName(_interpolated(cells(large, ["__g", "column_id"], probs), ["__g", "column_id"], probs))
    return found


def _hot_groups(df: DataFrame, grains: Sequence[Sequence[str]], columns: int) -> list[DataFrame | None]:
    """Large groups of every grain, from one job."""
    most = max(1, SMALL_GROUP // max(1, columns))
    counts = [
        df.groupBy(F.struct(*[F.col(k).alias(k) for k in keys]) if keys else F.struct(F.lit(0).alias("all")))
        .agg(F.count(F.lit(1)).alias("n"))
        .toDF("__g", "n")
        .filter(F.col("n") > most)
        .select("__g")
        for keys in grains
    ]
    tagged = [c.select(F.lit(i).alias("grain"), *[c["__g"] if j == i else F.lit(None).alias(f"g{j}") for j in range(len(counts))]) for i, c in enumerate(counts)]
    named = [t.toDF("grain", *[f"g{j}" for j in range(len(counts))]) for t in tagged]
    every = named[0]
    for t in named[1:]:
        every = every.union(t)
    every = settle(every)
    present = {r[0] for r in every.select("grain").distinct().collect()}
    return [every.filter(F.col("grain") == i).select(F.col(f"g{i}").alias("__g")) if i in present else None for i in range(len(counts))]


def column_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], groups: Sequence[str] = (), exact: bool = True
) -> DataFrame:
    """(groups, column_name, q0, q1, …), one row per column and group; null group values are a group.

    ``exact=False`` swaps in the mergeable sketch, which needs no second pass.
    """
    if exact:
        (hot,) = _hot_groups(df, [groups], len(columns))
        found = _exact(df, groups, columns, probs, hot).select(*[F.col("__g")[g].alias(g) for g in groups], "column_id", *[f"q{i}" for i in range(len(probs))])
    else:
        keys = [*groups, "column_id"]
        sketch = F.percentile_approx("value", [float(p) for p in probs], 10000).alias("__q")
        found = long_values(df, groups, columns).groupBy(*keys).agg(sketch).select(
            *keys, *[F.col("__q")[i].alias(f"q{i}") for i in range(len(probs))]
        )
    return found.select(*groups, column_name(columns), *[f"q{i}" for i in range(len(probs))])


def one_row(quantiles: DataFrame, columns: Sequence[str], names: Mapping[int, str]) -> DataFrame:
    """Spread :func:`column_quantiles` of an ungrouped frame into one row, e.g. ``{0: '{}_p01'}``."""
    return quantiles.agg(
        *[
            F.max(F.when(F.col("column_name") == c, F.col(f"q{i}"))).alias(pattern.format(c))
            for c in columns
            for i, pattern in names.items()
        ]
    )


def grouped_quantiles(
    df: DataFrame, grains: Mapping[str, tuple[Sequence[str], Sequence[str]]], probs: Mapping[str, float]
) -> dict[str, DataFrame]:
    """Quantiles of several columns at several grains.

    ``grains`` maps a grain name to (key columns, value columns); an empty key list is the whole
    frame. ``probs`` maps an output prefix to a probability; columns are ``<prefix>_<column>``. Rows
    with a null in a grain's keys do not take part in that grain, and a group without any value has no row.
    Each grain is one aggregate of ``df``, which should be cheap to read; the results are written together.
    """
    hot = _hot_groups(df, [keys for keys, _ in grains.values()], max(len(cols) for _, cols in grains.values()))
    slots = [f"k{i}" for i in range(max(len(keys) for keys, _ in grains.values()))]
    parts = []
    for g, (large, (keys, cols)) in enumerate(zip(hot, grains.values())):
        found = _exact(df.dropna(subset=list(keys)) if keys else df, keys, cols, list(probs.values()), large)
        named = [F.col("__g")[k].cast("string") for k in keys] + [F.lit(None).cast("string")] * (len(slots) - len(keys))
        values = [f"q{i}" for i in range(len(probs))]
        parts.append(found.select(F.lit(g).alias("grain"), *[k.alias(s) for k, s in zip(named, slots)], "column_id", *values))
    found = parts[0]
    for part in parts[1:]:
        found = found.union(part)
    found = settle(found)

    out = {}
    for g, (name, (grain_keys, cols)) in enumerate(grains.items()):
        mine = found.filter(F.col("grain") == g).groupBy(*slots[: len(grain_keys)]).agg(
            *[
                F.max(F.when(F.col("column_id") == j, F.col(f"q{i}"))).alias(f"{prefix}_{c}")
                for j, c in enumerate(cols)
                for i, prefix in enumerate(probs)
            ]
        )
        out[name] = mine.select(
            *[F.col(s).cast(df.schema[k].dataType).alias(k) for s, k in zip(slots, grain_keys)],
            *[f"{prefix}_{c}" for c in cols for prefix in probs],
        )
    return out


def grouped_medians(
    df: DataFrame, grains: Mapping[str, tuple[Sequence[str], Sequence[str]]]
) -> dict[str, DataFrame]:
    """``median_<column>`` at each grain; see :func:`grouped_quantiles`."""
    return grouped_quantiles(df, grains, {"median": 0.5})
