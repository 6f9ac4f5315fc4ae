"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from lendlens.llm.common import let, or_empty, unit_hash
from lendlens.shared import settle

#: Larger rates are split into equal parts, as exp(-rate) would round to zero.
MAX_PART = 500.0


def _cdf(rate: Column) -> Column:
    """Poisson distribution function at 0, 1, 2, ... until the rest is far below a double's precision."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 40).cast("int")
    p0 = F.exp(-rate)
    zero = F.struct(p0.alias("p"), p0.alias("c"), F.array(p0).alias("all"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * rate / k
        c = acc["c"] + p
        return F.struct(p.alias("p"), c.alias("c"), F.concat(acc["all"], F.array(c)).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), last), zero, step, lambda acc: acc["all"])


def source_rates(
    docs: DataFrame, weights: Mapping[str, float], default_weight: float = 1.0, scale: float = 1.0,
    source: str = "source", text: str = "text",
) -> DataFrame:
    """One row per source: its bytes and the rate at which its documents have to repeat.

    A document counts its UTF-8 bytes plus one, so that empty texts count too. Sources present share
    the input's bytes times ``scale`` by their weights; unlisted sources and null weigh
    ``default_weight``.
    """
    size = (F.octet_length(or_empty(F.col(text))) + 1).cast("bigint")
    sums = settle(docs.groupBy(F.col(source).alias("__s")).agg(F.sum(size).alias("n_bytes")))
    weight = F.lit(float(default_weight))
    for name, w in weights.items():
        weight = F.when(F.col("__s") == name, F.lit(float(w))).otherwise(weight)
    sums = sums.withColumn("weight", weight)
    whole = sums.agg(F.sum("n_bytes")).scalar()
    all_weights = sums.agg(F.sum("weight")).scalar()
    rate = F.col("weight") / all_weights * whole.cast("double") / F.col("n_bytes").cast("double") * scale
    return settle(sums.select("__s", "n_bytes", "weight", rate.alias("rate")))


def replicate(
    docs: DataFrame, weights: Mapping[str, float], default_weight: float = 1.0, scale: float = 1.0, seed: int = 17,
    id_column: str = "doc_id", source: str = "source", text: str = "text",
) -> DataFrame:
    """Documents in global random order, each as often as a Poisson draw at its source's rate says.

    The draw inverts the distribution function at a hash of seed and id, so it does not depend on
    partitioning or retries; rows with one id get one count. A null id draws by its text. Adds
    ``rate``, ``copies`` (the count), ``copy`` (1..copies) and ``shuffle_key`` in [0, 1), by which the
    result is range-partitioned and sorted; input columns of those names are replaced. Documents that
    draw 0 are left out: that is the method. The rates join by source with null equal to null; their
    table has a row per source and is read from a file of known size, so Spark broadcasts it only
    below its threshold, and a hot source is otherwise split by the adaptive skew join.
    """
    rates = source_rates(docs, weights, default_weight, scale, source, text)
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / MAX_PART)).cast("int")
    rates = rates.select("__s", F.col("rate").alias("__rate"), parts.alias("__parts"), _cdf(F.col("rate") / parts).alias("__cdf"))
    own = [c for c in docs.columns if c not in ("rate", "copies", "copy", "shuffle_key")]
    key = F.coalesce(F.col(id_column).cast("string"), F.concat(F.lit("text:"), F.md5(or_empty(F.col(text)).cast("binary"))))

    def draw(j: Column) -> Column:
        u = unit_hash(F.lit(str(seed)), j.cast("string"), F.col("__key"))
        return let(u, lambda x: F.size(F.filter("__cdf", lambda c: c <= x)))

    drawn = docs.select(*own, key.alias("__key")).join(rates, F.col(source).eqNullSafe(F.col("__s")))
    first = draw(F.lit(0))
    more = F.aggregate(F.sequence(F.lit(1), F.col("__parts") - 1), F.lit(0), lambda a, j: a + draw(j))
    count = first + F.when(F.col("__parts") > 1, more).otherwise(0)
    drawn = drawn.select(*own, "__key", F.col("__rate").alias("rate"), count.cast("int").alias("copies"))
    copies = drawn.filter("copies > 0").select("*", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    order = unit_hash(F.lit(str(seed)), F.lit("order"), F.col("__key"), F.col("copy").cast("string"))
    mixed = copies.select(*own, "rate", "copies", "copy", order.alias("shuffle_key"))
    return shuffle_by(mixed, "shuffle_key")


def shuffle_by(df: DataFrame, key: str) -> DataFrame:
    """Order the whole frame by an even key in [0, 1): equal-width slices need no sampled bounds."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionById(n, F.floor(F.col(key) * n).cast("int")).sortWithinPartitions(key)
