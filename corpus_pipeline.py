"""From raw documents to mixed, sharded training data in five stages.

Each stage takes (spark, docs, sf_dir) and returns a frame; all but the last return the columns of
documents. Every stage is written before the next one reads it.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from lendlens.llm import decontaminate, lsh_forest, mixing, quality_rules, resharding
from lendlens.llm.common import table
from lendlens.llm.queries import MIX_SEED, NEW_SHARDS, SOURCE_WEIGHTS, old_shard
from lendlens.shared import settle

#: The forest, the flow and the digests of the shards are not SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the current policy rejects; a null or empty text has too few words and goes."""
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest id of each group of near-duplicates; texts without words are in no group and stay."""
    return lsh_forest.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark window; without items, or without words, all stay."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat documents so that sources meet their weights, in global random order.

    A null source is a source of its own; columns named like those that the mixing adds keep their own values.
    """
    held = {c: f"__own_{c}" for c in docs.columns if c in ("rate", "copies", "copy", "shuffle_key")}
    mixed = mixing.replicate(docs.withColumnsRenamed(held), SOURCE_WEIGHTS, seed=MIX_SEED)
    return mixed.select(*[F.col(held.get(c, c)).alias(c) for c in docs.columns])


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Move the documents from their present shards into even ones and return the written shards.

    ``docs`` is a written table, so that the copies of a document can part: they are told apart by their
    place in its files; any other frame is written first. Columns of ``docs`` named ``old_shard``, ``shard`` or ``slot`` are
    replaced by the result's. Null ids and texts are sharded like others.
    """
    docs = docs if _is_scan(docs) else settle(docs)
    written = resharding.reshard(docs, old_shard(), NEW_SHARDS, tie=resharding.row_place())
    own = [c for c in docs.columns if c not in ("old_shard", "shard", "slot")]
    return written.select(*own, F.col("__place.old").alias("old_shard"), "__place.shard", "__place.slot")


def _is_scan(df: DataFrame) -> bool:
    """Whether the rows' places in their files can be asked for."""
    try:
        df.select(resharding.row_place())
    except AnalysisException:
        return False
    return True


STAGES = [
    ("quality_rules", quality),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark),
    ("source_mixing", mix),
    ("sharding", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the whole documents table."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
