"""Filling nulls with the most frequent value of a column, as a stage of a model pipeline."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, functions as F


def modes(df: DataFrame, columns: Sequence[str]) -> dict[str, str | None]:
    """Most frequent value of every column as text, ties by the smaller text; None for a column without values.

    All columns are counted in one pass, combined on the map side; a row per column comes back.
    """
    if not columns:
        return {}
    pairs = F.array(*[F.struct(F.lit(i).alias("column_id"), F.col(c).cast("string").alias("v")) for i, c in enumerate(columns)])
    counted = df.select(F.explode(pairs).alias("p")).filter("p.v IS NOT NULL").groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    first = F.min(F.struct((-F.col("n")).alias("less"), F.col("p.v").alias("v"))).alias("first")
    found = {r["column_id"]: r["first"]["v"] for r in counted.groupBy("p.column_id").agg(first).collect()}
    return {c: found.get(i) for i, c in enumerate(columns)}


class ModeImputer(Estimator, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Learns the mode of each of ``inputCols``; see :func:`modes`."""

    @keyword_only
    def __init__(self, *, inputCols: list[str] | None = None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> ModeImputerModel:
        return ModeImputerModel(learned=json.dumps(modes(dataset, self.getInputCols())))


class ModeImputerModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """Fills nulls with the learned modes and keeps the columns' types; a column without a mode stays as it is."""

    learned = Param(Params._dummy(), "learned", "mode of every column, as JSON", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, learned: str | None = None):
        super().__init__()
        self._set(**self._input_kwargs)

    def modes(self) -> dict[str, str | None]:
        return json.loads(self.getOrDefault(self.learned))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        kinds = dict(dataset.dtypes)
        filled = {c: F.coalesce(F.col(c), F.lit(v).cast(kinds[c])) for c, v in self.modes().items() if v is not None}
        return dataset.withColumns(filled) if filled else dataset
