"""Training, tuning, scoring and explaining approval models with Spark ML."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool
from typing import NamedTuple

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import Column, DataFrame, functions as F, types as T

from lendlens.functions.numbers import ratio
from lendlens.operators import fairness
from lendlens.operators.imputing import ModeImputer
from lendlens.operators.ranks import seeded_key
from lendlens.shared import forget, settle

KINDS = {
    "logistic": LogisticRegression,
    "random_forest": RandomForestClassifier,
    "decision_tree": DecisionTreeClassifier,
    "boosted_trees": GBTClassifier,
}


def fill_categories(df: DataFrame, columns: Sequence[str], token: str = "missing") -> DataFrame:
    return df.fillna(token, subset=list(columns))


def build_stages(
    numeric: Sequence[str], categorical: Sequence[str], one_hot: bool = True, scale: bool = True, fill_modes: bool = False
) -> list:
    """Median imputation and scaling for numbers; indexing, optionally one-hot, for categories.

    With ``fill_modes`` missing categories take the most frequent one first.
    """
    stages, inputs = [ModeImputer(inputCols=list(categorical))] if fill_modes and categorical else [], []
    if numeric:
        filled = [f"{c}__filled" for c in numeric]
        stages.append(Imputer(strategy="median", inputCols=list(numeric), outputCols=filled))
        stages.append(VectorAssembler(inputCols=filled, outputCol="__numeric"))
        if scale:
            stages.append(StandardScaler(inputCol="__numeric", outputCol="__scaled", withMean=True))
        inputs.append("__scaled" if scale else "__numeric")
    if categorical:
        indexed = [f"{c}__index" for c in categorical]
        stages.append(StringIndexer(inputCols=list(categorical), outputCols=indexed, handleInvalid="keep"))
        if one_hot:
            encoded = [f"{c}__hot" for c in categorical]
            stages.append(OneHotEncoder(inputCols=indexed, outputCols=encoded, dropLast=False))
            indexed = encoded
        inputs += indexed
    return [*stages, VectorAssembler(inputCols=inputs, outputCol="features")]


def build_pipeline(
    kind: str,
    label: str,
    numeric: Sequence[str],
    categorical: Sequence[str] = (),
    params: Mapping | None = None,
    weight: str | None = None,
    fill_modes: bool = False,
) -> Pipeline:
    linear = kind == "logistic"
    learner = KINDS[kind](labelCol=label, featuresCol="features", **(params or {}))
    if weight:
        learner = learner.setWeightCol(weight)
    return Pipeline(stages=[*build_stages(numeric, categorical, linear, linear, fill_modes), learner])


def _typed(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    doubles = {c: F.col(c).cast("double") for c in numeric}
    return fill_categories(df.withColumns({**doubles, **{c: F.col(c).cast("string") for c in categorical}}), categorical) if categorical else df.withColumns(doubles)


def train(
    df: DataFrame,
    kind: str,
    label: str,
    numeric: Sequence[str],
    categorical: Sequence[str] = (),
    params: Mapping | None = None,
    balanced: bool = False,
) -> PipelineModel:
    """Fit one of :data:`KINDS`; ``balanced`` weights the classes equally."""
    data = _typed(df, numeric, categorical)
    weight = None
    if balanced:
        data, weight = fairness.with_class_weights(data, label), "class_weight"
    return build_pipeline(kind, label, numeric, categorical, params, weight).fit(data)


def score(
    model: PipelineModel, df: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = (), keep: Sequence[str] | None = None
) -> DataFrame:
    """Approval probability and label for every row, in one distributed pass."""
    out = model.transform(_typed(df, numeric, categorical))
    kept = list(keep if keep is not None else [c for c in df.columns if c not in ("score", "predicted_label")])
    return out.select(
        *kept, vector_to_array("probability")[1].alias("score"), F.col("prediction").cast("int").alias("predicted_label")
    )


def score_external(df: DataFrame, load: Callable[[], Callable], features: Sequence[str], name: str = "score") -> DataFrame:
    """Score with any Python model, loaded once per task and fed Arrow batches."""
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches: Iterator) -> Iterator:
        predict = load()
        for pdf in batches:
            yield pdf.assign(**{name: predict(pdf[list(features)])})

    return df.mapInPandas(run, schema)


class Search(NamedTuple):
    """What :func:`tune` found."""

    #: the pipeline with the best setting, fitted on all rows
    model: PipelineModel
    #: one row per setting: ``setting`` (its number), ``params``, mean ``auc`` over the folds
    settings: DataFrame
    #: one row per fold and setting: ``fold``, ``setting``, ``auc``
    folds: DataFrame
    #: one row per held-out row and setting: the id, ``fold``, ``actual_value``, ``setting``, ``score``
    scored: DataFrame


def fold_column(key: Column, span: int, folds: int) -> Column:
    """Fold 0, 1, ... of a row by its key in [0, span), so a row is in one fold whatever the partitioning."""
    return F.floor(key.cast("bigint") * folds / span).cast("int")


def tune(
    df: DataFrame,
    kind: str,
    label: str,
    numeric: Sequence[str],
    categorical: Sequence[str] = (),
    grid: Mapping[str, Sequence] | None = None,
    id_column: str = "loan_application_id",
    folds: int = 3,
    train_ratio: float | None = None,
    parallelism: int = 2,
    seed: int = 42,
    key: Column | None = None,
    span: int = 1 << 31,
) -> Search:
    """Grid search by exact area under ROC, with folds or, given ``train_ratio``, a single held-out part.

    The rows are tagged with their fold and written once. A fold's preparation is fitted once on its
    training rows and its features are written once for all settings; its held-out rows are scored with
    all settings in one pass. The areas of all folds and settings come from one aggregation of the
    kept scores. The setting of the highest mean wins, ties by the order of ``grid``.
    ``key`` (an integer spread evenly over [0, ``span``)) replaces the seeded hash of the id.
    """
    key, span = (seeded_key(id_column, seed), 1 << 31) if key is None else (key, span)
    held_out = fold_column(key, span, folds) if train_ratio is None else F.when(key >= int(train_ratio * span), 0).otherwise(-1)
    learner = KINDS[kind](labelCol="__label", featuresCol="features")
    builder = ParamGridBuilder()
    for p, values in (grid or {}).items():
        builder = builder.addGrid(learner.getParam(p), list(values))
    maps = builder.build()
    data = settle(
        _typed(df, numeric, categorical).select(
            F.col(id_column).alias("__id"), F.col(label).cast("double").alias("__label"),
            held_out.alias("__fold"), *[c for c in (*numeric, *categorical)],
        )
    )
    linear = kind == "logistic"
    stages = Pipeline(stages=build_stages(numeric, categorical, linear, linear))
    parts = []
    for fold in range(folds if train_ratio is None else 1):
        preparation = stages.fit(data.filter(F.col("__fold") != fold))
        ready = settle(preparation.transform(data).select("__id", "__label", "__fold", "features"))
        with ThreadPool(parallelism) as pool:  # the fits of a fold are independent jobs
            fits = learner.fitMultiple(ready.filter(F.col("__fold") != fold), maps)
            models = dict(pool.map(inheritable_thread_target(df.sparkSession)(lambda _: next(fits)), maps))
        out = ready.filter(F.col("__fold") == fold)
        for i, m in sorted(models.items()):
            for part, name in (("probabilityCol", "p"), ("rawPredictionCol", "r"), ("predictionCol", "l")):
                m.set(m.getParam(part), f"__{name}{i}")
            out = m.transform(out)
        each = F.posexplode(F.array(*[vector_to_array(f"__p{i}")[1] for i in range(len(maps))])).alias("setting", "score")
        parts.append(settle(out.select(F.col("__id").alias(id_column), F.col("__fold").alias("fold"), F.col("__label").cast("int").alias("actual_value"), each)))
        forget(ready)
    scored = reduce(DataFrame.unionByName, parts)
    found = settle(fairness.auc(scored, ["fold", "setting"]).withColumnRenamed("auc_roc", "auc"))
    names = [(i, ", ".join(f"{p.name}={v}" for p, v in m.items())) for i, m in enumerate(maps)]
    means = found.groupBy("setting").agg(F.avg("auc").alias("auc"))
    settings = settle(df.sparkSession.createDataFrame(names, "setting int, params string").join(means, "setting", "left"))
    best = settings.orderBy(F.col("auc").desc_nulls_last(), "setting").first()["setting"]
    model = Pipeline(stages=[*stages.getStages(), learner.copy(maps[best])]).fit(data)
    forget(data)
    return Search(model, settings, found, scored)


def feature_names(model: PipelineModel, transformed: DataFrame) -> list[str]:
    """Name of every slot of the assembled vector, from its metadata."""
    attrs = transformed.schema["features"].metadata["ml_attr"]["attrs"]
    slots = sorted((a for group in attrs.values() for a in group), key=lambda a: a["idx"])
    return [a["name"] for a in slots]


def importances(
    model: PipelineModel, df: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = ()
) -> DataFrame:
    """Feature importances of a tree model; the source of an indexed or filled column is named."""
    names = feature_names(model, model.transform(_typed(df, numeric, categorical).limit(0)))
    values = model.stages[-1].featureImportances.toArray()
    rows = []
    numeric_slot = 0
    for n, v in zip(names, values):
        if n.startswith(("__numeric", "__scaled")) and "__filled" not in n:
            n, numeric_slot = numeric[numeric_slot], numeric_slot + 1
        rows.append((n.removeprefix("__numeric_").split("__")[0], float(v)))
    return df.sparkSession.createDataFrame(rows, "feature string, importance double")


def linear_contributions(
    df: DataFrame, weights: Mapping[str, float], prefix: str = "contribution_"
) -> DataFrame:
    """Exact per-row contributions w · (x − mean) of a linear model's log-odds."""
    means = df.agg(*[F.avg(c).alias(c) for c in weights]).select(F.struct("*")).scalar()
    with_means = df.withColumn("__means", means)
    return with_means.select(
        *df.columns,
        *[(F.lit(float(w)) * (F.col(c) - F.col("__means")[c])).alias(f"{prefix}{c}") for c, w in weights.items()],
    )


def evaluate(scored: DataFrame, actual: str = "actual_value", predicted: str = "predicted_label") -> DataFrame:
    """AUC from probabilities and from hard labels, accuracy and F1."""
    by_probability = fairness.auc(scored, actual=actual).select(F.col("auc_roc")).scalar()
    m = fairness.confusion(scored, actual=actual, predicted=predicted)
    tn = F.col("total") - F.col("tp") - F.col("fp") - F.col("fn")
    tpr = ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    tnr = ratio(tn, tn + F.col("fp"))
    return m.select(
        by_probability.alias("auc"), ((tpr + tnr) / 2).alias("auc_of_labels"), "accuracy", "f1_score"
    )
