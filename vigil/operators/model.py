"""The random forest: fit on a labelled feature matrix, score a feature matrix."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, functions as F

from vigil import constants
from vigil.functions.numeric import close_to
from vigil.operators.features import all_finite
from vigil.sources.shared import new_path

if TYPE_CHECKING:
    from pyspark.ml.classification import RandomForestClassificationModel


def fit(labelled: DataFrame, *, label: str = "gt", features: tuple[str, ...] = constants.FEATURES) -> RandomForestClassificationModel:
    """A forest with the frozen settings.  Its trees are those of Spark, so thresholds tuned on others do not carry over.

    It is stored and loaded: a model as fitted holds on to its session, which tasks cannot take once an Observation was made in it.
    """
    from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier  # with its 60 MB, for drivers that fit or score
    from pyspark.ml.feature import VectorAssembler

    data = VectorAssembler(inputCols=list(features), outputCol="features").transform(labelled.withColumn("label", F.col(label).cast("double")))
    path = new_path(labelled.sparkSession)
    RandomForestClassifier(**constants.FOREST).fit(data).write().overwrite().save(path)
    return RandomForestClassificationModel.load(path)


def score(model: RandomForestClassificationModel, frame: DataFrame, *, features: tuple[str, ...] = constants.FEATURES) -> DataFrame:
    """Adds score, the probability of label 1.  Missing columns or values that are not finite end the job."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    if missing := [c for c in features if c not in frame.columns]:
        raise ValueError(f"missing features {missing}")
    checked = frame.where(F.assert_true(all_finite(features), F.lit("a feature is not finite")).isNull())
    scored = model.transform(VectorAssembler(inputCols=list(features), outputCol="features").transform(checked))
    return scored.withColumn("score", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def verify_thresholds(published: DataFrame, *, fraction: float = 0.8) -> DataFrame:
    """Per frequency: whether exactly one published row has the fraction, with the frozen threshold (frequency, fraction, threshold)."""
    frozen: Column = F.create_map(*(x for k, v in constants.STAR.items() for x in (F.lit(k), F.lit(v))))
    rows = published.where(close_to(F.col("fraction"), fraction))
    same = F.abs(F.col("threshold") - F.try_element_at(frozen, F.col("frequency"))) <= 1e-12
    return rows.groupBy("frequency").agg(((F.count("*") == 1) & F.coalesce(F.bool_and(same), F.lit(False))).alias("verified"))
