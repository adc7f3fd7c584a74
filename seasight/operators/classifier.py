"""A pixel classifier of the spectral features: Spark ML's random forest or boosted trees, with balanced class weights."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seasight.operators import boosting
from seasight.operators.boosting import Boosted
from seasight.operators.curves import permuted

Model = PipelineModel | Boosted

#: What a feature without data counts as: below any that has.
MISSING = -9999.0


def _filled(df: DataFrame, features: list[str]) -> DataFrame:
    missing = set(features) - set(df.columns)
    if missing:
        raise ValueError(f"missing features: {', '.join(sorted(missing))}")
    return df.withColumns({f: F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(None)), F.lit(MISSING)) for f in features})


def fit(df: DataFrame, features: list[str], label: str = "label", trees: int = 60, depth: int = 12, seed: int = 7) -> PipelineModel:
    """Learns from all rows with a label; a class weighs as much as any other, however many rows it has."""
    d = _filled(df.filter(F.col(label).isNotNull()), features).withColumn("_label", F.col(label).cast("string"))
    sizes = d.groupBy("_label").agg(F.count("*").alias("_n"))  # a row per class
    every = Window.partitionBy(F.lit(1))
    weights = sizes.select("_label", (F.sum("_n").over(every) / (F.count("*").over(every) * F.col("_n"))).alias("_weight"))
    d = d.join(F.broadcast(weights), "_label")
    index = StringIndexer(inputCol="_label", outputCol="_index", stringOrderType="alphabetAsc").fit(d)
    forest = RandomForestClassifier(featuresCol="_features", labelCol="_index", weightCol="_weight", numTrees=trees, maxDepth=depth, seed=seed, predictionCol="_prediction", probabilityCol="_probability", rawPredictionCol="_raw")
    named = IndexToString(inputCol="_prediction", outputCol="predicted", labels=index.labels)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_features"), index.setHandleInvalid("keep"), forest, named]).fit(d)


def features_of(model: Model) -> list[str]:
    return model.features if isinstance(model, Boosted) else model.stages[0].getInputCols()


def classes_of(model: Model) -> list[str]:
    return model.classes if isinstance(model, Boosted) else model.stages[-1].getLabels()


def predict(model: Model, df: DataFrame) -> DataFrame:
    """``df`` with predicted and proba (an array in the order of ``classes_of``)."""
    if isinstance(model, Boosted):
        return boosting.predict(model, df)
    d = _filled(df, features_of(model)).withColumn("_label", F.lit(classes_of(model)[0]))
    out = model.transform(d).withColumn("proba", vector_to_array("_probability"))
    own = [F.col(c) for c in df.columns if c not in features_of(model)]
    return out.select(*own, *features_of(model), "predicted", "proba")


def probability(model: Model, df: DataFrame, name: str) -> DataFrame:
    """``df`` with the probability of one class; a class that the model doesn't know raises."""
    classes = classes_of(model)
    if name not in classes:
        raise ValueError(f"the model has no class {name}: {', '.join(classes)}")
    return predict(model, df).withColumn("probability", F.get("proba", classes.index(name))).drop("proba", "predicted")


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str, features: list[str]) -> PipelineModel:
    """The saved model; one of other features raises."""
    model = PipelineModel.load(path)
    if features_of(model) != list(features):
        raise ValueError("the model was fitted on other features")
    return model


def importances(model: Model) -> list[tuple[str, float]]:
    """Features with their share of the trees' gain, the most informative first; a value per feature."""
    if isinstance(model, Boosted):
        return boosting.importances(model)
    return sorted(zip(features_of(model), model.stages[2].featureImportances.toArray().tolist()), key=lambda x: (-x[1], x[0]))


def permutation_importances(model: Model, df: DataFrame, key: str, label: str = "label") -> list[tuple[str, float]]:
    """Features with what accuracy loses when their values are exchanged between rows, the most informative first; a value per feature."""
    right = lambda d: predict(model, d).agg(F.avg((F.col("predicted") == F.col(label).cast("string")).cast("double"))).first()[0]
    d = df.filter(F.col(label).isNotNull())
    whole = right(d)
    return sorted(((f, whole - right(permuted(d, f, key))) for f in features_of(model)), key=lambda x: (-x[1], x[0]))


def confusion_counts(model: Model, df: DataFrame, label: str = "label") -> DataFrame:
    """truth, pred, n on rows that the model hasn't seen."""
    d = predict(model, df.filter(F.col(label).isNotNull()))
    return d.groupBy(F.col(label).cast("string").alias("truth"), F.col("predicted").alias("pred")).agg(F.count("*").alias("n"))
