"""Trained models: logistic regression on embeddings or rule features, boosted trees, and their evaluation loops."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from adagium.operators.metrics import class_weights, summary
from adagium.operators.sampling import class_folds

C_GRID = (0.01, 0.1, 1.0, 10.0, 100.0)
NOISE = 0.07


def with_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced class weights as column weight; one row a class is joined."""
    return df.join(F.broadcast(class_weights(df, label).select(label, "weight")), label)  # a row a class


def logistic(df: DataFrame, features: str, label: str, c: float = 1.0, max_iter: int = 1000):
    """L2 logistic regression with balanced weights; c is the inverse of the penalty, as in common libraries."""
    n = df.count()
    model = LogisticRegression(featuresCol=features, labelCol=label, weightCol="weight", regParam=1.0 / (c * max(n, 1)), elasticNetParam=0.0, standardization=False, maxIter=max_iter)
    return model.fit(with_weights(df, label))


def embedded(df: DataFrame, vector: str, out: str = "features") -> DataFrame:
    return df.withColumn(out, array_to_vector(F.transform(F.col(vector), lambda x: x.cast("double"))))


def macro_f1(df: DataFrame, label: str) -> float:
    pairs = df.select(F.col(label).cast("int").cast("string").alias("gold"), F.col("prediction").cast("int").cast("string").alias("pred"))
    return float(summary(pairs).first()["macro_f1"] or 0.0)


def tune_logistic(train: DataFrame, val: DataFrame, test: DataFrame, label: str, grid=C_GRID, max_iter: int = 1000):
    """M1: the c of the best macro-F1 on val (the first on ties, O5), refit on train and val, one prediction of test.

    Returns (predictions of test, chosen c, [(c, macro-F1 on val)]).
    """
    train, val, test = (embedded(d, "embedding") for d in (train, val, test))
    tried = [(c, macro_f1(logistic(train, "features", label, c, max_iter).transform(val), label)) for c in grid]
    best = max(tried, key=lambda x: x[1])[0]
    model = logistic(train.unionByName(val), "features", label, best, max_iter)
    return model.transform(test), best, tried


def out_of_fold(df: DataFrame, features: list[str], label: str, key: str, folds: int = 5, c: float = 1.0) -> DataFrame:
    """Predictions of every row by a model that didn't see its fold."""
    rows = VectorAssembler(inputCols=features, outputCol="features").transform(class_folds(df, label, key, folds)).persist()
    out = None
    for k in range(folds):
        part = logistic(rows.filter(F.col("fold") != k), "features", label, c, 3000).transform(rows.filter(F.col("fold") == k))
        out = part if out is None else out.unionByName(part)
    return out


def rule_model(df: DataFrame, features: list[str], label: str, c: float = 1.0) -> PipelineModel:
    """M2, K5: a pipeline over rule features that can be saved and loaded."""
    lr = LogisticRegression(featuresCol="features", labelCol=label, weightCol="weight", regParam=1.0 / (c * max(df.count(), 1)), standardization=False, maxIter=3000)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), lr]).fit(with_weights(df, label))


def weights_report(model: PipelineModel, features: list[str]) -> list[tuple[str, float]]:
    """O3: features by weight, largest first."""
    return sorted(zip(features, map(float, model.stages[-1].coefficients)), key=lambda x: -x[1])


def apply_rule_model(model: PipelineModel, df: DataFrame) -> DataFrame:
    """pred_ip and prob_ip (four places)."""
    p = F.round(vector_to_array("probability")[1], 4)
    return model.transform(df).withColumns({"pred_ip": F.col("prediction").cast("int"), "prob_ip": p}).drop("features", "rawPrediction", "probability", "prediction")


def ablation(df: DataFrame, variants: dict[str, list[str]], label: str, key: str, noise: float = NOISE) -> DataFrame:
    """M3: macro-F1 and accuracy of every feature set, difference to the first, and whether it exceeds the noise."""
    rows, base = [], None
    for name, features in variants.items():
        pred = out_of_fold(df, features, label, key).select(F.col(label).cast("int").cast("string").alias("gold"), F.col("prediction").cast("int").cast("string").alias("pred"))
        s = summary(pred).first()
        base = s["macro_f1"] if base is None else base
        rows.append((name, float(s["macro_f1"]), float(s["accuracy"]), float(s["macro_f1"] - base), abs(s["macro_f1"] - base) > noise))
    return df.sparkSession.createDataFrame(rows, "variant string, macro_f1 double, accuracy double, delta double, beyond_noise boolean")


def boosted(df: DataFrame, features: str, label: str, rounds: int = 400, depth: int = 6, rate: float = 0.1):
    """M4: one-against-rest gradient boosted trees with inverse-frequency weights, four fifths of rows and of columns a tree. A substitute for multiclass boosting; its figures aren't comparable."""
    trees = GBTClassifier(featuresCol=features, labelCol=label, weightCol="weight", maxIter=rounds, maxDepth=depth, stepSize=rate, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=42)
    return OneVsRest(classifier=trees, featuresCol=features, labelCol=label, weightCol="weight").fit(with_weights(df, label))


def read_probabilities(df: DataFrame, key: str, prefix: str = "prob_") -> DataFrame:
    """M5: (key, code, share) from columns prob_<CODE> that a fine-tuned model stored elsewhere."""
    names = [c for c in df.columns if c.startswith(prefix)]
    pairs = F.array(*[F.struct(F.lit(c.removeprefix(prefix)).alias("code"), F.col(c).cast("double").alias("share")) for c in names])
    return df.select(key, F.explode(pairs).alias("p")).select(key, "p.code", "p.share")


def balanced(column: Column) -> Column:
    """A 0/1 label from text, null unless it is one of them."""
    v = column.cast("string").try_cast("double")
    return F.when(v.isin(0.0, 1.0), v.cast("int"))
