"""Model fitting, prediction and evaluation on spark.ml."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from typing import TypeVar

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, MultilayerPerceptronClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import PCA, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .aggregates import balanced_weights, class_report, class_totals, confusion, overall

T, R = TypeVar("T"), TypeVar("R")


#: Fits that run side by side.
PARALLEL = 4


def at_once(f: Callable[[T], R], cases: Iterable[T], width: int = PARALLEL) -> list[R]:
    """f of every case, in their order, `width` at a time: the cluster's work overlaps where one fit leaves it idle."""
    with ThreadPoolExecutor(width) as pool:
        return list(pool.map(f, cases))


def vectors(bands: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=bands, outputCol="features", handleInvalid="skip")


def estimator(kind: str, bands: list[str], seed: int = 42, **params):
    """rf, svm, gbt or mlp with this library's usual settings."""
    if kind == "rf":
        return RandomForestClassifier(seed=seed, featureSubsetStrategy="sqrt", weightCol="weight", **{"numTrees": 20, "maxDepth": 8, **params})
    if kind == "svm":
        return OneVsRest(classifier=LinearSVC(maxIter=20, **params), weightCol="weight")
    if kind == "gbt":
        return OneVsRest(classifier=GBTClassifier(seed=seed, **{"maxIter": 5, "maxDepth": 4, **params}))
    if kind == "mlp":
        return MultilayerPerceptronClassifier(seed=seed, maxIter=params.get("maxIter", 30), layers=[len(bands), 16, params["classes"]])
    raise ValueError(kind)


def train(df: DataFrame, bands: list[str], cls: str, kind: str = "rf", **params) -> PipelineModel:
    """Indexed labels, assembled and standardised features, balanced class weights, and a classifier."""
    indexer = StringIndexer(inputCol=cls, outputCol="label", stringOrderType="alphabetAsc")
    scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True)
    model = estimator(kind, bands, **params).setFeaturesCol("scaled")
    rows = balanced_weights(df.dropna(subset=[*bands, cls]), cls)
    return Pipeline(stages=[indexer, vectors(bands), scaler, model]).fit(rows)


def predict(model: PipelineModel, df: DataFrame, out: str = "pred") -> DataFrame:
    """Predicted class names of every row with complete bands; rows without get null. Needs no label."""
    labels = F.array(*(F.lit(x) for x in model.stages[0].labels))
    scored = reduce(lambda d, s: s.transform(d), model.stages[1:], df)
    return scored.withColumn(out, F.get(labels, F.col("prediction").cast("int")))


def probabilities(model: PipelineModel, df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, class, proba), long."""
    labels = F.array(*(F.lit(x) for x in model.stages[0].labels))
    p = predict(model, df).select(*keys, F.posexplode(vector_to_array("probability")).alias("k", "proba"))
    return p.select(*keys, F.get(labels, F.col("k")).alias("class"), "proba")


def cross_validate(df: DataFrame, bands: list[str], cls: str, fold: str, k: int, kind: str = "rf", **params) -> DataFrame:
    """Predictions for each fold by a model of the others: fold, truth, pred. k is small; fits run PARALLEL at a time."""

    def one(i: int) -> DataFrame:
        model = train(df.where(F.col(fold) != i), bands, cls, kind, **params)
        return predict(model, df.where(F.col(fold) == i)).select(F.lit(i).alias("fold"), F.col(cls).alias("truth"), "pred")

    return reduce(DataFrame.unionByName, at_once(one, range(k)))


def score(predictions: DataFrame, by: list[str]) -> DataFrame:
    """Overall accuracy, kappa and mean F1."""
    cm = confusion(predictions, "truth", "pred", by)
    f1 = class_report(class_totals(cm, by)).groupBy(*by).agg(F.avg("f1").alias("f1"))
    return overall(cm, by).join(f1, by) if by else overall(cm).join(F.broadcast(f1))


def permutation_importance(model: PipelineModel, df: DataFrame, bands: list[str], cls: str, unique: str, repeats: int = 1) -> DataFrame:
    """Accuracy lost when one band's values are dealt out anew, by two digest orders of the id, within hash groups."""
    base = score(predict(model, df).select(F.col(cls).alias("truth"), "pred"), []).select(F.col("oa").alias("base"))
    by = ["band", "repeat"]
    cases = F.array(*(F.struct(F.lit(band).alias("band"), F.lit(k).alias("repeat")) for band in bands for k in range(repeats)))
    rows = df.withColumn("g", F.pmod(F.xxhash64(unique), F.lit(64))).withColumn("case", F.explode(cases)).select("*", "case.*").drop("case")
    order = lambda salt: F.row_number().over(Window.partitionBy(*by, "g").orderBy(F.md5(F.concat_ws("-", F.lit(salt), *by, unique))))
    value = F.coalesce(*(F.when(F.col("band") == b, F.col(b)) for b in bands))
    moved = rows.withColumn("p", order("a")).join(rows.select(*by, "g", order("b").alias("p"), value.alias("value")), [*by, "g", "p"])
    moved = moved.withColumns({b: F.when(F.col("band") == b, F.col("value")).otherwise(F.col(b)) for b in bands})
    oa = overall(confusion(predict(model, moved).select(*by, F.col(cls).alias("truth"), "pred"), "truth", "pred", by), by).select(*by, "oa")
    return oa.join(F.broadcast(base)).withColumn("importance", F.col("base") - F.col("oa"))


def importances(spark, model: PipelineModel, bands: list[str]) -> DataFrame:
    """Impurity importance of each band, largest first."""
    values = model.stages[-1].featureImportances.toArray().tolist()
    return spark.createDataFrame(sorted(zip(bands, values), key=lambda x: -x[1]), "band string, importance double")


def grid_search(df: DataFrame, bands: list[str], cls: str, fold: str, k: int, trees: list[int], depths: list[int]) -> DataFrame:
    """Mean accuracy of each setting over given folds."""
    rows = StringIndexer(inputCol=cls, outputCol="label", stringOrderType="alphabetAsc").fit(df).transform(df)
    rows = vectors(bands).transform(balanced_weights(rows, cls)).withColumn("fold_no", F.col(fold).cast("int"))
    rf = RandomForestClassifier(seed=42, weightCol="weight")
    grid = ParamGridBuilder().addGrid(rf.numTrees, trees).addGrid(rf.maxDepth, depths).build()
    cv = CrossValidator(estimator=rf, estimatorParamMaps=grid, evaluator=MulticlassClassificationEvaluator(metricName="accuracy"), numFolds=k, foldCol="fold_no", parallelism=2)
    found = cv.fit(rows).avgMetrics
    return df.sparkSession.createDataFrame([(g[rf.numTrees], g[rf.maxDepth], float(m)) for g, m in zip(grid, found)], "trees int, depth int, accuracy double")


def regress(df: DataFrame, bands: list[str], y: str, **params) -> PipelineModel:
    return Pipeline(stages=[vectors(bands), RandomForestRegressor(labelCol=y, seed=42, **{"numTrees": 20, **params})]).fit(df.dropna(subset=[*bands, y]))


def kmeans(df: DataFrame, bands: list[str], k: int = 3, seed: int = 42) -> DataFrame:
    """Adds cluster."""
    rows = vectors(bands).transform(df)
    return KMeans(k=k, seed=seed, predictionCol="cluster").fit(rows).transform(rows).drop("features")


def pca(df: DataFrame, bands: list[str], k: int) -> tuple[DataFrame, list[float]]:
    """Adds pc (array of k scores of centred bands); and the explained shares. Fitted on complete rows without zeros."""
    valid = reduce(lambda a, b: a & b, (F.col(b).isNotNull() & (F.col(b) != 0) for b in bands))
    scaler = StandardScaler(inputCol="features", outputCol="centred", withMean=True, withStd=False)
    rows = vectors(bands).transform(df.fillna(0.0, bands))
    centred = scaler.fit(rows.where(valid))
    model = PCA(k=k, inputCol="centred", outputCol="pcs").fit(centred.transform(rows.where(valid)))
    out = model.transform(centred.transform(rows)).withColumn("pc", vector_to_array("pcs")).drop("features", "centred", "pcs")
    return out, model.explainedVariance.toArray().tolist()
