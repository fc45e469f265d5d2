"""Fitted classifiers on vector columns, with Spark ML and cluster-aware folds."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchstone.functions.numeric import keyed_int, keyed_unit
from touchstone.operators.agreement import roc_auc, topk_accuracy
from touchstone.operators.running import with_scalars
from touchstone.operators.sampling import cluster_split


def _featured(df, vector: str) -> DataFrame:
    return df.withColumn("features", array_to_vector(F.transform(vector, lambda v: v.cast("double"))))


def logistic_probe(df, key: str, vector: str, label: str, cluster: str, train: Column, grid=(0.01, 1.0), folds: int = 3, seed: int = 0) -> DataFrame:
    """Standardised logistic probe: C by grouped cross-validation on AUC, refit, test AUC.

    ``grid`` holds values of C; the penalty is 1 / (C n).  Whole clusters share a fold.
    """
    rows = _featured(df, vector).withColumn("__train", train).withColumn("__fold", F.pmod(keyed_int(seed, cluster), F.lit(folds)).cast("int"))
    fit_rows = rows.filter("__train").select(key, "features", F.col(label).alias("label"), "__fold").persist()
    n = fit_rows.count()
    model = LogisticRegression(featuresCol="scaled", labelCol="label", maxIter=100, standardization=False)
    pipe = Pipeline(stages=[StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True), model])
    search = CrossValidator(
        estimator=pipe, estimatorParamMaps=ParamGridBuilder().addGrid(model.regParam, [1.0 / (c * n) for c in grid]).build(),
        evaluator=BinaryClassificationEvaluator(labelCol="label"), numFolds=folds, foldCol="__fold")
    best = search.fit(fit_rows)
    fit_rows.unpersist()
    chosen = grid[max(range(len(grid)), key=lambda i: best.avgMetrics[i])]
    scored = best.transform(rows.filter("NOT __train").withColumn("label", F.col(label)))
    scored = scored.select(F.col(label).cast("int").alias("__y"), vector_to_array("probability")[1].alias("__p"))
    return roc_auc(scored, "__p", "__y").withColumn("chosen_c", F.lit(float(chosen)))


def tree_classifier(df, key: str, vector: str, label: str, cluster: str, test_share: float = 0.2, trees: int = 50, depth: int = 6, kind: str = "forest", seed: int = 0) -> DataFrame:
    """Random forest or boosted trees under a grouped split: top-k accuracy and mean reciprocal rank."""
    rows = _featured(df, vector).withColumn("label", F.col(label).cast("double"))
    total = rows.count()
    split = cluster_split(rows, cluster, int(test_share * total), seed).persist()
    make = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed) if kind == "forest" else GBTClassifier(maxIter=trees, maxDepth=depth, seed=seed)
    model = make.fit(split.filter("split = 'train'"))
    scored = model.transform(split.filter("split = 'test'"))
    long = scored.select(key, F.col("label").cast("int").alias("__truth"), F.posexplode(vector_to_array("probability")).alias("candidate", "p"))
    return topk_accuracy(long, key, "__truth", "candidate", "p")


def triple_scoring(df, classes: DataFrame, key: str, vector: str, label: str, profile: str, seen: Column, negatives: int = 2, trees: int = 20, seed: int = 0) -> DataFrame:
    """Leave-classes-out ranking: a model scores (vector, class profile) pairs, trained on seen
    classes only, and ranks all classes for rows of unseen ones.

    Each training row takes its own class and ``negatives`` hash-drawn others.  Classes are a
    label set, so they are exploded from one array rather than joined all against all.
    """
    listed = classes.agg(F.collect_list(F.struct(F.col(label).alias("c"), F.col(profile).alias("q"))).alias("__classes"))
    pairs = with_scalars(df.withColumn("__seen", seen), listed).withColumn("__c", F.explode("__classes"))
    pairs = pairs.select(key, vector, label, "__seen", F.col("__c.c").alias("candidate"), F.col("__c.q").alias("__q"))
    widen = lambda c: F.transform(c, lambda v: v.cast("double"))
    joint = F.concat(widen(vector), widen("__q"), F.zip_with(vector, "__q", lambda a, b: a.cast("double") - b))
    hit = (F.col("candidate") == F.col(label)).cast("double")
    pairs = pairs.withColumn("features", array_to_vector(joint)).withColumn("__hit", hit)
    count = classes.count()
    draw = keyed_unit(seed, key, "candidate") < negatives / max(count - 1, 1)
    train = pairs.filter(F.col("__seen") & ((F.col("__hit") == 1.0) | draw))
    model = RandomForestClassifier(labelCol="__hit", numTrees=trees, maxDepth=6, seed=seed).fit(train.select("features", "__hit"))
    scored = model.transform(pairs.filter("NOT __seen")).select(key, F.col(label).alias("__truth"), "candidate", vector_to_array("probability")[1].alias("p"))
    return topk_accuracy(scored, key, "__truth", "candidate", "p")
