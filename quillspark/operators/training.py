"""Classifiers on term counts, with Spark's own learners; predictions are deterministic given the rows."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import CountVectorizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from quillspark.functions.text import words
from quillspark.operators.neighbours import nearest_rows
from quillspark.operators.tables import draw, shared_folder


def terms(docs: DataFrame, text: str) -> DataFrame:
    """Add ``terms``, the words of a column of texts, or that column where it has words already."""
    found = F.col(text) if isinstance(docs.select(text).schema[0].dataType, ArrayType) else words(F.col(text))
    return docs.withColumn("terms", F.coalesce(found, F.array().cast("array<string>")))


def elastic_net(train: DataFrame, text: str, label: str, features: int = 2_000, mixing: float = 0.5, penalty: float = 0.01, rounds: int = 20):
    """A fitted pipeline of counts and a logistic regression with an elastic net; ``label`` is 0 or 1."""
    steps = [CountVectorizer(inputCol="terms", outputCol="features", vocabSize=features, minDF=2.0), LogisticRegression(labelCol=label, elasticNetParam=mixing, regParam=penalty, maxIter=rounds)]
    return Pipeline(stages=steps).fit(terms(train, text).withColumn(label, F.col(label).cast("double")))


def linear_svm(train: DataFrame, text: str, label: str, features: int = 2_000, penalty: float = 0.01, rounds: int = 20):
    """A fitted pipeline of counts, a linear SVM, and Platt scaling: a logistic regression on the
    margins gives the probabilities."""
    counts = CountVectorizer(inputCol="terms", outputCol="features", vocabSize=features, minDF=2.0)
    svm = LinearSVC(labelCol=label, regParam=penalty, maxIter=rounds, rawPredictionCol="margins")
    df = terms(train, text).withColumn(label, F.col(label).cast("double"))
    fitted = Pipeline(stages=[counts, svm]).fit(df)
    scaling = LogisticRegression(featuresCol="margins", labelCol=label, maxIter=100, predictionCol="scaled", rawPredictionCol="scaled_margins")
    return PipelineModel([*fitted.stages, scaling.fit(fitted.transform(df).select(label, "margins"))])


def forest(train: DataFrame, text: str, label: str, features: int = 500, trees: int = 20, depth: int = 5, seed: int = 1):
    counts = CountVectorizer(inputCol="terms", outputCol="features", vocabSize=features, minDF=2.0)
    model = RandomForestClassifier(labelCol=label, numTrees=trees, maxDepth=depth, seed=seed)
    return Pipeline(stages=[counts, model]).fit(terms(train, text).withColumn(label, F.col(label).cast("double")))


def boosted(train: DataFrame, text: str, label: str, features: int = 500, rounds: int = 10, depth: int = 3, seed: int = 1):
    counts = CountVectorizer(inputCol="terms", outputCol="features", vocabSize=features, minDF=2.0)
    model = GBTClassifier(labelCol=label, maxIter=rounds, maxDepth=depth, seed=seed)
    return Pipeline(stages=[counts, model]).fit(terms(train, text).withColumn(label, F.col(label).cast("double")))


def cross_validated(train: DataFrame, text: str, label: str, key: str, grid: Sequence[dict], folds: int = 5, repeats: int = 3, fit=None) -> tuple[dict, DataFrame]:
    """The best of the parameters by the mean area under the ROC curve over repeated folds, and all
    means. Folds are drawn by a hash of the key within each class, so they are stratified."""
    fit = fit or elastic_net
    spark, rows = train.sparkSession, []
    for i, parameters in enumerate(grid):
        for r in range(repeats):
            dealt = train.withColumn("_fold", draw(key, r) % folds)
            for f in range(folds):
                model = fit(dealt.where(F.col("_fold") != f), text, label, **parameters)
                scored = model.transform(terms(dealt.where(F.col("_fold") == f), text)).withColumn(label, F.col(label).cast("double"))
                rows.append((i, str(parameters), r, f, BinaryClassificationEvaluator(labelCol=label).evaluate(scored)))
    every = spark.createDataFrame(rows, "candidate int, parameters string, repeat int, fold int, auc double")
    means = every.groupBy("candidate", "parameters").agg(F.avg("auc").alias("auc"), F.stddev("auc").alias("sd"), F.count("*").alias("n"))
    best = means.orderBy(F.desc("auc"), "candidate").first()
    return dict(grid[best.candidate]), means


def learning_curve(train: DataFrame, test: DataFrame, text: str, label: str, key: str, shares: Sequence[float], fit=None, seed: int = 1) -> DataFrame:
    """share, n, accuracy of a model fitted on the first draws of that share of the training rows. Rows are
    stored once, as a fit passes over them several times; the learners here get words for texts."""
    fit = fit or elastic_net
    spark, out = train.sparkSession, []
    path = f"{shared_folder(spark)}/curve-{uuid.uuid4().hex}"
    for name, df in (("train", train), ("test", test)):
        kept = terms(df, text).withColumn(text, F.col("terms")).drop("terms") if fit in (elastic_net, linear_svm, forest, boosted) else df
        kept.write.parquet(f"{path}/{name}")
    train, test = (spark.read.parquet(f"{path}/{name}") for name in ("train", "test"))
    for s in shares:
        some = train.where(draw(key, seed) < int(s * 2**52))
        scored = fit(some, text, label).transform(terms(test, text))
        right = scored.agg(F.avg((F.col("prediction") == F.col(label)).cast("double"))).first()[0]
        out.append((s, some.count(), right))
    return spark.createDataFrame(out, "share double, n long, accuracy double")


def coefficients(model) -> DataFrame:
    """feature, coefficient of a fitted linear pipeline; its vocabulary is bounded."""
    from pyspark.sql import SparkSession

    linear = next(s for s in model.stages if hasattr(s, "coefficients"))
    words_ = model.stages[0].vocabulary
    return SparkSession.getActiveSession().createDataFrame([(w, float(c)) for w, c in zip(words_, linear.coefficients.toArray())], "feature string, coefficient double")


def importances(weights: DataFrame, most: int = 20, positive: str = "Positive", negative: str = "Negative") -> DataFrame:
    """The features with the largest coefficients either way, and their direction."""
    size = F.abs("coefficient")
    out = weights.withColumn("size", size).orderBy(F.desc("size"), "feature").limit(most)
    return out.withColumn("direction", F.when(F.col("coefficient") > 0, positive).when(F.col("coefficient") < 0, negative).otherwise("Neutral"))


def compared(a: DataFrame, b: DataFrame, most: int = 15) -> DataFrame:
    """The top features of two models side by side, with zeros, and whether the directions agree
    (null where one model hasn't the feature)."""
    one, two = (importances(x, most).select("feature", F.col("coefficient").alias(f"coefficient_{n}"), F.col("direction").alias(f"direction_{n}")) for n, x in (("a", a), ("b", b)))
    both = one.join(two, "feature", "full_outer").fillna(0.0, ["coefficient_a", "coefficient_b"])
    return both.withColumn("agree", F.col("direction_a") == F.col("direction_b"))


def near_zero_variance(df: DataFrame, names: Sequence[str], ratio: float = 95 / 5, distinct: float = 10.0) -> DataFrame:
    """name, freq_ratio, percent_unique and nzv of each column: the count of its commonest value over
    that of the next, and distinct values in percent of the rows. One pass over the long form."""
    counts = df.unpivot([], [F.col(c).cast("string").alias(c) for c in names], "name", "value").where("value is not null").groupBy("name", "value").agg(F.count("*").alias("n"))
    # of each column only the two largest counts, its distinct values and its rows
    most = counts.groupBy("name").agg(F.max("n").alias("first"), F.max_by("value", F.struct("n", "value")).alias("at"), F.count("*").alias("distinct"), F.sum("n").alias("rows"))
    second = counts.join(F.broadcast(most.select("name", "at")), "name").where(F.col("value") != F.col("at")).groupBy("name").agg(F.max("n").alias("second"))
    out = most.join(second, "name", "left")
    freq = F.when(F.col("second").isNull(), 0.0).otherwise(F.col("first") / F.col("second"))
    unique = 100 * F.col("distinct") / F.col("rows")
    return out.select("name", F.round(freq, 6).alias("freq_ratio"), F.round(unique, 6).alias("percent_unique"), ((F.col("distinct") == 1) | ((freq > ratio) & (unique <= distinct))).alias("nzv"))


def correlated(df: DataFrame, names: Sequence[str], threshold: float = 0.9) -> DataFrame:
    """a, b, correlation of the pairs of columns whose correlation exceeds the threshold either way,
    in one pass over the rows."""
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    row = df.agg(*[F.corr(a, b).alias(f"{i}") for i, (a, b) in enumerate(pairs)])
    each = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{i}").alias("correlation")) for i, (a, b) in enumerate(pairs)])
    return row.select(F.explode(each).alias("x")).select("x.*").where(F.abs("correlation") > threshold)


def save(model, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str):
    return PipelineModel.load(path)


def predicted(model, docs: DataFrame, text: str, key: str) -> DataFrame:
    """key, prediction and, where the model has one, the probability of class 1. One narrow pass:
    documents are scored where they are, whatever their number."""
    out = model.transform(terms(docs, text))
    p = F.round(vector_to_array("probability")[1], 6) if "probability" in out.columns else F.lit(None).cast("double")
    return out.select(key, F.col("prediction").cast("int").alias("prediction"), p.alias("probability"))


def balanced_by_neighbours(df: DataFrame, label: str, minority: int, values: list[str], copies: int, key: str, seed: int = 1, near: int = 5) -> DataFrame:
    """SMOTE: each minority row is moved, ``copies`` times, towards a drawn one of its ``near`` nearest
    minority rows (Euclidean distance of the values, exact at every size) by a drawn share; the
    original rows stay. Draws depend on the row's key alone.
    """
    import numpy as np
    import pandas as pd

    few = df.where(F.col(label) == minority)
    found = nearest_rows(few, key, values, near, seed=seed)

    def moved(frames):
        for f in frames:
            out = []
            for own, x, others in zip(f["key"], f["v"], f["others"]):
                x, rng = np.asarray(x, float), np.random.default_rng([seed, int(own) % 2**63])
                for _ in range(copies):
                    to = np.asarray(others[rng.integers(len(others))], float) if len(others) else x
                    out.append([own, *(x + rng.random() * (to - x))])
            yield pd.DataFrame(out, columns=[key, *values])

    pairs = found.select("key", "v", F.transform("neighbours", lambda n: n["v"]).alias("others"))
    made = pairs.mapInPandas(moved, f"`{key}` long, " + ", ".join(f"`{v}` double" for v in values)).withColumn(label, F.lit(minority))
    own = df.select(key, label, *[F.col(v).cast("double").alias(v) for v in values]).withColumn("synthetic", F.lit(False))
    return own.unionByName(made.select(key, F.col(label).cast(df.schema[label].dataType), *values).withColumn("synthetic", F.lit(True)))
