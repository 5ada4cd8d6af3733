"""Grouped cross-fitting with pyspark.ml: every row is predicted by a model that never saw its group."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchloom.session import cut


def fold_of(group: str, folds: int):
    return F.pmod(F.xxhash64(group), F.lit(folds))


def split_groups(df: DataFrame, group: str, share: float) -> DataFrame:
    """Adds is_train; all rows of a group fall on the same side."""
    return df.withColumn("is_train", F.pmod(F.xxhash64(group), F.lit(10_000)) < int(share * 10_000))


def boosted_out_of_fold(df: DataFrame, keys: list[str], group: str, label: str, features: list[str], folds: int = 3, rounds: int = 5) -> DataFrame:
    """(keys, label, raw, calibrated): boosted trees out of fold, then isotonic calibration."""
    rows = cut(VectorAssembler(inputCols=features, outputCol="_x").transform(df).withColumn("_fold", fold_of(group, folds)))
    parts = []
    for k in range(folds):
        model = GBTClassifier(featuresCol="_x", labelCol=label, maxIter=rounds, maxDepth=3, seed=42).fit(rows.where(F.col("_fold") != k))
        parts.append(model.transform(rows.where(F.col("_fold") == k)).select(*keys, label, F.get(vector_to_array("probability"), F.lit(1)).alias("raw")))
    oof = cut(reduce(DataFrame.unionByName, parts))
    iso = IsotonicRegression(featuresCol="raw", labelCol=label, predictionCol="calibrated").fit(oof)
    return iso.transform(oof).select(*keys, label, "raw", "calibrated")


def doubly_robust(df: DataFrame, group: str, treated: str, outcome: str, features: list[str], folds: int = 5, trim: float = 0.01) -> DataFrame:
    """One row (att, se, n): augmented inverse weighting for the treated, cross-fitted by group;
    the error is clustered by group, without small-sample factor."""
    rows = cut(VectorAssembler(inputCols=features, outputCol="_x").transform(df).withColumn("_fold", fold_of(group, folds)))
    parts = []
    for k in range(folds):
        train, test = rows.where(F.col("_fold") != k), rows.where(F.col("_fold") == k)
        p = LogisticRegression(featuresCol="_x", labelCol=treated, probabilityCol="_p", rawPredictionCol="_r", predictionCol="_c").fit(train)
        m = LinearRegression(featuresCol="_x", labelCol=outcome, predictionCol="_m0").fit(train.where(F.col(treated) == 0))
        parts.append(m.transform(p.transform(test)).select(group, treated, outcome, F.get(vector_to_array("_p"), F.lit(1)).alias("e"), "_m0"))
    oof = cut(reduce(DataFrame.unionByName, parts))
    e = F.greatest(F.least("e", F.lit(1 - trim)), F.lit(trim))
    t, gap = F.col(treated), F.col(outcome) - F.col("_m0")
    scored = oof.withColumn("s", gap * (t - (1 - t) * e / (1 - e)))
    per = scored.groupBy(group).agg(F.sum("s").alias("s"), F.sum(treated).alias("t"), F.count(F.lit(1)).alias("m"))
    one = per.agg(F.sum("s").alias("S"), F.sum("t").alias("T"), F.sum(F.col("s") * F.col("s")).alias("a"), F.sum(F.col("s") * F.col("t")).alias("b"), F.sum(F.col("t") * F.col("t")).alias("c"), F.sum("m").alias("n"))
    att = F.try_divide("S", "T")
    return one.select(att.alias("att"), F.try_divide(F.sqrt(F.greatest(F.col("a") - 2 * att * F.col("b") + att * att * F.col("c"), F.lit(0.0))), "T").alias("se"), "n")


def fit_pipeline(df: DataFrame, label: str, features: list[str]):
    """A saveable model (``model.write().overwrite().save(path)``)."""
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_x"), LogisticRegression(featuresCol="_x", labelCol=label)]).fit(df)
