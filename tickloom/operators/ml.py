"""Signal model: gradient-boosted trees over the feature sets."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.config import DEFAULT, Config
from tickloom.operators import ledger
from tickloom.operators.indicators import GOLD_FEATURES


def synthetic_training(spark: SparkSession, rows: int = 1000, seed: int = 42, features: tuple[str, ...] = GOLD_FEATURES) -> DataFrame:
    """Gaussian features and a coin as label; usd_strength and two momentum features lean with the label."""
    df = spark.range(rows).select("id", (F.rand(seed) < 0.5).cast("int").alias("label"), *[F.randn(seed + 1 + k).alias(c) for k, c in enumerate(features)])
    lean = {features[0]: 0.3, features[1]: 0.2, "risk_sentiment": -0.2}
    return df.withColumns({c: F.col(c) + v * F.col("label") for c, v in lean.items() if c in features})


def fit(training: DataFrame, features: tuple[str, ...] = GOLD_FEATURES, *, depth: int = 4, trees: int = 100, seed: int = 42) -> PipelineModel:
    """Training needs columns label (0, 1) and the features."""
    trees_model = GBTClassifier(labelCol="label", featuresCol="__x", maxDepth=depth, maxIter=trees, stepSize=0.1, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="__x", handleInvalid="keep"), trees_model]).fit(training)


def accuracy(model: PipelineModel, rows: DataFrame) -> float:
    return MulticlassClassificationEvaluator(labelCol="label", predictionCol="prediction", metricName="accuracy").evaluate(model.transform(rows))


def score(model: PipelineModel | None, rows: DataFrame) -> DataFrame:
    """Add ml_confidence, 0 to 100; 50 without a model."""
    if model is None:
        return rows.withColumn("ml_confidence", F.lit(50.0))
    return model.transform(rows).withColumn("ml_confidence", vector_to_array("probability")[1] * 100).drop("__x", "rawPrediction", "probability", "prediction")


def feature_importance(model: PipelineModel, spark: SparkSession, features: tuple[str, ...] = GOLD_FEATURES) -> DataFrame:
    """(feature, importance), one row per feature."""
    return spark.createDataFrame([(c, float(v)) for c, v in zip(features, model.stages[-1].featureImportances.toArray(), strict=True)], "feature string, importance double")


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def barrier_labels(candles: DataFrame, width: float = 0.004, config: Config = DEFAULT) -> DataFrame:
    """(symbol, ts, label, known_ts): whether a long trade from each bar's close would reach its target, two stops away, before its stop.

    Outcomes are those of ``ledger.resolve_replay``; expired ones count as not
    reached, open ones have no label.  known_ts is when the outcome is known at
    the latest: the trade's expiry.
    """
    trades = candles.select(F.concat_ws("|", "symbol", F.col("ts").cast("string")).alias("signal_id"), "symbol", F.col("ts").alias("entry_ts"), F.col("close").alias("entry_price"), (F.col("close") * (1 - width)).alias("stop_loss"), (F.col("close") * (1 + 2 * width)).alias("take_profit"))
    as_of = candles.groupBy("symbol").agg((F.max("ts") + F.expr("interval 1 hour")).alias("as_of"), F.max_by("close", "ts").alias("last_close"))
    out = ledger.resolve_replay(trades, candles, as_of, config).where("status <> 'OPEN'")
    return out.select("symbol", F.col("entry_ts").alias("ts"), (F.col("status") == "WIN").cast("int").alias("label"), (F.col("entry_ts") + F.make_dt_interval(hours=F.lit(config.trade_expiry_hours))).alias("known_ts"))


def walk_forward(rows: DataFrame, cuts: list, gap_hours: int = 0) -> DataFrame:
    """Rows (ts, known_ts, ...) once for each fold they serve, with fold and role.

    Fold k tests the rows from the k-th of *cuts* (times, ascending) to before
    the next, and trains on those whose label was known *gap_hours* before it,
    so no label tells of a bar that is tested.
    """
    cut = lambda k: F.lit(cuts[k]).cast("timestamp_ntz")
    gap = F.make_dt_interval(hours=F.lit(gap_hours))
    roles = []
    for k in range(len(cuts)):
        tests = (F.col("ts") >= cut(k)) & ((F.col("ts") < cut(k + 1)) if k + 1 < len(cuts) else F.lit(True))
        roles.append(F.struct(F.lit(k).alias("fold"), F.when(tests, "test").when(F.col("known_ts") + gap < cut(k), "train").alias("role")))
    return rows.withColumn("__r", F.explode(F.filter(F.array(*roles), lambda r: r["role"].isNotNull()))).select(*rows.columns, "__r.*")


def held_out_auc(rows: DataFrame, folds: int, features: tuple[str, ...] = GOLD_FEATURES, *, trees: int = 20, depth: int = 4) -> list[tuple[int, int, int, float]]:
    """(fold, rows trained on, rows tested, area under the curve) of the folds that can be fitted: both labels in both roles.

    A fit a fold: as many jobs as there are folds, each over its rows.
    """
    out = []
    for k in range(folds):
        train, test = (rows.where((F.col("fold") == k) & (F.col("role") == r)) for r in ("train", "test"))
        sizes = [df.agg(F.count("*").alias("n"), F.countDistinct("label").alias("k")).first() for df in (train, test)]
        if any(s["k"] < 2 for s in sizes):
            continue
        model = fit(train, features, trees=trees, depth=depth)
        auc = BinaryClassificationEvaluator(labelCol="label", rawPredictionCol="rawPrediction").evaluate(model.transform(test))
        out.append((k, sizes[0]["n"], sizes[1]["n"], float(auc)))
    return out
