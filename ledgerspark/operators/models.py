"""Splits, classifiers, stacking, anomaly scores and calibration of transactions, on MLlib."""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import new_path, persisted, written
from .prepare import median_imputed, oversampled
from .robust import quantiles

FEATURES = "TransactionAmt log_amount amount_decimal is_round_amount hour is_night day_of_week user_avg_amt user_std_amt user_txn_count amount_zscore amount_to_mean_ratio time_since_last txn_count_30min".split()
ID, Y = "TransactionID", "isFraud"


def ranked(df: DataFrame) -> DataFrame:
    """rank (from 1) and n of each row in its label, by md5 of the id. Rows are ranked within 4,096 ranges of the hash, whose counts
    give the offsets, so no task sorts a whole label."""
    df = df.withColumn("_h", F.md5(F.col(ID).cast("string"))).withColumn("_b", F.substring("_h", 1, 3))
    size = df.groupBy(Y, "_b").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(Y)
    size = size.select(Y, "_b", (F.sum("_n").over(w.orderBy("_b")) - F.col("_n")).alias("_before"), F.sum("_n").over(w).alias("n"))
    return df.join(F.broadcast(size), [Y, "_b"]).withColumn("rank", F.col("_before") + F.row_number().over(Window.partitionBy(Y, "_b").orderBy("_h", ID))).drop("_h", "_b", "_before")  # at most 8,192 counts


def stratified_split(df: DataFrame, share: float = 0.2) -> DataFrame:
    """is_test: the first share of each label."""
    return ranked(df).withColumn("is_test", (F.col("rank") <= F.ceil(F.col("n") * F.lit(share))).cast("int")).drop("rank", "n")


def stratified_kfold(df: DataFrame, folds: int = 7) -> DataFrame:
    return ranked(df).withColumn("fold", (F.col("rank") % folds).cast("int")).drop("rank", "n")


def prepared(df: DataFrame, columns: list[str] = FEATURES, label: str = Y) -> DataFrame:
    """Columns as doubles (null: 0), a double label, and weights that give both labels the same sum."""
    rate = df.agg(F.avg(label).alias("_rate"))
    df = df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns}).crossJoin(F.broadcast(rate))
    return df.withColumn("label", F.col(label).cast("double")).withColumn("weight", F.when(F.col(label) == 1, F.try_divide(F.lit(0.5), F.col("_rate"))).otherwise(F.try_divide(F.lit(0.5), 1 - F.col("_rate")))).drop("_rate")


def pipeline(kind: str, columns: list[str] = FEATURES) -> Pipeline:
    """kind: one of three boosted variants, a forest, a perceptron on scaled features, or a logistic model."""
    trees = {"gbt": (6, 20, 0.1), "gbt_shallow": (3, 30, 0.1), "gbt_sampled": (5, 20, 0.2)}
    gather = [VectorAssembler(inputCols=columns, outputCol="raw_features"), StandardScaler(inputCol="raw_features", outputCol="features", withMean=True)]
    if kind in trees:
        depth, rounds, step = trees[kind]
        return Pipeline(stages=[*gather, GBTClassifier(maxDepth=depth, maxIter=rounds, stepSize=step, subsamplingRate=0.7 if kind == "gbt_sampled" else 1.0, weightCol="weight", seed=42)])
    last = {
        "forest": RandomForestClassifier(numTrees=300, maxDepth=14, weightCol="weight", seed=42),
        "perceptron": MultilayerPerceptronClassifier(layers=[len(columns), 256, 128, 64, 2], maxIter=60, seed=42),
        "logistic": LogisticRegression(weightCol="weight", regParam=0.01),
    }
    return Pipeline(stages=[*gather, last[kind]])


def with_proba(model: PipelineModel, df: DataFrame, name: str = "proba") -> DataFrame:
    out = model.transform(df).withColumn(name, vector_to_array("probability")[1])
    return out.drop("raw_features", "features", "rawPrediction", "probability", "prediction")


def trained(df: DataFrame, kind: str) -> DataFrame:
    """The test rows with the probabilities of a model that was fitted on the others, saved and loaded."""
    data = written(stratified_split(prepared(df)), "split")
    model = persisted(pipeline(kind).fit(data.where("is_test = 0")), new_path(df.sparkSession, "model"))
    return with_proba(model, data.where("is_test = 1"))


def round_trip(df: DataFrame, kind: str = "logistic") -> DataFrame:
    """TransactionID, proba of a fitted pipeline, and same: whether its saved and loaded copy gives that too."""
    data = written(prepared(df), "round-trip")
    model = pipeline(kind).fit(data)
    both = with_proba(persisted(model, new_path(df.sparkSession, "model")), with_proba(model, data), "again")
    return both.select(ID, "proba", (F.abs(F.col("proba") - F.col("again")) < 1e-12).cast("int").alias("same"))


def auc_of(df: DataFrame, score: str) -> float:
    return BinaryClassificationEvaluator(rawPredictionCol=score, labelCol="label", numBins=0).evaluate(df)


def resampled(train: DataFrame, ratio: float | None, columns: list[str] = FEATURES) -> DataFrame:
    """The rows to fit on: with a ratio, those and made minority rows from them alone, so a fold's held-out rows lend nothing."""
    if ratio is None:
        return train
    made = oversampled(train.withColumn(Y, F.col("label").cast("int")), tuple(columns), ratio)
    return made.withColumns({"label": F.col(Y).cast("double"), "weight": F.lit(1.0)})


def at_once(jobs: list, threads: int = 4) -> list:
    """The results of Spark jobs without arguments, a few running side by side, in their order."""
    with ThreadPoolExecutor(threads) as pool:
        return list(pool.map(lambda j: j(), jobs))


def oof_predictions(df: DataFrame, kinds: tuple[str, ...], folds: int, ratio: float | None = None) -> DataFrame:
    """TransactionID, fold, model, is_test, proba: each training row's probability by the models that didn't see its fold, and each
    test row's by those of every fold. df: prepared, with is_test and fold. ratio: in each fold the rows that are fitted
    on are oversampled to it, after the fold's rows are held out."""
    train, test = df.where("is_test = 0"), df.where("is_test = 1")
    others = [train.where(F.col("fold") != k) for k in range(folds)]
    if ratio:
        others = [written(resampled(o, ratio), "resampled") for o in others]

    def fitted(k: int, kind: str) -> DataFrame:
        rows = train.where(F.col("fold") == k).unionByName(test)
        out = with_proba(pipeline(kind).fit(others[k]), rows)
        return written(out.select(ID, F.lit(k).alias("fold"), F.lit(kind).alias("model"), "is_test", "proba"), "oof")

    parts = at_once([lambda k=k, kind=kind: fitted(k, kind) for k in range(folds) for kind in kinds])
    return reduce(DataFrame.unionByName, parts)


def oof_stacking(df: DataFrame, kinds=("gbt", "gbt_sampled", "perceptron"), folds: int = 7, ratio: float | None = None, anomaly: bool = True) -> DataFrame:
    """Test rows with each model's mean probability over the folds (p_kind), the isolation score (anomaly) and proba, that of the boosted
    meta-learner on out-of-fold probabilities and the isolation score."""
    data = written(stratified_kfold(stratified_split(prepared(df)), folds), "folds")
    long = oof_predictions(data, kinds, folds, ratio)
    names = [f"p_{k}" for k in kinds]
    wide = long.groupBy(ID, "is_test").pivot("model", list(kinds)).agg(F.avg("proba")).withColumnsRenamed(dict(zip(kinds, names)))
    every = data.select(ID, Y, "label", "weight", "is_test").join(wide.drop("is_test"), ID)
    if anomaly:
        every, names = every.join(isolation_forest(data), ID).withColumnRenamed("iso_score", "p_isolation"), [*names, "p_isolation"]
    every = written(every, "stacked")
    return with_proba(pipeline("gbt_shallow", names).fit(every.where("is_test = 0")), every.where("is_test = 1"))


def tuned(df: DataFrame, tree_depths=(3, 5), steps=(0.05, 0.2), shares=(0.7, 1.0), folds: int = 3, rounds: int = 10) -> DataFrame:
    """max_depth, step_size, subsampling, auc: the mean AUC over the folds of each setting, settings and folds fitted side by side."""
    data = written(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(stratified_kfold(prepared(df), folds)).select(ID, "fold", "features", "label", "weight"), "tuning")
    grid = [(a, b, c) for a in tree_depths for b in steps for c in shares]

    def tried(setting: tuple, k: int) -> float:
        depth, step, share = setting
        model = GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=step, subsamplingRate=share, weightCol="weight", seed=42).fit(data.where(F.col("fold") != k))
        return BinaryClassificationEvaluator().evaluate(model.transform(data.where(F.col("fold") == k)))

    got = at_once([lambda s=s, k=k: tried(s, k) for s in grid for k in range(folds)])
    rows = [(int(a), float(b), float(c), float(np.mean(got[i * folds : (i + 1) * folds]))) for i, (a, b, c) in enumerate(grid)]
    return df.sparkSession.createDataFrame(rows, "max_depth int, step_size double, subsampling double, auc double")


def importance_table(df: DataFrame, kinds=("gbt", "forest"), columns: list[str] = FEATURES, label: str = Y, folds: int | None = None) -> DataFrame:
    """model, fold, feature, importance: of each tree model, fitted on all rows or on those outside each fold."""
    data = prepared(df, columns, label)
    data = written(stratified_kfold(data, folds) if folds else data.withColumn("fold", F.lit(-1)), "importances")

    def fitted(kind: str, k: int) -> list[tuple]:
        got = pipeline(kind, columns).fit(data.where(F.col("fold") != k)).stages[-1].featureImportances.toArray()
        return [(kind, k, c, float(v)) for c, v in zip(columns, got)]

    jobs = [lambda kind=kind, k=k: fitted(kind, k) for kind in kinds for k in range(folds or 1)]
    return df.sparkSession.createDataFrame([r for rows in at_once(jobs) for r in rows], "model string, fold int, feature string, importance double")


def avg_importance(table: DataFrame, top: int | None = None) -> DataFrame:
    """feature, importance: the mean over models and folds of importances that sum to 1 in each; the top greatest, or all."""
    total = table.groupBy("model", "fold").agg(F.sum("importance").alias("_t"))
    mean = table.join(F.broadcast(total), ["model", "fold"]).groupBy("feature").agg(F.avg(F.coalesce(F.try_divide("importance", "_t"), F.lit(0.0))).alias("importance"))
    return mean.orderBy(F.desc("importance"), "feature").limit(top) if top else mean


def importances(df: DataFrame, kinds=("gbt", "forest"), columns: list[str] = FEATURES, label: str = Y) -> DataFrame:
    """feature, importance: mean over the tree models of importances that sum to 1 in each."""
    return avg_importance(importance_table(df, kinds, columns, label))


def selected_features(df: DataFrame, least: float = 0.001, folds: int = 3) -> DataFrame:
    """feature, importance, kept: the mean importance over the folds' boosted models, and whether it reaches least."""
    return avg_importance(importance_table(df, ("gbt",), folds=folds)).withColumn("kept", (F.col("importance") >= least).cast("int"))


def adversarial_validation(df: DataFrame, is_late: Column, folds: int = 3) -> DataFrame:
    """auc of telling late rows from early ones, its status, and the features that tell most (up to ten)."""
    origin = df.drop(Y).withColumn(Y, is_late.cast("int"))
    data = written(stratified_kfold(prepared(origin), folds), "origins")
    total, mean = 0.0, np.zeros(len(FEATURES))
    for k in range(folds):
        model = pipeline("gbt_shallow").fit(data.where(F.col("fold") != k))
        total += auc_of(with_proba(model, data.where(F.col("fold") == k)), "proba") / folds
        mean += model.stages[-1].featureImportances.toArray() / folds
    status = "none" if total < 0.55 else "mild" if total < 0.65 else "moderate" if total < 0.75 else "severe"
    top = sorted(zip(FEATURES, mean.tolist()), key=lambda x: (-x[1], x[0]))[:10]
    return df.sparkSession.createDataFrame([(total, status, n, v) for n, v in top], "auc double, status string, feature string, importance double")


def contributions(df: DataFrame, weights: dict[str, float]) -> DataFrame:
    """df with parts: an array of (size, name, value) of each column's signed contribution w (x - mean), exact for a linear model;
    nulls count as the mean."""
    means = df.agg(*(F.avg(F.col(c).cast("double")).alias(f"_m_{c}") for c in weights))
    value = lambda c: F.coalesce((F.col(c).cast("double") - F.col(f"_m_{c}")) * F.lit(float(weights[c])), F.lit(0.0))
    parts = F.array(*(F.struct(F.abs(value(c)).alias("size"), F.lit(c).alias("name"), value(c).alias("value")) for c in weights))
    return df.crossJoin(F.broadcast(means)).withColumn("parts", parts).drop(*(f"_m_{c}" for c in weights))


def explained(df: DataFrame, top: int = 5) -> DataFrame:
    """TransactionID, reasons, largest (the value of the first), spread (the mean size of all): from contributions, the top greatest in
    size, ties by name from the end."""
    best = F.slice(F.reverse(F.array_sort("parts")), 1, top)
    text = F.transform(best, lambda x: F.format_string("%s %s fraud risk (SHAP=%.3f)", x["name"], F.when(x["value"] > 0, "increases").otherwise("decreases"), x["value"]))
    spread = F.aggregate("parts", F.lit(0.0), lambda s, x: s + x["size"]) / F.size("parts")
    return df.select(ID, F.array_join(text, " | ").alias("reasons"), F.transform(best, lambda x: x["value"])[0].alias("largest"), spread.alias("spread"))


def mean_contributions(df: DataFrame) -> DataFrame:
    """feature, mean_size: the mean size of each column's contributions over all rows."""
    return df.select(F.explode("parts").alias("p")).groupBy(F.col("p.name").alias("feature")).agg(F.avg("p.size").alias("mean_size"))


def most_explained(df: DataFrame, n: int = 3) -> DataFrame:
    """The n rows of explained with the greatest spread, ties by id."""
    return explained(df).orderBy(F.desc(F.round("spread", 9)), ID).limit(n)


def logistic_weights(data: DataFrame) -> dict[str, float]:
    """A logistic model's weights on prepared columns, in their own units."""
    model = pipeline("logistic").fit(data)
    return {c: float(a / s) if s else 0.0 for c, s, a in zip(FEATURES, model.stages[1].std.toArray(), model.stages[2].coefficients.toArray())}


def linear_contributions(df: DataFrame, top: int = 5) -> DataFrame:
    """Each row's largest signed contributions to a logistic model, as text."""
    data = written(prepared(df), "explained")
    return explained(contributions(data, logistic_weights(data)), top)


def pca_v(df: DataFrame, columns: list[str], k: int = 5) -> DataFrame:
    """Principal components of standardised columns (null: median); the loading of largest size of each is positive."""
    scaled, model = components_of(df, columns, k)
    load = model.pc.toArray()
    load = load * np.sign(load[np.abs(load).argmax(0), range(load.shape[1])])
    x = vector_to_array("z")
    return scaled.select(ID, *(sum(x[i] * float(load[i, j]) for i in range(len(columns))).alias(f"pca_{j + 1}") for j in range(k)))


def components_of(df: DataFrame, columns: list[str], k: int, fit_on: Column | None = None):
    data = written(median_imputed(df, tuple(columns)), "components")
    base = data if fit_on is None else data.where(fit_on)
    scale = Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="x"), StandardScaler(inputCol="x", outputCol="z", withMean=True)]).fit(base)
    return scale.transform(data), PCA(k=k, inputCol="z", outputCol="p").fit(scale.transform(base))


def pca_anomaly(df: DataFrame, columns: list[str] = FEATURES, k: int = 10) -> DataFrame:
    """error of reconstruction from components fitted on label 0, its 95th percentile there as threshold, and a score from 0 to 1."""
    scaled, model = components_of(df, columns, k, F.col(Y) == 0)
    out = model.transform(scaled)
    z, p = vector_to_array("z"), vector_to_array("p")
    square = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v * v)
    out = written(out.select(ID, Y, (F.greatest(square(z) - square(p), F.lit(0.0)) / len(columns)).alias("error")), "errors")  # components are orthonormal
    return anomaly_scores(out)


def anomaly_scores(df: DataFrame) -> DataFrame:
    """TransactionID, error, threshold (the 95th percentile of label 0), score (0 to 1: the error over the greater of its 99.9th percentile and
    three thresholds), is_anomaly, from errors of reconstruction."""
    cut = quantiles(df.where(F.col(Y) == 0), "error", 0.95).select(F.col("q").alias("threshold")).crossJoin(quantiles(df, "error", 0.999).select(F.col("q").alias("_top")))
    out = df.crossJoin(F.broadcast(cut))
    return out.select(ID, "error", "threshold", F.least(F.lit(1.0), F.coalesce(F.try_divide("error", F.greatest("_top", 3 * F.col("threshold"))), F.lit(0.0))).alias("score"), (F.col("error") > F.col("threshold")).cast("int").alias("is_anomaly"))


def grown(x: np.ndarray, rng, depth: int) -> tuple:
    """A random isolation tree: (column, cut, left, right) or the size of a leaf."""
    low, high = x.min(0), x.max(0)
    open_ = np.flatnonzero(high > low)
    if depth == 0 or len(x) < 2 or not len(open_):
        return (len(x),)
    c = int(rng.choice(open_))
    cut = float(rng.uniform(low[c], high[c]))
    left = x[:, c] <= cut
    return (c, cut, grown(x[left], rng, depth - 1), grown(x[~left], rng, depth - 1))


def usual_depth(n: float) -> float:
    return 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def path_lengths(tree: tuple, x: np.ndarray, depth: int = 0) -> np.ndarray:
    if len(tree) == 1:
        return np.full(len(x), depth + usual_depth(tree[0]))
    out, left = np.empty(len(x)), x[:, tree[0]] <= tree[1]
    out[left], out[~left] = path_lengths(tree[2], x[left], depth + 1), path_lengths(tree[3], x[~left], depth + 1)
    return out


def isolation_forest(df: DataFrame, columns: list[str] = FEATURES, trees: int = 100, rows: int = 256) -> DataFrame:
    """iso_score: 0 (most usual) to 1. Each tree is grown on rows that the operator's own sampling picks by hash (256 a tree)."""
    data = written(prepared(df, columns).select(ID, *columns), "isolation")
    share = min(1.0, 2 * trees * rows / max(data.count(), 1))
    picks = data.where(F.pmod(F.xxhash64(ID), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    picks = picks.withColumn("r", F.row_number().over(Window.partitionBy("tree").orderBy(F.xxhash64(ID, "tree"), ID))).where(f"r <= {rows}")

    def build(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(ID)
        tree = int(part["tree"].iloc[0])
        return pd.DataFrame({"tree": [tree], "shape": [json.dumps(grown(part[columns].to_numpy(float), np.random.default_rng(tree), 8))]})

    forest = [json.loads(r["shape"]) for r in picks.groupBy("tree").applyInPandas(build, "tree int, shape string").orderBy("tree").collect()]  # trees of at most 256 rows
    usual = usual_depth(rows)

    def score(batches):
        for b in batches:
            x = b[columns].to_numpy(float)
            mean = np.mean([path_lengths(t, x) for t in forest], 0)
            yield pd.DataFrame({ID: b[ID], "raw": 2.0 ** (-mean / usual)})

    out = written(data.mapInPandas(score, f"{ID} long, raw double"), "isolation")
    return spread_out(out)


def spread_out(df: DataFrame) -> DataFrame:
    """TransactionID, iso_score: raw scores from 0 to (nearly) 1 between their ends."""
    ends = df.agg(F.min("raw").alias("lo"), F.max("raw").alias("hi"))
    return df.crossJoin(F.broadcast(ends)).select(ID, ((F.col("raw") - F.col("lo")) / (F.col("hi") - F.col("lo") + 1e-8)).alias("iso_score"))


def isotonic_calibration(df: DataFrame, calibration: Column) -> DataFrame:
    """calibrated: isotonic fit of the label on proba over the calibration rows; outside their range the nearest value."""
    data = df.withColumn("label", F.col(Y).cast("double"))
    model = IsotonicRegression(featuresCol="proba", labelCol="label", predictionCol="calibrated").fit(data.where(calibration))
    return model.transform(data)


def brier(df: DataFrame) -> DataFrame:
    return df.agg(F.avg((F.col("proba") - F.col("label")) ** 2).alias("brier_before"), F.avg((F.col("calibrated") - F.col("label")) ** 2).alias("brier_after"))
