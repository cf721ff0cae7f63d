"""Models and what is derived from them, on pyspark.ml and on numpy within groups."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.times import quarter_label
from ..operators.buckets import equal_chunks, quantile_cuts
from ..operators.evaluation import auc
from ..operators.isotonic import isotonic_pools, with_curve
from ..operators.ranking import with_keyed_prefix_sums
from ..sources.catalog import row_fingerprint
from ..sources.shared import persist_shared


def _vector(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="_raw", handleInvalid="skip").transform(df)


def fit_logistic(df: DataFrame, features: Sequence[str], label: str, c: float = 1.0, test: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows with score, feature coefficients ranked by size) of a standardised, L2-penalised logistic regression.

    Means and deviations are those of the training rows; the rows scored are ``test`` where it is given, else those
    trained on.
    """
    rows = _vector(df, features)
    scaler = StandardScaler(inputCol="_raw", outputCol="_x", withMean=True, withStd=True).fit(rows)
    rows = scaler.transform(rows)
    model = LogisticRegression(featuresCol="_x", labelCol=label, regParam=1.0 / (c * max(rows.count(), 1)), maxIter=100, tol=1e-9, standardization=False).fit(rows)
    some = rows if test is None else scaler.transform(_vector(test, features))
    scored = model.transform(some).withColumn("score", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction", "_raw")
    coef = sorted(((f, float(w)) for f, w in zip(features, model.coefficients)), key=lambda x: (-abs(x[1]), x[0]))
    return scored, df.sparkSession.createDataFrame([(i + 1, f, w) for i, (f, w) in enumerate(coef)], "place int, feature string, coefficient double")


def robust_intervals(scored: DataFrame, label: str, cluster: str, features: Sequence[str], coefficients: dict[str, float]) -> DataFrame:
    """feature, coefficient, low, high: sandwich intervals from gradients summed by cluster.

    The p x p sums are one aggregation; only they come to the driver.
    """
    p = len(features)
    x = vector_to_array("_x")
    rows = scored.select(cluster, x.alias("x"), (F.col(label) - F.col("score")).alias("r"), (F.col("score") * (1 - F.col("score"))).alias("w"))
    bread = rows.agg(*[F.sum(F.col("w") * F.col("x")[i] * F.col("x")[j]).alias(f"b{i}_{j}") for i in range(p) for j in range(p)]).first()
    grads = rows.groupBy(cluster).agg(*[F.sum(F.col("r") * F.col("x")[i]).alias(f"g{i}") for i in range(p)])
    meat = grads.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(f"g{i}") * F.col(f"g{j}")).alias(f"m{i}_{j}") for i in range(p) for j in range(p)]).first()
    b = np.array([[bread[f"b{i}_{j}"] for j in range(p)] for i in range(p)])
    m = np.array([[meat[f"m{i}_{j}"] for j in range(p)] for i in range(p)])
    inv = np.linalg.pinv(b)
    se = np.sqrt(np.clip(np.diag(inv @ m @ inv), 0, None) * meat["n"] / max(meat["n"] - 1, 1))
    out = [(f, coefficients[f], coefficients[f] - 1.96 * float(s), coefficients[f] + 1.96 * float(s)) for f, s in zip(features, se)]
    return scored.sparkSession.createDataFrame(out, "feature string, coefficient double, low double, high double")


def fit_gbt(df: DataFrame, features: Sequence[str], label: str, trees: int = 20, depth: int = 4, seed: int = 42, test: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows with raw and score, normalised feature importances by rank) of boosted trees; rows as in ``fit_logistic``."""
    rows = _vector(df, features).withColumnRenamed("_raw", "_x")
    model = GBTClassifier(featuresCol="_x", labelCol=label, maxIter=trees, maxDepth=depth, seed=seed).fit(rows)
    raw = vector_to_array("rawPrediction")[1]
    some = rows if test is None else _vector(test, features).withColumnRenamed("_raw", "_x")
    scored = model.transform(some).withColumn("raw", 2 * raw).withColumn("score", 1 / (1 + F.exp(-F.col("raw")))).drop("rawPrediction", "probability", "prediction")
    gains = sorted(zip(features, model.featureImportances.toArray().tolist()), key=lambda x: (-x[1], x[0]))
    return scored, df.sparkSession.createDataFrame([(i + 1, f, g) for i, (f, g) in enumerate(gains)], "place int, feature string, importance double")


def ridge_cv(df: DataFrame, features: Sequence[str], target: str, key: str, folds: int = 5, alpha: float = 1.0, seed: int = 42) -> DataFrame:
    """fold, r2: ridge regression on hash folds of the key; rows keep their fold in every run."""
    rows = _vector(df.withColumn("fold", F.pmod(F.xxhash64(F.lit(seed), key), F.lit(folds)).cast("int")), features)
    rows = persist_shared(StandardScaler(inputCol="_raw", outputCol="_x", withMean=True, withStd=True).fit(rows).transform(rows).select("fold", target, vector_to_array("_x").alias("_a")), "ridge-rows")
    rows = rows.withColumn("_x", array_to_vector("_a"))
    sizes = {r["fold"]: r["n"] for r in rows.groupBy("fold").agg(F.count(F.lit(1)).alias("n")).collect()}
    out = []
    for k in range(folds):
        train, test = rows.where(F.col("fold") != k), rows.where(F.col("fold") == k)
        left = sum(n for f, n in sizes.items() if f != k)
        model = LinearRegression(featuresCol="_x", labelCol=target, regParam=alpha / max(left, 1), elasticNetParam=0.0, standardization=False).fit(train)
        pred = model.transform(test)
        mean = pred.agg(F.avg(target).alias("m"))
        e = pred.crossJoin(F.broadcast(mean)).agg(F.sum((F.col(target) - F.col("prediction")) ** 2), F.sum((F.col(target) - F.col("m")) ** 2)).first()  # mean is one row
        out.append((k, 1 - e[0] / e[1] if e[1] else None))
    return df.sparkSession.createDataFrame(out, "fold int, r2 double")


def isotonic_residuals(df: DataFrame, score: str, confounds: Sequence[str], key: str, seed: int = 42, cross_fit: bool = True) -> DataFrame:
    """key, residual: the score less increasing functions of the confounds' ranks, one after another.

    Rows fall into halves by a hash of the key; ranks, ties at their mean, are shares of the half. In each half the score
    is fitted on the first confound, what is left on the next, and so on; a row's residual takes the functions of the
    other half (without ``cross_fit`` there is one half, fitted on itself). Functions are fitted on the mean of each
    distinct rank and are linear between pools; rows without a confound or score are left out.
    """
    half = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(2 if cross_fit else 1)).cast("int")
    whole = df.select(key, half.alias("_half"), F.col(score).cast("double").alias("_s"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(confounds)]).dropna()
    rows = persist_shared(whole, "isotonic-rows")
    n = {r["_half"]: r["n"] for r in rows.groupBy("_half").agg(F.count(F.lit(1)).alias("n")).collect()}
    for i in range(len(confounds)):
        ties = rows.groupBy("_half", f"_c{i}").agg(F.count(F.lit(1)).alias("_n"))
        upto = with_keyed_prefix_sums(ties, ["_half"], [f"_c{i}"], {"_upto": F.col("_n")})
        size = F.element_at(F.create_map(*[F.lit(x) for h, k in n.items() for x in (h, k)]), F.col("_half")) if n else F.lit(1)
        ranks = upto.select("_half", f"_c{i}", ((F.col("_upto") - (F.col("_n") - 1) / 2) / size).alias(f"_r{i}"))
        rows = rows.join(ranks, ["_half", f"_c{i}"])
    rows = persist_shared(rows.withColumns({"_fit": F.col("_s"), "_apply": F.col("_s")}), "isotonic-ranks")
    for i in range(len(confounds)):
        points = rows.groupBy(F.col("_half").alias("key"), F.col(f"_r{i}").alias("x")).agg(F.sum("_fit").alias("total"), F.count(F.lit(1)).cast("double").alias("weight"))
        pools = persist_shared(isotonic_pools(points), "isotonic-curve")
        own = with_curve(rows, F.col("_half"), f"_r{i}", pools, "_own")
        other = with_curve(own, 1 - F.col("_half"), f"_r{i}", pools, "_other") if cross_fit else own.withColumn("_other", F.col("_own"))
        rows = persist_shared(other.withColumns({"_fit": F.col("_fit") - F.col("_own"), "_apply": F.col("_apply") - F.col("_other")}).drop("_own", "_other"), "isotonic-left")
    return rows.select(key, F.col("_apply").alias("residual"))


def score_folds(df: DataFrame, at: str, features: Sequence[str], label: str, kind: str = "logistic", most_folds: int = 4, **options) -> tuple[DataFrame, DataFrame]:
    """(test rows with fold and score, coefficients or importances by fold) of walk-forward folds.

    Each quarter but the first is tested on by a model of all earlier ones; of many quarters ``most_folds`` evenly spaced
    ones are taken. Folds whose training rows have one label only are left out. Each fold is one fit of a Spark model.
    """
    rows = persist_shared(df.withColumn("fold", quarter_label(F.col(at))).dropna(subset=[*features, label]), "fold-rows")
    quarters = sorted(r["fold"] for r in rows.select("fold").distinct().collect())[1:]
    take = sorted({round(i * (len(quarters) - 1) / max(most_folds - 1, 1)) for i in range(min(most_folds, len(quarters)))})
    scored, told = [], []
    for fold in (quarters[i] for i in take):
        train, test = rows.where(F.col("fold") < fold), rows.where(F.col("fold") == fold)
        if len(train.select(label).distinct().head(2)) < 2:
            continue
        fit = fit_logistic if kind == "logistic" else fit_gbt
        s, t = fit(train, features, label, test=test, **options)
        scored.append(s)
        told.append(t.withColumn("fold", F.lit(fold)))
    if not scored:
        raise ValueError("no fold has both labels before it")
    return reduce(DataFrame.unionByName, scored), reduce(DataFrame.unionByName, told)


def residual_slices(df: DataFrame, features: Sequence[str], loss: str, least_rows: int = 1000, depth: int = 3, lift: float = 1.10) -> DataFrame:
    """rule, n, mean_loss of the leaves of a shallow tree whose mean loss is ``lift`` times the overall one or more."""
    rows = _vector(df, features).withColumnRenamed("_raw", "_x")
    model = DecisionTreeRegressor(featuresCol="_x", labelCol=loss, maxDepth=depth, minInstancesPerNode=least_rows).fit(rows)
    overall = df.agg(F.avg(loss)).first()[0] or 0.0
    rules: list[tuple[str, float]] = []
    path: list[str] = []
    for line in model.toDebugString.splitlines()[1:]:
        level = (len(line) - len(line.lstrip())) - 2
        said = line.strip()
        path = path[:level]
        if said.startswith("Predict:"):
            rules.append((" and ".join(path) or "all rows", float(said.split(":")[1])))
        else:
            condition = said[said.index("(") + 1 : said.rindex(")")]
            for i in reversed(range(len(features))):
                condition = condition.replace(f"feature {i} ", f"{features[i]} ")
            path.append(condition.replace(" in ", " in "))
    leaf = model.transform(rows).groupBy(F.round("prediction", 9).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()
    sizes = {r["p"]: r["n"] for r in leaf}
    found = [(r, sizes.get(round(m, 9)), m) for r, m in rules if m >= lift * overall]
    return df.sparkSession.createDataFrame(found, "rule string, n bigint, mean_loss double")


def worst_decile(df: DataFrame, feature: str, key: str, error: str) -> DataFrame:
    """One row: decile, mae, ratio to the overall error, tier of the decile of a feature with the largest error."""
    by = equal_chunks(df, [feature, key], 10, "decile").groupBy("decile").agg(F.avg(error).alias("mae"), F.sum(error).alias("s"), F.count(F.lit(1)).alias("n"))
    worst = by.agg(F.max_by("decile", "mae").alias("decile"), F.max("mae").alias("mae"), (F.sum("s") / F.sum("n")).alias("overall"))
    ratio = F.col("mae") / F.col("overall")
    return worst.select("decile", "mae", ratio.alias("ratio"), F.when(ratio >= 2, "severe").when(ratio >= 1.5, "high").when(ratio >= 1.3, "mild").otherwise("none").alias("tier"))


def temporal_auc(df: DataFrame, features: Sequence[str], label: str, at: str, share: float = 0.8) -> DataFrame:
    """feature, auc on the rows behind the time's ``share`` quantile: each feature alone, then all together."""
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    cut = quantile_cuts(df.select(micros.alias("_t")), "_t", [share]).first()["q0"]
    placed = persist_shared(df.withColumn("_late", micros > cut), "temporal-rows")
    train, test = placed.where(~F.col("_late")), placed.where("_late")
    found = [auc(test, f, label).select(F.lit(f).alias("feature"), "auc") for f in features]
    scored, _ = fit_logistic(train, features, label, c=1e6, test=test)
    found.append(auc(scored, "score", label).select(F.lit("all").alias("feature"), "auc"))
    return reduce(DataFrame.unionByName, found)


def compare_predictions(a: DataFrame, b: DataFrame, keys: Sequence[str], score: str, least_corr: float = 0.99999) -> DataFrame:
    """One row: n_a, n_b, n_both, corr, max_drift (share of a), equal, same_hash.

    ``same_hash`` says whether the tables of keys and scores have equal fingerprints: the same rows to the last bit, in any order.
    """
    first, second = (x.select(*keys, F.col(score).cast("double").alias("score")) for x in (a, b))
    both = first.withColumnRenamed("score", "a").join(second.withColumnRenamed("score", "b"), list(keys), "full")
    out = both.agg(F.count("a").alias("n_a"), F.count("b").alias("n_b"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("n_both"), F.corr("a", "b").alias("corr"),
                   F.max(F.try_divide(F.abs(F.col("a") - F.col("b")), F.abs("a"))).alias("max_drift"))
    out = out.withColumn("equal", (F.col("n_a") == F.col("n_b")) & (F.col("n_a") == F.col("n_both")) & (F.coalesce("corr", F.lit(1.0)) >= least_corr))
    prints = row_fingerprint(first).select(F.col("fingerprint").alias("_a")).crossJoin(row_fingerprint(second).select(F.col("fingerprint").alias("_b")))  # one row each
    return out.crossJoin(prints).withColumn("same_hash", F.col("_a") == F.col("_b")).drop("_a", "_b")
