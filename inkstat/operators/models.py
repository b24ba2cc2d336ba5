"""Cross-validated logistic separation of two labels, and its null."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstat.operators.statistics import AI, HUMAN, percentiles, rank_sums
from inkstat.runtime import cut


def matrix(long: DataFrame, present: float = 0.5) -> tuple[DataFrame, list[str]]:
    """Wide rows of the features that half of the documents have, gaps filled with medians."""
    v = long.filter(F.col("label").isin(HUMAN, AI) & ~F.col("feature").startswith("det_"))
    n = v.select("doc_id").distinct().count()
    stats = v.filter("value IS NOT NULL").groupBy("feature").agg(F.count("*").alias("k"), F.stddev("value").alias("sd"))
    stats = stats.join(percentiles(v, "feature", "value", {"median": 0.5}), "feature")
    med = {r["feature"]: r["median"] for r in stats.filter((F.col("k") >= present * n) & (F.col("sd") > 0)).collect()}  # one row a feature
    names = sorted(med)
    wide = v.groupBy("doc_id", "label").pivot("feature", names).agg(F.first("value", ignorenulls=True)) if names else v.select("doc_id", "label").distinct()
    return wide.fillna(med), names


def _fit(train: DataFrame, names: list[str], c: float = 0.1):
    """L2-penalised logistic regression with balanced weights on scaled features; ``regParam = 1 / (C * sum of weights)``."""
    n = train.groupBy("label").count().collect()
    total = sum(r["count"] for r in n)
    weight = F.lit(None).cast("double")
    for r in n:
        weight = F.when(F.col("label") == r["label"], total / (len(n) * r["count"])).otherwise(weight)
    data = VectorAssembler(inputCols=names, outputCol="raw").transform(train).withColumns({"y": (F.col("label") == AI).cast("double"), "w": weight})
    scaler = StandardScaler(inputCol="raw", outputCol="x", withMean=True, withStd=True).fit(data)
    lr = LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", regParam=1.0 / (c * total), elasticNetParam=0.0, standardization=False, maxIter=200)
    return scaler, lr.fit(scaler.transform(data))


def cross_validated(wide: DataFrame, names: list[str], folds: int = 5, seed: int = 0) -> list[float]:
    """The AUC of each fold; folds are dealt by hash inside each label, so that they are the same everywhere."""
    from pyspark.ml.functions import vector_to_array

    d = wide.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(folds)))
    out = []
    for f in range(folds):
        scaler, model = _fit(d.filter(F.col("fold") != f), names)
        test = VectorAssembler(inputCols=names, outputCol="raw").transform(d.filter(F.col("fold") == f))
        p = model.transform(scaler.transform(test)).select("doc_id", "label", F.lit("p").alias("feature"), vector_to_array("probability")[1].alias("value"))
        r = rank_sums(p).first()
        if r is not None and r["auc"] is not None:
            out.append(float(r["auc"]))
    return out


def discriminative(long: DataFrame, folds: int = 5, seed: int = 0, top: int = 25) -> DataFrame:
    """``(feature, weight, auc_mean, auc_sd, n_folds)``: the heaviest weights of the fit on all documents. No rows under 20
    documents or with one label."""
    wide, names = matrix(long)
    wide = cut(wide)
    sizes = {r["label"]: r["count"] for r in wide.groupBy("label").count().collect()}
    spark = long.sparkSession
    schema = "feature string, weight double, auc_mean double, auc_sd double, n_folds int"
    if len(sizes) < 2 or sum(sizes.values()) < 20 or not names:
        return spark.createDataFrame([], schema)
    auc = cross_validated(wide, names, min(folds, min(sizes.values())), seed)
    w = _fit(wide, names)[1].coefficients.toArray()
    order = sorted(zip(names, w), key=lambda z: (-abs(z[1]), z[0]))[:top]
    return spark.createDataFrame([(f, float(v), float(np.mean(auc)), float(np.std(auc)), len(auc)) for f, v in order], schema)


def _dealt(wide: DataFrame, names: list[str], rounds: int, folds: int) -> DataFrame:
    """``(x, y, fold)``: the scaled features, and label and fold of every round. Labels change places by the rank of a hash inside
    buckets of some thousand documents, so that no task orders all of them."""
    m = wide.agg(*[f(k) for k in names for f in (F.avg, F.stddev)]).first()
    x = [(F.col(k) - m[2 * i]) / (m[2 * i + 1] or 1.0) for i, k in enumerate(names)]
    d = wide.select(
        "doc_id", (F.col("label") == AI).cast("int").alias("is_ai"), F.array(*x).alias("x"), F.pmod(F.xxhash64("doc_id", F.lit(0)), F.lit(max(1, wide.count() // 5000))).alias("bucket"),
        F.array(*[F.xxhash64("doc_id", F.lit(1000 + r)) for r in range(rounds)]).alias("key"),
        F.array(*[F.pmod(F.xxhash64("doc_id", F.lit(r)), F.lit(folds)).cast("int") for r in range(rounds)]).alias("fold"),
    )

    def deal(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("doc_id", ignore_index=True)
        y = np.zeros((len(b), rounds), np.int32)
        for r, key in enumerate(np.stack(b["key"]).T):
            y[np.argsort(key, kind="stable"), r] = b["is_ai"]
        return pd.DataFrame({"x": b["x"], "y": list(y), "fold": b["fold"]})

    return d.groupBy("bucket").applyInPandas(deal, "x array<double>, y array<int>, fold array<int>")


def _summed(d: DataFrame, part) -> np.ndarray:
    """The sum over all rows of ``part(x, y, fold)``, which has one line for each model; a partition adds up before the shuffle."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for b in it:
            if len(b):
                got = part(*(np.stack(b[k]) for k in ("x", "y", "fold")))
                total = got if total is None else total + got
        if total is not None:
            yield pd.DataFrame({"m": np.arange(len(total)), "v": list(total)})

    def add(b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"m": b["m"].iloc[:1], "v": [np.stack(b["v"]).sum(0)]})

    g = d.mapInPandas(run, "m int, v array<double>").groupBy("m").applyInPandas(add, "m int, v array<double>")
    return np.array([r["v"] for r in sorted(g.collect())])  # one row a model


def _many_fits(d: DataFrame, rounds: int, folds: int, c: float = 0.1) -> np.ndarray:
    """Weights and, last, the constant of the fit of ``_fit`` for every round and fold left out, all fitted in the same passes by
    Newton's method; zeros where one label is missing."""

    def moments(x, y, fold):
        out = []
        for r in range(rounds):
            for f in range(folds):
                k = fold[:, r] != f
                out.append(np.concatenate([[k.sum(), y[k, r].sum()], x[k].sum(0), (x[k] ** 2).sum(0)]))
        return np.array(out)

    s = _summed(d, moments)
    p = (s.shape[1] - 2) // 2
    n, ai = s[:, 0], s[:, 1]
    both = (ai > 0) & (ai < n)
    mean = s[:, 2 : 2 + p] / np.maximum(n, 1)[:, None]
    var = (s[:, 2 + p :] - n[:, None] * mean**2) / np.maximum(n - 1, 1)[:, None]
    scale = np.where(var > 1e-12, 1 / np.sqrt(np.maximum(var, 1e-12)), 0.0)
    weight = np.stack([n / np.maximum(2 * (n - ai), 1), n / np.maximum(2 * ai, 1)], 1)
    to_raw = np.zeros((len(s), p + 1, p + 1))  # scaled columns out of those of x and a one
    to_raw[:, range(p), range(p)] = scale
    to_raw[:, p, :p], to_raw[:, p, p] = -mean * scale, 1.0
    ridge = np.append(np.full(p, 1 / c), 0.0)
    theta = np.zeros((len(s), p + 1))
    for _ in range(50):
        raw = np.einsum("mij,mj->mi", to_raw, theta)

        def slopes(x, y, fold, raw=raw):
            x = np.hstack([x, np.ones((len(x), 1))])
            out = []
            for m, v in enumerate(raw):
                r, f = divmod(m, folds)
                k = fold[:, r] != f
                z, t = x[k], y[k, r]
                q = 1 / (1 + np.exp(-np.clip(z @ v, -500, 500)))
                w = weight[m][t]
                out.append(np.concatenate([z.T @ (w * (q - t)), ((z * (w * q * (1 - q))[:, None]).T @ z).ravel()]))
            return np.array(out)

        s = _summed(d, slopes)
        g = np.einsum("mji,mj->mi", to_raw, s[:, : p + 1]) + ridge * theta
        h = to_raw.transpose(0, 2, 1) @ s[:, p + 1 :].reshape(-1, p + 1, p + 1) @ to_raw + np.diag(ridge)
        step = np.zeros_like(theta)
        step[both] = np.linalg.solve(h[both], g[both][:, :, None])[:, :, 0]
        theta -= step
        if np.abs(step).max() < 1e-7:
            return np.einsum("mij,mj->mi", to_raw, theta)
    raise ArithmeticError("the fits do not converge")


def null_aucs(wide: DataFrame, names: list[str], rounds: int, folds: int) -> list[float]:
    """The mean AUC over the folds for each round of labels dealt out anew; without rounds that have no AUC."""
    d = cut(_dealt(wide, names, rounds, folds))
    raw = _many_fits(d, rounds, folds)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            if len(b):
                x, y, fold = (np.stack(b[k]) for k in ("x", "y", "fold"))
                for r in range(rounds):
                    v = raw[r * folds + fold[:, r]]
                    yield pd.DataFrame({"feature": [f"{r}:{f}" for f in fold[:, r]], "label": np.where(y[:, r] == 1, AI, HUMAN), "value": (x * v[:, :-1]).sum(1) + v[:, -1]})

    got: dict[str, list[float]] = {}
    for r in rank_sums(d.mapInPandas(run, "feature string, label string, value double")).collect():  # one row a model
        if r["auc"] is not None:
            got.setdefault(r["feature"].split(":")[0], []).append(r["auc"])
    return [float(np.mean(v)) for v in got.values()]


def permutation_null(long: DataFrame, rounds: int = 20, folds: int = 5, seed: int = 0) -> DataFrame:
    """``(n_perm, null_mean, null_sd, null_p95, observed, p_value)``: the AUC under labels dealt out anew by the rank of a hash.
    ``observed`` is the mean AUC of ``discriminative``. No rows under 20 documents or with one label."""
    wide, names = matrix(long)
    wide = cut(wide)
    sizes = {r["label"]: r["count"] for r in wide.groupBy("label").count().collect()}
    schema = "n_perm int, null_mean double, null_sd double, null_p95 double, observed double, p_value double"
    if len(sizes) < 2 or sum(sizes.values()) < 20 or not names:
        return long.sparkSession.createDataFrame([], schema)
    folds = min(folds, min(sizes.values()))
    observed = float(np.mean(cross_validated(wide, names, folds, seed)))
    a = np.array(null_aucs(wide, names, rounds, folds))
    if not len(a):
        return long.sparkSession.createDataFrame([], schema)
    row = (len(a), float(a.mean()), float(a.std(ddof=1)) if len(a) > 1 else 0.0, float(np.percentile(a, 95)), observed, float(((a >= observed).sum() + 1) / (len(a) + 1)))
    return long.sparkSession.createDataFrame([row], schema)
