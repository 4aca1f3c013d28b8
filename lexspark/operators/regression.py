"""Features -> score regression: correlation screening, stratified folds, ridge from sums, RBF support vectors.

Ridge sees the data only through sums per fold cell (counts, first and second moments), so any number of rows fits in
one aggregation, however many folds and penalties are tried. The kernel machine is quadratic in its rows; it is fitted
on a bounded sample of labelled rows (`fit_rows`), its grid spread over the executors, and predicts every row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.operators import stats
from lexspark.operators.agreement import check_missing_share
from lexspark.operators.ranking import running_offset
from lexspark.session import cut

#: The grids that are searched, and the score from which a participant counts as unimpaired.
RIDGE_ALPHAS = (0.01, 0.1, 1.0, 10.0, 100.0)
SVR_C, SVR_GAMMA = (0.1, 1.0, 10.0, 100.0), ("scale", "auto", 0.01, 0.1, 1.0)
CUTOFF = 24


def correlation_table(df: DataFrame, features: Sequence[str], target: str = "mmse", least: float = 0.3) -> DataFrame:
    """feature, n, r, p_value, passes (|r| > least, strictly): one aggregation over all features, no row per feature."""
    y = F.col(target).cast("double")
    sums = [a for i, f in enumerate(features) for a in (stats.correlation(F.col(f).cast("double"), y).alias(f"r{i}"), F.count(F.when(F.col(f).isNotNull(), F.col(target))).alias(f"n{i}"))]
    g = df.agg(*sums)
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"n{i}").alias("n"), stats.finite(F.col(f"r{i}")).alias("r")) for i, f in enumerate(features)])
    return stats.with_rho_p(g.select(F.inline(rows)), "r").withColumn("passes", F.coalesce(F.abs("r") > least, F.lit(False)))


def select_features(table: DataFrame) -> list[str]:
    return [r["feature"] for r in table.filter("passes").orderBy("feature").collect()]


def stratified_folds(df: DataFrame, stratum: str, key: str, k: int = 5, seed: int = 0, name: str = "fold") -> DataFrame:
    """df with a fold 0..k-1: within each stratum rows are dealt round in the order of a seeded hash of their key, so
    fold sizes differ by one at most. Null strata are dealt among themselves."""
    ranked = running_offset(df, [stratum], F.xxhash64(F.lit(seed), key), ties=[key], name="_r")
    return ranked.withColumn(name, F.pmod("_r", F.lit(k)).cast("int")).drop("_r")


def _moments(df: DataFrame, features: Sequence[str], target: str, by: Sequence[str]) -> dict[tuple, np.ndarray]:
    """Sums of z z' for z = (1, features, target) of every cell; the cells are folds, a few dozen."""
    z = [F.lit(1.0), *(F.col(f).cast("double") for f in features), F.col(target).cast("double")]
    pairs = [(i, j) for i in range(len(z)) for j in range(i, len(z))]
    out = {}
    for r in df.groupBy(*by).agg(*[F.sum(z[i] * z[j]).alias(f"m{i}_{j}") for i, j in pairs]).collect():
        m = np.zeros((len(z), len(z)))
        for i, j in pairs:
            m[i, j] = m[j, i] = r[f"m{i}_{j}"] or 0.0
        out[tuple(r[b] for b in by)] = m
    return out


def ridge_from_moments(m: np.ndarray, alpha: float) -> np.ndarray:
    """Intercept and coefficients on the raw features: features scaled by mean and population deviation, penalty alpha
    on the scaled coefficients, none on the intercept."""
    n, d = m[0, 0], len(m) - 2
    mean = m[0, 1:] / n
    cov = m[1:, 1:] - n * np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov)[:d] / n, 0.0))
    sd[sd == 0] = 1.0
    a = cov[:d, :d] / np.outer(sd, sd) + alpha * np.eye(d)
    w = np.linalg.solve(a, cov[:d, d] / sd) / sd
    return np.concatenate([[mean[d] - mean[:d] @ w], w])


def ridge_cv(df: DataFrame, features: Sequence[str], target: str = "mmse", stratum: str = "diagnosis", key: str = "participant_id", seed: int = 0, alphas: Sequence[float] = RIDGE_ALPHAS, outer: int = 5, inner: int = 3) -> DataFrame:
    """df with `fold`, `alpha` (chosen for the fold by inner cross-validation on the mean absolute error, the first of
    equals) and `prediction` for the held-out rows. Rows without a feature or the target are left out, with an error
    if they are more than a tenth."""
    rows = check_missing_share(cut(df, "labelled"), [*features, target])
    rows = stratified_folds(rows, stratum, key, outer, seed)
    rows = cut(stratified_folds(cut(rows, "fold"), stratum, key, inner, seed + 1, "_inner"), "folds")
    cells = _moments(rows, features, target, ["fold", "_inner"])
    total = sum(cells.values(), np.zeros((len(features) + 2,) * 2))
    folds = sorted({f for f, _ in cells})
    coef = np.zeros((len(folds), inner, len(alphas), len(features) + 1))
    for a, f in enumerate(folds):
        for g in range(inner):
            train = sum((m for (o, i), m in cells.items() if o != f and i != g), np.zeros_like(total))
            for b, alpha in enumerate(alphas):
                coef[a, g, b] = ridge_from_moments(train, alpha)

    def errors(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Sums of absolute inner validation errors, per outer fold and penalty."""
        s = np.zeros((len(folds), len(alphas), 2))
        for p in frames:
            x = np.column_stack([np.ones(len(p)), *(p[f].to_numpy(dtype=float) for f in features)])
            y, o, g = p[target].to_numpy(dtype=float), p["fold"].to_numpy(), p["_inner"].to_numpy()
            for a, f in enumerate(folds):
                use = o != f
                e = np.abs(np.einsum("nk,nbk->nb", x[use], coef[a][g[use]]) - y[use][:, None])
                s[a, :, 0] += e.sum(0)
                s[a, :, 1] += use.sum()
        yield pd.DataFrame([(f, b, *s[a, b]) for a, f in enumerate(folds) for b in range(len(alphas))], columns=["fold", "b", "e", "n"])

    mae = rows.select(*features, target, "fold", "_inner").mapInPandas(errors, "fold int, b int, e double, n double").groupBy("fold", "b").agg((F.sum("e") / F.sum("n")).alias("mae")).collect()
    out = F.lit(None).cast("double")
    chosen = F.lit(None).cast("double")
    for f in folds:
        b = min((r["mae"], r["b"]) for r in mae if r["fold"] == f)[1]
        w = ridge_from_moments(sum((m for (o, _), m in cells.items() if o != f), np.zeros_like(total)), alphas[b])
        pred = F.lit(float(w[0]))
        for c, name in zip(w[1:], features):
            pred = pred + F.lit(float(c)) * F.col(name)
        out, chosen = F.when(F.col("fold") == f, pred).otherwise(out), F.when(F.col("fold") == f, F.lit(float(alphas[b]))).otherwise(chosen)
    return rows.drop("_inner").withColumns({"alpha": chosen, "prediction": out})


def _gamma(g, x: np.ndarray) -> float:
    if g == "scale":
        v = x.var()
        return 1.0 / (x.shape[1] * v) if v > 0 else 1.0
    return 1.0 / x.shape[1] if g == "auto" else float(g)


def svr_fit(x: np.ndarray, y: np.ndarray, c: float, gamma: float, epsilon: float = 0.1, epochs: int = 200, tol: float = 1e-4) -> np.ndarray:
    """Dual weights of an epsilon-insensitive machine with an RBF kernel plus 1 (the 1 carries the bias), by coordinate
    descent: each weight is soft-thresholded and clipped to [-c, c] until none moves by more than `tol`."""
    k = np.exp(-gamma * ((x[:, None, :] - x[None, :, :]) ** 2).sum(-1)) + 1.0
    beta, f = np.zeros(len(y)), np.zeros(len(y))
    for _ in range(epochs):
        moved = 0.0
        for i in range(len(y)):
            r = y[i] - f[i] + k[i, i] * beta[i]
            new = np.clip(np.sign(r) * max(abs(r) - epsilon, 0.0) / k[i, i], -c, c)
            step = new - beta[i]
            if step:
                f += step * k[i]
                beta[i], moved = new, max(moved, abs(step))
        if moved < tol:
            break
    return beta


def svr_predict(x: np.ndarray, beta: np.ndarray, new: np.ndarray, gamma: float) -> np.ndarray:
    return (np.exp(-gamma * ((new[:, None, :] - x[None, :, :]) ** 2).sum(-1)) + 1.0) @ beta


def svr_cv(df: DataFrame, features: Sequence[str], target: str = "mmse", stratum: str = "diagnosis", key: str = "participant_id", seed: int = 0, outer: int = 5, inner: int = 3, max_rows: int | None = None, fit_rows: int = 400) -> DataFrame:
    """fold, key, truth, prediction, c, gamma of every labelled row, held out. The machine of a fold is fitted on the
    `fit_rows` rows with the smallest hashes of their key among those of the other folds (all, if there are fewer), its
    grid search one task per setting; the held-out rows are predicted where they lie. `max_rows` asks for a sample of
    so many rows in all."""
    rows = check_missing_share(df, [*features, target]).withColumn("_h", F.xxhash64(F.lit(seed), key))
    rows = rows if max_rows is None else rows.orderBy("_h", key).limit(max_rows)
    dealt = cut(stratified_folds(rows, stratum, key, outer, seed).select(key, "fold", *features, target, "_h"), "folds")
    train = {}
    for f in range(outer):
        t = dealt.filter(F.col("fold") != f).orderBy("_h", key).limit(fit_rows).toPandas().sort_values(key)
        train[f] = t[list(features)].to_numpy(dtype=float), t[target].to_numpy(dtype=float)
    grid = [(c, g) for c in SVR_C for g in SVR_GAMMA]
    tasks = df.sparkSession.createDataFrame([(f, i) for f in range(outer) for i in range(len(grid))], "fold int, i int").repartition(outer * len(grid), "fold", "i")

    def scaled(train: np.ndarray, *others: np.ndarray) -> list[np.ndarray]:
        m, s = train.mean(0), train.std(0)
        s[s == 0] = 1.0
        return [(v - m) / s for v in (train, *others)]

    def inner_mae(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in frames:
            out = []
            for f, i in zip(t["fold"], t["i"]):
                x, y = train[f]
                k = max(2, min(inner, len(y) // 2))
                part, e = np.arange(len(y)) % k, []
                for g in range(k):
                    a, b = scaled(x[part != g], x[part == g])
                    gm = _gamma(grid[i][1], a)
                    e.append(np.abs(svr_predict(a, svr_fit(a, y[part != g], grid[i][0], gm), b, gm) - y[part == g]).mean())
                out.append((f, i, float(np.mean(e))))
            yield pd.DataFrame(out, columns=["fold", "i", "mae"])

    scores = tasks.mapInPandas(inner_mae, "fold int, i int, mae double").groupBy("fold").agg(F.min(F.struct("mae", "i")).alias("b")).select("fold", F.col("b.i").alias("i"))

    def fit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in frames:
            for f, i in zip(t["fold"], t["i"]):
                x = scaled(train[f][0])[0]
                yield pd.DataFrame({"fold": [f], "i": [i], "beta": [svr_fit(x, train[f][1], grid[i][0], _gamma(grid[i][1], x))]})

    fitted = {r["fold"]: (r["i"], np.array(r["beta"])) for r in scores.mapInPandas(fit, "fold int, i int, beta array<double>").collect()}

    def predict(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in frames:
            for f, held in t.groupby("fold"):
                i, beta = fitted[f]
                for start in range(0, len(held), 1000):
                    h = held.iloc[start : start + 1000]
                    a, b = scaled(train[f][0], h[list(features)].to_numpy(dtype=float))
                    p = svr_predict(a, beta, b, _gamma(grid[i][1], a))
                    yield pd.DataFrame({"fold": f, key: h[key].to_numpy(), "truth": h[target].to_numpy(dtype=float), "prediction": p, "c": grid[i][0], "gamma": str(grid[i][1])})

    return dealt.mapInPandas(predict, f"fold int, {key} {df.schema[key].dataType.simpleString()}, truth double, prediction double, c double, gamma string")


def model_cv(df: DataFrame, features: Sequence[str], fit: Callable[[np.ndarray, np.ndarray, dict], Callable[[np.ndarray], np.ndarray]], grid: Sequence[dict], target: str = "mmse", stratum: str = "diagnosis", key: str = "participant_id", seed: int = 0, outer: int = 5, inner: int = 3, fit_rows: int = 5000) -> DataFrame:
    """fold, key, truth, prediction, setting of every labelled row, held out, by a model of one's own: `fit` takes
    scaled features, targets and a setting of `grid` and gives a function that predicts. The setting with the least
    mean absolute error of an inner cross-validation is chosen, the first if equal. As in `svr_cv`, a fold's model sees
    the `fit_rows` rows with the smallest hashes among those of the other folds; every row is predicted."""
    rows = check_missing_share(df, [*features, target]).withColumn("_h", F.xxhash64(F.lit(seed), key))
    dealt = cut(stratified_folds(rows, stratum, key, outer, seed).select(key, "fold", *features, target, "_h"), "folds")
    train = {}
    for f in range(outer):
        t = dealt.filter(F.col("fold") != f).orderBy("_h", key).limit(fit_rows).toPandas().sort_values(key)
        train[f] = t[list(features)].to_numpy(dtype=float), t[target].to_numpy(dtype=float)
    settings = list(grid)

    def scaler(x: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
        m, s = x.mean(0), x.std(0)
        return lambda v: (v - m) / np.where(s > 0, s, 1.0)

    def choose(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in frames:
            for f in t["fold"]:
                x, y = train[f]
                k, errors = max(2, min(inner, len(y) // 2)), []
                part = np.arange(len(y)) % k
                for setting in settings:
                    e = []
                    for g in range(k):
                        scale = scaler(x[part != g])
                        e.append(np.abs(fit(scale(x[part != g]), y[part != g], setting)(scale(x[part == g])) - y[part == g]).mean())
                    errors.append(float(np.mean(e)))
                best = settings[int(np.argmin(errors))]
                yield pd.DataFrame({"fold": [f], "setting": [repr(best)], "model": [cloudpickle.dumps((scaler(x), fit(scaler(x)(x), y, best)))]})

    folds = df.sparkSession.createDataFrame([(f,) for f in range(outer) if len(train[f][1])], "fold int").repartition(outer, "fold")
    fitted = {r["fold"]: (r["setting"], bytes(r["model"])) for r in folds.mapInPandas(choose, "fold int, setting string, model binary").collect()}

    def held_out(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        models = {f: cloudpickle.loads(m) for f, (_, m) in fitted.items()}
        for t in frames:
            for f, held in t.groupby("fold"):
                scale, model = models[f]
                yield pd.DataFrame({"fold": f, key: held[key].to_numpy(), "truth": held[target].to_numpy(dtype=float), "prediction": model(scale(held[list(features)].to_numpy(dtype=float))), "setting": fitted[f][0]})

    return dealt.mapInPandas(held_out, f"fold int, {key} {df.schema[key].dataType.simpleString()}, truth double, prediction double, setting string")


def most_common_setting(folds: DataFrame, *setting: str) -> DataFrame:
    """The setting most folds chose; the one of the earliest fold if equal."""
    g = folds.select("fold", *setting).distinct().groupBy(*setting).agg(F.count("*").alias("n"), F.min("fold").alias("first"))
    return g.orderBy(F.desc("n"), "first").limit(1)


def evaluation(predicted: DataFrame, truth: str = "mmse", prediction: str = "prediction", cutoff: float = CUTOFF, n_boot: int = 1000, seed: int = 20260507) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(mean absolute error with interval, confusion at the cutoff, kappa at the cutoff)."""
    e = predicted.select(F.abs(F.col(truth) - F.col(prediction)).alias("e"), F.xxhash64(*[F.col(c) for c in predicted.columns]).alias("h"))
    cls = predicted.select((F.col(truth) >= cutoff).cast("int").alias("t"), (F.col(prediction) >= cutoff).cast("int").alias("p"))
    return stats.bootstrap_mean(e, "e", n_boot, seed), stats.confusion(cls, F.col("t"), F.col("p")), stats.kappa(cls, "t", "p")
