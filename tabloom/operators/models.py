"""Predictors as distributed ML fits.

``fit(spec, train, features, target, classes)`` returns a model whose
``predict`` adds ``p`` (regression) or ``probs``, an array of class
probabilities in the order of ``classes``.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.spread import spread
from tabloom.operators import knn as K
from tabloom.operators import ridge
from tabloom.operators.folds import holdout
from tabloom.operators.scale import (
    log_target,
    restore_target,
    spline_exprs,
    standardize_target,
    target_stats,
    unlog_target,
)
from tabloom.session import stored

# Scores whose boosting objective is the absolute error, and the
# score fitted on log1p of the target.
ABSOLUTE_SCORES = ("mae", "medae", "smape", "mare", "mape")
LOG_SCORES = ("rmsle",)


@dataclass(frozen=True)
class Spec:
    """A predictor kind and its settings."""

    kind: str
    params: dict = field(default_factory=dict)
    score_name: str = "rmse"
    seed: int = 61


@dataclass
class Model:
    """Feature expressions, fitted parts and how to read their output.

    ``place`` holds columns the feature expressions build on.
    """

    features: list[Column]
    stages: list[PipelineModel]
    read: object
    n_out: int = 1
    place: dict[str, Column] = field(default_factory=dict)
    iterations: int | None = None  # of a fit in stages

    def predict(self, df: DataFrame) -> DataFrame:
        keep = df.columns
        out = (df.withColumns(self.place) if self.place else df).withColumn(
            "_fa", F.array(*[c.cast("double") for c in self.features])
        )
        if self.stages:
            out = out.withColumn("_x", array_to_vector("_fa"))
        for s in self.stages:
            out = s.transform(out)
        name = "p" if self.n_out == 1 else "probs"
        return out.select(*keep, self.read.alias(name))


#: names of distances, and of the general one by its exponent
NEIGHBOUR_METRICS = {"euclidean": "l2", "manhattan": "l1", "chebyshev": "chebyshev", ("minkowski", 1): "l1", ("minkowski", 2): "l2"}


@dataclass
class NeighbourModel:
    """Training rows to be searched; columns are standardised by them, gaps count as their mean."""

    train: DataFrame
    vector: Column
    id_col: str
    params: dict
    classes: int

    def predict(self, df: DataFrame) -> DataFrame:
        rows = stored(df.withColumn("_key", F.monotonically_increasing_id()), "asked")
        p = self.params
        metric = p.get("metric", "euclidean")
        metric = NEIGHBOUR_METRICS[(metric, p.get("p", 2)) if metric == "minkowski" else metric]
        asked = rows.select(F.col("_key").alias(self.id_col), self.vector.alias("vec"))
        near = K.nearest_neighbours(self.train, asked, p.get("n_neighbors", 5), self.id_col, "vec", metric, label="_y")
        weights = p.get("weights", "uniform")
        if self.classes > 1:
            shares = K.knn_classifier(near, weights).groupBy("row_id")
            share = lambda c: F.coalesce(F.sum(F.when(F.col("class") == c, F.col("p"))), F.lit(0.0))
            found = shares.agg(F.array(*[share(c) for c in range(self.classes)]).alias("probs"))
        else:
            found = K.knn_regressor(near, weights)
        return rows.join(found.withColumnRenamed("row_id", "_key"), "_key").drop("_key")


def _fit_neighbours(spec: Spec, train: DataFrame, features: list[str], target: str, classes: int, id_col: str | None) -> NeighbourModel:
    x = [F.col(f"`{c}`").cast("double") for c in features]
    stats = train.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(x)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(x)]).first()
    scaled = [F.coalesce((c - F.lit(stats[f"m{i}"] or 0.0)) / F.lit(stats[f"s{i}"] or 1.0), F.lit(0.0)) for i, c in enumerate(x)]
    vector = F.array(*scaled)
    key = F.col(f"`{id_col}`") if id_col else F.monotonically_increasing_id()
    rows = train.select(key.alias("_id"), vector.alias("vec"), F.col(target).cast("double").alias("_y"))
    return NeighbourModel(rows if id_col else stored(rows, "neighbours"), vector, "_id", spec.params, classes)


def assembled(df: DataFrame, exprs: list[Column], label: Column, extra: list[Column] = ()) -> DataFrame:
    """``(_x, _y, extra)``: a projection; the fits cache what they iterate over."""
    arr = F.array(*[e.cast("double") for e in exprs])
    return df.select(array_to_vector(arr).alias("_x"), label.cast("double").alias("_y"), *extra)


def _in_tasks(train: DataFrame) -> DataFrame:
    """Rows in tasks of bounded size: trees keep theirs in memory and read them again for every level."""
    return spread(train, train.count())


def _doubles(features: list[str]) -> list[Column]:
    return [F.col(f"`{c}`").cast("double") for c in features]


def _renamed(est, i: int):
    """Separate output columns so that several fitted parts can be chained."""
    for p in ("predictionCol", "probabilityCol", "rawPredictionCol"):
        if est.hasParam(p):
            est = est._set(**{p: f"_{p}{i}"})
    return est


def _boost_rows(df: DataFrame, id_col: str | None, patience: bool) -> tuple[list[Column], dict]:
    if not patience or id_col is None:
        return [], {}
    return [holdout(F.col(id_col)).alias("_stop")], {
        "validationIndicatorCol": "_stop",
        "validationTol": 1e-6,
    }


def fit(
    spec: Spec,
    train: DataFrame,
    features: list[str],
    target: str,
    classes: int = 0,
    id_col: str | None = None,
) -> Model | NeighbourModel:
    """Fit on complete rows; ``classes`` > 1 makes it a classifier of codes 0..k-1."""
    if spec.kind == "knn":
        return _fit_neighbours(spec, train, features, target, classes, id_col)
    return (_fit_classifier if classes > 1 else _fit_regressor)(spec, train, features, target, classes, id_col)


RIDGE_PENALTY = 0.01


def fold_additive(spec: Spec, classes: int = 0) -> bool:
    """Whether all folds can be fitted from one pass (``operators.ridge``)."""
    return classes == 0 and spec.kind in ("spline", "ridge") and set(spec.params) <= {"knots", "regParam", "elasticNetParam"} and not spec.params.get("elasticNetParam")


def _fit_regressor(spec: Spec, train, features, target, classes, id_col) -> Model:
    exprs, y = _doubles(features), F.col(target)
    undo = lambda p: p
    p, place = dict(spec.params), {}
    if spec.kind in ("gbt", "rf"):
        if spec.score_name in LOG_SCORES:
            y, undo = log_target(y), unlog_target
        extra, stop = [], {}
        if spec.kind == "gbt":
            extra, stop = _boost_rows(train, id_col, p.pop("early_stop", False))
            loss = "absolute" if spec.score_name in ABSOLUTE_SCORES else "squared"
            est = GBTRegressor(featuresCol="_x", labelCol="_y", seed=spec.seed, lossType=loss, **stop, **p)
        else:
            est = RandomForestRegressor(featuresCol="_x", labelCol="_y", seed=spec.seed, **p)
    elif spec.kind == "kernel_svm":
        exprs, rest = _fourier(spec, train, features)
        stats = target_stats(train, target)
        y, undo = standardize_target(y, stats), lambda q: restore_target(q, stats)
        est = LinearRegression(featuresCol="_x", labelCol="_y", loss="huber", epsilon=1.35, **rest)
        extra = []
    elif spec.kind in ("spline", "ridge"):
        basis = ridge.basis_of(train, features, spec.kind, p.pop("knots", 5))
        reg = p.pop("regParam", RIDGE_PENALTY)
        if fold_additive(spec):
            found = ridge.fit_all(train, basis, target, reg)
            return Model(basis.exprs, [], found.predict(F.col("_fa")), place=basis.place)
        exprs, place = [e.cast("double") for e in basis.exprs], basis.place
        train = train.withColumns(place) if place else train
        est, extra = LinearRegression(featuresCol="_x", labelCol="_y", regParam=reg, **p), []
    else:
        raise ValueError(f"no regressor {spec.kind}")
    data = assembled(_in_tasks(train) if spec.kind in ("gbt", "rf") else train, exprs, y, extra)
    fitted = Pipeline(stages=[_renamed(est, 0)]).fit(data)
    return Model(exprs, [fitted], undo(F.col("_predictionCol0")), place=place)


def _fit_classifier(spec: Spec, train, features, target, classes, id_col) -> Model:
    exprs, p = _doubles(features), dict(spec.params)
    extra: list[Column] = []
    y = F.col(target)
    if spec.kind == "rf":
        est = RandomForestClassifier(featuresCol="_x", labelCol="_y", seed=spec.seed, **p)
        return _one_model(est, _in_tasks(train), exprs, y, classes)
    if spec.kind == "spline":
        place, groups = spline_exprs(train, features, p.pop("knots", 5))
        exprs = [e.cast("double") for g in groups.values() for e in g]
        train = train.withColumns(place) if place else train
        layers = [len(exprs), *p.pop("hidden", (20,)), classes]
        most, early = p.pop("maxIter", 50), p.pop("early_stop", True)
        make = lambda **more: MultilayerPerceptronClassifier(
            featuresCol="_x", labelCol="_y", layers=layers, seed=spec.seed, **p, **more
        )
        if early and id_col is not None:
            model = _staged_network(make, train, exprs, y, classes, id_col, most)
        else:
            model = _one_model(make(maxIter=most), train, exprs, y, classes)
        model.place = place
        return model
    if spec.kind == "gbt":
        train = _in_tasks(train)
        extra, stop = _boost_rows(train, id_col, p.pop("early_stop", False))
        make = lambda: [
            GBTClassifier(featuresCol="_x", labelCol="_y", seed=spec.seed, **stop, **p)
        ]
    elif spec.kind == "kernel_svm":
        exprs, rest = _fourier(spec, train, features)
        make = lambda: [
            LinearSVC(featuresCol="_x", labelCol="_y", **rest),
            None,
        ]
        by = [F.col(f"`{id_col}`")] if id_col else [F.col(f"`{c}`") for c in features]
        extra = [F.pmod(F.xxhash64(F.lit(spec.seed), *by), F.lit(CALIBRATION_PARTS)).alias("_part")]
    else:
        raise ValueError(f"no classifier {spec.kind}")
    return _per_class(make, train, exprs, y, classes, extra)


#: most iterations between two looks at the rows kept aside, and looks without gain before a stop
STAGE_ITERATIONS = 10
STAGE_PATIENCE = 2
#: relative gain that a look must show
STAGE_GAIN = 1e-4
#: parts of the rows whose margins calibrate a margin-only model
CALIBRATION_PARTS = 3


def _staged_network(make, train: DataFrame, exprs, y, classes: int, id_col: str, most: int) -> Model:
    """Fits in stages, each from the weights of the one before, until the log loss
    on a tenth of the rows that no stage sees has not got better for a while.

    The weights of the best stage are kept, however small its gain. Stages are
    short enough that a stop can come before ``most`` iterations.
    """
    data = stored(assembled(train, exprs, y, [holdout(F.col(f"`{id_col}`")).alias("_stop")]), "network")
    seen, aside = data.where("not _stop"), data.where("_stop")
    if aside.isEmpty() or seen.select("_y").distinct().count() < 2:
        return _one_model(make(maxIter=most), train, exprs, y, classes)
    # after the first stage come those without gain and one that the stop leaves out
    later = min(STAGE_ITERATIONS, max(1, most // (STAGE_PATIENCE + 3)))
    first = max(1, min(STAGE_ITERATIONS, most - (STAGE_PATIENCE + 1) * later))
    best, weights, worse, done = (float("inf"), None), None, 0, 0
    while done < most and worse < STAGE_PATIENCE:
        step = min(later, most - done) if done else first
        est = _renamed(make(maxIter=step, **({} if weights is None else {"initialWeights": weights})), 0)
        model = est.fit(seen)
        weights, done = model.weights, done + step
        true = F.get(vector_to_array("_probabilityCol0"), F.col("_y").cast("int"))
        loss = model.transform(aside).agg(-F.avg(F.log(F.greatest(true, F.lit(1e-15))))).first()[0]
        worse = 0 if loss is not None and loss < best[0] * (1 - STAGE_GAIN) else worse + 1
        if loss is not None and loss < best[0]:
            best = loss, model
    chosen = best[1] or model
    out = Model(exprs, [PipelineModel(stages=[chosen])], vector_to_array("_probabilityCol0"), classes)
    out.iterations = done
    return out


def _one_model(est, train, exprs, y, classes) -> Model:
    fitted = Pipeline(stages=[_renamed(est, 0)]).fit(assembled(train, exprs, y))
    return Model(exprs, [fitted], vector_to_array("_probabilityCol0"), classes)


def _per_class(make, train, exprs, y, classes: int, extra: list[Column]) -> Model:
    """Binary models, one per class beyond two, with normalised probabilities.

    A margin-only model gets a logistic fit on its margin for probabilities. The
    margins are those of rows that the margin's own fit has not seen: the model
    is fitted once more without each of a few parts of the rows, whose margins
    are then taken and stored. Margins of a model's own rows lie too far apart
    and would make the probabilities too sure.
    """
    data = assembled(train, exprs, y, extra)
    wanted = [1] if classes == 2 else list(range(classes))
    stages, probs = [], []
    for i, c in enumerate(wanted):
        part = data if classes == 2 else data.withColumn("_y", (F.col("_y") == c).cast("double"))
        kinds = make()
        model = Pipeline(stages=[_renamed(kinds[0], i)]).fit(part)
        stages.append(model)
        col = f"_probabilityCol{i}"
        if len(kinds) > 1:
            data_parts = stored(part, "calibration")
            seen = [data_parts.where(F.col("_part") != k) for k in range(CALIBRATION_PARTS)]
            cross = [
                Pipeline(stages=[_renamed(make()[0], i)]).fit(rows).transform(data_parts.where(F.col("_part") == k))
                for k, rows in enumerate(seen)
                if rows.select("_y").distinct().count() == 2  # a part may leave one class only
            ]
            margins = reduce(DataFrame.unionByName, cross) if cross else model.transform(part)
            margins = stored(margins.select(f"_rawPredictionCol{i}", "_y"), "margins")
            calib = LogisticRegression(featuresCol=f"_rawPredictionCol{i}", labelCol="_y", regParam=1e-3)
            calib = calib._set(
                predictionCol=f"_cp{i}", probabilityCol=f"_probabilityCol{i}", rawPredictionCol=f"_cr{i}"
            )
            stages.append(Pipeline(stages=[calib]).fit(margins))
        probs.append(vector_to_array(col)[1])
    if classes == 2:
        read = F.array(1 - probs[0], probs[0])
    else:
        total = sum(probs[1:], probs[0])
        read = F.array(*[F.coalesce(F.try_divide(q, total), F.lit(1.0 / classes)) for q in probs])
    return Model(exprs, stages, read, classes)


def _fourier(spec: Spec, train: DataFrame, features: list[str]) -> tuple[list[Column], dict]:
    """Random Fourier features of the standardised columns for an RBF kernel.

    cos(w.x + b) with w normal of variance 2 gamma, in column expressions; the
    linear model on them approximates the kernel machine.
    """
    p = dict(spec.params)
    gamma, c = p.pop("gamma", 0.1), p.pop("C", 1.0)
    n_out = p.pop("components", 32)
    rng = np.random.default_rng(spec.seed)
    w = rng.normal(scale=np.sqrt(2 * gamma), size=(n_out, len(features)))
    b = rng.uniform(0, 2 * np.pi, size=n_out)
    stats = train.agg(
        *[F.avg(f"`{f}`").alias(f"m{i}") for i, f in enumerate(features)],
        *[F.stddev_pop(f"`{f}`").alias(f"s{i}") for i, f in enumerate(features)],
        F.count(F.lit(1)).alias("n"),
    ).first()
    # (x - m) / s . w + b, with the scaling folded into the weights
    dev = np.array([stats[f"s{i}"] or 1.0 for i in range(len(features))], dtype=float)
    mean = np.array([stats[f"m{i}"] or 0.0 for i in range(len(features))], dtype=float)
    w = w / dev
    b = b - w @ mean
    norm = float(np.sqrt(2.0 / n_out))
    exprs = []
    for j in range(n_out):
        terms = " + ".join(f"cast(`{f}` as double) * {float(v)!r}D" for f, v in zip(features, w[j]))
        exprs.append(F.expr(f"{norm!r}D * cos({float(b[j])!r}D + {terms})"))
    p.setdefault("maxIter", 20)
    p["regParam"] = 1.0 / (c * max(stats["n"], 1))
    return exprs, p


def fit_targets(spec: Spec, train: DataFrame, features: list[str], targets: list[str], id_col: str | None = None) -> dict[str, Model]:
    """One regressor per target column."""
    return {t: fit(spec, train.where(F.col(t).isNotNull()), features, t, 0, id_col) for t in targets}


def predict_targets(models: dict[str, Model], df: DataFrame) -> DataFrame:
    """Adds ``p_<target>`` for every target in one chain of projections."""
    out = df
    for t, m in models.items():
        out = m.predict(out).withColumnRenamed("p", f"p_{t}")
    return out


# --- model-based feature selection -------------------------------------------


def l1_selector(train: DataFrame, features: list[str], target: str, c: float = 1.0, classes: int = 2) -> list[str]:
    """Features with a non-zero weight in an L1 logistic model of strength ``c``."""
    data = assembled(train, _doubles(features), F.col(target))
    est = LogisticRegression(
        featuresCol="_x", labelCol="_y", elasticNetParam=1.0, regParam=1.0 / (c * max(data.count(), 1)),
        family="binomial" if classes == 2 else "multinomial",
    )
    weights = np.abs(est.fit(data).coefficientMatrix.toArray()).sum(axis=0)
    return [f for f, w in zip(features, weights) if w > 0]


def rf_selector(
    train: DataFrame, features: list[str], target: str, removed: int = 1, trees: int = 20, depth: int = 5, seed: int = 61
) -> list[str]:
    """Recursive elimination: the least important feature goes, ``removed`` times."""
    left = list(features)
    data = stored(
        train.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in features], F.col(target).cast("double").alias("_y")),
        "selector",
    )
    for _ in range(min(removed, len(features) - 1)):
        x = VectorAssembler(inputCols=left, outputCol="_x").transform(data)
        est = RandomForestClassifier(featuresCol="_x", labelCol="_y", numTrees=trees, maxDepth=depth, seed=seed)
        worth = est.fit(x).featureImportances.toArray()
        left.pop(int(np.argmin(worth)))
    return left

