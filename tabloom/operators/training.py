"""Training submissions on folds, with predictions and scores kept as tables."""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.functions import spread as P
from tabloom.operators import scores as S
from tabloom.operators import ridge
from tabloom.operators.folds import fold_of, held_out
from tabloom.operators.models import RIDGE_PENALTY, Spec, fit, fold_additive
from tabloom.session import stored

def rows_schema(id_kind: str = "bigint") -> str:
    """Predictions of one submission and fold; rows keep the type of their id."""
    return f"split string, row_id {id_kind}, y double, class int, p double, target string"


def predictions_schema(id_kind: str = "bigint") -> str:
    return f"submission string, fold int, {rows_schema(id_kind)}"


FAILURES = "submission string, fold int, error string"
SCORES = "submission string, fold int, step string, score_name string, value double, seconds double, n_rows long"


@dataclass
class Task:
    """Prepared tables and what to learn from them."""

    train: DataFrame
    test: DataFrame
    id_col: str
    target: str
    features: list[str]
    score_name: str
    classes: int = 0
    targets: tuple[str, ...] = ()  # of a regression with several
    parts: dict[int, str] = field(default_factory=dict)  # columns of ``train`` with the part held out, by repeat

    @property
    def several(self) -> bool:
        """Whether rows have a prediction per target, which is part of what is predicted."""
        return len(self.targets) > 1

    @property
    def cell(self) -> list[str]:
        """What one number is predicted for."""
        return ["row_id"] + ["class"] * self.blocks + ["target"] * self.several

    @property
    def id_kind(self) -> str:
        """Type of the row ids: whole numbers are long, anything else stays what it is."""
        kind = dict(self.train.dtypes)[self.id_col]
        return "bigint" if kind in ("tinyint", "smallint", "int") else kind

    def row_id(self) -> Column:
        return F.col(f"`{self.id_col}`").cast(self.id_kind).alias("row_id")

    @property
    def blocks(self) -> bool:
        """Whether a row has a prediction per class, so that averages keep them apart."""
        return self.classes > 2 or (self.classes == 2 and self.score_name in S.LABEL_SCORES)


@dataclass
class Store:
    """Result tables below one shared folder; a folder per submission and fold.

    Folders are written once and whole, so concurrent fits and a restart after
    a crash cannot mix.
    """

    spark: SparkSession
    path: str
    extra: dict = field(default_factory=dict)

    def folder(self, table: str, submission: str, fold: int | str) -> str:
        return f"{self.path}/{table}/submission={submission}/fold={fold}"

    def write(self, df: DataFrame, table: str, submission: str, fold: int | str) -> None:
        df.write.mode("overwrite").parquet(self.folder(table, submission, fold))

    def write_folds(self, df: DataFrame, table: str, submission: str) -> None:
        """Rows of several folds (column ``fold``), each fold's folder replaced whole."""
        writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("fold")
        writer.parquet(f"{self.path}/{table}/submission={submission}")

    def read(self, table: str, schema: str) -> DataFrame:
        """The table, empty while nothing was written; any other read error is raised."""
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{table}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def predictions(self, task: Task, split: str = "valid") -> DataFrame:
        rows = self.read("predictions", predictions_schema(task.id_kind)).where(F.col("split") == split).drop("split")
        return _used(rows, task)

    def scores(self) -> DataFrame:
        return self.read("scores", SCORES)

    def append(self, rows: list[tuple], table: str, schema: str) -> None:
        self.spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{self.path}/{table}")


def _used(rows: DataFrame, task: Task) -> DataFrame:
    """Without the columns that tell apart what this task does not have."""
    return rows.drop(*["class"] * (not task.blocks), *["target"] * (not task.several))


def task_score(preds: DataFrame, task: Task, keys: tuple[str, ...]) -> DataFrame:
    """The task's score per key; with several targets the mean of theirs."""
    return (S.combined if task.several else S.score)(preds, task.score_name, keys)


def fit_predict(spec: Spec, task: Task, part: DataFrame, rows: DataFrame, keep: Callable[[str], list[Column]]) -> DataFrame:
    """``rows`` predicted by fits on ``part``: one, or one per target."""
    outs = []
    for t in task.targets if task.several else (task.target,):
        model = fit(spec, part, task.features, t, task.classes, task.id_col)
        out = output_rows(model.predict(rows), task, keep(t))
        outs.append(out.withColumn("target", F.lit(t if task.several else None).cast("string")))
    return reduce(DataFrame.unionByName, outs)


def output_rows(out: DataFrame, task: Task, keep: list[Column]) -> DataFrame:
    """The kept columns with ``class`` and ``p``.

    Regression: the value. Two classes and a probability score: P(class 1).
    Otherwise a row per class with its probability.
    """
    if task.blocks:
        return out.select(*keep, F.posexplode("probs").alias("class", "p"))
    p = F.col("p") if task.classes == 0 else F.col("probs")[1]
    return out.select(*keep, F.lit(None).cast("int").alias("class"), p.alias("p"))


def _marked(task: Task, folds: list[int], n_parts: int) -> Task:
    """The task with the parts of its training rows stored, so that no pass of a fit hashes the ids anew.

    A table that fits one task is left as it is.
    """
    if len(folds) < 2 or task.train.count() <= P.TASK_ROWS:
        return task
    parts = {r: f"_part_{r}" for r in sorted({f // n_parts for f in folds})}
    marks = {c: fold_of(F.col(task.id_col), r, n_parts) for r, c in parts.items()}
    return replace(task, train=stored(task.train.withColumns(marks), "marked"), parts=parts)


def _fold_rows(task: Task, fold: int, n_parts: int) -> tuple[DataFrame, DataFrame]:
    """Training part, and all rows to predict tagged by split."""
    part = task.parts.get(fold // n_parts)
    out = F.col(part) == fold % n_parts if part else held_out(task.id_col, fold, n_parts)
    tagged = task.train.withColumn("split", F.when(out, F.lit("valid")).otherwise(F.lit("train")))
    test = task.test.withColumn("split", F.lit("test"))
    targets = task.targets if task.several else (task.target,)
    for t in targets:
        if t not in test.columns:
            test = test.withColumn(t, F.lit(None).cast("double"))
    cols = [task.id_col, *targets, *task.features, "split"]
    return task.train.where(~out), tagged.select(*cols).unionByName(test.select(*cols))


def _train_additive(
    store: Store, task: Task, spec: Spec, submission: str, folds: list[int], n_parts: int, train_score: bool
) -> None:
    """All folds of a submission whose normal equations add up: one pass fits, one predicts, one scores.

    A spline's knots span all training rows, so that folds share them.
    """
    start, spark = time.monotonic(), store.spark
    basis = ridge.basis_of(task.train, task.features, spec.kind, spec.params.get("knots", 5))
    fits = ridge.fit_folds(task.train, basis, task.id_col, task.target, folds, spec.params.get("regParam", RIDGE_PENALTY), n_parts)
    table = [(f, m.intercept, m.weights.tolist()) for f, m in fits.items()]
    # a row per fold: at most some thirty rows of weights
    weights = F.broadcast(spark.createDataFrame(table, "fold int, _b double, _w array<double>"))
    out_of = {r: fold_of(F.col(f"`{task.id_col}`"), r, n_parts) + r * n_parts for r in {f // n_parts for f in folds}}
    held = F.array(*[c.cast("int") for c in out_of.values()])
    every = F.array(*[F.lit(f) for f in folds])

    def rows(df: DataFrame, split: str, which: Column) -> DataFrame:
        y = F.col(task.target).cast("double") if task.target in df.columns else F.lit(None).cast("double")
        wide = basis.apply(df).select(F.lit(split).alias("split"), task.row_id(), y.alias("y"), "_fa", F.explode(which).alias("fold"))
        p = F.aggregate(F.zip_with("_fa", "_w", lambda a, b: a * b), F.col("_b"), lambda a, b: a + b)
        return wide.join(weights, "fold").select("split", "row_id", "y", F.lit(None).cast("int").alias("class"), p.alias("p"), "fold")

    out = rows(task.train, "valid", F.array_intersect(held, every)).unionByName(rows(task.test, "test", every))
    store.write_folds(out, "predictions", submission)
    seconds = (time.monotonic() - start) / len(folds)
    saved = spark.read.schema(f"{rows_schema(task.id_kind)}, fold int").parquet(f"{store.path}/predictions/submission={submission}")
    judged = saved.where(F.col("fold").isin(folds)).drop("class", "target")
    if train_score:
        judged = judged.unionByName(rows(task.train, "train", F.array_except(every, held)).drop("class"))
    sizes = judged.groupBy("fold", "split").agg(F.count(F.lit(1)).alias("n_rows"))
    scored = S.score(judged.where("y is not null"), task.score_name, ("fold", "split"))
    store.write_folds(_score_rows(scored.join(sizes, ["fold", "split"]), task, seconds, "fold").coalesce(1), "scores", submission)


def _score_rows(scored: DataFrame, task: Task, seconds: float, *more: str) -> DataFrame:
    return scored.select(
        F.col("split").alias("step"), F.lit(task.score_name).alias("score_name"), F.col("score").alias("value"),
        F.lit(seconds).alias("seconds"), "n_rows", *more,
    )


def _train_one(store: Store, task: Task, spec: Spec, submission: str, fold: int, n_parts: int, train_score: bool) -> None:
    start = time.monotonic()
    part, rows = _fold_rows(task, fold, n_parts)
    keep = lambda t: [F.col("split"), task.row_id(), F.col(t).cast("double").alias("y")]
    out = fit_predict(spec, task, part, rows, keep)
    store.write(out.where("split <> 'train'"), "predictions", submission, fold)
    seconds = time.monotonic() - start
    saved = store.spark.read.schema(rows_schema(task.id_kind)).parquet(store.folder("predictions", submission, fold))
    per_row = task.classes if task.blocks else max(1, len(task.targets))

    def judged(df: DataFrame) -> tuple[DataFrame, DataFrame]:
        df = _used(df, task)
        sizes = df.groupBy("split").agg((F.count(F.lit(1)) / per_row).cast("long").alias("n_rows"))
        return task_score(df.where("y is not null"), task, ("split",)), sizes

    scored, sizes = judged(saved)
    if train_score:  # the training part is ten times as large and only its score is wanted
        more = judged(out.where("split = 'train'"))
        scored, sizes = scored.unionByName(more[0]), sizes.unionByName(more[1])
    store.write(_score_rows(scored.join(sizes, "split"), task, seconds).coalesce(1), "scores", submission, fold)


def pending(store: Store, wanted: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """The (submission, fold) pairs without a score yet."""
    if not wanted:
        return []
    rows = store.spark.createDataFrame(wanted, "submission string, fold int")
    left = rows.join(store.scores().select("submission", "fold").distinct(), ["submission", "fold"], "left_anti")
    return sorted((r["submission"], r["fold"]) for r in left.collect())


def train_folds(
    store: Store,
    task: Task,
    specs: dict[str, Spec],
    folds: list[int],
    force: bool = False,
    n_parts: int = 10,
    parallel: int = 4,
    train_score: bool = True,
) -> DataFrame:
    """Train submissions on folds and return ``(submission, mean_valid)``.

    Pairs already scored are skipped. Submissions whose folds add up are one
    job for all their folds. ``train_score`` off saves a pass over the training
    rows per fit. Fits run as concurrent Spark jobs from a
    few driver threads, which hold no data. A fit that fails is noted in the
    table ``failures`` and has no score; the others go on. If all fail, the
    first error is raised.
    """
    wanted = [(s, f) for s in specs for f in folds]
    todo = wanted if force else pending(store, wanted)

    additive = lambda spec: not task.several and fold_additive(spec, task.classes)
    jobs: list[tuple[str, list[int]]] = []
    for s in specs:
        mine = [f for n, f in todo if n == s]
        jobs += [(s, mine)] if mine and additive(specs[s]) else [(s, [f]) for f in mine]

    marked = _marked(task, [f for s, mine in jobs if not additive(specs[s]) for f in mine], n_parts)

    def run(job: tuple[str, list[int]]) -> Exception | None:
        name, mine = job
        try:
            if additive(specs[name]):
                _train_additive(store, task, specs[name], name, mine, n_parts, train_score)
            else:
                _train_one(store, marked, specs[name], name, mine[0], n_parts, train_score)
        except Exception as e:  # noqa: BLE001  whatever a trial's settings bring about
            return e
        return None

    with ThreadPoolExecutor(max_workers=parallel) as pool:
        errors = list(pool.map(inheritable_thread_target(store.spark)(run), jobs))
    failed = [
        (s, f, f"{type(e).__name__}: {e}"[:1000]) for (s, mine), e in zip(jobs, errors) if e is not None for f in mine
    ]
    if failed:
        store.append(failed, "failures", FAILURES)
    if todo and len(failed) == len(todo):
        raise next(e for e in errors if e is not None)
    done = store.scores().where(F.col("submission").isin(list(specs)) & F.col("fold").isin(folds))
    return mean_valid(done)


def mean_valid(scores: DataFrame) -> DataFrame:
    return (
        scores.where(F.col("step") == "valid")
        .groupBy("submission")
        .agg(F.avg("value").alias("mean_valid"))
    )


def retrain_full(task: Task, spec: Spec) -> DataFrame:
    """``(row_id[, class][, target], p)`` for the test table from a fit on every training row."""
    return _used(fit_predict(spec, task, task.train, task.test, lambda t: [task.row_id()]), task)


def search(
    store: Store, task: Task, specs: dict[str, Spec], folds: list[int], parallel: int = 4
) -> tuple[DataFrame, str | None]:
    """Train the settings and return their mean scores and the best one's name."""
    means = train_folds(store, task, specs, folds, parallel=parallel)
    lower = S.lower_is_better(task.score_name)
    by = F.col("mean_valid").asc() if lower else F.col("mean_valid").desc()
    best = means.orderBy(by, "submission").limit(1).collect()
    return means, (best[0]["submission"] if best else None)
