"""Prediction files, trial tables and the results summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.names import safe_name

POSITIVE_CLASS_SCORES = ("gini", "ngini", "auc", "nll")


def _onto(ids: DataFrame, values: DataFrame, id_col: str) -> DataFrame:
    """One value row per id; ids without a prediction keep nulls."""
    return ids.join(values, id_col, "left")


def regression_output(ids: DataFrame, preds: DataFrame, id_col: str, target: str) -> DataFrame:
    """``preds(id, p)`` as id and target value."""
    return _onto(ids, preds.select(id_col, F.col("p").alias(target)), id_col)


def class_output(
    ids: DataFrame,
    preds: DataFrame,
    id_col: str,
    target: str,
    classes: list[str],
    score_name: str,
    positive: str | None = None,
) -> DataFrame:
    """``preds(id, class, p)`` in the shape the score asks for.

    ``nll`` over more than two classes: one probability column per class.
    Scores on the positive class: its probability. Others: the most probable
    class, the first declared one on ties.
    """
    if score_name == "nll" and len(classes) > 2:
        wide = preds.groupBy(id_col).agg(
            *[
                F.max(F.when(F.col("class") == c, F.col("p"))).alias(
                    c if c in ids.columns else safe_name(f"{target}_{c}")
                )
                for c in classes
            ]
        )
        return _onto(ids.select(id_col), wide, id_col)
    if score_name in POSITIVE_CLASS_SCORES:
        if positive is None:
            raise ValueError(f"{score_name} needs the positive class of {target}")
        hit = preds.where(F.col("class") == positive)
        return _onto(ids.select(id_col), hit.select(id_col, F.col("p").alias(target)), id_col)
    wide = preds.groupBy(id_col).agg(
        *[F.max(F.when(F.col("class") == c, F.col("p"))).alias(f"_{i}") for i, c in enumerate(classes)]
    )
    probs = F.array(*[f"_{i}" for i in range(len(classes))])
    place = F.array_position(probs, F.array_max(probs)).cast("int")
    label = F.element_at(F.array(*[F.lit(c) for c in classes]), place)
    return _onto(ids.select(id_col), wide.select(id_col, label.alias(target)), id_col)


def write_predictions(df: DataFrame, path: str, fmt: str = "csv", order: str | None = None) -> None:
    """Write the output table; ``order`` keeps the row order of a sample file."""
    if order is not None:
        df = df.orderBy(order).drop(order)
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.format(fmt).save(path)


def write_trials(trials: DataFrame, path: str, base: str = "base") -> None:
    """The trial summary as Parquet, one folder per base predictor.

    Every task writes its own rows, so a base holding most of the trials is not
    written by one task.
    """
    trials.write.mode("overwrite").partitionBy(base).parquet(path)


def append_run(summary: DataFrame, run: DataFrame) -> DataFrame:
    """Add a run row; counts missing on either side become 0; sorted by run key."""
    out = summary.unionByName(run, allowMissingColumns=True)
    counts = [c for c, t in out.dtypes if c not in ("kit", "version", "number", "host")]
    return out.na.fill(0, counts).orderBy("kit", "version", "number")
