"""From coded test predictions to the files a user hands in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.meta import Kit
from tabloom.operators.training import Task
from tabloom.sources.kits import ORDER
from tabloom.sources.outputs import class_output, regression_output, write_predictions



def labelled(preds: DataFrame, labels: list[str]) -> DataFrame:
    """``(row_id, class, p)`` with a label for each class code.

    Predictions without a class column are those of class 1 of two; the other
    class gets what is missing to one, which turns averaged ranks round as well.
    """
    if "class" not in preds.columns:
        sides = F.array(
            F.struct(F.lit(0).alias("class"), (1 - F.col("p")).alias("p")),
            F.struct(F.lit(1).alias("class"), F.col("p").alias("p")),
        )
        preds = preds.select("row_id", F.explode(sides).alias("e")).select("row_id", "e.*")
    names = F.array(*[F.lit(x) for x in labels])
    return preds.withColumn("class", F.get(names, F.col("class")))


def prediction_table(kit: Kit, task: Task, preds: DataFrame) -> DataFrame:
    """``preds(row_id[, class][, target], p)`` of the test rows in the shape that the score asks for.

    ``kit`` has been set up, so that its description lists the labels by code.
    Rows and their order are those of the sample file where there is one, else
    those of the test table by id; a row without a prediction keeps a null.
    """
    meta, id_col, target = kit.meta, task.id_col, task.target
    source = kit.sample if kit.sample is not None else kit.test
    place = F.col(ORDER) if ORDER in source.columns else F.col(id_col)
    if kit.sample is not None and ORDER not in source.columns:
        place = F.monotonically_increasing_id()  # a sample that was not read from a file
    ids = source.select(F.col(f"`{id_col}`").cast(task.id_kind).alias(id_col), place.alias(ORDER))
    if meta.is_classification:
        labels = [str(v) for v in meta.target_values[target]]
        named = labelled(preds, labels).withColumnRenamed("row_id", id_col)
        out = class_output(ids, named, id_col, target, labels, meta.score_name, meta.positive_values.get(target))
    elif task.several:
        one = lambda t: F.max(F.when(F.col("target") == t, F.col("p"))).alias(t)
        wide = preds.groupBy(F.col("row_id").alias(id_col)).agg(*[one(t) for t in task.targets])
        out = ids.select(id_col).join(wide, id_col, "left")
    else:
        out = regression_output(ids.select(id_col), preds.withColumnRenamed("row_id", id_col), id_col, target)
    return out.join(ids, id_col)


def write_outputs(kit: Kit, task: Task, outputs: dict[str, DataFrame], path: str, fmt: str = "csv") -> list[str]:
    """Write every output of a race below ``path``; one per base for single best trials."""
    written = []
    for name, preds in sorted(outputs.items()):
        bases = [r["base"] for r in preds.select("base").distinct().collect()] if "base" in preds.columns else [None]
        for base in sorted(bases, key=str):
            part = preds if base is None else preds.where(F.col("base") == base).drop("base")
            folder = f"{path}/{name}" if base is None else f"{path}/{name}_{base}"
            write_predictions(prediction_table(kit, task, part), folder, fmt, ORDER)
            written.append(folder)
    return written
