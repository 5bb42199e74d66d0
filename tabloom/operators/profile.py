"""Profiling, cleaning and target preparation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.hashing import md5_normal, md5_unit, pick_by_share
from tabloom.functions.joins import Fitted, attach


def is_missing(df: DataFrame, name: str) -> Column:
    """Null, or NaN in a floating column."""
    c = F.col(f"`{name}`")
    floating = dict(df.dtypes)[name] in ("double", "float")
    return (c.isNull() | F.isnan(c)) if floating else c.isNull()


def _long(df: DataFrame, value: str) -> DataFrame:
    """A one-row frame of per-column figures as ``(feature, value)``."""
    return df.unpivot([], df.columns, "feature", value)


def missing_counts(train: DataFrame, test: DataFrame, cols: list[str]) -> DataFrame:
    """Missing cells per column over both tables; an absent column adds 0."""

    def side(df: DataFrame) -> DataFrame:
        return df.agg(
            *[
                (F.count_if(is_missing(df, c)) if c in df.columns else F.lit(0).cast("long")).alias(c)
                for c in cols
            ]
        )

    both = _long(side(train), "n").unionByName(_long(side(test), "n"))
    return both.groupBy("feature").agg(F.sum("n").alias("missing"))


def unique_counts(df: DataFrame, cols: list[str], approximate: bool = False) -> DataFrame:
    """Distinct values per column, null counted as one value.

    ``approximate`` trades exactness for a single pass without a shuffle of
    distinct values.
    """
    count = F.approx_count_distinct if approximate else F.count_distinct
    return _long(
        df.agg(
            *[
                (
                    count(F.when(~is_missing(df, c), F.col(f"`{c}`")))
                    + F.coalesce(F.max(is_missing(df, c).cast("long")), F.lit(0))
                ).alias(c)
                for c in cols
            ]
        ),
        "n_unique",
    )


def clean_category(c: Column) -> Column:
    """Trimmed text; empty text and the text ``nan`` are missing."""
    text = F.trim(c.cast("string"))
    return F.nullif(F.nullif(text, F.lit("nan")), F.lit(""))


def clean_categories(df: DataFrame, cols: list[str]) -> DataFrame:
    meta = {f.name: f.metadata for f in df.schema.fields}
    return df.select(
        *[
            clean_category(F.col(f"`{c}`")).alias(c, metadata=meta[c])
            if c in cols
            else F.col(f"`{c}`")
            for c in df.columns
        ]
    )


def value_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """``(feature, value, n)`` for all columns in one shuffle, combined map-side."""
    text = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in cols])
    long = text.unpivot([], cols, "feature", "value")
    return long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))


def feature_values(train: DataFrame, test: DataFrame, cols: list[str]) -> DataFrame:
    """Distinct cleaned values of every categorical column over both tables."""
    both = clean_categories(train.select(*cols), cols).unionByName(
        clean_categories(test.select(*cols), cols)
    )
    return (
        value_counts(both, cols).select("feature", F.coalesce("value", F.lit("")).alias("value"))
    )


def unseen_category_rows(train: DataFrame, test: DataFrame, cols: list[str]) -> DataFrame:
    """Rows whose category the other table lacks, in both directions.

    Works on the category counts, so no row is joined.
    """
    tr = value_counts(train, cols).withColumnRenamed("n", "n_train").withColumn(
        "n_test", F.lit(0).cast("long")
    )
    te = value_counts(test, cols).withColumnRenamed("n", "n_test").withColumn(
        "n_train", F.lit(0).cast("long")
    )
    per_value = (
        tr.unionByName(te)
        .groupBy("feature", "value")
        .agg(F.sum("n_train").alias("n_train"), F.sum("n_test").alias("n_test"))
    )
    return per_value.groupBy("feature").agg(
        F.sum(F.when(F.col("n_test") == 0, F.col("n_train")).otherwise(0)).alias("train_rows"),
        F.sum(F.when(F.col("n_train") == 0, F.col("n_test")).otherwise(0)).alias("test_rows"),
    )


def row_counts(train: DataFrame, test: DataFrame) -> DataFrame:
    n = lambda df, s: df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("split", F.lit(s))
    return n(train, "train").unionByName(n(test, "test"))


def label_codes(train: DataFrame, target: str, id_col: str) -> DataFrame:
    """``(target, code)``: codes 0..k-1 by the smallest id a label occurs at.

    The window runs over the labels, one row per class.
    """
    first = train.where(F.col(target).isNotNull()).groupBy(target).agg(F.min(id_col).alias("_at"))
    w = Window.partitionBy(F.lit(0)).orderBy("_at", target)
    return first.select(target, (F.row_number().over(w) - 1).alias("code"))


def encode_labels(df: DataFrame, codes: DataFrame | Fitted, target: str) -> DataFrame:
    """Replace the label by its code; labels train never had become null."""
    return attach(df, codes, [target]).drop(target).withColumnRenamed("code", target)


def class_shares(df: DataFrame, target: str) -> DataFrame:
    """``(target, n, share)``; the total is taken over the classes."""
    per = df.where(F.col(target).isNotNull()).groupBy(target).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    return per.withColumn("share", F.col("n") / total)


def dummy_targets(
    train: DataFrame, test: DataFrame, target: str, id_col: str, classification: bool, seed: int = 43
) -> DataFrame:
    """Give ``test`` a stand-in target when it has none.

    Regression draws from the normal with train's mean and deviation,
    classification from train's class frequencies. Draws depend on the row id
    and the seed only.
    """
    if target in test.columns:
        return test
    if classification:
        rows = class_shares(train, target).orderBy(target).collect()
        draw = pick_by_share(md5_unit(seed, F.col(id_col)), [(r[target], r["share"]) for r in rows])
    else:
        m, s = train.agg(F.avg(target), F.stddev_samp(target)).first()
        draw = F.lit(float(m)) + F.lit(float(s or 0.0)) * md5_normal(seed, F.col(id_col))
    return test.withColumn(target, draw)
