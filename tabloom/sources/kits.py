"""Reading kits: a folder with train, test, metadata and an optional sample file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.functions.names import feature_name
from tabloom.meta import Kit, Meta, with_roles


ORDER = "_order"


def in_file_order(df: DataFrame) -> DataFrame:
    """Add the place of each row in its files: Spark deals splits to tasks by size."""
    place = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    return df.withColumn(ORDER, place)


def _text(spark: SparkSession, path: str) -> str:
    """A small file as one string (the kit description)."""
    return spark.read.text(path, wholetext=True).first()[0]


def _table(spark: SparkSession, folder: str, name: str, fmt: str, schema) -> DataFrame:
    path = f"{folder}/{name}.{fmt}"
    if fmt == "csv":
        reader = spark.read.option("header", True)
        reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
        return reader.csv(path)
    return spark.read.format(fmt).load(path)


def read_kit(
    spark: SparkSession,
    folder: str,
    fmt: str = "csv",
    train_schema=None,
    test_schema=None,
    has_sample: bool = False,
) -> Kit:
    """Train and test frames with roles, and the description of the problem.

    Give schemas for large CSV files: inference reads the file once more.
    """
    meta = Meta.from_json(_text(spark, f"{folder}/metadata.json"))
    roles = dict(meta.roles) | {t: "target" for t in meta.target_cols} | {meta.id_col: "id"}
    train = with_roles(_table(spark, folder, "train", fmt, train_schema), roles)
    test = with_roles(_table(spark, folder, "test", fmt, test_schema), roles)
    train, test = cast_features(train, meta.casts), cast_features(test, meta.casts)
    sample = in_file_order(_table(spark, folder, "sample_submission", fmt, None)) if has_sample else None
    return Kit(train, test, meta, sample)


def cast_features(df: DataFrame, casts: dict[str, str]) -> DataFrame:
    """Apply declared type overrides; columns that are absent are skipped."""
    present = {c: t for c, t in casts.items() if c in df.columns}
    if not present:
        return df
    meta = {f.name: f.metadata for f in df.schema.fields}
    return df.select(
        *[
            F.col(f"`{c}`").cast(present[c]).alias(c, metadata=meta[c])
            if c in present
            else F.col(f"`{c}`")
            for c in df.columns
        ]
    )


def drop_null_targets(df: DataFrame, targets: list[str]) -> DataFrame:
    """Remove rows with any missing target; NaN counts as missing."""
    keep = df
    for t in targets:
        ok = F.col(f"`{t}`").isNotNull()
        if dict(df.dtypes)[t] in ("double", "float"):
            ok = ok & ~F.isnan(f"`{t}`")
        keep = keep.where(ok)
    return keep


def feature_names(features: list[str], id_col: str) -> dict[str, str]:
    """Old to new names; positions count every declared feature, id included."""
    return {
        c: (c if c == id_col else feature_name(c, i)) for i, c in enumerate(features)
    }


def rename_features(df: DataFrame, features: list[str], id_col: str) -> DataFrame:
    names = feature_names(features, id_col)
    return df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns})


def rename_kit(kit: Kit) -> Kit:
    """Rename in both tables and in the description."""
    m = kit.meta
    names = feature_names(list(m.roles), m.id_col)
    meta = Meta(
        m.title,
        m.id_col,
        m.target_cols,
        m.prediction_type,
        m.score_name,
        {names[c]: r for c, r in m.roles.items()},
        {names.get(c, c): t for c, t in m.casts.items()},
        m.positive_values,
        m.target_values,
        m.profile,
    )
    return Kit(
        rename_features(kit.train, list(m.roles), m.id_col),
        rename_features(kit.test, list(m.roles), m.id_col),
        meta,
        kit.sample,
    )


def drop_priors(table: DataFrame, features: list[str], id_col: str, order: str) -> DataFrame:
    """Per-feature drop probabilities as ``(feature, prior)``.

    The table has one column per feature and one row per measurement in
    ``order``. Its first row is the baseline and is left out; the prior is the
    value of the row after it.
    """
    names = feature_names(features, id_col)
    present = [c for c in features if c in table.columns and c != id_col]
    rows = table.orderBy(order).limit(2).withColumn("_first", F.col(order))
    base = rows.agg(F.min("_first").alias("_base"), F.max("_first").alias("_next"))
    row = base.first()
    if row is None or row["_base"] == row["_next"]:
        return table.limit(0).select(
            F.lit("").alias("feature"), F.lit(0.0).alias("prior")
        )
    second = table.where(F.col(order) == F.lit(row["_next"])).select(
        *[F.col(f"`{c}`").cast("double").alias(names[c]) for c in present]
    )
    return second.unpivot([], [names[c] for c in present], "feature", "prior")


def read_drop_priors(
    spark: SparkSession, path: str, features: list[str], id_col: str, order: str
) -> DataFrame:
    table = spark.read.option("header", True).option("inferSchema", True).csv(path)
    return drop_priors(table, features, id_col, order)


def known_settings(table: DataFrame, contributivity: str | Column = "contributivity") -> DataFrame:
    """Known-good hyperparameter settings: rows with a contributivity."""
    c = F.col(contributivity) if isinstance(contributivity, str) else contributivity
    return table.where(c.isNotNull())


def read_arms(spark: SparkSession, path: str) -> DataFrame:
    table = spark.read.option("header", True).option("inferSchema", True).csv(path)
    return known_settings(table)
