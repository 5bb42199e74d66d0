"""Filling missing cells by column statistics or by a model of the other columns."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import FeatureHasher, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.joins import Fitted, attach, fitted
from tabloom.functions.quantiles import exact_quantiles
from tabloom.functions.running import running
from tabloom.meta import Kit
from tabloom.operators.profile import is_missing, value_counts
from tabloom.session import stored

#: indicator columns that a categorical input of a model is hashed to
INPUT_BUCKETS = 32


def medians(df: DataFrame, cols: list[str]) -> dict[str, float | None]:
    """Exact medians of all columns; NaN counts as missing."""
    clean = df.select(*[F.when(~is_missing(df, c), F.col(f"`{c}`")).alias(c) for c in cols])
    return {c: q[0] for c, q in exact_quantiles(clean, cols, [0.5]).items()}


def modes(df: DataFrame, cols: list[str]) -> DataFrame:
    """``(feature, mode, n)``: most frequent value, the smallest on ties.

    Counts are combined per value first; picking the best is an aggregate, so a
    column with very many values does not land in one sort.
    """
    counts = value_counts(df, cols).where("value is not null")
    return counts.groupBy("feature").agg(
        F.min_by("value", F.struct((-F.col("n")).alias("a"), F.col("value").alias("b"))).alias("mode"),
        F.max("n").alias("n"),
    )


def fill(df: DataFrame, values: dict[str, object]) -> DataFrame:
    """Replace missing cells by literals, keeping types and roles."""
    meta = {f.name: f for f in df.schema.fields}
    out = []
    for c in df.columns:
        if values.get(c) is None:
            out.append(F.col(f"`{c}`"))
            continue
        is_int = meta[c].dataType.typeName() in ("integer", "long", "short", "byte")
        kind = "double" if is_int else meta[c].dataType
        expr = F.when(is_missing(df, c), F.lit(values[c]).cast(kind)).otherwise(
            F.col(f"`{c}`").cast(kind)
        )
        out.append(expr.alias(c, metadata=meta[c].metadata))
    return df.select(*out)


def _fill_both(kit: Kit, values: dict[str, object]) -> Kit:
    return kit.replace(fill(kit.train, values), fill(kit.test, values))


def impute_median(kit: Kit, cols: list[str]) -> Kit:
    """Medians over train and test together."""
    return _fill_both(kit, medians(kit.both(), cols)) if cols else kit


def impute_mode(kit: Kit, cols: list[str]) -> Kit:
    """Most frequent categories over train and test together."""
    if not cols:
        return kit
    rows = modes(kit.both(), cols).collect()
    return _fill_both(kit, {r["feature"]: r["mode"] for r in rows})


def _neighbours(both: DataFrame, num: list[str], cat: list[str]):
    """Other columns as model inputs: medians, modes, and categories hashed to indicators.

    Hashing needs no list of values, so an input of any cardinality will do.
    """
    fills: dict[str, object] = dict(medians(both, num)) if num else {}
    num = [c for c in num if fills[c] is not None]
    if cat:
        fills |= {r["feature"]: r["mode"] for r in modes(both, cat).collect()}
        cat = [c for c in cat if fills.get(c) is not None]
    num_cols = [
        F.coalesce(F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None)), F.lit(float(fills[c]))).alias(f"_n{i}")
        for i, c in enumerate(num)
    ]
    cat_cols = [
        F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(str(fills[c]))).alias(f"_c{i}")
        for i, c in enumerate(cat)
    ]
    stages = []
    if cat:
        names = [f"_c{i}" for i in range(len(cat))]
        stages = [FeatureHasher(inputCols=names, outputCol="_h", numFeatures=INPUT_BUCKETS * len(names))]
    inputs = [f"_n{i}" for i in range(len(num))] + (["_h"] if cat else [])
    stages.append(VectorAssembler(inputCols=inputs, outputCol="_x"))
    return stages, num_cols + cat_cols


def impute_num_model(
    kit: Kit,
    col: str,
    num: list[str],
    cat: list[str],
    trees: int = 500,
    depth: int = 5,
    rate: float = 0.2,
    seed: int = 61,
) -> Kit:
    """Fill a numeric column by boosted trees over the other columns.

    The model is fitted on train rows that have the value; predictions are
    coalesced into the gaps of both tables in one projection, without a join.
    """
    return _impute_model(
        kit,
        col,
        [c for c in num if c != col],
        cat,
        GBTRegressor(
            featuresCol="_x", labelCol="_y", predictionCol="_p",
            maxIter=trees, maxDepth=depth, stepSize=rate, seed=seed,
        ),
        codes=None,
    )


def impute_cat_model(
    kit: Kit,
    col: str,
    num: list[str],
    cat: list[str],
    trees: int = 40,
    depth: int = 7,
    seed: int = 61,
    max_classes: int = 64,
) -> Kit:
    """Fill a categorical column by a forest over the other columns.

    A column with a single label gets the literal ``missing`` instead. Beyond
    ``max_classes`` labels a forest would hold a number per label in every node;
    then each label gets a code word, a small forest learns each of its bits,
    and a gap gets the label whose code word is the likeliest.
    """
    counts = value_counts(kit.train, [col]).where("value is not null")
    # numbered by value; the forest knows the numbers, and a table gives the labels back
    values = stored(counts.select("value", F.lit(0).alias("_all"), F.lit(1).alias("_one")), "labels")
    codes = fitted(
        running(values, ["_all"], [F.col("value")], {"_n": ("sum", "_one")}).select(
            F.col("value").alias("_label"), (F.col("_n") - 1).cast("double").alias("_code")
        )
    )
    if codes.rows <= 1:
        return _fill_both(kit, {col: "missing"})
    if codes.rows > max_classes:
        return _impute_by_bits(kit, col, num, [c for c in cat if c != col], codes, max(1, trees // 4), depth, seed)
    model = RandomForestClassifier(
        featuresCol="_x", labelCol="_y", predictionCol="_p", numTrees=trees, maxDepth=depth, seed=seed
    )
    return _impute_model(kit, col, num, [c for c in cat if c != col], model, codes)


def code_bits(labels: int) -> int:
    """Twice the bits that tell the labels apart, so that code words differ in several."""
    return 2 * math.ceil(math.log2(max(labels, 2))) + 2


def code_words(codes: np.ndarray, bits: int, seed: int) -> np.ndarray:
    """A pseudorandom 0/1 row per label number."""
    state = codes.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(1, bits + 1, dtype=np.uint64) * np.uint64(
        0xBF58476D1CE4E5B9
    ) + np.uint64(seed)
    state = (state ^ (state >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    state = (state ^ (state >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((state ^ (state >> np.uint64(31))) >> np.uint64(40) & np.uint64(1)).astype(np.int8)


def _impute_by_bits(kit: Kit, col: str, num: list[str], cat: list[str], codes: Fitted, trees: int, depth: int, seed: int) -> Kit:
    """One forest of two classes per bit of the code words; the driver holds no label."""
    if not kit.both().agg(F.max(is_missing(kit.train, col).cast("int"))).first()[0]:
        return kit
    bits, n_labels = code_bits(codes.rows), codes.rows
    stages, inputs = _neighbours(kit.both(), num, cat)
    known = kit.train.where(~is_missing(kit.train, col)).select(F.col(f"`{col}`").cast("string").alias("_label"), *inputs)
    prep = Pipeline(stages=stages).fit(kit.train.limit(0).select(*inputs))

    @F.pandas_udf("array<double>")
    def word(code: pd.Series) -> pd.Series:
        return pd.Series(list(code_words(code.to_numpy().astype(np.int64), bits, seed).astype(float)))

    coded = attach(known, codes, ["_label"], "inner").withColumn("_w", word("_code"))
    data = stored(prep.transform(coded).select("_x", "_w"), "known")
    forests = [
        RandomForestClassifier(
            featuresCol="_x", labelCol="_y", probabilityCol=f"_q{b}", predictionCol=f"_p{b}", rawPredictionCol=f"_r{b}",
            numTrees=trees, maxDepth=depth, maxBins=128, seed=seed + b,
        ).fit(data.select("_x", F.col("_w")[b].alias("_y")))
        for b in range(bits)
    ]

    def likeliest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        numbers = np.arange(n_labels)
        for pdf in batches:
            p = np.clip(np.stack(pdf["_q"].to_numpy()).astype(float), 1e-6, 1 - 1e-6) if len(pdf) else np.zeros((0, bits))
            best = np.full(len(p), -np.inf)
            code = np.zeros(len(p))
            for at in range(0, n_labels, 4096):  # labels in blocks, so memory does not grow with them
                words = code_words(numbers[at : at + 4096], bits, seed).astype(float)
                fit = np.log(p) @ words.T + np.log(1 - p) @ (1 - words).T
                k = fit.argmax(axis=1)
                top = fit[np.arange(len(p)), k]
                code = np.where(top > best, at + k, code)
                best = np.maximum(best, top)
            yield pdf.drop(columns=["_q"]).assign(_code=code)

    def apply(df: DataFrame) -> DataFrame:
        gap = is_missing(df, col)
        gaps = stored(df.where(gap).withColumn("_row", F.monotonically_increasing_id()), "gaps")
        out = prep.transform(gaps.select("_row", *inputs)).select("_row", "_x")
        for f in forests:
            out = f.transform(out)
        out = out.select("_row", F.array(*[vector_to_array(f"_q{b}")[1] for b in range(bits)]).alias("_q"))
        guess = attach(out.mapInPandas(likeliest, "_row long, _code double"), codes, ["_code"], "inner")
        label = F.col("_label").cast(df.schema[col].dataType).alias(col, metadata=df.schema[col].metadata)
        filled = gaps.drop(col).join(guess, "_row")
        filled = filled.select(*[label if c == col else F.col(f"`{c}`") for c in df.columns])
        return df.where(~gap).unionByName(filled)

    return kit.replace(apply(kit.train), apply(kit.test))


def _impute_model(kit: Kit, col: str, num: list[str], cat: list[str], model, codes: Fitted | None) -> Kit:
    gaps = kit.both().agg(F.max(is_missing(kit.train, col).cast("int"))).first()[0]
    if not gaps:
        return kit
    stages, inputs = _neighbours(kit.both(), num, cat)
    known = kit.train.where(~is_missing(kit.train, col))
    if codes is None:
        known = known.select(F.col(f"`{col}`").cast("double").alias("_y"), *inputs)
    else:
        labelled = known.select(F.col(f"`{col}`").cast("string").alias("_label"), *inputs)
        known = attach(labelled, codes, ["_label"], "inner").withColumnRenamed("_code", "_y").drop("_label")
    prep = Pipeline(stages=stages).fit(kit.train.limit(0).select(*inputs))
    fitted_model = model.fit(stored(prep.transform(known).select("_x", "_y"), "known"))

    def apply(df: DataFrame) -> DataFrame:
        keep = df.columns
        field = df.schema[col]
        scored = fitted_model.transform(prep.transform(df.select(*[F.col(f"`{c}`") for c in keep], *inputs)))
        if codes is None:
            guess, kind = F.col("_p"), "double"
        else:
            # only gaps have a code to look up
            coded = scored.withColumn("_code", F.when(is_missing(df, col), F.col("_p")))
            scored, guess, kind = attach(coded, codes, ["_code"]), F.col("_label"), "string"
        new = F.when(is_missing(df, col), guess).otherwise(F.col(f"`{col}`")).cast(kind)
        return scored.select(
            *[new.alias(c, metadata=field.metadata) if c == col else F.col(f"`{c}`") for c in keep]
        )

    return kit.replace(apply(kit.train), apply(kit.test))


def impute_models(kit: Kit, gappy: list[str], num: list[str], cat: list[str], **settings) -> Kit:
    """Fill the columns one after another; later models see earlier fills.

    Each step is written to the shared folder, so plans stay short.
    """
    for c in gappy:
        kit = (
            impute_num_model(kit, c, num, cat, **settings)
            if c in num
            else impute_cat_model(kit, c, num, cat, **{k: v for k, v in settings.items() if k != "rate"})
        )
        kit = kit.replace(stored(kit.train, "imputed"), stored(kit.test, "imputed"))
    return kit


