"""Column selection: by role, by presence, by spread, by relation to the target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.names import stripped_name
from tabloom.meta import Kit


def drop_id(df: DataFrame, id_col: str) -> DataFrame:
    """The table without the id among its features.

    Inside a chain the id stays as a row key (its role is ``id``, so assembly
    skips it); this form is for output.
    """
    return df.drop(id_col)


def drop_columns(df: DataFrame, flags: dict[str, bool]) -> DataFrame:
    """Remove the flagged features; flags of absent columns are ignored."""
    return df.drop(*[c for c, on in flags.items() if on])


def one_sided_columns(train: DataFrame, test: DataFrame, keep: list[str]) -> list[str]:
    """Columns found in one table only, ``keep`` (ids, targets) excepted."""
    return sorted((set(train.columns) ^ set(test.columns)) - set(keep))


def col_in_train_only(train: DataFrame, test: DataFrame, keep: list[str]) -> tuple[DataFrame, DataFrame]:
    gone = one_sided_columns(train, test, keep)
    return train.drop(*gone), test.drop(*gone)


def _ends(df: DataFrame, cols: list[str], by: str | None = None) -> list:
    """Minimum and maximum of every column per split, in one pass.

    A column has one distinct value exactly when the two agree, so no distinct
    counts are needed.
    """
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.min(f"`{c}`").alias(f"lo{i}"), F.max(f"`{c}`").alias(f"hi{i}")]
    return (df.groupBy(by) if by else df.groupBy()).agg(*aggs).collect()  # a row per split


def constant_over(df: DataFrame, cols: list[str]) -> list[str]:
    """Columns with one distinct value, nulls ignored."""
    if not cols:
        return []
    row = _ends(df, cols)[0]
    return [c for i, c in enumerate(cols) if row[f"lo{i}"] is not None and row[f"lo{i}"] == row[f"hi{i}"]]


def constant_columns(train: DataFrame, test: DataFrame, cols: list[str]) -> list[str]:
    """Columns whose single non-null value is the same in both tables."""
    if not cols:
        return []
    tagged = train.select(*[f"`{c}`" for c in cols], F.lit(0).alias("_split")).unionByName(
        test.select(*[f"`{c}`" for c in cols], F.lit(1).alias("_split"))
    )
    rows = _ends(tagged, cols, "_split")
    if len(rows) < 2:
        return []
    return [
        c
        for i, c in enumerate(cols)
        if rows[0][f"lo{i}"] is not None
        and len({r[f"{e}{i}"] for r in rows for e in ("lo", "hi")}) == 1
    ]


def rm_constant_col(train: DataFrame, test: DataFrame, cols: list[str]) -> tuple[DataFrame, DataFrame]:
    gone = constant_columns(train, test, [c for c in cols if c in test.columns])
    return train.drop(*gone), test.drop(*gone)


def invalid_col_names(df: DataFrame) -> DataFrame:
    """Strip special characters from the names; equal results are an error."""
    names = {c: stripped_name(c) for c in df.columns}
    if len(set(names.values())) < len(names):
        raise ValueError(f"stripped column names collide: {sorted(names.values())}")
    return df.withColumnsRenamed(names)


def variances(df: DataFrame, cols: list[str]) -> DataFrame:
    """``(feature, variance)``, population variance, all columns in one pass."""
    return df.agg(*[F.var_pop(f"`{c}`").alias(c) for c in cols]).unpivot(
        [], cols, "feature", "variance"
    )


def variance_threshold(df: DataFrame, cols: list[str], threshold: float = 0.0) -> list[str]:
    """Features whose variance exceeds the threshold."""
    row = df.agg(*[F.var_pop(f"`{c}`").alias(c) for c in cols]).first()
    return [c for c in cols if row[c] is not None and row[c] > threshold]


def _ratio(over: Column, under: Column) -> Column:
    """An F value; infinite for a feature that leaves nothing unexplained."""
    return F.when((under <= 0) & (over > 0), F.lit(float("inf"))).otherwise(F.try_divide(over, under))


def correlation_scores(df: DataFrame, cols: list[str], target: str) -> DataFrame:
    """``(feature, r, f)``: Pearson correlation and the F value of a linear fit.

    A feature is judged on the rows that have it and the target.
    """
    pair = lambda c: F.col(f"`{c}`").isNotNull() & F.col(target).isNotNull()
    row = df.agg(
        *[F.corr(F.col(f"`{c}`").cast("double"), F.col(target).cast("double")).alias(f"r{i}") for i, c in enumerate(cols)],
        *[F.count_if(pair(c)).alias(f"n{i}") for i, c in enumerate(cols)],
    )
    entries = [
        F.struct(F.lit(c).alias("feature"), F.col(f"r{i}").alias("r"), F.col(f"n{i}").alias("_n")) for i, c in enumerate(cols)
    ]
    long = row.select(F.explode(F.array(*entries)).alias("e")).select("e.*")
    r2 = F.col("r") * F.col("r")
    return long.select("feature", "r", _ratio(r2 * (F.col("_n") - 2), 1 - r2).alias("f"))


def _per_class(df: DataFrame, cols: list[str], target: str) -> DataFrame:
    """``(feature, class, n, s, m, v)``: one grouped pass, a row per class and feature.

    Cells that are there: their number, sum, mean and sum of squared deviations
    from the class mean. Rows without a class are left out.
    """
    x = lambda c: F.when(F.isnan(F.col(f"`{c}`").cast("double")), None).otherwise(F.col(f"`{c}`").cast("double"))
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.count(x(c)).alias(f"n{i}"), F.sum(x(c)).alias(f"s{i}"), F.avg(x(c)).alias(f"m{i}")]
        aggs.append((F.var_pop(x(c)) * F.count(x(c))).alias(f"v{i}"))
    sums = df.where(F.col(target).isNotNull()).groupBy(F.col(target).alias("class")).agg(*aggs)
    entries = F.array(
        *[
            F.struct(F.lit(c).alias("feature"), *[F.col(f"{k}{i}").alias(k) for k in "nsmv"])
            for i, c in enumerate(cols)
        ]
    )
    return sums.select("class", F.explode(entries).alias("e")).select("class", "e.*").where("n > 0")


def anova_scores(df: DataFrame, cols: list[str], target: str) -> DataFrame:
    """``(feature, f)``: one-way analysis of variance over the classes.

    Between-class squares are taken from the gaps of class means, and squares
    within a class by its running variance, so a large mean costs no digits.
    """
    per = _per_class(df, cols, target)
    whole = per.groupBy("feature").agg((F.sum("s") / F.sum("n")).alias("_mean"))
    gap = F.col("m") - F.col("_mean")
    tot = per.join(F.broadcast(whole), "feature").groupBy("feature").agg(  # one row per feature
        F.sum("n").alias("n"),
        F.count(F.lit(1)).alias("k"),
        F.sum(F.col("n") * gap * gap).alias("ssb"),
        F.sum("v").alias("ssw"),
    )
    between, within = F.try_divide("ssb", F.col("k") - 1), F.try_divide("ssw", F.col("n") - F.col("k"))
    return tot.select("feature", _ratio(between, within).alias("f"))


def chi2_scores(df: DataFrame, cols: list[str], target: str) -> DataFrame:
    """``(feature, chi2)``: class sums of non-negative features against their share."""
    per = _per_class(df, cols, target)
    tot = per.groupBy("feature").agg(F.sum("n").alias("nt"), F.sum("s").alias("st"))
    expected = F.col("st") * F.col("n") / F.col("nt")
    gap = F.col("s") - expected
    return (
        per.join(F.broadcast(tot), "feature")  # one row per feature
        .groupBy("feature")
        .agg(F.sum(F.try_divide(gap * gap, expected)).alias("chi2"))
    )


def equal_width_code(df: DataFrame, cols: list[str], bins: int) -> dict:
    """Bin expressions 0..bins-1 between each column's minimum and maximum."""
    row = df.agg(
        *[F.min(f"`{c}`").alias(f"lo{i}") for i, c in enumerate(cols)],
        *[F.max(f"`{c}`").alias(f"hi{i}") for i, c in enumerate(cols)],
    ).first()
    out = {}
    for i, c in enumerate(cols):
        lo, hi = row[f"lo{i}"], row[f"hi{i}"]
        if lo is None or lo == hi:
            out[c] = F.when(F.col(f"`{c}`").isNotNull(), F.lit(0))
            continue
        step = (F.col(f"`{c}`") - F.lit(lo)) * F.lit(float(bins)) / F.lit(float(hi) - float(lo))
        out[c] = F.least(F.floor(step), F.lit(bins - 1)).cast("int")
    return out


def mutual_information(
    df: DataFrame, cols: list[str], target: str, bins: int = 20, bin_target: bool = False
) -> DataFrame:
    """``(feature, mi)`` in nats between binned features and the (binned) target."""
    codes = equal_width_code(df, cols + [target] if bin_target else cols, bins)
    y = codes.pop(target) if bin_target else F.col(target)
    wide = df.select(y.cast("string").alias("_y"), *[e.alias(c) for c, e in codes.items()])
    cells = (
        wide.unpivot(["_y"], cols, "feature", "b")
        .where("b is not null and _y is not null")
        .groupBy("feature", "_y", "b")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # bins x classes cells per feature
    over = lambda *by: F.sum("n").over(Window.partitionBy("feature", *by))
    parts = cells.withColumns({"nb": over("b"), "ny": over("_y"), "nt": over()})
    p = F.col("n") / F.col("nt")
    return parts.groupBy("feature").agg(
        F.sum(p * F.log(F.col("n") * F.col("nt") / (F.col("nb") * F.col("ny")))).alias("mi")
    )


def kbest_scores(df: DataFrame, cols: list[str], target: str, classification: bool, score: int) -> DataFrame:
    """``(feature, score)`` for score function 1, 2 or 3 of the task type.

    Classification: chi2, ANOVA F, mutual information. Regression: Pearson r,
    F, mutual information.
    """
    if score not in (1, 2, 3):
        raise ValueError("score function must be 1, 2 or 3")
    if classification:
        if score == 1:
            return chi2_scores(df, cols, target).withColumnRenamed("chi2", "score")
        if score == 2:
            return anova_scores(df, cols, target).withColumnRenamed("f", "score")
        return mutual_information(df, cols, target).withColumnRenamed("mi", "score")
    if score == 3:
        return mutual_information(df, cols, target, bin_target=True).withColumnRenamed("mi", "score")
    both = correlation_scores(df, cols, target)
    return both.select("feature", F.col("r" if score == 1 else "f").alias("score"))


def select_kbest(
    df: DataFrame, cols: list[str], target: str, classification: bool, score: int = 2, removed: int = -1
) -> DataFrame:
    """The best ``len(cols) + removed`` features, at least one."""
    k = max(len(cols) + removed, 1)
    scored = kbest_scores(df, cols, target, classification, score)
    return scored.orderBy(F.col("score").desc_nulls_last(), "feature").limit(k)


def keep_features(kit: Kit, features: list[str], keep: list[str]) -> Kit:
    """Drop the features outside ``keep`` from both tables."""
    gone = [c for c in features if c not in keep]
    return kit.replace(kit.train.drop(*gone), kit.test.drop(*gone))
