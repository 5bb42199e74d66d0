"""Sources, sinks, profiling and cleaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.catalog.registry import query
from tabloom.catalog.views import (
    KIT_SQL,
    SPLIT_DAY,
    TRIALS_SQL,
    all_rows,
    items,
    kit_rows,
    order_kit,
    sql_normal,
    sql_unit,
    table,
    trials,
)
from tabloom.operators import profile as P
from tabloom.session import work_dir
from tabloom.sources import kits as K
from tabloom.sources import outputs as O

Q = "WITH " + KIT_SQL


def _write_kit(spark: SparkSession, sf: str) -> tuple[str, object]:
    """The order kit as a folder of CSV tables and a description."""
    kit = order_kit(spark, sf)
    path = work_dir(spark, "kit")
    for name, df in (("train", kit.train), ("test", kit.test)):
        df.write.option("header", True).csv(f"{path}/{name}.csv")
    spark.createDataFrame([(kit.meta.to_json(),)], "value string").coalesce(1).write.text(f"{path}/metadata.json")
    return path, kit


@query(
    "read_kit",
    f"{Q} SELECT id, price, status, balance, nationkey, priority, segment, place, ordered, is_test FROM kit",
)
def read_kit(spark: SparkSession, sf: str) -> DataFrame:
    path, kit = _write_kit(spark, sf)
    got = K.read_kit(spark, path, train_schema=kit.train.schema, test_schema=kit.test.schema)
    mark = lambda df, v: df.withColumn("is_test", F.lit(v))
    return mark(got.train, False).unionByName(mark(got.test, True))


@query(
    "cast_features",
    f"{Q} SELECT CAST(id AS VARCHAR) AS id, CAST(nationkey AS DOUBLE) AS nationkey, CAST(balance AS BIGINT) AS balance FROM "
    "(SELECT id, nationkey, trunc(balance) AS balance FROM train)",
)
def cast_features(spark: SparkSession, sf: str) -> DataFrame:
    train = order_kit(spark, sf).train.select("id", "nationkey", "balance")
    return K.cast_features(train, {"id": "string", "nationkey": "double", "balance": "bigint", "absent": "int"})


@query("drop_null_targets", f"{Q} SELECT id, balance, priority FROM train WHERE balance IS NOT NULL AND priority IS NOT NULL")
def drop_null_targets(spark: SparkSession, sf: str) -> DataFrame:
    train = order_kit(spark, sf).train.select("id", "balance", "priority")
    return K.drop_null_targets(train, ["balance", "priority"])


@query(
    "rename_features",
    f"{Q} SELECT id, balance AS \"_balance__USD__1\", priority AS \"_order_priority_2\", segment AS \"_segment_3\" FROM train",
)
def rename_features(spark: SparkSession, sf: str) -> DataFrame:
    odd = order_kit(spark, sf).train.select(
        "id", F.col("balance").alias("balance [USD]"), F.col("priority").alias("order/priority"), "segment"
    )
    return K.rename_features(odd, ["id", "balance [USD]", "order/priority", "segment"], "id")


@query(
    "read_drop_priors",
    """SELECT f AS feature, p AS prior FROM (
         SELECT '_quantity_1' AS f, round(avg(l_quantity) / 100, 6) AS p FROM lineitem WHERE l_linenumber = 2
         UNION ALL SELECT '_price__USD__2', round(avg(l_extendedprice) / 1000000, 6) FROM lineitem WHERE l_linenumber = 2
         UNION ALL SELECT '_discount_3', round(avg(l_discount), 6) FROM lineitem WHERE l_linenumber = 2)""",
)
def read_drop_priors(spark: SparkSession, sf: str) -> DataFrame:
    """Measurements per line number; the first is the baseline."""
    li = table(spark, sf, "lineitem")
    wide = li.groupBy(F.col("l_linenumber").alias("step")).agg(
        F.round(F.avg("l_quantity") / 100, 6).alias("quantity"),
        F.round(F.avg("l_extendedprice") / 1_000_000, 6).alias("price [USD]"),
        F.round(F.avg("l_discount"), 6).alias("discount"),
    )
    path = work_dir(spark, "priors")
    wide.write.option("header", True).csv(path)
    return K.read_drop_priors(spark, path, ["id", "quantity", "price [USD]", "discount"], "id", "step")


@query(
    "read_arms",
    "SELECT CAST(p_partkey AS INTEGER) AS arm, p_size AS size_i, CAST(p_size * 10 AS INTEGER) AS contributivity FROM part WHERE p_size > 10",
)
def read_arms(spark: SparkSession, sf: str) -> DataFrame:
    arms = table(spark, sf, "part").select(
        F.col("p_partkey").alias("arm"),
        F.col("p_size").alias("size_i"),
        F.when(F.col("p_size") > 10, F.col("p_size") * 10).alias("contributivity"),
    )
    path = work_dir(spark, "arms")
    arms.write.option("header", True).csv(path)
    return K.read_arms(spark, path)


def _written(spark: SparkSession, df: DataFrame, schema: str) -> DataFrame:
    path = work_dir(spark, "predictions")
    O.write_predictions(df, path)
    return spark.read.option("header", True).schema(schema).csv(path)


@query("write_predictions", f"{Q} SELECT id, round(balance * 3 + 17, 4) AS price FROM test")
def write_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Regression rule; rows without a prediction stay, with a null."""
    test = order_kit(spark, sf).test
    preds = test.where("balance IS NOT NULL").select("id", F.round(F.col("balance") * 3 + 17, 4).alias("p"))
    return _written(spark, O.regression_output(test.select("id"), preds, "id", "price"), "id long, price double")


def _class_probs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, list[str]]:
    rows = items(spark, sf)
    probs = F.array(
        F.struct(F.lit("A").alias("class"), (F.col("q") / 100).alias("p")),
        F.struct(F.lit("N").alias("class"), (F.lit(0.3)).alias("p")),
        F.struct(F.lit("R").alias("class"), (F.lit(0.7) - F.col("q") / 100).alias("p")),
    )
    long = rows.select(F.col("row_id").alias("id"), F.explode(probs).alias("e")).select("id", "e.*")
    return rows.select(F.col("row_id").alias("id")), long, ["A", "N", "R"]


CLASS_SQL = "WITH items AS (SELECT l_orderkey * 10 + l_linenumber AS id, max(l_quantity) AS q FROM lineitem GROUP BY 1)"


@query(
    "write_predictions_classes",
    f"{CLASS_SQL} SELECT id, q / 100 AS \"flag_A\", 0.3::DOUBLE AS \"flag_N\", 0.7::DOUBLE - q / 100 AS \"flag_R\" FROM items",
)
def write_predictions_classes(spark: SparkSession, sf: str) -> DataFrame:
    ids, long, classes = _class_probs(spark, sf)
    out = O.class_output(ids, long, "id", "flag", classes, "nll")
    return _written(spark, out, "id long, flag_A double, flag_N double, flag_R double")


@query("write_predictions_positive", f"{CLASS_SQL} SELECT id, 0.7::DOUBLE - q / 100 AS flag FROM items")
def write_predictions_positive(spark: SparkSession, sf: str) -> DataFrame:
    ids, long, classes = _class_probs(spark, sf)
    out = O.class_output(ids, long, "id", "flag", classes, "auc", positive="R")
    return _written(spark, out, "id long, flag double")


@query(
    "write_predictions_label",
    f"""{CLASS_SQL} SELECT id, CASE WHEN q / 100 >= 0.3::DOUBLE AND q / 100 >= 0.7::DOUBLE - q / 100 THEN 'A'
        WHEN 0.3::DOUBLE >= 0.7::DOUBLE - q / 100 THEN 'N' ELSE 'R' END AS flag FROM items""",
)
def write_predictions_label(spark: SparkSession, sf: str) -> DataFrame:
    ids, long, classes = _class_probs(spark, sf)
    out = O.class_output(ids, long, "id", "flag", classes, "accuracy")
    return _written(spark, out, "id long, flag string")


@query(
    "write_trials",
    f"WITH {TRIALS_SQL} SELECT submission, fold, valid, train, seconds, split_part(submission, '_', 1) AS base FROM trials",
)
def write_trials(spark: SparkSession, sf: str) -> DataFrame:
    out = trials(spark, sf).select(
        "submission", "fold", "valid", "train", "seconds", F.split("submission", "_")[0].alias("base")
    )
    path = work_dir(spark, "trials")
    O.write_trials(out, path)
    return spark.read.schema(out.schema).parquet(path)


@query(
    "append_run",
    """SELECT 'u' || user_id AS kit, event_type AS version, count(*) AS number, 'h' AS host,
              CASE WHEN event_type = 'error' THEN 0 ELSE max(event_id) END AS contributivity,
              CASE WHEN event_type = 'error' THEN 0 ELSE min(event_id) END AS rounds,
              CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS flag
       FROM events GROUP BY user_id, event_type""",
)
def append_run(spark: SparkSession, sf: str) -> DataFrame:
    """Error runs come without contributivity and rounds, the others without the flag."""
    per = (
        table(spark, sf, "events")
        .groupBy(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("kit"), F.col("event_type").alias("version"))
        .agg(F.count(F.lit(1)).alias("number"), F.max("event_id").alias("contributivity"), F.min("event_id").alias("rounds"))
        .withColumn("host", F.lit("h"))
    )
    run = per.where("version = 'error'").drop("contributivity", "rounds").withColumn("flag", F.lit(1))
    return O.append_run(per.where("version <> 'error'"), run)


# --- profiling -----------------------------------------------------------------

COLS = ["balance", "priority", "segment", "nationkey", "place"]


@query(
    "missing_counts",
    f"""{Q} SELECT 'balance' AS feature, count(*) - count(balance) AS missing FROM kit
        UNION ALL SELECT 'priority', count(*) - count(priority) FROM kit
        UNION ALL SELECT 'segment', count(*) - count(segment) FROM kit
        UNION ALL SELECT 'gap', count(*) - count(balance) FROM train""",
)
def missing_counts(spark: SparkSession, sf: str) -> DataFrame:
    kit = order_kit(spark, sf)
    train = kit.train.withColumn("gap", F.col("balance"))
    return P.missing_counts(train, kit.test, ["balance", "priority", "segment", "gap"])


@query(
    "unique_counts",
    f"{Q} " + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS n_unique FROM train"
        for c in COLS
    ),
)
def unique_counts(spark: SparkSession, sf: str) -> DataFrame:
    return P.unique_counts(order_kit(spark, sf).train, COLS)


@query(
    "feature_values",
    f"{Q} " + " UNION ".join(
        f"SELECT '{c}' AS feature, coalesce({c}, '') AS value FROM kit" for c in ("priority", "segment", "place")
    ),
)
def feature_values(spark: SparkSession, sf: str) -> DataFrame:
    kit = order_kit(spark, sf)
    return P.feature_values(kit.train, kit.test, ["priority", "segment", "place"])


@query(
    "unseen_category_rows",
    f"""WITH {KIT_SQL},
        a AS (SELECT id, is_test, 'buyer' AS feature, CAST(c AS VARCHAR) AS v FROM (SELECT id, is_test, o_custkey AS c FROM kit JOIN orders ON id = o_orderkey)
              UNION ALL SELECT id, is_test, 'year', CAST(year(ordered) AS VARCHAR) FROM kit
              UNION ALL SELECT id, is_test, 'segment', segment FROM kit),
        tr AS (SELECT DISTINCT feature, v FROM a WHERE NOT is_test),
        te AS (SELECT DISTINCT feature, v FROM a WHERE is_test)
        SELECT a.feature,
               CAST(sum(CASE WHEN NOT is_test AND te.v IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS train_rows,
               CAST(sum(CASE WHEN is_test AND tr.v IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS test_rows
        FROM a LEFT JOIN te ON a.feature = te.feature AND a.v = te.v
               LEFT JOIN tr ON a.feature = tr.feature AND a.v = tr.v
        GROUP BY 1""",
)
def unseen_category_rows(spark: SparkSession, sf: str) -> DataFrame:
    buyers = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("string").alias("buyer"))
    rows = kit_rows(spark, sf).join(buyers, "id").withColumn("year", F.year("ordered").cast("string"))
    late = F.col("ordered") >= F.lit(SPLIT_DAY).cast("timestamp_ntz")
    return P.unseen_category_rows(rows.where(~late), rows.where(late), ["buyer", "year", "segment"])


@query("clean_categories", f"{Q} SELECT id, priority, segment FROM train")
def clean_categories(spark: SparkSession, sf: str) -> DataFrame:
    """Padding and the text nan are undone."""
    messy = order_kit(spark, sf).train.select(
        "id",
        F.coalesce(F.concat(F.lit("  "), "priority", F.lit(" ")), F.lit(" nan ")).alias("priority"),
        F.concat("segment", F.lit(" ")).alias("segment"),
    )
    return P.clean_categories(messy, ["priority", "segment"])


@query("row_counts", f"{Q} SELECT count(*) AS n_rows, CASE WHEN is_test THEN 'test' ELSE 'train' END AS split FROM kit GROUP BY 2")
def row_counts(spark: SparkSession, sf: str) -> DataFrame:
    kit = order_kit(spark, sf)
    return P.row_counts(kit.train, kit.test)


@query(
    "encode_labels",
    f"""WITH {KIT_SQL},
        first AS (SELECT segment, min(id) AS seen FROM train GROUP BY 1),
        codes AS (SELECT segment, CAST(row_number() OVER (ORDER BY seen) - 1 AS INTEGER) AS code FROM first)
        SELECT id, code AS segment FROM kit LEFT JOIN codes USING (segment)""",
)
def encode_labels(spark: SparkSession, sf: str) -> DataFrame:
    kit = order_kit(spark, sf)
    codes = P.label_codes(kit.train, "segment", "id")
    return P.encode_labels(all_rows(kit, "id", "segment"), codes, "segment")


@query(
    "class_shares",
    f"{Q} SELECT status, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM train GROUP BY status",
)
def class_shares(spark: SparkSession, sf: str) -> DataFrame:
    return P.class_shares(order_kit(spark, sf).train, "status").withColumn("share", F.round("share", 6))


@query(
    "dummy_targets",
    f"""{Q}, s AS (SELECT avg(price) AS m, stddev_samp(price) AS sd FROM train)
        SELECT id, round(m + sd * {sql_normal("'43_' || id")}, 2) AS price FROM test, s""",
)
def dummy_targets(spark: SparkSession, sf: str) -> DataFrame:
    kit = order_kit(spark, sf)
    out = P.dummy_targets(kit.train, kit.test.drop("price"), "price", "id", classification=False)
    return out.select("id", F.round("price", 2).alias("price"))


@query(
    "dummy_targets_classes",
    f"""{Q}, n AS (SELECT status, count(*) AS n FROM train GROUP BY 1),
        c AS (SELECT status, sum(n) OVER (ORDER BY status) / sum(n) OVER () AS hi, (sum(n) OVER (ORDER BY status) - n) / sum(n) OVER () AS lo FROM n),
        u AS (SELECT id, {sql_unit("'43_' || id")} AS u FROM test)
        SELECT id, status FROM u JOIN c ON u >= lo AND u < hi""",
)
def dummy_targets_classes(spark: SparkSession, sf: str) -> DataFrame:
    kit = order_kit(spark, sf)
    out = P.dummy_targets(kit.train, kit.test.drop("status"), "status", "id", classification=True)
    return out.select("id", "status")


