"""Column selection, statistic imputation and encoders."""

from __future__ import annotations

from hashlib import md5


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.catalog.registry import query
from tabloom.catalog.views import KIT_SQL, all_rows, kit_rows, order_kit, sql_mod, table
from tabloom.meta import Kit, features_of, with_roles
from tabloom.operators import columns as C
from tabloom.operators import encode as E
from tabloom.operators import impute as I
from tabloom.operators.stages import ClipToRange
from tabloom.plans import prepare as R

Q = "WITH " + KIT_SQL
NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _r(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


# --- selection -------------------------------------------------------------------


@query("drop_id", f"{Q} SELECT price, status, balance, nationkey, priority, segment, place, ordered FROM train")
def drop_id(spark: SparkSession, sf: str) -> DataFrame:
    return C.drop_id(order_kit(spark, sf).train, "id")


@query("drop_columns", f"{Q} SELECT id, price, status, balance, nationkey, segment, place FROM train")
def drop_columns(spark: SparkSession, sf: str) -> DataFrame:
    return C.drop_columns(order_kit(spark, sf).train, {"priority": True, "ordered": True, "balance": False})


@query("col_in_train_only", f"{Q} SELECT id, price, status, nationkey, segment, place, ordered, is_test FROM kit")
def col_in_train_only(spark: SparkSession, sf: str) -> DataFrame:
    kit = order_kit(spark, sf)
    train, test = C.col_in_train_only(kit.train.drop("balance"), kit.test.drop("priority"), ["id", "price"])
    return train.withColumn("is_test", F.lit(False)).unionByName(test.withColumn("is_test", F.lit(True)))


@query("rm_constant_col", f"{Q} SELECT id, nationkey, CAST(year(ordered) AS INTEGER) AS year FROM kit")
def rm_constant_col(spark: SparkSession, sf: str) -> DataFrame:
    """Orders carry no time of day, so hour and minute are constant."""
    add = lambda df: df.select(
        "id", "nationkey", F.year("ordered").alias("year"),
        F.hour(F.col("ordered").cast("timestamp")).alias("hour"),
        F.minute(F.col("ordered").cast("timestamp")).alias("minute"),
    )
    kit = order_kit(spark, sf)
    train, test = C.rm_constant_col(add(kit.train), add(kit.test), ["nationkey", "year", "hour", "minute"])
    return train.unionByName(test)


@query("invalid_col_names", f"{Q} SELECT id, balance AS \"balanceUSD\", segment AS \"marketsegment\" FROM train")
def invalid_col_names(spark: SparkSession, sf: str) -> DataFrame:
    odd = order_kit(spark, sf).train.select(
        "id", F.col("balance").alias("balance [USD]"), F.col("segment").alias("market-segment")
    )
    return C.invalid_col_names(odd)


@query(
    "variance_threshold",
    "SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, round(var_pop({c}), 6) AS variance FROM lineitem" for c in ("l_quantity", "l_discount", "l_tax")
    ) + ") WHERE variance > 0.0008",
)
def variance_threshold(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select("l_quantity", "l_discount", "l_tax")
    kept = C.variance_threshold(li, li.columns, 0.0008)
    return _r(C.variances(li.select(*kept), kept), "variance")


def _anova_sql(c: str) -> str:
    return f"""SELECT '{c}' AS feature, ((b - s * s / n) / (k - 1)) / ((ss - b) / (n - k)) AS score FROM (
        SELECT sum(n) AS n, count(*) AS k, sum(s) AS s, sum(ss) AS ss, sum(s * s / n) AS b FROM (
          SELECT l_returnflag, count(*) AS n, sum({c}) AS s, sum({c} * {c}) AS ss FROM lineitem GROUP BY 1))"""


@query(
    "select_kbest",
    "SELECT feature, round(score, 4) AS score FROM (" + " UNION ALL ".join(_anova_sql(c) for c in NUM) + ") ORDER BY score DESC, feature LIMIT 3",
)
def select_kbest(spark: SparkSession, sf: str) -> DataFrame:
    """ANOVA F of the return flag, the default score."""
    return _r(C.select_kbest(table(spark, sf, "lineitem"), NUM, "l_returnflag", True, 2, -1), "score", digits=4)


def _chi2_sql(c: str) -> str:
    return f"""SELECT '{c}' AS feature, sum((s - st * n / nt) * (s - st * n / nt) / (st * n / nt)) AS score FROM (
        SELECT l_returnflag, count(*) AS n, sum({c}) AS s, sum(count(*)) OVER () AS nt, sum(sum({c})) OVER () AS st
        FROM lineitem GROUP BY 1)"""


@query(
    "select_kbest_chi2",
    "SELECT feature, round(score, 4) AS score FROM (" + " UNION ALL ".join(_chi2_sql(c) for c in NUM) + ") ORDER BY score DESC, feature LIMIT 2",
)
def select_kbest_chi2(spark: SparkSession, sf: str) -> DataFrame:
    return _r(C.select_kbest(table(spark, sf, "lineitem"), NUM, "l_returnflag", True, 1, -2), "score", digits=4)


def _mi_sql(c: str) -> str:
    return f"""SELECT '{c}' AS feature, sum(n / nt * ln(n * nt / (nb * ny))) AS score FROM (
      SELECT CAST(n AS DOUBLE) AS n, CAST(sum(n) OVER () AS DOUBLE) AS nt, CAST(sum(n) OVER (PARTITION BY b) AS DOUBLE) AS nb,
             CAST(sum(n) OVER (PARTITION BY y) AS DOUBLE) AS ny FROM (
        SELECT l_returnflag AS y, least(floor(({c} - lo) * 20.0::DOUBLE / (hi - lo)), 19) AS b, count(*) AS n
        FROM lineitem, (SELECT min({c}) AS lo, max({c}) AS hi FROM lineitem) GROUP BY 1, 2))"""


@query(
    "select_kbest_mutual_information",
    "SELECT feature, round(score, 6) AS score FROM (" + " UNION ALL ".join(_mi_sql(c) for c in NUM) + ") ORDER BY score DESC, feature LIMIT 3",
)
def select_kbest_mi(spark: SparkSession, sf: str) -> DataFrame:
    return _r(C.select_kbest(table(spark, sf, "lineitem"), NUM, "l_returnflag", True, 3, -1), "score")


REG = ["l_quantity", "l_discount", "l_tax"]
CORR_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, corr({c}, l_extendedprice) AS r, count(*) AS n FROM lineitem" for c in REG
)


@query(
    "select_kbest_pearson",
    f"SELECT feature, round(r, 6) + 0 AS score FROM ({CORR_SQL}) ORDER BY r DESC, feature LIMIT 2",
)
def select_kbest_pearson(spark: SparkSession, sf: str) -> DataFrame:
    return _r(C.select_kbest(table(spark, sf, "lineitem"), REG, "l_extendedprice", False, 1, -1), "score")


@query(
    "select_kbest_f_regression",
    f"SELECT feature, round(r * r * (n - 2) / (1 - r * r), 3) AS score FROM ({CORR_SQL}) ORDER BY score DESC, feature LIMIT 2",
)
def select_kbest_f(spark: SparkSession, sf: str) -> DataFrame:
    return _r(C.select_kbest(table(spark, sf, "lineitem"), REG, "l_extendedprice", False, 2, -1), "score", digits=3)


# --- imputation --------------------------------------------------------------------


@query("impute_median", f"{Q} SELECT id, coalesce(balance, (SELECT median(balance) FROM kit)) AS balance FROM kit")
def impute_median(spark: SparkSession, sf: str) -> DataFrame:
    return all_rows(I.impute_median(order_kit(spark, sf), ["balance"]), "id", "balance")


@query(
    "impute_mode",
    f"""{Q}, m AS (SELECT priority FROM kit WHERE priority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, priority LIMIT 1)
        SELECT id, coalesce(priority, (SELECT priority FROM m)) AS priority FROM kit""",
)
def impute_mode(spark: SparkSession, sf: str) -> DataFrame:
    return all_rows(I.impute_mode(order_kit(spark, sf), ["priority"]), "id", "priority")


# --- category encoders ---------------------------------------------------------------

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"]


@query(
    "encode_onehot",
    f"{Q} SELECT id, CAST(priority IS NULL AS INTEGER) AS priority_nan, " + ", ".join(
        f"CAST(coalesce(priority = '{v}', false) AS INTEGER) AS \"priority_{v.replace('-', '_')}\"" for v in PRIORITIES
    ) + " FROM kit",
)
def encode_onehot(spark: SparkSession, sf: str) -> DataFrame:
    kit = order_kit(spark, sf)
    cut = kit.replace(kit.train.select("id", "priority"), kit.test.select("id", "priority"))
    return E.encode_onehot(cut, "priority").both()


@query(
    "encode_onehot_two_values",
    f"{Q} SELECT id, CAST(CASE WHEN ordered >= TIMESTAMP '1998-01-01' THEN 1 ELSE 0 END AS INTEGER) AS era_new FROM kit",
)
def encode_onehot_two(spark: SparkSession, sf: str) -> DataFrame:
    era = F.when(F.col("ordered") >= F.lit("1998-01-01").cast("timestamp_ntz"), "new").otherwise("a-old").alias("era")
    kit = order_kit(spark, sf)
    return E.encode_onehot(kit.replace(kit.train.select("id", era), kit.test.select("id", era)), "era").both()


@query(
    "encode_count",
    f"{Q}, n AS (SELECT priority, count(*) AS n FROM kit GROUP BY 1) SELECT id, n AS priority FROM kit JOIN n ON kit.priority IS NOT DISTINCT FROM n.priority",
)
def encode_count(spark: SparkSession, sf: str) -> DataFrame:
    return all_rows(E.encode_count(order_kit(spark, sf), "priority"), "id", "priority")


def _target_sql(col: str) -> str:
    return f"""pr AS (SELECT avg(price) AS prior FROM train),
      st AS (SELECT {col}, avg(price) AS mean, count(*) AS n FROM train WHERE {col} IS NOT NULL GROUP BY 1),
      w AS (SELECT {col}, mean, 1 / (1 + exp(-(n - 1) / 10.0::DOUBLE)) AS w FROM st),
      code AS (SELECT {col}, prior * (1 - w) + mean * w AS code FROM w, pr)"""


@query(
    "encode_target",
    f"{Q}, {_target_sql('priority')} SELECT id, round(coalesce(code, prior), 4) AS priority FROM kit LEFT JOIN code USING (priority), pr",
)
def encode_target(spark: SparkSession, sf: str) -> DataFrame:
    out = E.encode_target(order_kit(spark, sf), "priority", F.col("price"))
    return _r(all_rows(out, "id", "priority"), "priority", digits=4)


@query(
    "add_target_encoding",
    f"""{Q}, {_target_sql('place')}, {_target_sql('segment').replace('pr AS', 'pr2 AS').replace('st AS', 'st2 AS').replace('w AS (', 'w2 AS (', 1).replace('code AS (', 'code2 AS (').replace('FROM st)', 'FROM st2)').replace('FROM w, pr)', 'FROM w2, pr2)')}
        SELECT id, place, segment, round(code.code, 4) AS place_target_encode, round(code2.code, 4) AS segment_target_encode
        FROM kit LEFT JOIN code USING (place) LEFT JOIN code2 USING (segment)""",
)
def add_target_encoding(spark: SparkSession, sf: str) -> DataFrame:
    out = E.add_target_encoding(order_kit(spark, sf), ["place", "segment"], F.col("price"))
    return _r(
        all_rows(out, "id", "place", "segment", "place_target_encode", "segment_target_encode"),
        "place_target_encode", "segment_target_encode", digits=4,
    )


@query(
    "encode_target_out_of_fold",
    f"""{Q}, t AS (SELECT id, priority, price, {sql_mod(10, "id || '_0'")} AS fold FROM train),
        g AS (SELECT priority, fold, sum(price) AS s, count(*) AS n FROM t WHERE priority IS NOT NULL GROUP BY 1, 2),
        f AS (SELECT fold, sum(price) AS s, count(*) AS n FROM t GROUP BY 1),
        c AS (SELECT priority, sum(s) AS s, sum(n) AS n FROM g GROUP BY 1),
        a AS (SELECT sum(price) AS s, count(*) AS n FROM t),
        x AS (SELECT t.id, t.priority, fold, (a.s - f.s) / (a.n - f.n) AS prior, (c.s - g.s) / (c.n - g.n) AS mean,
                     1 / (1 + exp(-((c.n - g.n) - 1) / 10.0::DOUBLE)) AS w
              FROM t JOIN f USING (fold) LEFT JOIN g USING (priority, fold) LEFT JOIN c USING (priority), a)
        SELECT id, priority, fold, round(coalesce(prior * (1 - w) + mean * w, prior), 4) AS priority_target_encode FROM x""",
)
def encode_target_out_of_fold(spark: SparkSession, sf: str) -> DataFrame:
    """On a column with gaps, which get the prior of the other folds."""
    from tabloom.operators.folds import fold_of

    t = order_kit(spark, sf).train.select("id", "priority", "price", fold_of(F.col("id"), 0).alias("fold"))
    out = E.encode_target_out_of_fold(t, "priority", "price", "fold").drop("price")
    return _r(out, "priority_target_encode", digits=4)


@query(
    "encode_binary",
    f"""{Q}, v AS (SELECT segment, row_number() OVER (ORDER BY segment) AS code FROM (SELECT DISTINCT segment FROM kit))
        SELECT id, CAST((code >> 2) & 1 AS INTEGER) AS segment_0, CAST((code >> 1) & 1 AS INTEGER) AS segment_1,
               CAST(code & 1 AS INTEGER) AS segment_2 FROM kit JOIN v USING (segment)""",
)
def encode_binary(spark: SparkSession, sf: str) -> DataFrame:
    out = E.encode_binary(order_kit(spark, sf), "segment")
    return all_rows(out, "id", "segment_0", "segment_1", "segment_2")


@query(
    "encode_hashing",
    "SELECT doc_id, " + ", ".join(
        f"CAST({sql_mod(20, 'source')} = {i} AS INTEGER) AS source_col_{i}" for i in range(20)
    ) + " FROM documents",
)
def encode_hashing(spark: SparkSession, sf: str) -> DataFrame:
    """All 20 columns, as the column set must not depend on the data here."""
    docs = with_roles(table(spark, sf, "documents").select("doc_id", "source"), {"source": "cat"})
    kit = Kit(docs, docs.limit(0), None)
    return E.encode_hashing(kit, "source", drop_constant=False).train


@query(
    "encode_text_minhash",
)
def encode_text_minhash(spark: SparkSession, sf: str) -> DataFrame:
    """Whole texts; checked against brute force in the tests."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    kit = Kit(docs, docs.limit(0), None)
    return E.encode_text_minhash(kit, "text").train


# --- dates -------------------------------------------------------------------------

SQL_PARTS = {
    "month": "month({c})",
    "weekofyear": "week({c})",
    "dayofyear": "dayofyear({c})",
    "dayofmonth": "day({c})",
    "dayofweek": "(isodow({c}) - 1)",
    "hour": "hour({c})",
    "minute": "minute({c})",
    "second": "second({c})",
    "microsecond": "(epoch_us({c}) % 1000000)",
    "nanosecond": "0",
}


def _part(p: str) -> str:
    return SQL_PARTS[p].format(c="ts")


def _waves(parts: list[str]) -> str:
    return ", ".join(
        f"round({fn}({_part(p)} / {E.PERIODS[p]!r}::DOUBLE * 2 * pi()), 9) + 0 AS ts_{p}_{fn}" for p in parts for fn in ("cos", "sin")
    )


def _events_kit(spark: SparkSession, sf: str) -> Kit:
    ev = table(spark, sf, "events").select("event_id", "ts")
    return Kit(ev, ev.limit(0), None)


def _rounded_waves(df: DataFrame) -> DataFrame:
    return _r(df, *[c for c in df.columns if c.endswith(("_cos", "_sin"))], digits=9)


@query(
    "encode_date_raw",
    "SELECT event_id, CAST(year(ts) AS INTEGER) AS ts_year, " + ", ".join(f"CAST({_part(p)} AS INTEGER) AS ts_{p}" for p in SQL_PARTS) + " FROM events",
)
def encode_date_raw(spark: SparkSession, sf: str) -> DataFrame:
    return E.encode_date(_events_kit(spark, sf), "ts", "raw", drop_constant=False).train


@query(
    "encode_date_cyclical",
    f"SELECT event_id, CAST(year(ts) AS INTEGER) AS ts_year, {_waves(list(SQL_PARTS))} FROM events",
)
def encode_date_cyclical(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded_waves(E.encode_date(_events_kit(spark, sf), "ts", "cyclical", drop_constant=False).train)


@query(
    "encode_date_cyclical_ohe",
    "SELECT event_id, CAST(year(ts) AS INTEGER) AS ts_year, "
    + _waves([p for p in SQL_PARTS if p not in E.ONEHOT_PARTS]) + ", "
    + ", ".join(
        f"CAST({_part(p)} = {v} AS INTEGER) AS ts_{p}_{v}" for p, vs in E.ONEHOT_PARTS.items() for v in vs
    ) + " FROM events",
)
def encode_date_cyclical_ohe(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded_waves(E.encode_date(_events_kit(spark, sf), "ts", "cyclical-ohe", drop_constant=False).train)


@query(
    "drop_constant_date_parts",
    f"""{Q} SELECT id, CAST(year(ordered) AS INTEGER) AS ordered_year, CAST(month(ordered) AS INTEGER) AS ordered_month,
        CAST(week(ordered) AS INTEGER) AS ordered_weekofyear, CAST(dayofyear(ordered) AS INTEGER) AS ordered_dayofyear,
        CAST(day(ordered) AS INTEGER) AS ordered_dayofmonth, CAST(isodow(ordered) - 1 AS INTEGER) AS ordered_dayofweek FROM kit""",
)
def drop_constant_date_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Order dates have no time of day, so those parts go."""
    kit = order_kit(spark, sf)
    cut = kit.replace(kit.train.select("id", "ordered"), kit.test.select("id", "ordered"))
    return E.encode_date(cut, "ordered", "raw").both()


DAYS = ["01-01", "05-01", "07-04", "12-25", "12-26"]


def calendar(spark: SparkSession, sf: str) -> DataFrame:
    """Five fixed days a year per nation, for the years the orders span."""
    span = table(spark, sf, "orders").agg(F.min(F.year("o_orderdate")).alias("lo"), F.max(F.year("o_orderdate")).alias("hi")).first()
    years = F.sequence(F.lit(span["lo"] or 1970), F.lit(span["hi"] or 1970))
    days = F.array(*[F.lit(d) for d in DAYS])
    return (
        table(spark, sf, "nation")
        .select(F.col("n_name").alias("location"), F.explode(years).alias("y"))
        .select("location", "y", F.explode(days).alias("d"))
        .select("location", F.to_date(F.concat(F.col("y").cast("string"), F.lit("-"), "d")).alias("day"))
    )


@query(
    "add_holidays",
    f"""{Q} SELECT id, place, CAST(strftime(ordered, '%m-%d') IN ({', '.join(repr(d) for d in DAYS)}) AS INTEGER) AS is_holiday FROM kit""",
)
def add_holidays(spark: SparkSession, sf: str) -> DataFrame:
    rows = kit_rows(spark, sf).select("id", "place", "ordered")
    days = E.holiday_table(calendar(spark, sf), "place")
    return E.add_holidays(rows, days, "ordered", "place").drop("ordered")


# --- stages and the chain --------------------------------------------------------------


@query(
    "custom_stage",
    f"""{Q}, r AS (SELECT min(balance) AS blo, max(balance) AS bhi, min(nationkey) AS nlo, max(nationkey) AS nhi FROM train)
        SELECT id, CASE WHEN balance IS NOT NULL THEN least(greatest(balance, blo), bhi) END AS balance,
               least(greatest(nationkey, nlo), nhi) AS nationkey FROM test, r""",
)
def custom_stage(spark: SparkSession, sf: str) -> DataFrame:
    """The sample user stage, fitted on train and applied to test."""
    kit = order_kit(spark, sf)
    cols = ["id", "balance", "nationkey"]
    return ClipToRange(cols=["balance", "nationkey"]).fit(kit.train.select(*cols)).transform(kit.test.select(*cols))


# 25 nations are more than 20 values, so places are hashed; empty buckets get no column.
PLACE_BUCKETS = sorted({int(md5(f"NATION_{i}".encode()).hexdigest()[:8], 16) % 20 for i in range(25)})


@query(
    "preprocess_chain",
    f"""{Q}, m AS (SELECT median(balance) AS b FROM kit),
        p AS (SELECT priority FROM kit WHERE priority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, priority LIMIT 1),
        f AS (SELECT id, is_test, coalesce(balance, b) AS balance, nationkey, coalesce(kit.priority, p.priority) AS priority, segment, place, ordered FROM kit, m, p)
        SELECT id, is_test, balance, CAST(nationkey AS DOUBLE) AS nationkey, CAST(year(ordered) AS INTEGER) AS ordered_year, """
    + ", ".join(
        f"round({fn}({SQL_PARTS[q].format(c='ordered')} / {E.PERIODS[q]!r}::DOUBLE * 2 * pi()), 9) + 0 AS ordered_{q}_{fn}"
        for q in ("month", "weekofyear", "dayofyear", "dayofmonth", "dayofweek") for fn in ("cos", "sin")
    )
    + ", CAST(strftime(ordered, '%m-%d') IN (" + ", ".join(repr(d) for d in DAYS) + ") AS INTEGER) AS is_holiday, "
    + ", ".join(f"CAST(priority = '{v}' AS INTEGER) AS \"priority_{v.replace('-', '_')}\"" for v in PRIORITIES)
    + ", " + ", ".join(
        f"CAST(segment = '{v}' AS INTEGER) AS segment_{v}" for v in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
    ) + ", " + ", ".join(
        f"CAST({sql_mod(20, 'place')} = {i} AS INTEGER) AS place_col_{i}" for i in PLACE_BUCKETS
    ) + " FROM f",
)
def preprocess_chain(spark: SparkSession, sf: str) -> DataFrame:
    """The default chain without model imputers: one lazy plan per table."""
    kit = order_kit(spark, sf)
    kit = kit.replace(kit.train.drop("status"), kit.test.drop("status", "price"))
    out = R.preprocess_chain(kit, R.ChainSettings(calendar=calendar(spark, sf)))
    cols = ["id", *features_of(out.train)]
    both = out.train.select(*cols).withColumn("is_test", F.lit(False)).unionByName(
        out.test.select(*cols).withColumn("is_test", F.lit(True))
    )
    return _rounded_waves(both.withColumn("nationkey", F.col("nationkey").cast("double")))


