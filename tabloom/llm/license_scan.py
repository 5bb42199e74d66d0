"""License scans by canonical digest lookup.

Case, punctuation, copyright lines and equivalent spellings are normalised, and
the SHA-256 of a whole canonical text is hash-joined with the digests of known
licence texts. Every line of a document is looked up the same way, which finds
one-line notices. The known table has a fixed number of rows and is broadcast;
documents are not shuffled, only their matches and keys are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm.common import let, table, text_or_empty
from tabloom.llm.license_texts import SPELLINGS, full_texts, known_texts
from tabloom.llm.registry import query
from tabloom.session import stored

COPYRIGHT = r"^[\s#*/;-]*(copyright|\(c\)|©).*(\d{4}|\(c\)|©|<year>|\[yyyy\]).*$"
_VARIANT = r"\b(" + "|".join(SPELLINGS) + r")\b"


def canonical_line(line: Column) -> Column:
    """Lower-case words with one space between them; empty for a copyright line."""
    lower = F.lower(line)
    plain = F.trim(F.regexp_replace(lower, r"[^\p{L}\p{N}]+", " "))
    spelt = plain
    for variant, common in SPELLINGS.items():
        spelt = F.regexp_replace(spelt, rf"\b{variant}\b", common)
    same = F.when(plain.rlike(_VARIANT), spelt).otherwise(plain)
    return F.when(lower.contains("copyright") | lower.rlike(r"\(c\)|©"), F.when(
        lower.rlike(COPYRIGHT), F.lit("")).otherwise(same)).otherwise(same)


def canonical_lines(text: Column) -> Column:
    """The lines of a text that say something, each in canonical form."""
    lines = F.transform(F.split(text, "[\n\r]+"), canonical_line)
    return F.filter(lines, lambda x: x != "")


def digest(canonical: Column) -> Column:
    return F.sha2(canonical.cast("binary"), 256)


def known_digests(spark: SparkSession, texts: list[tuple[str, str]] | None = None) -> DataFrame:
    """(digest, license) of known texts; texts that agree in canonical form count once."""
    own = digest(F.array_join(canonical_lines(F.col("k.text")), " ")).alias("digest")
    rows = F.array(*[F.struct(F.lit(a).alias("license"), F.lit(b).alias("text")) for a, b in texts or known_texts()])
    known = spark.range(1).select(F.explode(rows).alias("k")).select(own, F.col("k.license").alias("license"))
    if texts is None:
        # the plan holds the digests of the long texts only
        long = spark.createDataFrame([(x,) for x in full_texts()], "k struct<license:string,text:string>")
        found = long.select(own, F.col("k.license").alias("license")).collect()
        more = F.array(*[F.struct(F.lit(r["digest"]).alias("digest"), F.lit(r["license"]).alias("license")) for r in found])
        known = known.unionByName(spark.range(1).select(F.explode(more).alias("k")).select("k.digest", "k.license"))
    return (
        known.groupBy("digest")
        .agg(F.min("license").alias("license"))
    )


def scan_licenses(docs: DataFrame, known: DataFrame, text_col: str = "text") -> DataFrame:
    """A row per row of ``docs`` (doc_id, text).

    ``text_license``: licence whose text is the whole document, else null.
    ``line_licenses``: licences named by whole lines, sorted and comma-joined,
    else null; ``n_license_lines`` counts those lines. A null or empty text
    matches nothing; its digest is that of the empty string. Rows with equal id
    and text get equal results; a null id is an id like any other.
    """
    # the known texts are a bounded table: their digests pick the lines that can match
    listed = [r["digest"] for r in known.select("digest").distinct().collect()]
    canonical = canonical_lines(text_or_empty(text_col))
    found = let(
        canonical,
        lambda lines: F.struct(
            digest(F.array_join(lines, " ")).alias("digest"),
            F.filter(F.transform(lines, digest), lambda d: d.isin(listed)).alias("_lines"),
        ),
    )
    # canonical lines are the costly part: made once, and only digests are kept
    lined = stored(
        docs.select("doc_id", F.xxhash64("doc_id", text_col).alias("_key"), found.alias("f")).select("doc_id", "_key", "f.*"),
        "lines",
    )
    hits = (
        # rows that agree in id and text have the same lines; a position counts once
        lined.select("doc_id", "_key", F.posexplode("_lines").alias("_pos", "digest"))
        .join(F.broadcast(known), "digest")
        .groupBy("doc_id", "_key", "_pos")
        .agg(F.first("license").alias("license"))
        .groupBy("doc_id", "_key")
        .agg(
            F.array_join(F.sort_array(F.collect_set("license")), ",").alias("line_licenses"),
            F.count(F.lit(1)).alias("n_license_lines"),
        )
    )
    whole = lined.drop("_lines")
    return (
        whole.join(F.broadcast(known.withColumnRenamed("license", "text_license")), "digest", "left")
        .alias("w")
        .join(
            hits.alias("h"),
            F.col("w.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("w._key") == F.col("h._key")),
            "left",
        )
        .select(
            "w.doc_id",
            F.col("w.digest").alias("text_digest"),
            "w.text_license",
            "h.line_licenses",
            F.coalesce("h.n_license_lines", F.lit(0)).alias("n_license_lines"),
        )
    )


def _sql() -> str:
    def line(x: str) -> str:
        spelt = f"trim(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
        for variant, common in SPELLINGS.items():
            spelt = f"regexp_replace({spelt}, '\\b{variant}\\b', '{common}', 'g')"
        return f"CASE WHEN regexp_matches(lower({x}), '{COPYRIGHT}') THEN '' ELSE {spelt} END"

    values = ", ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b in known_texts())
    return f"""
WITH known AS (
  SELECT sha256({line("text")}) AS digest, min(license) AS license
  FROM (VALUES {values}) AS t(license, text) GROUP BY 1
), src AS (
  SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS text FROM documents
), parts AS (
  SELECT row_id, generate_subscripts(l, 1) AS p, unnest(l) AS x
  FROM (SELECT row_id, string_split_regex(text, '[\\n\\r]+') AS l FROM src)
), lines AS (
  SELECT row_id, p, {line("x")} AS c FROM parts
), hits AS (
  SELECT row_id, string_agg(DISTINCT license, ',' ORDER BY license) AS line_licenses, count(*) AS n
  FROM lines JOIN known ON sha256(c) = digest WHERE c <> '' GROUP BY row_id
), whole AS (
  SELECT row_id, sha256(coalesce(string_agg(c, ' ' ORDER BY p) FILTER (c <> ''), '')) AS d FROM lines GROUP BY row_id
)
SELECT s.doc_id, w.d AS text_digest, k.license AS text_license, h.line_licenses,
  coalesce(h.n, 0)::BIGINT AS n_license_lines
FROM src s JOIN whole w USING (row_id) LEFT JOIN known k ON k.digest = w.d LEFT JOIN hits h USING (row_id)
"""


@query("op6_license_scan", _sql())
def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of the whole ``documents``, by whole text and by line."""
    return scan_licenses(table(spark, sf_dir, "documents"), known_digests(spark))
