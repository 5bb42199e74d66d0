"""Quality rules by line-first cleaning.

Punctuation, navigation and boilerplate rules are evaluated for every line.
Lines that fail are taken out, and a document that loses too much of its text
is rejected, as is one that fails the base rules on length and repetition.

Everything is one projection of SQL functions over a row: no shuffle, no state
between rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm.common import let, table, text_or_empty, word_chars, words
from tabloom.llm.registry import query

WINDOW = 8
SYMBOLS = "#*$%&|<>"
#: phrases that mark a line of page furniture; fixed values
BOILERPLATE = (
    "accept cookies|cookie policy|privacy policy|terms of (use|service)|all rights reserved|"
    "subscribe (now|to our)|sign up for|click here|read more|javascript|lorem ipsum|"
    "skip to (main )?content|back to top|powered by|log in to"
)


@dataclass(frozen=True)
class LineRules:
    """Limits of the line rules and of the verdict on a document."""

    max_mark_share: float = 0.2  # punctuation and symbols of a line's visible characters
    min_marks: int = 4  # a line with fewer marks passes the punctuation rule
    max_bars: int = 1  # more separators than this make a line navigation
    max_boilerplate_words: int = 30  # a longer line is prose that mentions a phrase
    max_lost_share: float = 0.3  # of word characters


def repeat_words(tokens: Column, window: int = WINDOW) -> Column:
    """Words inside windows of ``window`` words that occur twice or more.

    Windows are compared by a 64-bit hash of their words' hashes.
    """
    span = F.lit(window)

    def hashes(h: Column) -> Column:
        starts = F.when(F.size(h) >= span, F.sequence(F.lit(0), F.size(h) - span))
        parts = lambda i: [F.get(h, i + F.lit(k)) for k in range(window)]
        return F.transform(
            F.coalesce(starts, F.array().cast("array<int>")), lambda i: F.xxhash64(*parts(i))
        )

    def covered(h: Column) -> Column:
        keyed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        same = lambda a, b: a["h"].eqNullSafe(b["h"])
        again = let(
            keyed,
            lambda s: F.filter(
                s, lambda e, k: same(F.get(s, k - 1), e) | same(F.get(s, k + 1), e)
            ),
        )
        starts = F.sort_array(F.transform(again, lambda e: e["i"]))
        zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        total = F.aggregate(
            starts,
            zero,
            lambda acc, i: F.struct(
                (acc["n"] + i + span - F.greatest(acc["end"], i)).alias("n"),
                (i + span).alias("end"),
            ),
        )
        return total["n"]

    hashed = F.transform(tokens, lambda w: F.xxhash64(w))
    return let(
        let(hashed, hashes),
        lambda h: F.when(F.size(h) == F.size(F.array_distinct(h)), F.lit(0)).otherwise(covered(h)),
    )


def line_fails(line: Column, rules: LineRules) -> Column:
    """True for a line that the punctuation, navigation or boilerplate rule removes."""
    visible = word_chars(line)
    marks = F.length(F.regexp_replace(line, r"[\p{L}\p{M}\p{N}\s]+", ""))
    bars = F.length(line) - F.length(F.translate(line, "|»›", ""))
    punctuation = (marks >= rules.min_marks) & (marks > visible * F.lit(rules.max_mark_share))
    phrase = F.lower(line).rlike(BOILERPLATE) & (
        F.size(words(line)) <= rules.max_boilerplate_words
    )
    return punctuation | (bars > rules.max_bars) | phrase


OUTPUTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "clean_text", "base_failed", "n_lost_chars", "kept",
)


def quality_rules(
    docs: DataFrame, text_col: str = "text", rules: LineRules = LineRules()
) -> DataFrame:
    """Add measures, ``clean_text`` and ``kept``; every row of ``docs`` comes back.

    A null text counts as empty: no words, ``base_failed``, not kept. Columns
    of ``docs`` named like an output are replaced; others pass through,
    whatever their names. Repeated rows are judged alike, and an empty table
    gives an empty table.
    """
    names = docs.columns
    docs = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col(f"`{text_col}`").alias("_text"))
    text = text_or_empty("_text")
    has_word = lambda x: x.rlike(r"[^\x20\x09-\x0D]")
    measured = (
        docs.withColumn("_words", words(text))
        .withColumn("_lines", F.split(text, "\n"))
        .withColumn("_full", F.filter("_lines", has_word))
        .withColumns(
            {
                "n_words": F.size("_words").cast("long"),
                "word_chars": word_chars(text).cast("long"),
                "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
                "n_dup_lines": (F.size("_full") - F.size(F.array_distinct("_full"))).cast("long"),
                "n_repeat_words": repeat_words(F.col("_words")).cast("long"),
                "_good": F.filter("_lines", lambda x: ~line_fails(x, rules)),
            }
        )
    )
    clean = F.when(F.size("_good") == F.size("_lines"), F.col("_text")).otherwise(
        F.array_join("_good", "\n")
    )
    judged = (
        measured.withColumn("clean_text", clean)
        .withColumn(
            "base_failed",
            (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30),
        )
        .withColumn(
            "n_lost_chars", F.col("word_chars") - word_chars(text_or_empty("clean_text")).cast("long")
        )
        .withColumn(
            "kept",
            ~F.col("base_failed")
            & (F.col("n_lost_chars") <= F.col("word_chars") * F.lit(rules.max_lost_share)),
        )
    )
    return judged.select(*[F.col("_row")[c].alias(c) for c in names if c not in OUTPUTS], *OUTPUTS)


def quality_stage(docs: DataFrame) -> DataFrame:
    """Documents that pass, with the cleaned text; same columns as ``docs``."""
    work = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), "text")
    kept = quality_rules(work).where("kept")
    doc = F.col("_doc").withField("text", F.col("clean_text"))
    if "n_chars" in docs.columns:
        changed = F.when(F.col("n_lost_chars") > 0, F.length("clean_text")).otherwise(
            F.col("_doc.n_chars")
        )
        doc = doc.withField("n_chars", changed.cast(docs.schema["n_chars"].dataType))
    return kept.select(doc.alias("_doc")).select("_doc.*")


_SQL = rf"""
WITH src AS (
  SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS text FROM documents
), tok AS (
  SELECT row_id, doc_id, text,
    [x FOR x IN string_split_regex(text, '[\x20\x09-\x0D]+') IF x <> ''] AS w,
    string_split(text, chr(10)) AS lines
  FROM src
), pos AS (
  SELECT row_id, generate_subscripts(w, 1) AS p, unnest(w) AS word FROM tok
), win AS (
  SELECT row_id, p, array_to_string([word,
    lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o,
    lead(word, 5) OVER o, lead(word, 6) OVER o, lead(word, 7) OVER o], ' ') AS g,
    lead(p, 7) OVER o AS last
  FROM pos WINDOW o AS (PARTITION BY row_id ORDER BY p)
), hits AS (
  SELECT row_id, p FROM (
    SELECT row_id, p, count(*) OVER (PARTITION BY row_id, g) AS n FROM win WHERE last IS NOT NULL
  ) WHERE n > 1
), rep AS (
  SELECT row_id, count(DISTINCT p + k) AS n FROM hits, (SELECT unnest(range(0, 8)) AS k) GROUP BY row_id
), line AS (
  SELECT row_id, unnest(lines) AS l FROM tok
), judged AS (
  SELECT row_id, l, length(regexp_replace(l, '[\x20\x09-\x0D]', '', 'g')) AS visible,
    length(regexp_replace(l, '[\p{{L}}\p{{M}}\p{{N}}\s]+', '', 'g')) AS marks,
    length(l) - length(translate(l, '|»›', '')) AS bars,
    regexp_matches(lower(l), '{BOILERPLATE}')
      AND len([x FOR x IN string_split_regex(l, '[\x20\x09-\x0D]+') IF x <> '']) <= 30 AS phrase
  FROM line
), lost AS (
  SELECT row_id, count(*) FILTER (visible > 0) - count(DISTINCT l) FILTER (visible > 0) AS dup,
    coalesce(sum(visible) FILTER ((marks >= 4 AND marks > visible * 0.2::DOUBLE) OR bars > 1 OR phrase), 0)
      AS lost
  FROM judged GROUP BY row_id
), base AS (
  SELECT t.doc_id, len(w)::BIGINT AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    length(text) - length(translate(text, '{SYMBOLS}', ''))::BIGINT AS n_symbols,
    l.dup::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, l.lost::BIGINT AS n_lost_chars
  FROM tok t JOIN lost l USING (row_id) LEFT JOIN rep r USING (row_id)
)
SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words)
    AND n_lost_chars <= word_chars * 0.3::DOUBLE AS kept
FROM base
"""


@query("op7_quality_rules", _SQL)
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents``: base measures, base verdict and the verdict of the line rules."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules(docs).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "n_lost_chars",
        "base_failed",
        "kept",
    )
