"""Personal data by candidate gradient boosting.

Base rules find e-mail addresses, IP addresses, card and phone numbers. High
recall generators then propose further spans, which may overlap, in the text
that the base rules left. Boosted trees score a proposal by its format and its
context, and thresholds calibrated on held-out candidates decide.

The trees are fitted on all distinct candidates whose label the base
checks or the format decide, and on rewritten copies of them; proposals that
nothing decides are only scored. They are then compiled to one
SQL expression, so scoring is a projection over rows: texts are not shuffled
and no Python runs on the executors. All patterns run in linear time: a run of
characters is entered at its start only and repeated groups are possessive.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.functions.running import running
from tabloom.functions.spread import spread
from tabloom.llm.common import let, table, text_or_empty
from tabloom.llm.registry import query
from tabloom.session import stored

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_AT = r"(?:@|\x20?(?:\(at\)|\[at\]|\{at\})\x20?)"
_DOT = r"(?:\.|\x20?(?:\(dot\)|\[dot\]|\{dot\})\x20?)"
#: wider than the base rules; a masked character takes part in none
GENERATORS = {
    "email": rf"(?<![\p{{L}}\p{{N}}._%+-])[\p{{L}}\p{{N}}._%+-]++{_AT}[\p{{L}}\p{{N}}-]++(?:{_DOT}[\p{{L}}\p{{N}}-]++)*+",
    "ip": r"(?<![\p{L}\p{N}:.])(?:[0-9]++(?:\[\.\]|\(\.\))[0-9]++(?:(?:\[?\.\]?|\(\.\))[0-9]++){2}"
    r"|[0-9A-Fa-f]{1,4}:(?:[0-9A-Fa-f]{0,4}:){2,6}[0-9A-Fa-f]{1,4}|[0-9]++(?:\.[0-9]++){3})",
    "card": r"(?<![\p{L}\p{N}])[0-9](?:[\x20._/-]{0,2}[0-9]){11,18}+(?![0-9])",
    "phone": r"(?<![\p{L}\p{N}])[(]?[0-9](?:[\x20()./-]{0,2}[0-9]){6,14}+(?![0-9])",
}
#: words before a span that tell its kind; fixed values
CONTEXT = {
    "email": r"(?i)(mail|contact|write|reach|address)",
    "ip": r"(?i)(\bip\b|host|server|address|login|from)",
    "card": r"(?i)(card|visa|master|credit|debit|payment|paid|iban|account)",
    "phone": r"(?i)(tel|phone|call|mobile|cell|fax|ring|whatsapp|sms)",
}
MASK = "\x01"
_OCTET = r"0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_NEAR = 24

FEATURES = [
    *[f"is_{k}" for k in KINDS],
    "length",
    "digits",
    "digit_share",
    "separators",
    "luhn",
    "international",
    "brackets",
    "longest_run",
    "hint",
    "cue",
    "glued",
    "octets",
]


@dataclass(frozen=True)
class PiiSettings:
    max_training: int | None = None  # fit on so many candidates only, the least by hash
    holdout: int = 4  # every so manieth of them calibrates the thresholds
    precision: float = 0.98  # that a threshold must keep on held-out candidates
    trees: int = 10
    depth: int = 3
    seed: int = 11


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of at most a few dozen digits has a valid check digit."""
    n = F.length(digits)
    terms = F.transform(
        F.split(digits, ""),
        lambda d, i: F.when((n - i) % 2 == 0, F.get(F.array(*[F.lit(2 * k if k < 5 else 2 * k - 9) for k in range(10)]), d.cast("int"))).otherwise(d.cast("int")),
    )
    return F.aggregate(F.filter(terms, lambda t: t.isNotNull()), F.lit(0), lambda a, t: a + t) % 10 == 0


def _checks(kind: str, m: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return m.rlike(rf"^{_OCTET}(\.{_OCTET}){{3}}$")
    n = F.length(_digits(m))
    if kind == "card":
        return F.when(n.between(12, 19), luhn(_digits(m))).otherwise(F.lit(False))
    return n.between(9, 15)


def _passes(span: Column) -> Column:
    """The base check of a span's own kind."""
    checks = [F.when(span["kind"] == k, _checks(k, span["m"])) for k in KINDS]
    return F.coalesce(*checks)


def located(text: Column, kind: str, pattern: str) -> Column:
    """Matches with their code point positions and what stands around them."""
    blank = F.array().cast(
        "array<struct<kind:string,start:int,end:int,m:string,before:string,after:string>>"
    )
    zero = F.struct(F.lit(0).alias("pos"), blank.alias("found"))

    def spans(pieces: Column) -> Column:
        def add(acc: Column, x: Column) -> Column:
            start = acc["pos"] + F.length(x["p"])
            end = start + F.length(x["m"])
            span = F.struct(
                F.lit(kind).alias("kind"),
                start.alias("start"),
                end.alias("end"),
                x["m"].alias("m"),
                F.right(x["p"], F.lit(_NEAR)).alias("before"),
                F.left(x["q"], F.lit(1)).alias("after"),
            )
            return F.struct(end.alias("pos"), F.concat(acc["found"], F.array(span)).alias("found"))

        parts = F.transform(
            F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
            lambda m, i: F.struct(
                F.get(pieces, i).alias("p"), m.alias("m"), F.get(pieces, i + 1).alias("q")
            ),
        )
        return F.aggregate(parts, zero, add)["found"]

    return let(F.split(text, pattern, -1), spans)


def masked(text: Column, kind: str) -> Column:
    """``text`` with valid base matches of a kind overwritten, positions kept."""
    pieces = F.split(text, BASE[kind], -1)
    found = F.regexp_extract_all(text, F.lit(BASE[kind]), F.lit(0))
    hidden = F.transform(
        found, lambda m: F.when(_checks(kind, m), F.repeat(F.lit(MASK), F.length(m))).otherwise(m)
    )
    joined = F.zip_with(pieces, hidden, lambda p, m: F.concat(p, F.coalesce(m, F.lit(""))))
    return F.array_join(joined, "")


def with_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``_base`` (matches with ``valid``) and ``_more`` (proposals in the rest)."""
    text = text_or_empty(text_col)
    none = F.array().cast(
        "array<struct<kind:string,start:int,end:int,m:string,before:string,after:string>>"
    )
    maybe = text.rlike(r"[0-9@]|(?i)[(\[{]at[)\]}]")
    gated = docs.withColumn("_text", F.when(maybe, text).otherwise(F.lit("")))
    gated = gated.withColumns({f"_b_{k}": located(F.col("_text"), k, BASE[k]) for k in KINDS})
    every = F.concat(*[f"_b_{k}" for k in KINDS])
    gated = gated.withColumns(
        {"_base": F.filter(every, _passes), "_failed": F.filter(every, lambda s: ~_passes(s))}
    )
    for kind in KINDS:
        gated = gated.withColumn("_text", masked(F.col("_text"), kind))
    return gated.withColumn(
        "_more", F.concat(none, *[located(F.col("_text"), k, GENERATORS[k]) for k in KINDS])
    ).drop("_text", *[f"_b_{k}" for k in KINDS])


def features(s: Column) -> Column:
    """Format and context of a span, as doubles in the order of ``FEATURES``."""
    m, digits = s["m"], _digits(s["m"])
    n, length = F.length(digits), F.length(s["m"])
    flag = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    cue = reduce(
        lambda a, b: a | b, [(s["kind"] == k) & s["before"].rlike(CONTEXT[k]) for k in KINDS]
    )
    runs = F.transform(F.split(m, "[^0-9]+"), F.length)
    made = {
        **{f"is_{k}": flag(s["kind"] == k) for k in KINDS},
        "length": F.least(length, F.lit(100)).cast("double"),
        "digits": F.least(n, F.lit(40)).cast("double"),
        "digit_share": n / F.greatest(length, F.lit(1)),
        "separators": F.least(length - F.length(F.translate(m, " ().-/_", "")), F.lit(40)).cast("double"),
        "luhn": flag(n.between(12, 19) & luhn(F.substring(digits, 1, 19))),
        "international": flag(m.startswith("+") | m.startswith("00") | F.rtrim(s["before"]).endswith("+")),
        "brackets": flag(m.contains("(") & m.contains(")")),
        "longest_run": F.least(F.array_max(runs), F.lit(40)).cast("double"),
        "hint": flag(m.rlike(r"(?i)(@|[(\[{]at[)\]}]).*\p{L}.*(\.|[(\[{]dot[)\]}])\s?\p{L}{2,}$")),
        "cue": flag(cue),
        "glued": flag(s["before"].rlike(r"[\p{L}\p{N}_=/#]$") | s["after"].rlike(r"^[\p{L}_=/#]")),
        "octets": flag(F.regexp_replace(m, r"[\[\]()]", "").rlike(rf"^{_OCTET}(\.{_OCTET}){{3}}$")),
    }
    return F.array(*[made[name].cast("double") for name in FEATURES])


def _rewritten(span: Column) -> Column:
    """(span, label) pairs: other ways to write a valid span, and near misses."""
    m, kind = span["m"], span["kind"]
    tail = F.right(m, F.lit(1))
    wrong = F.concat(F.substring(m, F.lit(1), F.length(m) - 1), ((tail.cast("int") + 1) % 10).cast("string"))
    pairs = {
        ("email", 1): [
            F.regexp_replace(m, "@", " (at) "),
            F.regexp_replace(F.regexp_replace(m, "@", "[at]"), r"\.(?=[^.]+$)", "[dot]"),
        ],
        ("email", 0): [F.regexp_replace(m, r"@.*$", "@"), F.regexp_replace(m, r"\..*$", "")],
        ("ip", 1): [F.regexp_replace(m, r"\.", "[.]")],
        ("ip", 0): [F.concat(m, F.lit("999")), F.regexp_replace(m, r"\.", ":")],
        ("card", 1): [F.regexp_replace(m, r"([0-9]{4})(?=[0-9])", "$1."), F.regexp_replace(m, r"([0-9]{4})(?=[0-9])", "$1/")],
        ("card", 0): [wrong, F.regexp_replace(wrong, r"([0-9]{4})(?=[0-9])", "$1.")],
        ("phone", 1): [F.regexp_replace(m, r"^\+", "00"), F.regexp_replace(m, r"^\+[0-9]+\s*", "")],
        ("phone", 0): [_digits(m), F.substring(_digits(m), 1, 7)],
    }
    made = [
        F.when(kind == k, F.struct(span.withField("m", x).alias("s"), F.lit(float(label)).alias("label")))
        for (k, label), xs in pairs.items()
        for x in xs
    ]
    return F.filter(F.array(*made), lambda p: p.isNotNull())


@dataclass(frozen=True)
class PiiModel:
    """Trees as nested tuples with their weights, and a threshold on the margin per kind."""

    trees: list[tuple[float, object]]
    thresholds: dict[str, float]


def _node(java) -> object:
    if java.subtreeDepth() == 0:
        return float(java.prediction())
    split = java.split()
    return (split.featureIndex(), float(split.threshold()), _node(java.leftChild()), _node(java.rightChild()))


def _branch(node: object, f: Column) -> Column:
    if isinstance(node, float):
        return F.lit(node)
    index, threshold, left, right = node
    return F.when(F.get(f, F.lit(index)) <= threshold, _branch(left, f)).otherwise(_branch(right, f))


def margin(model: PiiModel, f: Column) -> Column:
    """Weighted sum of the trees as one expression."""
    return reduce(lambda a, b: a + b, [F.lit(w) * _branch(t, f) for w, t in model.trees], F.lit(0.0))


def _disproved(s: Column) -> Column:
    """Whether the format of a proposal alone shows that it is none of its kind."""
    m, n = s["m"], F.length(_digits(s["m"]))
    plain = F.regexp_replace(m, r"[\[\]()]", "")
    # IPv6 has eight groups, or one gap in place of some
    six = (F.size(F.split(m, ":")) == 8) & ~m.contains("::") | (F.size(F.split(m, "::")) == 2)
    wrong = {
        "email": ~m.rlike(rf"{_DOT}[\p{{L}}\p{{N}}-]*\p{{L}}[\p{{L}}\p{{N}}-]*$"),
        "ip": F.when(m.contains(":"), ~six).otherwise(~plain.rlike(rf"^{_OCTET}(\.{_OCTET}){{3}}$")),
        "card": ~(n.between(12, 19) & luhn(F.substring(_digits(m), 1, 19))),
        # longer than any number, or a date
        "phone": (n > 15) | m.rlike(r"^(19|20)[0-9]{2}[./-](0[1-9]|1[0-2])[./-](0[1-9]|[12][0-9]|3[01])$"),
    }
    return F.coalesce(*[F.when(s["kind"] == k, x) for k, x in wrong.items()])


def _proposable(s: Column) -> Column:
    """Whether a generator would propose the span: valid base matches are hidden from it."""
    checks = [
        F.when(
            s["kind"] == k,
            s["m"].rlike(f"^(?:{GENERATORS[k]})$") & ~(s["m"].rlike(f"^(?:{BASE[k]})$") & _checks(k, s["m"])),
        )
        for k in KINDS
    ]
    return F.coalesce(*checks)


def fit_pii(spanned: DataFrame, settings: PiiSettings = PiiSettings()) -> PiiModel:
    """Fit on the distinct candidates of all rows of ``with_spans``.

    Of the proposals only those are taught as wrong whose format disproves them:
    the others are not verified and may be what the model is to find. Thresholds
    are calibrated on spans that a generator can propose. Without both labels
    there is nothing to learn: the model then adds no span. Only the trees and a
    threshold per kind reach the driver.
    """
    label = lambda col, y: F.transform(
        col, lambda s: F.struct(s.alias("s"), F.lit(float(y)).alias("label"))
    )
    wrong = F.filter("_more", _disproved)
    seen = spanned.select(
        F.explode(F.concat(label("_base", 1), label("_failed", 0), label(wrong, 0))).alias("c")
    )
    order = F.xxhash64(F.lit(settings.seed), "c.s.kind", "c.s.m", "c.s.before")
    # a candidate counts once, however often it stands in the corpus
    taught = seen.groupBy(order.alias("_h"), F.col("c.label").alias("_l")).agg(F.min("c").alias("c")).drop("_l")
    if settings.max_training is not None:
        taught = taught.orderBy("_h", "c").limit(settings.max_training)
    pairs = F.when(F.col("c.label") == 1, F.concat(F.array("c"), _rewritten(F.col("c.s")))).otherwise(F.array("c"))
    rows = stored(
        taught.select("_h", F.explode(pairs).alias("c")).select(
            F.col("c.s.kind").alias("kind"),
            features(F.col("c.s")).alias("f"),
            F.col("c.label").alias("label"),
            (F.pmod("_h", F.lit(settings.holdout)) == 0).alias("held"),
            _proposable(F.col("c.s")).alias("proposable"),
        ),
        "pii_candidates",
    )
    labels = rows.where("not held").groupBy("label").count().collect()  # two rows at most
    if len(labels) < 2:
        return PiiModel([], {})
    # trees read their rows again for every level
    part = spread(rows.where("not held"), sum(r["count"] for r in labels))
    train = part.select(array_to_vector("f").alias("features"), "label")
    fitted = GBTClassifier(
        maxIter=settings.trees, maxDepth=settings.depth, seed=settings.seed, minInstancesPerNode=5
    ).fit(train)
    trees = [(float(w), _node(t._call_java("rootNode"))) for w, t in zip(fitted.treeWeights, fitted.trees)]
    model = PiiModel(trees, {})
    # the lowest margin from which a kind keeps its precision: a row per margin, not per candidate
    held = rows.where("held and proposable").withColumn("x", margin(model, F.col("f")))
    margins = stored(held.groupBy("kind", "x").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("s")), "pii_margins")
    upto = running(margins, ["kind"], [F.desc("x")], {"_n": ("sum", "n"), "_s": ("sum", "s")})
    good = (
        upto.where((F.col("_s") / F.col("_n") >= settings.precision) & (F.col("x") > 0))
        .groupBy("kind")
        .agg(F.min("x").alias("t"))
    )
    return PiiModel(trees, {r["kind"]: r["t"] for r in good.collect()})


def add_spans(spanned: DataFrame, model: PiiModel) -> DataFrame:
    """Add ``spans``: base spans and accepted proposals, by start, then kind as listed."""
    kinds = F.array(*[F.lit(k) for k in KINDS])

    def slim(col: Column) -> Column:
        return F.transform(
            col,
            lambda s: F.struct(s["start"].alias("start"), F.array_position(kinds, s["kind"]).alias("k"), s["end"].alias("end")),
        )

    accepted = F.array().cast("array<struct<start:int,k:bigint,end:int>>")
    if model.thresholds:
        # the features of a span are built once and read by all trees
        limit = lambda s: F.coalesce(*[F.when(s["kind"] == k, F.lit(t)) for k, t in model.thresholds.items()])
        accepted = slim(
            F.filter("_more", lambda s: let(features(s), lambda f: margin(model, f)) >= limit(s))
        )
    return spanned.withColumn("_base_spans", F.sort_array(slim(F.col("_base")))).withColumn(
        "spans", F.sort_array(F.concat("_base_spans", accepted))
    )


def _written(col: str) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(
            col,
            lambda s: F.concat_ws(":", F.element_at(kinds, s["k"].cast("int")), s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def find_pii(docs: DataFrame, settings: PiiSettings = PiiSettings()) -> DataFrame:
    """Add counts of base spans, ``base_sha256`` and ``spans`` (structs) to ``docs``.

    A null text counts as empty and has no spans. Columns of ``docs`` named like
    an output are replaced, others pass through, whatever their names. Repeated
    rows are judged alike; an empty table gives an empty table and no model.
    """
    names = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), "text")
    spanned = with_spans(packed)
    model = fit_pii(spanned, settings)
    kinds = F.transform("_base", lambda s: s["kind"])
    counts = {
        f"n_{k}": (F.size("_base") - F.size(F.array_remove(kinds, k))).cast("long") for k in KINDS
    }
    found = (
        add_spans(spanned, model)
        .withColumns(counts)
        .withColumn("base_sha256", F.sha2(_written("_base_spans").cast("binary"), 256))
    )
    outputs = [*counts, "base_sha256", "spans"]
    return found.select(*[F.col("_row")[c].alias(c) for c in names if c not in outputs], *outputs)


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Replace the spans of ``find_pii`` in the text; overlapping spans become one mark."""
    merged = F.aggregate(
        "spans",
        F.array().cast("array<struct<start:int,k:bigint,end:int>>"),
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (s["start"] < F.get(acc, F.size(acc) - 1)["end"]),
            F.concat(
                F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))),
                F.array(
                    F.get(acc, F.size(acc) - 1).withField(
                        "end", F.greatest(F.get(acc, F.size(acc) - 1)["end"], s["end"])
                    )
                ),
            ),
        ).otherwise(F.concat(acc, F.array(s))),
    )
    marks = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("done"), F.col(text_col).alias("rest"))

    def cut(acc: Column, s: Column) -> Column:
        return F.struct(
            s["end"].alias("at"),
            F.concat(
                acc["done"],
                F.substring(acc["rest"], F.lit(1), s["start"] - acc["at"]),
                F.element_at(marks, s["k"].cast("int")),
            ).alias("done"),
            F.substring(acc["rest"], s["end"] - acc["at"] + 1, F.length(acc["rest"])).alias("rest"),
        )

    clean = F.aggregate(merged, zero, cut, lambda acc: F.concat(acc["done"], acc["rest"]))
    return docs.withColumn(text_col, F.when(F.size("spans") > 0, clean).otherwise(F.col(text_col)))


def pii_stage(docs: DataFrame, settings: PiiSettings = PiiSettings()) -> DataFrame:
    """All documents with their personal data redacted; same columns as ``docs``."""
    work = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), "text")
    clean = redact(find_pii(work, settings))
    doc = F.col("_doc").withField("text", F.col("text"))
    if "n_chars" in docs.columns:
        chars = F.when(F.size("spans") > 0, F.length("text")).otherwise(F.col("_doc.n_chars"))
        doc = doc.withField("n_chars", chars.cast(docs.schema["n_chars"].dataType))
    return clean.select(doc.alias("_doc")).select("_doc.*")


@query("op10_pii")
def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and digest, and all spans, of the whole ``documents``."""
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", _written("spans").alias("spans")
    )
