"""Token counts behind a digest cache.

The cache is a table of (content digest, tokenizer digest, token count) in the
shared folder. Contents are joined with it by digest; only distinct contents
that it lacks are encoded, and their counts are appended to it. A tokenizer is
named by the digest of its file and of the settings, so another version never
reads the counts of this one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm.common import table
from tabloom.llm.registry import query
from tabloom.session import stored, work_dir

CACHE_SCHEMA = "digest binary, tokenizer string, n_tokens long"
LIMIT = 4096
#: digests of 32 bytes that are broadcast; with more misses the texts are shuffled to them
BROADCAST_MISSES = 100_000


@dataclass(frozen=True)
class TokenizerFile:
    """A tokenizer file that the tasks can open at ``path``."""

    path: str

    @property
    def version(self) -> str:
        with open(self.path, "rb") as f:
            return hashlib.sha256(f.read() + b"|plain text, no added tokens").hexdigest()


def counter(path: str):
    """A function from a list of texts to their token counts, by the file's kind."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda texts: [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def _digests(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    """Digest and size of each text; or each content that this task meets first, with its text."""
    seen: set[bytes] = set()
    for batch in batches:
        texts = [t or "" for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
        raw = [t.encode() for t in texts]
        digests = [hashlib.sha256(r).digest() for r in raw]
        if with_text:
            new = []
            for i, d in enumerate(digests):
                if d not in seen:
                    seen.add(d)
                    new.append(i)
            columns = [pa.array([digests[i] for i in new], pa.binary()), pa.array([texts[i] for i in new], pa.string())]
            yield pa.record_batch(columns, names=["digest", "text"])
        else:
            columns = [batch.column(0), pa.array([len(r) for r in raw], pa.int64()), pa.array(digests, pa.binary())]
            yield pa.record_batch(columns, names=["doc_id", "n_bytes", "digest"])


def _encoder(path: str, chunk_bytes: int = 4 << 20):
    """Count tokens of a partition sorted by digest, one text per digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, last = None, None
        for batch in batches:
            count = count or counter(path)
            digests, texts, size = [], [], 0
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if d == last:
                    continue
                last = d
                digests.append(d)
                texts.append(t)
                size += len(t)
                if size >= chunk_bytes:
                    yield _counted(digests, count(texts))
                    digests, texts, size = [], [], 0
            if digests:
                yield _counted(digests, count(texts))

    return run


def _counted(digests: list[bytes], counts: list[int]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(digests, pa.binary()), pa.array(counts, pa.int64())], names=["digest", "n_tokens"])


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache at ``path``; empty where nothing was appended yet."""
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    there = place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
    return spark.read.schema(CACHE_SCHEMA).parquet(path) if there else spark.createDataFrame([], CACHE_SCHEMA)


def token_counts(docs: DataFrame, tokenizer: TokenizerFile, cache_path: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of ``docs``.

    A null text counts as empty. Repeated rows and copies are encoded once. The
    counts of contents new to the cache are appended to ``cache_path``; a run
    that stops before that leaves the cache as it was.
    """
    spark = docs.sparkSession
    version = tokenizer.version
    kind = dict(docs.dtypes)["doc_id"]
    marked = stored(
        docs.select("doc_id", "text").mapInArrow(
            lambda b: _digests(b, False), f"doc_id {kind}, n_bytes long, digest binary"
        ),
        "digests",
    )
    cached = read_cache(spark, cache_path).where(F.col("tokenizer") == version).select("digest", "n_tokens")
    # appends of two runs at once may both hold a digest
    cached = cached.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    # digests meet the cache first; texts are read again, and moved, for the misses only
    misses = stored(marked.select("digest").distinct().join(cached.select("digest"), "digest", "left_anti"), "misses")
    n_misses = misses.count()
    texts = docs.limit(0) if n_misses == 0 else docs
    texts = texts.select("text").mapInArrow(lambda b: _digests(b, True), "digest binary, text string")
    if n_misses <= BROADCAST_MISSES:
        missed = texts.join(F.broadcast(misses), "digest", "left_semi").repartition("digest")
    else:  # as many as the encoder's shuffle moves anyway
        missed = texts.repartition("digest").join(misses, "digest", "left_semi")
    new = stored(
        missed.sortWithinPartitions("digest")
        .mapInArrow(_encoder(tokenizer.path), "digest binary, n_tokens long"),
        "new_counts",
    )
    known = cached.unionByName(new)
    result = marked.join(known, "digest").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
    result = stored(result, "token_counts")
    new.select("digest", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache_path)
    return result


@query("op2_token_counts")
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of the whole ``documents``, through a cache of its own that starts empty."""
    import public_tokenizers

    tokenizer = TokenizerFile(public_tokenizers.path("piece_bpe_32k.model"))
    return token_counts(table(spark, sf_dir, "documents"), tokenizer, work_dir(spark, "token_cache"))
