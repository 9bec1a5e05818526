"""Token counts through a digest cache.

The cache is a Parquet table (content digest, tokenizer-version digest, n_tokens) in the shared folder. Contents are
normalised (null is the empty text; nothing else, as the library counts every character), digested in the JVM and joined to the
cache; only distinct contents that it lacks are encoded, and their counts are appended. A lost executor repeats its part
of the append's job; Spark's committer leaves no half-written files, and counts read twice agree, so the cache stays right.

Copies of a content are one row a task before the join by digest, so no digest is hot there; the last join, from each row to its
count, is an outer one whose large partitions Spark splits. Repeated rows and contents and null ids each get their row; empty tables
and empty texts (0 tokens) are fine; a text of any length is encoded whole; extra columns are not read. The rows' digests stay on
the executors' disks for the result to read until the session ends or clears its cache.
"""

from __future__ import annotations

import hashlib
import uuid

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

CACHE_SCHEMA = "digest binary, version string, n_tokens long"


def version_of(vocabulary: str) -> str:
    """Digest of the vocabulary file and of the library's version."""
    import sentencepiece

    with open(public_tokenizers.path(vocabulary), "rb") as f:
        return hashlib.sha256(f.read() + sentencepiece.__version__.encode()).hexdigest()


def read_cache(spark: SparkSession, path: str, version: str) -> DataFrame:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], "digest binary, n_tokens long")
    kept = spark.read.schema(CACHE_SCHEMA).parquet(path).filter(F.col("version") == version)
    return kept.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def _counter(vocabulary: str):
    """Counts of (digest, text) rows; what repeats within a batch is encoded once."""

    def run(batches):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(vocabulary))
        for batch in batches:
            own = dict(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            digests, texts, counts = list(own), list(own.values()), []
            for a, b in common.slices([t.encode() for t in texts]):
                counts += [len(x) for x in model.encode(texts[a:b], num_threads=1)]
            yield pa.record_batch([pa.array(digests, pa.binary()), pa.array(counts, pa.int64())], names=["digest", "n_tokens"])
        common.freed()

    return run


def count_tokens(docs: DataFrame, cache_path: str, vocabulary: str = "piece_bpe_32k.model", limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row of docs; the counts come from the cache, which grows by what it lacked."""
    spark, version = docs.sparkSession, version_of(vocabulary)
    content = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), content.alias("text"), F.unhex(F.sha2(content, 256)).alias("digest"))
    digests = common.held(rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest"))
    # copies meet as one row a task before anything is shuffled by digest, and only one row a digest is
    distinct = digests.groupBy("digest").agg(F.min("doc_id").alias("of"))
    wanted = distinct.join(read_cache(spark, cache_path, version), "digest", "left_anti").withColumnRenamed("digest", "want")
    # one row of each missing content brings its text: id and digest together name it, so null or repeated ids match no more than that
    found = rows.join(wanted, (F.col("digest") == F.col("want")) & F.col("doc_id").eqNullSafe(F.col("of")))
    counted = found.select("digest", "text").mapInArrow(_counter(vocabulary), "digest binary, n_tokens long")
    counted = counted.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))  # a row that is repeated with its id comes once
    counted.select("digest", F.lit(version).alias("version"), "n_tokens").write.mode("append").parquet(cache_path)
    # a table of this batch's counts: joined as it is read, so that the rows of a hot digest can be split
    full = common.settled(distinct.select("digest").join(read_cache(spark, cache_path, version), "digest"), "counts")
    return digests.join(full, "digest", "left").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache of its own for each call, so that every distinct content is encoded here; removed when the driver ends."""
    path = f"{common.shared_dir(spark)}/llm/token-cache-{uuid.uuid4().hex}"
    common.remove_at_exit(spark, path)
    return count_tokens(common.read(spark, sf_dir, "documents"), path)
