"""Operator 5: token counts through a digest cache.

The cache is a table (content_digest, tokenizer_digest, n_tokens).  Documents
are digested in the JVM, one document stands for each digest that the cache
lacks, only those texts are encoded, and their counts are appended.  The counts
then join back by digest.  Content is normalised before it is digested only in
ways that the tokenizer itself makes meaningless.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from importlib.metadata import version

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import WordChunks, chunk_table, vocabulary
from .common import scratch_path, staged, table, text_rows

TOKENIZER, LIMIT = "word_bpe_49k.json", 2048
CACHE_SCHEMA = "content_digest binary, tokenizer_digest string, n_tokens long"


def normalised(text: Column, tokenizer: str) -> Column:
    """Content as the digest sees it: white space at the ends goes, where the tokenizer drops it anyway."""
    coder = chunk_table(vocabulary(tokenizer))
    return F.btrim(text, F.lit(" \t\n\r")) if isinstance(coder, WordChunks) and coder.parted else text


def tokenizer_digest(tokenizer: str) -> str:
    """Of the file and of the version of the library that reads it."""
    library = "sentencepiece" if vocabulary(tokenizer).endswith(".model") else "tokenizers"
    with open(vocabulary(tokenizer), "rb") as f:
        return hashlib.sha256(f.read() + f"{library} {version(library)}".encode()).hexdigest()


def count_tokens(docs: DataFrame, cache_path: str, tokenizer: str = TOKENIZER, limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of whole texts; ``cache_path`` is read if it holds a cache, then appended to.

    A null text is empty: 0 bytes, 0 tokens.  A repeated row returns once for
    each time it is there, a null ``doc_id`` stays null, an empty table gives
    an empty one, and other columns are dropped.  Runs that append to one cache
    at the same time may both count a text; such a digest is read once.
    """
    spark, path, coded_by = docs.sparkSession, vocabulary(tokenizer), tokenizer_digest(tokenizer)
    seen = text_rows(docs)
    digest = F.unhex(F.sha2(normalised(F.col("text"), tokenizer).cast("binary"), 256))
    rows = seen.select("doc_id", "text", digest.alias("content_digest"), F.octet_length("text").cast("long").alias("n_bytes"))
    known = staged(rows.select("doc_id", "content_digest", "n_bytes"), "token-digests")

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder, done = chunk_table(path), set()  # rows with one id and one text are in one partition
        for b in batches:
            b = b[[not (d in done or done.add(d)) for d in map(bytes, b["content_digest"])]]
            counts = [len(ids) // 4 for at in range(0, len(b), 512) for ids in coder.texts(b["text"].iloc[at : at + 512].tolist())]
            yield pd.DataFrame({"content_digest": b["content_digest"], "tokenizer_digest": coded_by, "n_tokens": counts})

    # One row of each digest that is not cached: with texts only where the row is the one that stands for its digest.
    first = known.groupBy("content_digest").agg(F.min("doc_id").alias("doc_id"))
    if cached(spark, cache_path):
        old = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("tokenizer_digest") == coded_by)
        first = first.join(old, "content_digest", "left_anti")
    missing = rows.select("doc_id", "text", "content_digest").hint("shuffle_hash").join(first.hint("shuffle_hash"), ["content_digest", "doc_id"], "left_semi")
    if not known.where(F.col("doc_id").isNull()).isEmpty():  # a join does not meet them; the texts are read again for them alone
        unnamed = first.where(F.col("doc_id").isNull()).hint("shuffle_hash")
        missing = missing.unionByName(rows.where(F.col("doc_id").isNull()).select("doc_id", "text", "content_digest").join(unnamed, "content_digest", "left_semi"))
    # Repeated rows of a split partition are encoded in two tasks; the cache takes one count for each digest.
    missing.mapInPandas(encode, CACHE_SCHEMA).dropDuplicates(["content_digest"]).write.mode("append").parquet(cache_path)
    counts = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("tokenizer_digest") == coded_by).dropDuplicates(["content_digest"])
    out = known.join(counts, "content_digest")
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def cached(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def op5_digest_cache_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts from an empty cache each time."""
    return count_tokens(table(spark, sf_dir, "documents"), scratch_path(spark, "token-cache"))
